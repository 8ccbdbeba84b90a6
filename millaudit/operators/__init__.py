"""Table operators: DataFrame(s) in, DataFrame out, lazily."""
