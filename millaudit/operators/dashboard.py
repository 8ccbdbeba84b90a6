"""Dashboard aggregates over audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def category_shares(rows: DataFrame, category: str) -> DataFrame:
    """Count and share of the total per category; the total is one row, joined to every category."""
    counts = rows.groupBy(category).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total"))


def ranking(rows: DataFrame, keys, most: int = 5, marked: int = 3) -> DataFrame:
    """The most frequent keys with count, bar relative to the first and a mark for the first three."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), *[F.asc(k) for k in keys]).limit(most)
    order = Window.orderBy(F.desc("n"), *[F.asc(k) for k in keys])
    return (
        top.withColumn("rank", F.row_number().over(order))
        .withColumn("bar", F.col("n") / F.max("n").over(order))
        .withColumn("marked", F.col("rank") <= marked)
    )


def monthly_counts(rows: DataFrame, day: str) -> DataFrame:
    """Count per month with a flag for the (first) month of the peak."""
    months = rows.groupBy(F.date_trunc("month", F.col(day)).cast("date").alias("month")).agg(F.count("*").alias("n"))
    peak = months.agg(F.max(F.struct("n", (-F.unix_date("month")).alias("m"))).alias("p"))
    one = months.withColumn("_one", F.lit(1)).join(
        peak.select(F.lit(1).alias("_one"), (-F.col("p.m")).alias("peak_day")), "_one"
    )
    return one.withColumn("is_peak", F.unix_date("month") == F.col("peak_day")).select("month", "n", "is_peak")


def period_figures(facts: DataFrame, day: str, measures: dict[str, str]) -> DataFrame:
    """Distinct counts per month with the change to the month before, one row per (month, measure).

    measures: figure name -> column whose distinct values are counted.
    """
    month = F.date_trunc("month", F.col(day)).cast("date").alias("month")
    long = facts.select(
        month,
        F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.col(c).cast("string").alias("v")) for k, c in measures.items()])).alias("m"),
    ).select("month", "m.figure", "m.v")
    counts = long.groupBy("month", "figure").agg(F.count_distinct("v").alias("n"))
    before = F.lag("n").over(Window.partitionBy("figure").orderBy("month"))
    return counts.withColumn("previous", before).withColumn(
        "change", (F.col("n") - F.col("previous")) / F.nullif(F.col("previous"), F.lit(0))
    )
