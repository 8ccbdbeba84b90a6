"""Small shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_k(rows: DataFrame, keys, order, k: int) -> DataFrame:
    """The first k rows per key, with their rank.

    The rank filter makes Spark cut every map task to k rows per key before the shuffle, so a hot key
    never gathers more than k rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_row(rows: DataFrame, keys, order) -> DataFrame:
    return first_k(rows, keys, order, 1).drop("rank")


def first_names(rows: DataFrame, key: str, name: str, order, k: int) -> DataFrame:
    """(key, names): the first k names in order joined by ', '; the list never holds more than k."""
    few = first_k(rows, [key], order, k)
    named = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(name).alias("n")))), lambda x: x["n"])
    return few.groupBy(key).agg(F.array_join(named, ", ").alias("names"))


def block_running_sum(rows: DataFrame, keys, block, order, value: str, out: str) -> DataFrame:
    """Running sum per key in two steps, so that no key runs through one task.

    Inside (key, block) the sum is a window; block totals (one row per block) are summed over the key and
    added. ``block`` must be a function of the order column that never decreases along it.
    """
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy(*keys, block).agg(F.sum(value).alias("_t"))
    over_blocks = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(*keys, block, F.coalesce(F.sum("_t").over(over_blocks), F.lit(0)).alias("_before"))
    return (
        rows.withColumn("_in", F.sum(value).over(inner))
        .join(before, [*keys, block])
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_in", "_before")
    )


def block_positions(rows: DataFrame, keys, blocks, order, out: str) -> DataFrame:
    """Positions 1, 2, … per key in two steps, so that no key is ordered in one task.

    Inside (key, blocks) rows are numbered; block counts give the offsets. ``blocks`` are columns whose
    order agrees with ``order``, fine enough that one block fits a task.
    """
    inner = Window.partitionBy(*keys, *blocks).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, *blocks).agg(F.count("*").alias("_n"))
    offsets = counts.select(*keys, *blocks, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        rows.withColumn("_in", F.row_number().over(inner))
        .join(offsets, [*keys, *blocks])
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_in", "_before")
    )
