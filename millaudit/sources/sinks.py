"""Writers: per-standard JSON, text reports, result JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millaudit.functions.text import safe_file_name
from millaudit.operators import standards
from millaudit.operators.common import block_positions

PART_ROWS = 1000
FILES_PER_STANDARD = 8


def write_artifacts(records: DataFrame, path: str) -> None:
    """One JSON folder per standard, its name safe for file systems."""
    named = records.withColumn("safe_gb", safe_file_name("gb_number"))
    # Rows of a standard meet in few tasks: a folder holds few files, and a frequent standard is spread.
    named.repartition("safe_gb", F.pmod(F.xxhash64(*records.columns), F.lit(FILES_PER_STANDARD))).write.mode("overwrite").partitionBy("safe_gb").json(path)


def verdict_sections(verdicts: DataFrame) -> DataFrame:
    """Text sections of a standards check: a head and one numbered section per code.

    verdicts: (request_id, food_name, production_date, pos, n_codes, code, …verdict fields).
    """
    line = "=" * 80
    head = F.concat(
        F.lit("食品名称："), F.col("food_name"), F.lit("\n生产日期："), F.col("production_date"), F.lit("\n待校验国标数量："),
        F.col("n_codes").cast("string"), F.lit(f"\n{line}\n"),
    )
    from millaudit.functions.codes import standard_number

    title = F.concat(
        F.lit("【"), (F.col("pos") + 1).cast("string"), F.lit("/"), F.col("n_codes").cast("string"), F.lit("】校验国标："),
        F.col("code"), F.lit(" (GB "), standard_number("code"), F.lit(")\n" + "-" * 80 + "\n"),
    )
    rows = standards.verdict_reports(verdicts)
    sections = rows.select("request_id", (F.col("pos") + 1).alias("section"), F.concat(title, F.col("report_text"), F.lit("\n\n")).alias("text"))
    heads = rows.where("pos = 0").select("request_id", F.lit(0).alias("section"), head.alias("text"))
    return heads.unionByName(sections)


def write_verdict_text(sections: DataFrame, path: str) -> None:
    """Text files in request order, sorted inside and across files; nothing is gathered in one task."""
    sections.orderBy("request_id", "section").select("text").write.mode("overwrite").text(path)


def nested_parts(rows: DataFrame, key: str, name: str, place: str, size: int) -> DataFrame:
    """Rows of a list as JSON-ready parts of at most ``size`` rows: (key, list, part, entries), in order of a long place."""
    rest = [c for c in rows.columns if c != key]
    numbered = block_positions(
        rows.withColumn("_j", F.to_json(F.struct(*rest))).withColumn("_b", F.floor(F.col(place) / size)), [key], ["_b"], [place, "_j"], "_n"
    )
    return (
        numbered.groupBy(key, F.floor((F.col("_n") - 1) / size).cast("long").alias("part"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_j"))), lambda x: x["_j"]).alias("entries"))
        .select(key, F.lit(name).alias("list"), "part", "entries")
    )


def write_results(summary: DataFrame, lists: dict[str, DataFrame], path: str, part_rows: int = PART_ROWS) -> None:
    """Result JSON: one line per report summary and one per list part, so that no report is ever one value.

    lists: name -> (report_id, pos, …) with pos a long; a part holds at most ``part_rows`` rows.
    """
    summary.write.mode("overwrite").json(f"{path}/summary")
    for name, rows in lists.items():
        nested_parts(rows, "report_id", name, "pos", part_rows).write.mode("overwrite").json(f"{path}/{name}")
