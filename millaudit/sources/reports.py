"""Readers: parsed reports, requests, labelled lines, query configuration, file catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millaudit.functions.text import strip
from millaudit.operators.common import block_positions

PAGE_SCHEMA = "report_id string, page int, text_lines array<string>, tables array<array<array<string>>>"
REQUEST_SCHEMA = "summary struct<food_name:string,production_date:string,gb_codes:array<string>>"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Already parsed report pages (parquet, json or orc) under one fixed schema, lines stripped."""
    rows = spark.read.format(fmt).schema(PAGE_SCHEMA).load(path)
    return rows.withColumn("text_lines", F.filter(F.transform("text_lines", strip), lambda x: x != ""))


def read_uploads(spark: SparkSession, path: str, suffix: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(pages, error rows) of uploaded files: other suffixes are skipped, a broken row becomes an error row."""
    schema = PAGE_SCHEMA + ", _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("pathGlobFilter", suffix).json(path)
    rows = rows.withColumn("filename", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    broken = F.col("_corrupt_record").isNotNull() | F.col("report_id").isNull()
    errors = rows.where(broken).select(
        "filename", F.col("_corrupt_record").alias("source_text"), F.array(F.lit("处理失败")).alias("issues"),
        F.lit(1).alias("issue_count"), F.lit("error").alias("status"),
    )
    return rows.where(~broken).drop("_corrupt_record"), errors


def labelled_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """Code and date of labelled lines; error is set where one of the two is missing. Blank lines are gone."""
    code = F.regexp_extract(text, r"国标编号：\s*GB\s*(\d+-\d{4})", 1)
    day = F.regexp_extract(text, r"生产日期：\s*(\d{4}-\d{1,2}-\d{1,2})", 1)
    good = (code != "") & (day != "")
    rows = lines.where(strip(text) != "")
    return (
        rows.withColumn("gb_number", F.when(good, code))
        .withColumn("gb_full", F.when(good, F.concat(F.lit("GB "), code)))
        .withColumn("production_date", F.when(good, day))
        .withColumn("error", F.when(~good, F.concat(F.lit("Unrecognized line format: "), strip(text))))
    )


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    return labelled_lines(spark.read.text(path), "value")


def request_rows(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of requests with a summary: one row per cited code, the food name has a default.

    requests: (request_id, summary). Missing date or codes make an error.
    """
    day, cited = F.col("summary.production_date"), F.col("summary.gb_codes")
    no_day = F.coalesce(day, F.lit("")) == ""
    no_codes = F.coalesce(F.size(cited), F.lit(0)) <= 0
    error = F.when(no_day, "缺少生产日期（production_date）").when(no_codes, "缺少国标编号（gb_codes）")
    marked = requests.withColumn("error", error)
    rows = marked.where("error IS NULL").select(
        "request_id", F.coalesce("summary.food_name", F.lit("未知食品")).alias("food_name"), day.alias("production_date"),
        F.size(cited).alias("n_codes"), F.posexplode(cited).alias("pos", "code"),
    )
    return rows, marked.where("error IS NOT NULL").select("request_id", "error")


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema(REQUEST_SCHEMA).option("multiLine", True).json(path)
    return request_rows(rows.withColumn("request_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))


def query_config(texts: DataFrame, text: str = "value") -> DataFrame:
    """Nested configuration category -> item -> {query, standard} as rows."""
    parsed = F.from_json(text, "map<string,map<string,struct<query:string,standard:string>>>")
    keep = [c for c in texts.columns if c != text]
    by_category = texts.select(*keep, F.explode(parsed).alias("category", "items"))
    return by_category.select(*keep, "category", F.explode("items").alias("item", "q")).select(
        *keep, "category", "item", "q.query", F.coalesce("q.standard", F.lit("")).alias("standard")
    )


def read_query_config(spark: SparkSession, path: str) -> DataFrame:
    return query_config(spark.read.option("wholetext", True).text(path))


# --- file catalogue -----------------------------------------------------------------------------

# Extensions each catalogue tab shows; a tab without an entry shows all files.
TAB_EXTENSIONS = {"reports": [".pdf"], "labels": [".jpg", ".jpeg", ".png", ".webp", ".bmp"]}


def file_manifest(spark: SparkSession, path: str, tab: str) -> DataFrame:
    """File metadata below a path; contents are never read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.lit(tab).alias("tab"), "path", "length", "modificationTime")


def catalogue(manifest: DataFrame) -> DataFrame:
    """Catalogue rows of a manifest (tab, path, length, modificationTime): name, size text and date."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    shown = F.lit(True)
    for tab, extensions in TAB_EXTENSIONS.items():
        shown = shown & ((F.col("tab") != tab) | extension.isin(extensions))
    kilobytes = F.col("length") / 1024
    size = F.when(
        kilobytes >= 1024, F.concat(F.format_string("%.1f", F.bround(kilobytes / 1024, 1)), F.lit(" MB"))
    ).otherwise(F.concat(F.format_string("%.0f", F.bround(kilobytes, 0)), F.lit(" KB")))
    return manifest.where(shown).select(
        "tab", name.alias("name"), size.alias("size"), F.date_format("modificationTime", "yyyy-MM-dd").alias("date")
    )


def catalogue_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("tab").agg(F.count("*").alias("n"))


def in_name_order(files: DataFrame, block: int = 6) -> DataFrame:
    """Catalogue rows with their place in the name order of their tab and the tab's number of files.

    Places are counted by blocks of names with equal beginnings, so that no tab is sorted in one task.
    """
    beginnings = files.withColumn("_begin", F.substring("name", 1, block))
    placed = block_positions(beginnings, ["tab"], ["_begin"], ["name"], "place").drop("_begin")
    return placed.join(catalogue_counts(files), "tab")


def search_counts(files: DataFrame, text: str) -> DataFrame:
    """Per tab how many files there are in all and how many hold the text in their name."""
    return files.groupBy("tab").agg(F.count("*").alias("total"), F.count_if(F.contains(F.lower("name"), F.lit(text.lower()))).alias("hits"))


def searched(files: DataFrame, text: str) -> DataFrame:
    """Files whose name holds the text, in any case."""
    return files.where(F.contains(F.lower("name"), F.lit(text.lower())))
