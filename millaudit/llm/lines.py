"""Line dedup by distinct-site spread, in DataFrame functions only.

HyperLogLog sketches of sites are built per line hash and merged by aggregation. Lines whose estimate lies near the threshold get exact
distinct counts. Lines found on enough sites are boilerplate: they stay once, where they first occur, and go
everywhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millaudit.llm.common import written

#: Sites that make a line boilerplate, and the shortest line looked at, in code points after trimming.
SITES = 10
MIN_CHARS = 20
#: Sketches of 2^LOG_REGISTERS registers, and their relative standard error.
LOG_REGISTERS = 8
ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
#: Estimates so many standard errors around the threshold are counted exactly.
ERRORS = 4
_KEY = ["h1", "h2", "length"]


def _trimmed(line):
    return F.trim(line)


def document_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, length, doc_id, text_key, pos, source) of every line of at least ``min_chars`` code points."""
    exploded = documents.where("text is not null").select("doc_id", "source", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = _trimmed("raw")
    return exploded.where(F.length(line) >= min_chars).select(F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"), F.length(line).alias("length"), "doc_id", "text_key", "pos", "source")


def boilerplate(lines: DataFrame, sites: int = SITES, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(h1, h2, length, first): lines on at least ``sites`` distinct sites, with their first place among documents that have an id."""
    error = 1.04 / 2 ** (log_registers / 2)
    low, high = sites * (1 - ERRORS * error), sites * (1 + ERRORS * error)
    place = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key", "pos"))
    spread = lines.groupBy(*_KEY).agg(F.hll_sketch_agg("source", F.lit(log_registers)).alias("sketch"), F.min(place).alias("first"))
    estimated = written(spread.withColumn("spread", F.hll_sketch_estimate("sketch")).drop("sketch").where(F.col("spread") >= low), "spread")
    near = estimated.where(F.col("spread") <= high)
    exact = (
        lines.join(near.select(*_KEY), _KEY, "left_semi").groupBy(*_KEY, "source").agg(F.lit(1).alias("one"))
        .where("source is not null").groupBy(*_KEY).agg(F.count("*").alias("exact")).where(F.col("exact") >= sites)
    )
    return estimated.where(F.col("spread") > high).drop("spread").unionByName(near.join(exact, _KEY).select(*_KEY, "first"))


def removals(documents: DataFrame, sites: int = SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, positions) of the lines to remove."""
    lines = document_lines(documents, min_chars)
    found = lines.join(boilerplate(lines, sites), _KEY).where(F.struct("doc_id", "text_key", "pos") != F.col("first"))
    return found.where("doc_id is not null").groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("positions"))


def without_boilerplate(documents: DataFrame, sites: int = SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents, their text without boilerplate lines, with n_lines and n_removed.

    Lines are compared trimmed of spaces; the lines that stay keep their order and spelling. A null text stays null and has no lines; an empty
    one has one empty line. A null source is no site. Rows without doc_id count for the spread but keep all their lines. Rows of one
    doc_id with different texts are told apart; equal rows lose the same lines. Columns n_lines and n_removed of the input are replaced.
    """
    documents = documents.drop("n_lines", "n_removed")
    out = documents.columns
    # Removals grow with the documents, so they are never broadcast.
    gone = written(removals(documents, sites, min_chars), "removals").withColumnsRenamed({"doc_id": "__gone_doc", "text_key": "__gone_text", "positions": "__gone"})
    joined = documents.join(gone.hint("merge"), (F.col("doc_id") == F.col("__gone_doc")) & (F.xxhash64("text") == F.col("__gone_text")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__gone", i)), "\n")
    return joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint"),
            "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint"),
            "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept),
        }
    ).select(*out, "n_lines", "n_removed")


def deduplicated(documents: DataFrame, sites: int = SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with their own columns: boilerplate gone, n_chars following the text; a document of nothing but boilerplate goes."""
    cleaned = without_boilerplate(documents, sites, min_chars).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in documents.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType))
    return cleaned.select(*documents.columns)
