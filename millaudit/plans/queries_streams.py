"""Streams over the given tables, run until the available files are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from millaudit.operators import limits
from millaudit.plans import audit, queries_limits as QL, queries_lines, queries_standards as QS
from millaudit.plans.derived import DERIVED, derived
from millaudit.plans.registry import CHECKS, query
from millaudit.session import table, work_folder
from millaudit.sources.store import VerdictStore
from millaudit.streaming import jobs, reports, reuse

STORE_SCHEMA = (
    "code string, production_date string, passed boolean, status string, status_text string, publish_date string, "
    "implement_date string, abolish_date string, detail_url string, reasons array<string>, error string, ts double"
)


def _stream_in_order(spark, rows, order, name, files=4):
    """Rows as a stream of files in the order of a column, one a micro-batch; files are written one after another, as they are read by their age."""
    path = work_folder(spark, f"arriving-{name}")
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    step = max(1, (hi - lo) // files + 1) if lo is not None else 1
    for k in range(files):
        at = F.floor((F.col(order) - F.lit(lo or 0)) / step)
        rows.where(at == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _stream(spark, sf, name):
    """A given table as a stream of several files, one a micro-batch; the same keys come in several of them."""
    rows, path = table(spark, sf, name), work_folder(spark, f"arriving-{name}")
    rows.repartition(3).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("x1_report_arrivals", QL._DECIDED + "SELECT report_id, line, part, supp, item, value, lim AS \"limit\", limit_rule, limit_issue FROM d")
def report_arrivals(spark, sf):
    """Items arriving as a stream, judged against their limits; equals the batch result."""
    out, checkpoint = work_folder(spark, "arrivals"), work_folder(spark, "arrivals-state")
    stream = spark.sql(DERIVED["d_item"], lineitem=_stream(spark, sf, "lineitem"), part=table(spark, sf, "part")).select(
        "report_id", "line", "part", "supp", "item", "value", F.col("standard").alias("limit"), F.lit("").alias("report_limit")
    )
    jobs.run_arrivals(stream, limits.limit_decisions, out, checkpoint).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select("report_id", "line", "part", "supp", "item", "value", "limit", "limit_rule", "limit_issue")


def audited_stream(spark, sf):
    """All report pages in two batches, the first with an older version of every third report: the merged tables of what they say."""
    pages = queries_lines.report_pages(spark, sf)
    o = F.col("report_id")
    now = pages.select("report_id", F.lit(1).alias("version"), "page", "text_lines", "tables", (o % 2).alias("batch"))
    old = pages.where(o % 3 == 0).select(
        "report_id", F.lit(0).alias("version"), "page", F.array(F.lit("样品名称：旧"), F.lit("检验结论：符合GB 1-1999要求")).alias("text_lines"), "tables", F.lit(0).cast("long").alias("batch")
    )
    both, path = now.unionByName(old), work_folder(spark, "arriving-pages")
    for k in (0, 1):
        both.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(both.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path)
    registry = derived(spark, sf, "d_standard")
    kept = reports.AuditedReports(spark, work_folder(spark, "audited"), ("summary", "cited", "items", "verdicts"), buckets=8)
    reports.run_audits(stream, lambda some: audit.read_reports(spark, some, registry), kept, work_folder(spark, "audited-state")).awaitTermination()
    return kept


@query("x1_audited_reports", """SELECT report_id, 'GB ' || CAST(2000 + report_id % 50 AS VARCHAR) || '-2021' AS code FROM d_report UNION ALL SELECT report_id, 'GB/T ' || CAST(5000 + report_id % 30 AS VARCHAR) FROM d_report
  UNION ALL SELECT report_id, 'GB 77-2001' FROM d_report WHERE report_id % 4 = 0""")
def audited_reports(spark, sf):
    """Codes that arriving reports cite, read, judged and merged by report: no code of a replaced version, none twice."""
    return audited_stream(spark, sf).read("cited").select("report_id", "code")


@query("x2_verdict_reuse")
def verdict_reuse(spark, sf):
    """Requests arriving in micro-batches, answered from the verdict store the batches before left; equals the batch result."""
    out, checkpoint, folder = (work_folder(spark, n) for n in ["verdicts", "verdicts-state", "verdict-store"])
    store = VerdictStore(spark, folder, STORE_SCHEMA)
    old = QS._store(spark, sf).select(
        "code", "production_date", "passed", "status", F.lit("").alias("status_text"),
        *[F.lit(None).cast("string").alias(c) for c in ["publish_date", "implement_date", "abolish_date", "detail_url"]],
        F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("string").alias("error"), "ts",
    )
    store.write(old)
    requests = spark.sql(DERIVED["d_request"], events=_stream(spark, sf, "events"))
    query_ = jobs.run_verdict_reuse(
        spark, requests, derived(spark, sf, "d_standard"), store, lambda batch: QS._NOW + 60.0 * batch, out, checkpoint
    )
    query_.awaitTermination()
    return spark.read.parquet(out).select("code", "production_date", "passed", "status").distinct()


CHECKS["x2_verdict_reuse"] = CHECKS["e2_validate_standards"]


_STORE_OFFSET = 3980800  # brings the derived store to the day before the first request

_REUSED = """WITH RECURSIVE """ + QS._JUDGED.replace(
    "SELECT DISTINCT c.code, r.production_date FROM d_cited c JOIN d_report r USING (report_id)", "SELECT DISTINCT code, production_date FROM d_request"
) + f""",
store AS (SELECT code, production_date, max(CAST((ts + {_STORE_OFFSET}) * 1000000 AS BIGINT)) AS since, max_by(passed, ts) AS passed, max_by(status, ts) AS status FROM d_store GROUP BY ALL),
asked AS (SELECT code, production_date, epoch_us(asked) AS t, row_number() OVER (PARTITION BY code, production_date ORDER BY asked) AS n FROM d_request),
walk AS (
    SELECT k.code, k.production_date, 0::BIGINT AS n, s.since, s.passed, s.status FROM (SELECT DISTINCT code, production_date FROM d_request) k LEFT JOIN store s USING (code, production_date)
    UNION ALL
    SELECT w.code, w.production_date, x.n, CASE WHEN kept THEN w.since ELSE x.t END, CASE WHEN kept THEN w.passed ELSE v.passed END, CASE WHEN kept THEN w.status ELSE v.status END
    FROM (SELECT *, n + 1 AS next FROM walk) w JOIN asked x ON x.code = w.code AND x.production_date = w.production_date AND x.n = w.next
    JOIN verdict v ON v.code = w.code AND v.production_date = w.production_date,
    LATERAL (SELECT coalesce(x.t - w.since < CASE WHEN w.status = 'error' THEN 3600000000 ELSE 86400000000 END, false) AS kept))
SELECT code, production_date, since AS judged_at, passed, status, count(*) AS answered FROM walk WHERE n > 0 GROUP BY ALL"""


@query("x2_verdict_state", _REUSED)
def verdict_state(spark, sf):
    """Requests in the order they were asked, answered from keyed state that begins with a store: which verdict answered how many."""
    out, checkpoint = work_folder(spark, "reuse"), work_folder(spark, "reuse-state")
    requests = derived(spark, sf, "d_request").select("code", "production_date", F.unix_micros(F.col("asked").cast("timestamp")).alias("asked"))
    old = QS._store(spark, sf).select(
        "code", "production_date", ((F.col("ts") + _STORE_OFFSET) * reuse.SECOND).cast("bigint").alias("judged_at"), "passed", "status",
        *[F.lit("").alias("status_text")], *[F.lit(None).cast("string").alias(c) for c in ["publish_date", "implement_date", "abolish_date", "detail_url"]],
        F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("string").alias("error"),
    )
    stream = _stream_in_order(spark, requests, "asked", "requests")
    reuse.run_reuse(stream, derived(spark, sf, "d_standard"), old, out, checkpoint).awaitTermination()
    answers = spark.read.parquet(out)
    return answers.groupBy("code", "production_date", "judged_at", "passed", "status").agg(F.sum("answered").alias("answered"))
