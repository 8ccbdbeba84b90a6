"""Sources and sinks: written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from millaudit.operators import lines, standards
from millaudit.plans import queries_lines as QL, queries_standards as QS
from millaudit.plans.derived import derived
from millaudit.plans.registry import query
from millaudit.plans.sql_parts import standard_number
from millaudit.session import table, work_folder
from millaudit.sources import reports, sinks
from millaudit.sources.keyed import KeyedTable
from millaudit.sources.store import VerdictStore


@query("s1_report_scan", f"WITH {QL._LINES} SELECT CAST(report_id AS VARCHAR) AS report_id, line_no, line FROM lines")
def report_scan(spark, sf):
    """Documents written as parsed pages, read back under the page schema."""
    path = work_folder(spark, "pages")
    QL.document_pages(spark, sf).withColumn("report_id", F.col("report_id").cast("string")).write.parquet(path)
    return lines.report_lines(reports.read_pages(spark, path)).select("report_id", "line_no", "line")


@query("s4_uploads", """SELECT CAST(o_orderkey AS VARCHAR) AS report_id, CASE WHEN o_orderkey % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS issue_count FROM orders""")
def uploads(spark, sf):
    """JSON uploads with broken rows: those become error rows, the batch goes on."""
    path = work_folder(spark, "uploads")
    key = F.col("o_orderkey").cast("string")
    good = F.to_json(F.struct(key.alias("report_id"), F.lit(1).alias("page"), F.array(F.lit("a")).alias("text_lines")))
    broken = F.concat(F.lit('{"report_id": "'), key, F.lit('", "page": '))
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, broken).otherwise(good).alias("value"))
    rows.write.option("compression", "none").format("text").save(path)
    pages, errors = reports.read_uploads(spark, path, "*.txt")
    key_of = F.regexp_extract("source_text", '"report_id": "([0-9]+)"', 1)
    return pages.select("report_id", F.lit("ok").alias("status"), F.lit(0).alias("issue_count")).unionByName(
        errors.select(key_of.alias("report_id"), "status", "issue_count")
    )


_FILES = """f AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'reports' WHEN 1 THEN 'labels' ELSE 'rules' END AS tab, lang || '_' || CAST(doc_id AS VARCHAR) || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' ELSE '.txt' END AS name, n_chars * 333 AS n, doc_id FROM documents),
  s AS (SELECT tab, name, CASE WHEN n / 1024 >= 1024 THEN printf('%.1f', n / 1024 / 1024) || ' MB' ELSE printf('%.0f', n / 1024) || ' KB' END AS size, '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') AS date FROM f WHERE (tab <> 'reports' OR name LIKE '%.pdf') AND (tab <> 'labels' OR name LIKE '%.PNG'))"""


def _catalogue(spark, sf):
    d = F.col("doc_id")
    tab = F.when(d % 3 == 0, "reports").when(d % 3 == 1, "labels").otherwise("rules")
    extension = F.when(d % 5 == 0, ".pdf").when(d % 5 == 1, ".PNG").otherwise(".txt")
    manifest = table(spark, sf, "documents").select(
        tab.alias("tab"), F.concat(F.lit("/files/"), F.col("lang"), F.lit("_"), d.cast("string"), extension).alias("path"),
        (F.col("n_chars") * 333).alias("length"), F.expr("timestamp'2024-01-01 08:00:00' + make_interval(0, 0, 0, cast(doc_id % 28 as int))").alias("modificationTime"),
    )
    return reports.catalogue(manifest)


@query("s5_catalogue", f"WITH {_FILES} SELECT * FROM s")
def catalogue(spark, sf):
    """File catalogue rows with size text and date, extensions filtered by tab."""
    return _catalogue(spark, sf)


@query("s5_a20_catalogue_counts", f"WITH {_FILES} SELECT tab, count(*) AS n FROM s GROUP BY 1")
def catalogue_counts(spark, sf):
    return reports.catalogue_counts(_catalogue(spark, sf))


@query("s6_catalogue_search", f"WITH {_FILES} SELECT * FROM s WHERE contains(lower(name), 'fr_1')")
def catalogue_search(spark, sf):
    """Files whose name holds a text, any case."""
    return reports.searched(_catalogue(spark, sf), "FR_1")


@query("s5_file_manifest", "SELECT source AS tab, CAST(sum(strlen(text) + 1) AS BIGINT) AS length FROM documents GROUP BY 1")
def file_manifest(spark, sf):
    """Documents written as text files, one folder per source; the manifest of those files, contents never read."""
    path = work_folder(spark, "files")
    texts = table(spark, sf, "documents").select("source", "text")
    texts.write.option("compression", "none").partitionBy("source").format("text").save(path)
    files = reports.file_manifest(spark, path, "rules").where("path LIKE '%.txt'")
    return files.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("tab")).agg(F.sum("length").alias("length"))


@query("s7_labelled_lines", """SELECT l_orderkey AS o, l_partkey AS p, CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_partkey AS VARCHAR) || '-2021' END AS gb_number, CASE WHEN l_suppkey % 4 <> 0 THEN '2021-5-' || CAST(1 + l_suppkey % 28 AS VARCHAR) END AS production_date, l_suppkey % 4 = 0 AS failed FROM lineitem""")
def labelled_lines(spark, sf):
    """Labelled text lines; a line lacking either field is an error."""
    line = F.concat(
        F.lit(" 国标编号： GB "), F.col("l_partkey").cast("string"), F.lit("-2021；"),
        F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("生产日期：2021-5-"), (1 + F.col("l_suppkey") % 28).cast("string"))).otherwise("日期不明"),
    )
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), line.alias("line"))
    return reports.labelled_lines(rows).select("o", "p", "gb_number", "production_date", F.col("error").isNotNull().alias("failed"))


def _requests(spark, sf):
    """JSON requests, one per order, written as text and parsed back."""
    k = F.col("o_orderkey")
    body = F.to_json(
        F.struct(
            F.struct(
                F.when(k % 3 != 0, F.concat(F.lit("食品"), k.cast("string"))).alias("food_name"),
                F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("production_date"),
                F.when(k % 7 != 0, F.array(F.lit("GB 2001-2016"), F.concat(F.lit("GB "), (2000 + k % 100).cast("string"), F.lit("-2016")))).alias("gb_codes"),
            ).alias("summary")
        )
    )
    parsed = F.from_json(body, reports.REQUEST_SCHEMA)
    return table(spark, sf, "orders").select(k.alias("request_id"), parsed["summary"].alias("summary"))


@query("s8_requests", """WITH o AS (SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)
  SELECT k AS request_id, CASE WHEN k % 3 = 0 THEN '未知食品' ELSE '食品' || CAST(k AS VARCHAR) END AS food_name, d AS production_date, 2 AS n_codes, 0 AS pos, 'GB 2001-2016' AS code FROM o
  UNION ALL SELECT k, CASE WHEN k % 3 = 0 THEN '未知食品' ELSE '食品' || CAST(k AS VARCHAR) END, d, 2, 1, 'GB ' || CAST(2000 + k % 100 AS VARCHAR) || '-2016' FROM o""")
def requests(spark, sf):
    """Requests to rows, one per cited code."""
    return reports.request_rows(_requests(spark, sf))[0]


@query("s8_request_errors", """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 5 = 0 THEN '缺少生产日期（production_date）' ELSE '缺少国标编号（gb_codes）' END AS error FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0""")
def request_errors(spark, sf):
    return reports.request_rows(_requests(spark, sf))[1]


@query("s9_query_config", """SELECT p_partkey AS k, p_type AS category, p_name AS item, 'q ' || p_brand AS query, CASE WHEN p_partkey % 2 = 0 THEN 'GB ' || CAST(p_size AS VARCHAR) ELSE '' END AS standard FROM part""")
def query_config(spark, sf):
    """Nested configuration texts to rows."""
    text = F.concat(
        F.lit('{"'), F.col("p_type"), F.lit('": {"'), F.col("p_name"), F.lit('": {"query": "q '), F.col("p_brand"), F.lit('"'),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(', "standard": "GB '), F.col("p_size").cast("string"), F.lit('"'))).otherwise(""), F.lit("}}}"),
    )
    return reports.query_config(table(spark, sf, "part").select(F.col("p_partkey").alias("k"), text.alias("value")))


@query("s10_artifacts", "SELECT replace(code, '/', '-') AS safe_gb, code AS gb_number, count(*) AS n FROM d_cited GROUP BY 1, 2")
def artifacts(spark, sf):
    """One JSON folder per cited standard, read back."""
    path = work_folder(spark, "artifacts")
    records = derived(spark, sf, "d_cited").groupBy(F.col("code").alias("gb_number")).agg(F.count("*").alias("n"))
    sinks.write_artifacts(records, path)
    return spark.read.schema("gb_number string, n long, safe_gb string").json(path).select("safe_gb", "gb_number", "n")


@query("s11_verdict_store", "SELECT code, production_date, CAST(passed AS BOOLEAN) AS passed, status, CAST(ts + 1 AS DOUBLE) AS ts FROM d_store")
def verdict_store(spark, sf):
    """Verdict store written twice; the later snapshot counts."""
    store = VerdictStore(spark, work_folder(spark, "store"), "code string, production_date string, passed boolean, status string, ts double")
    store.write(QS._store(spark, sf))
    store.write(store.read().withColumn("ts", F.col("ts") + 1))
    return store.read()


@query("s12_verdict_sections", f"""WITH q AS (SELECT c.report_id, c.code, r.production_date, row_number() OVER (PARTITION BY c.report_id ORDER BY c.pos) AS no, count(*) OVER (PARTITION BY c.report_id) AS n FROM d_cited c JOIN d_report r USING (report_id))
  SELECT '食品名称：食品' || CAST(report_id AS VARCHAR) AS head, count(*) AS n FROM q WHERE no = 1 GROUP BY 1 UNION ALL SELECT '【' || CAST(no AS VARCHAR) || '/' || CAST(n AS VARCHAR) || '】校验国标：' || code || ' (GB ' || {standard_number('code')} || ')', count(*) FROM q GROUP BY 1""")
def verdict_sections(spark, sf):
    """Text report of every report's codes, written and read back: its head lines and numbered section titles."""
    path = work_folder(spark, "verdict-text")
    cited = QS._cited_with_dates(spark, sf)
    judged = standards.verdicts(cited.select("code", "production_date").distinct(), derived(spark, sf, "d_standard"))
    by_report = Window.partitionBy("report_id")
    # A report cites few standards, so one report is one small window.
    rows = cited.join(judged, ["code", "production_date"]).select(
        F.col("report_id").alias("request_id"), F.concat(F.lit("食品"), F.col("report_id").cast("string")).alias("food_name"),
        (F.row_number().over(by_report.orderBy("pos")) - 1).alias("pos"), F.count("*").over(by_report).alias("n_codes"), "code", "production_date",
        *standards.VERDICT_FIELDS,
    )
    sinks.write_verdict_text(sinks.verdict_sections(rows), path)
    lines_ = spark.read.text(path).where("value LIKE '食品名称：%' OR value LIKE '【%'")
    return lines_.groupBy(F.col("value").alias("head")).agg(F.count("*").alias("n"))


@query("s13_result_json", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY part, item, value) AS no FROM d_item) SELECT report_id, (no - 1) // 3 AS part, count(*) AS n, min(item) AS first_item FROM n GROUP BY 1, 2")
def result_json(spark, sf):
    """Result lists as JSON in bounded parts, read back."""
    path = work_folder(spark, "results")
    items = derived(spark, sf, "d_item").select("report_id", F.col("part").alias("pos"), "item", "value")
    summary = derived(spark, sf, "d_report").select("report_id", "food_name")
    sinks.write_results(summary, {"items": items}, path, 3)
    back = spark.read.schema("report_id long, part long, entries array<string>").json(f"{path}/items")
    each = back.select("report_id", "part", F.explode("entries").alias("e")).withColumn("item", F.get_json_object("e", "$.item"))
    return each.groupBy("report_id", "part").agg(F.count("*").alias("n"), F.min("item").alias("first_item"))


@query("s5_catalogue_places", f"WITH {_FILES} SELECT *, row_number() OVER (PARTITION BY tab ORDER BY name) AS place, count(*) OVER (PARTITION BY tab) AS n FROM s")
def catalogue_places(spark, sf):
    """Catalogue in name order: each file's place in its tab beside the tab's number of files."""
    return reports.in_name_order(_catalogue(spark, sf))


@query("s6_search_counts", f"WITH {_FILES} SELECT tab, count(*) AS total, count(*) FILTER (contains(lower(name), 'fr_1')) AS hits FROM s GROUP BY 1")
def search_counts(spark, sf):
    """Files and hits of a name search per tab."""
    return reports.search_counts(_catalogue(spark, sf), "FR_1")


@query("s7_labelled_files", """SELECT CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_partkey AS VARCHAR) || '-2021' END AS gb_number, CASE WHEN l_suppkey % 4 <> 0 THEN '2021-5-' || CAST(1 + l_suppkey % 28 AS VARCHAR) END AS production_date, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def labelled_files(spark, sf):
    """Labelled lines written as text files and read from them."""
    path = work_folder(spark, "labelled")
    line = F.concat(
        F.lit(" 国标编号： GB "), F.col("l_partkey").cast("string"), F.lit("-2021；"),
        F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("生产日期：2021-5-"), (1 + F.col("l_suppkey") % 28).cast("string"))).otherwise("日期不明"),
    )
    table(spark, sf, "lineitem").select(line.alias("value")).write.text(path)
    return reports.read_labelled_lines(spark, path).groupBy("gb_number", "production_date").agg(F.count("*").alias("n"))


@query("s9_config_files", """SELECT DISTINCT p_type || '/' || p_brand AS category, p_name AS item, 'q ' || p_brand AS query, 'GB ' || CAST(min(p_size) AS VARCHAR) AS standard FROM part GROUP BY p_type, p_brand, p_name""")
def config_files(spark, sf):
    """Configuration files, one nested text per category, written and read from disk."""
    path = work_folder(spark, "config")
    item = F.concat(F.lit('"'), F.col("p_name"), F.lit('": {"query": "q '), F.col("p_brand"), F.lit('", "standard": "GB '), F.col("size").cast("string"), F.lit('"}'))
    items = table(spark, sf, "part").groupBy("p_type", "p_brand", "p_name").agg(F.min("p_size").alias("size"))
    # A configuration text names the items of one category: as many as the rule book gives it.
    texts = items.groupBy("p_type", "p_brand").agg(F.concat(
        F.lit('{"'), F.col("p_type"), F.lit("/"), F.col("p_brand"), F.lit('": {'), F.array_join(F.array_sort(F.collect_list(item)), ", "), F.lit("}}")).alias("value"))
    texts.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return reports.read_query_config(spark, path)


@query("s11_keyed_store", """SELECT code, production_date, CAST(passed AS BOOLEAN) AS passed, CASE WHEN code LIKE '%1-2016' THEN 'again' ELSE status END AS status, CAST(ts AS DOUBLE) AS ts FROM d_store WHERE code NOT LIKE '%2-2016'""")
def keyed_store(spark, sf):
    """Verdict store as a log: written, some keys written again, some taken out, compacted, cleared of old files and read."""
    store = KeyedTable(spark, work_folder(spark, "keyed-store"), ["code", "production_date"], "code string, production_date string, passed boolean, status string, ts double", 8)
    rows = QS._store(spark, sf)
    store.write(rows, 0)
    store.write(rows.where("code LIKE '%1-2016'").withColumn("status", F.lit("again")), 1, gone=rows.where("code LIKE '%2-2016'"))
    store.compact(2)
    store.vacuum(keep=1)
    return store.read()
