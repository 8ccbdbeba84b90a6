"""Report results, review view, dashboard, and the composite audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from millaudit.functions import codes as C, numbers as N
from millaudit.operators import compliance, dashboard, lines, review, standards
from millaudit.plans import audit as jobs, queries_items as Q, queries_lines as QL, queries_standards as QS
from millaudit.plans.derived import derived
from millaudit.plans.registry import query
from millaudit.session import table

# --- report issues ------------------------------------------------------------------------------

_FAILED = f"""WITH {QS._JUDGED}, f AS (SELECT c.report_id, c.code, c.pos % 2 = 0 AS cited, v.status_text FROM d_cited c JOIN d_report r USING (report_id) JOIN verdict v ON v.code = c.code AND v.production_date = r.production_date WHERE NOT v.passed),
  i AS (SELECT report_id, 1 AS section, '缺少食品名称' AS issue FROM d_report WHERE food_name = '' UNION ALL SELECT report_id, 2, CASE WHEN cited THEN '国标验证失败: ' || code ELSE '检测方法标准 ' || code || ' 无效 (' || status_text || ')' END FROM f
   UNION ALL SELECT report_id, 3, '[合规性] 缺少必检项目: ' || food_name FROM d_report WHERE report_id % 3 = 0)"""


def _issues(spark, sf):
    reports = derived(spark, sf, "d_report")
    fields = lines.field_issues(reports.select("report_id", "food_name", "production_date", F.lit(1).alias("n_codes"), F.lit(1).alias("n_items")))
    cited = QS._cited_with_dates(spark, sf).withColumn("role", F.when(F.col("pos") % 2 == 0, "cited").otherwise("method"))
    failed = standards.report_verdicts(cited, QS._judged(spark, sf)).where("NOT passed")
    status = reports.select(
        "report_id", F.when(F.col("report_id") % 3 == 0, "fail").otherwise("warning").alias("status"),
        F.array(F.concat(F.lit("缺少必检项目: "), F.col("food_name"))).alias("issues"),
    )
    return compliance.report_issues(fields, failed, status)


@query("a1_report_issues", _FAILED + " SELECT report_id, section, issue FROM i")
def report_issues(spark, sf):
    """All issues of all reports."""
    return _issues(spark, sf).drop("pos")


@query("a1_report_results", _FAILED + ", c AS (SELECT report_id, count(*) AS n FROM i GROUP BY 1) SELECT r.report_id, coalesce(n, 0) AS issue_count, CASE WHEN n > 0 THEN 'error' ELSE 'success' END AS status FROM d_report r LEFT JOIN c USING (report_id)")
def report_results(spark, sf):
    """Issue count and status per report."""
    return compliance.report_results(derived(spark, sf, "d_report").select("report_id"), _issues(spark, sf))


@query("a2_module_statuses", """WITH c AS (SELECT report_id, count(*) FILTER (part % 5 = 0) AS n_method, count(*) FILTER (part % 7 = 0) AS n_indicator, count(*) FILTER (part % 2 = 0) AS n_matched, count(*) FILTER (part % 3 = 0) AS n_evidence FROM d_item GROUP BY 1)
  SELECT r.report_id, CASE r.report_id % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'unknown' END AS standards_compliance_status, CASE WHEN n_method > 0 THEN 'failed' WHEN n_matched > 0 THEN 'passed' ELSE 'unknown' END AS method_compliance_status,
   CASE WHEN n_indicator > 0 THEN 'failed' WHEN n_evidence > 0 THEN 'passed' ELSE 'unknown' END AS standard_indicators_status FROM d_report r LEFT JOIN c USING (report_id)""")
def module_statuses(spark, sf):
    """Module statuses from the lists of a report."""
    n = lambda k: F.count_if(F.col("part") % k == 0)
    counts = derived(spark, sf, "d_item").groupBy("report_id").agg(n(5).alias("n_method"), n(7).alias("n_indicator"), n(2).alias("n_matched"), n(3).alias("n_evidence"))
    at = F.col("report_id") % 3
    rows = derived(spark, sf, "d_report").select(
        "report_id", F.when(at == 0, "pass").when(at == 1, "fail").otherwise("warning").alias("status"), F.lit(None).cast("boolean").alias("all_passed")
    )
    return compliance.module_statuses(rows.join(counts, "report_id", "left")).select(
        "report_id", "standards_compliance_status", "method_compliance_status", "standard_indicators_status"
    )


# --- review -------------------------------------------------------------------------------------

def _evidence(spark, sf):
    """Evidence per reported item (first of each name), found under its own or another name."""
    i = derived(spark, sf, "d_item")
    names = i.groupBy("report_id", "item").agg(F.min(F.struct("line", "part", "supp", "price")).alias("f"))
    part = F.col("f.part")
    return names.select(
        "report_id", F.when(part % 4 == 0, F.concat(F.lit("要求"), F.col("item"))).otherwise(F.col("item")).alias("item"),
        F.when(part % 4 == 1, F.lit("别名")).otherwise(F.col("item")).alias("report_name"),
        F.when(part % 3 == 0, "≤20").when(part % 3 == 1, "未查到").otherwise("8~30").alias("standard_value"),
        F.when(part % 2 == 0, "mg/kg").otherwise("–").alias("standard_unit"),
    )


def _plain_items(spark, sf):
    return derived(spark, sf, "d_item").select("report_id", "item", F.struct("line", "part", "supp", "price").alias("pos"), "value", "standard", "unit")


_EVIDENCE = """WITH i AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY line, part, supp, price) AS rn FROM d_item),
  n AS (SELECT report_id, item, arg_min(part, rn) AS part FROM i GROUP BY 1, 2),
  e AS (SELECT report_id, CASE WHEN part % 4 = 0 THEN '要求' || item ELSE item END AS item, CASE WHEN part % 4 = 1 THEN '别名' ELSE item END AS report_name, CASE part % 3 WHEN 0 THEN '≤20' WHEN 1 THEN '未查到' ELSE '8~30' END AS standard_value, CASE WHEN part % 2 = 0 THEN 'mg/kg' ELSE '–' END AS standard_unit FROM n),
  l AS (SELECT report_id, item AS key, arg_max(value, rn) AS value, arg_max(standard, rn) AS standard, arg_max(unit, rn) AS unit FROM i GROUP BY 1, 2),
  j AS (SELECT e.*, coalesce(nullif(CASE WHEN a.key IS NOT NULL THEN a.value ELSE b.value END, ''), '–') AS measured, coalesce(nullif(CASE WHEN a.key IS NOT NULL THEN a.standard ELSE b.standard END, ''), '–') AS report_standard, coalesce(nullif(CASE WHEN a.key IS NOT NULL THEN a.unit ELSE b.unit END, ''), '–') AS report_unit
    FROM e LEFT JOIN l a ON a.report_id = e.report_id AND a.key = e.report_name LEFT JOIN l b ON b.report_id = e.report_id AND b.key = e.item)"""


@query("j11_evidence_items", _EVIDENCE + " SELECT * FROM j")
def evidence_items(spark, sf):
    """Evidence with its report item, by reported name, else by item name."""
    return review.reported_for_evidence(_evidence(spark, sf), _plain_items(spark, sf))


@query("f44_unit_table", _EVIDENCE + " SELECT report_id, item, report_unit, standard_unit, CASE WHEN standard_unit = '–' THEN 'unknown' WHEN report_unit <> '–' AND report_unit = standard_unit THEN 'match' ELSE 'differs' END AS unit_class FROM j")
def unit_table(spark, sf):
    rows = review.unit_table(_evidence(spark, sf), _plain_items(spark, sf))
    return rows.select("report_id", "item", "report_unit", "standard_unit", "unit_class")


def _choices(spark, sf):
    """Human decisions on evidence: one per (report, item) of some parts."""
    e = _evidence(spark, sf)
    at = (F.col("report_id") + F.length("item")) % 5
    decision = F.when(at == 0, "compliant").when(at == 1, "exceeded").when(at == 2, "unit_mismatch")
    return e.select("report_id", F.concat(F.lit(review.CHOICE_PREFIX), F.col("item")).alias("key"), decision.alias("decision")).where("decision IS NOT NULL").distinct()


@query("j15_value_table", _EVIDENCE + """, d AS (SELECT *, CASE (report_id + length(item)) % 5 WHEN 0 THEN 'compliant' WHEN 1 THEN 'exceeded' WHEN 2 THEN 'unit_mismatch' END AS choice FROM j)
  SELECT report_id, item, choice, CASE choice WHEN 'compliant' THEN '合规' WHEN 'exceeded' THEN '指标超标' WHEN 'unit_mismatch' THEN '单位不符' END AS badge FROM d""")
def value_table(spark, sf):
    """Every row of the value table with its decision and that decision's badge, if any."""
    rows = review.value_table(_evidence(spark, sf), _plain_items(spark, sf), _choices(spark, sf))
    return rows.select("report_id", "item", "choice", F.when(F.col("choice").isNotNull(), F.col("badge")).alias("badge"))


@query("e8_value_table")
def whole_value_table(spark, sf):
    """The whole value table: automatic class, decision, final class and badge."""
    rows = review.value_table(_evidence(spark, sf), _plain_items(spark, sf), _choices(spark, sf))
    return rows.select("report_id", "item", "measured", "effective_limit", "row_class", "choice", "final_class", "badge")


_MODULES = """WITH v AS (SELECT report_id, bool_or(CASE WHEN part % 3 = 0 THEN supp % 2 = 0 ELSE part % 5 = 0 END) AS red, bool_or(part % 3 <> 0 AND part % 5 = 1) AS yellow FROM d_item GROUP BY 1),
  l AS (SELECT report_id, bool_or(pos % 3 = 0) AS info FROM d_cited GROUP BY 1),
  s AS (SELECT report_id, count(*) FILTER (part % 11 = 0) AS miss, count(*) FILTER (part % 13 = 0) AS rej, count(*) FILTER (part % 4 = 0) AS opn FROM d_item GROUP BY 1),
  j AS (SELECT r.report_id, red, yellow, info, coalesce(miss, 0) AS miss, coalesce(rej, 0) AS rej, coalesce(opn, 0) AS opn, CASE r.report_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ap FROM d_report r LEFT JOIN v USING (report_id) LEFT JOIN l USING (report_id) LEFT JOIN s USING (report_id)),
  m AS (SELECT report_id, 1 AS module_no, CASE WHEN miss > 0 OR rej > 0 THEN 'failed' WHEN opn > 0 THEN 'pending_review' ELSE 'passed' END AS status FROM j UNION ALL SELECT report_id, 2, CASE WHEN ap THEN 'passed' WHEN NOT ap THEN 'failed' ELSE 'unknown' END FROM j
   UNION ALL SELECT report_id, 3, 'passed' FROM j UNION ALL SELECT report_id, 4, CASE WHEN red IS NULL THEN 'unknown' WHEN red THEN 'failed' WHEN yellow THEN 'pending_review' ELSE 'passed' END FROM j UNION ALL SELECT report_id, 5, CASE WHEN info IS NULL THEN 'unknown' WHEN info THEN 'passed' ELSE 'unknown' END FROM j),
  k AS (SELECT *, CASE WHEN status IN ('passed', 'failed') THEN status ELSE 'unknown' END AS status_class FROM m)"""


def _modules(spark, sf):
    i = derived(spark, sf, "d_item")
    part = F.col("part")
    values = i.select(
        "report_id", F.when(part % 3 == 0, F.when(F.col("supp") % 2 == 0, "exceeded").otherwise("compliant")).alias("choice"),
        F.when(part % 5 == 0, "standard_mismatch").when(part % 5 == 1, "missing_unit").otherwise("compliant").alias("row_class"),
    )
    tags = derived(spark, sf, "d_cited").select(
        "report_id", F.when(F.col("pos") % 3 == 0, "纯牛奶").alias("product_type"), F.lit("").alias("standard_code")
    )
    summary = i.groupBy("report_id").agg(F.count_if(part % 11 == 0).alias("n_missing"), F.count_if(part % 13 == 0).alias("n_rejected"), F.count_if(part % 4 == 0).alias("n_open"))
    at = F.col("report_id") % 3
    reports = derived(spark, sf, "d_report").select(
        "report_id", F.when(at == 0, True).when(at == 1, False).alias("all_passed"), F.lit("passed").alias("method_compliance_status"),
        F.lit(None).cast("string").alias("standard_indicators_status"), F.lit(None).cast("string").alias("label_info_status"),
    )
    return review.module_table(reports, values, tags, summary)


@query("a5_module_table", _MODULES + " SELECT report_id, module_no, status, status_class FROM k")
def module_table(spark, sf):
    """Five module verdicts per report; red beats yellow."""
    return _modules(spark, sf).drop("module")


@query("a6_overall_verdicts", _MODULES + """, c AS (SELECT report_id, count(*) FILTER (status_class = 'failed') AS n_failed, count(*) FILTER (status_class = 'passed') AS n_passed, count(*) FILTER (status_class = 'unknown') AS n_unknown, count(*) FILTER (status = 'pending_review') AS n_pending FROM k GROUP BY 1)
  SELECT *, CASE WHEN n_failed > 0 THEN '验证未通过' WHEN n_pending > 0 THEN '待审核' WHEN n_unknown = 0 THEN '验证通过' ELSE '待补充信息' END AS overall FROM c""")
def overall_verdicts(spark, sf):
    return review.overall_verdicts(_modules(spark, sf))


@query("f46_status_texts", _MODULES + " SELECT status, CASE status WHEN 'passed' THEN '通过' WHEN 'failed' THEN '未通过' WHEN 'pending_review' THEN '待审核' ELSE '待验证' END AS text, count(*) AS n FROM k GROUP BY 1, 2")
def status_texts(spark, sf):
    return _modules(spark, sf).groupBy("status", review.status_text("status").alias("text")).agg(F.count("*").alias("n"))


@query("j12_verdict_codes", """WITH e AS (SELECT report_id, part, line, supp, price, CASE part % 3 WHEN 0 THEN 'GB ' || CAST(2000 + supp AS VARCHAR) || '-2016' WHEN 1 THEN '依据 ' || CAST(supp % 30 AS VARCHAR) ELSE '明示' END AS basis FROM d_item),
  x AS (SELECT DISTINCT e.report_id, e.basis, arg_min(c.code, c.pos) FILTER (c.code = e.basis) OVER w AS same, arg_min(c.code, c.pos) FILTER (regexp_extract(e.basis, '([0-9]+([.][0-9]+)?)', 1) <> '' AND contains(replace(c.code, ' ', ''), regexp_extract(e.basis, '([0-9]+([.][0-9]+)?)', 1))) OVER w AS loose FROM e JOIN d_cited c USING (report_id) WINDOW w AS (PARTITION BY e.report_id, e.basis))
  SELECT e.report_id, e.part, e.line, e.basis AS required_basis, coalesce(x.same, x.loose) AS verdict_code FROM e LEFT JOIN x ON x.report_id = e.report_id AND x.basis = e.basis""")
def verdict_codes(spark, sf):
    """Verdict code of an evidence basis: the same, else the first holding its number."""
    part, supp = F.col("part"), F.col("supp")
    basis = F.when(part % 3 == 0, F.concat(F.lit("GB "), (2000 + supp).cast("string"), F.lit("-2016"))).when(
        part % 3 == 1, F.concat(F.lit("依据 "), (supp % 30).cast("string"))
    ).otherwise("明示")
    evidence = derived(spark, sf, "d_item").select("report_id", "part", "line", basis.alias("required_basis"))
    return review.basis_verdict_codes(evidence, derived(spark, sf, "d_cited").select("report_id", "pos", "code"))


@query("j23_labels_by_report", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pos) AS no FROM d_cited) SELECT report_id, (no - 1) // 2 AS part, string_agg(code, ',' ORDER BY pos) AS codes FROM n GROUP BY 1, 2")
def labels_by_report(spark, sf):
    """Labels of a report in bounded parts."""
    tags = derived(spark, sf, "d_cited").select("report_id", "pos", "code")
    rows = review.labels_by_report(tags, 2)
    return rows.select("report_id", "part", F.array_join(F.transform("labels", lambda x: x["code"]), ",").alias("codes"))


@query("p18_found_tokens", """SELECT standard, standard <> '' AND standard NOT IN ('未查到', '–', '未提取', '未找到限量值') AS found, count(*) AS n FROM d_item GROUP BY 1""")
def found_tokens(spark, sf):
    return derived(spark, sf, "d_item").groupBy("standard").agg(F.count("*").alias("n")).select("standard", N.is_found("standard").alias("found"), "n")


# --- dashboard ----------------------------------------------------------------------------------

def _facts(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    return orders.join(li, "o_orderkey")


@query("a16_category_shares", "SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER () AS total, count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1")
def category_shares(spark, sf):
    return dashboard.category_shares(table(spark, sf, "orders"), "o_orderpriority")


@query("a17_submitter_ranking", """WITH c AS (SELECT c_name, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5)
  SELECT *, row_number() OVER (ORDER BY n DESC, c_name, n_name) AS rank, n / max(n) OVER () AS bar, row_number() OVER (ORDER BY n DESC, c_name, n_name) <= 3 AS marked FROM c""")
def submitter_ranking(spark, sf):
    """Most active submitters with their department (a top-five report)."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return dashboard.ranking(rows, ["c_name", "n_name"])


@query("a17_standard_ranking", f"""WITH b AS (SELECT regexp_replace(regexp_replace(code, '-\\s*[0-9]{{4}}$', ''), '\\s+$', '') AS base_code FROM d_cited), c AS (SELECT base_code, count(*) AS n FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
  SELECT *, row_number() OVER (ORDER BY n DESC, base_code) AS rank, n / max(n) OVER () AS bar, row_number() OVER (ORDER BY n DESC, base_code) <= 3 AS marked FROM c""")
def standard_ranking(spark, sf):
    """Most cited standards (a top-five report)."""
    rows = derived(spark, sf, "d_cited").select(C.without_trailing_year("code").alias("base_code"))
    return dashboard.ranking(rows, ["base_code"])


@query("a18_monthly_counts", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS mo, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(CAST(mo AS DATE) AS VARCHAR) AS month, n, mo = (SELECT arg_min(mo, -n * 100000 + date_diff('month', DATE '1970-01-01', CAST(mo AS DATE))) FROM m) AS is_peak FROM m""")
def monthly_counts(spark, sf):
    """Reports per month with the peak month."""
    return dashboard.monthly_counts(table(spark, sf, "orders"), "o_orderdate").withColumn("month", F.col("month").cast("string"))


@query("a19_period_figures", """WITH f AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey, o_custkey, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  c AS (SELECT month, 'reports' AS figure, count(DISTINCT o_orderkey) AS n FROM f GROUP BY 1 UNION ALL SELECT month, 'submitters', count(DISTINCT o_custkey) FROM f GROUP BY 1 UNION ALL SELECT month, 'items', count(DISTINCT l_partkey) FROM f GROUP BY 1 UNION ALL SELECT month, 'standards', count(DISTINCT l_suppkey) FROM f GROUP BY 1),
  p AS (SELECT *, lag(n) OVER (PARTITION BY figure ORDER BY month) AS previous FROM c) SELECT CAST(month AS VARCHAR) AS month, figure, n, previous, (n - previous) / previous AS change FROM p""")
def period_figures(spark, sf):
    """Reports, items, submitters and standards per month with the change."""
    measures = {"reports": "o_orderkey", "items": "l_partkey", "submitters": "o_custkey", "standards": "l_suppkey"}
    return dashboard.period_figures(_facts(spark, sf), "o_orderdate", measures).withColumn("month", F.col("month").cast("string"))


@query("a20_counts_per_tab", "SELECT source AS tab, count(*) AS n, count(*) FILTER (n_chars > 1000) AS available FROM documents GROUP BY 1")
def counts_per_tab(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("tab")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("available"))


# --- composite jobs -----------------------------------------------------------------------------

def limit_chunks(spark, sf):
    """Limit texts per part: one standard document per size, a table with the part's item."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    content = F.concat(
        F.lit("<table><tr><th>项目</th><th>单位</th><th>指标</th></tr><tr><td>"), F.col("p_name"), F.lit("</td><td>mg/kg</td><td>≤"), size,
        F.lit("</td></tr><tr><td>维生素K"), (p % 3).cast("string"), F.lit("</td><td>mg</td><td>≤"), (1 + p % 7).cast("string"), F.lit("</td></tr></table>"),
    )
    return table(spark, sf, "part").select(
        p.alias("chunk_id"), F.concat(F.lit("GB "), (2000 + F.col("p_size")).cast("string"), F.lit("-2016 标准")).alias("doc_name"),
        F.col("p_size").alias("page_num"), content.alias("content"),
    )


@query("e12_limit_lookup")
def limit_lookup(spark, sf):
    """Limit and verdict of every matched item: code, questions, retrieval, best chunk, limit, decision."""
    found = Q.matched(spark, sf).join(derived(spark, sf, "d_report").select("report_id", "food_name"), "report_id")
    first = derived(spark, sf, "d_cited").groupBy("report_id").agg(F.min_by("code", F.struct("pos", "code")).alias("first_code"))
    return jobs.lookup_limits(spark, found, first, limit_chunks(spark, sf), grams=three_characters).drop("content")


def three_characters(c):
    from millaudit.operators.retrieval import char_grams

    return char_grams(c, 3)


@query("e3_compliance", f"WITH {Q.LISTS} SELECT report_id, status, issues FROM status")
def compliance_job(spark, sf):
    """Compliance of all items as one job, with shared results stored once."""
    reports = derived(spark, sf, "d_report").select("report_id", "category", "food_name").join(Q.reports(spark, sf).select("report_id"), "report_id")
    result = jobs.check_compliance(spark, reports, Q.reported(spark, sf), derived(spark, sf, "d_cited"), Q.rules(spark, sf))
    return result["status"].select("report_id", "status", F.array_join("issues", "|").alias("issues"))


@query("e7_batch_limits", """WITH n AS (SELECT p_brand, p_name, min(p_partkey) AS k, max(p_size) AS size FROM part GROUP BY 1, 2)
  SELECT 'GB ' || CAST(2000 + CAST(substr(p_brand, 7) AS INT) AS VARCHAR) AS query_code, p_name AS item, '≤' || CAST(size AS VARCHAR) AS standard_value, 'mg/kg' AS standard_unit FROM n""")
def batch_limits(spark, sf):
    """Limits of all items of a standard from stored answers over its combined text."""
    from millaudit.operators.common import block_positions

    part = table(spark, sf, "part")
    code = F.concat(F.lit("GB "), (2000 + F.substring("p_brand", 7, 10).cast("int")).cast("string"))
    names = part.groupBy(code.alias("query_code"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"), F.max("p_size").alias("size"))
    numbered = block_positions(names.withColumn("block", F.floor(F.col("k") / 50_000)), ["query_code"], ["block"], ["k"], "no")
    items = numbered.select("query_code", "name", "k", F.lit("黄瓜").alias("food"), (F.col("no") - 1).cast("long").alias("pos"))
    # An answer names the items of one standard: as many as the rule book gives it.
    told = names.groupBy("query_code").agg(
        F.concat(F.lit("答 {"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "size"))), lambda x: F.concat(
            F.lit('"'), x["name"], F.lit('": {"standard_value": "≤'), x["size"].cast("string"), F.lit('", "standard_unit": "mg/kg"}'))), ", "), F.lit("}")).alias("text")
    )
    chunks = part.select(
        F.col("p_partkey").alias("chunk_id"), F.concat(code, F.lit(" 文件")).alias("doc_name"), F.col("p_size").alias("page_num"),
        F.concat(F.lit("瓜类蔬菜 限量 "), F.col("p_name")).alias("content"),
    )
    rows = jobs.batch_limits(items.select("query_code", "pos", "name", "food"), chunks, told)
    return rows.select("query_code", "item", "standard_value", "standard_unit")


def rule_book(spark, sf):
    """Rule chunks per part: a category and a table of required items."""
    p = F.col("p_partkey")
    names = ["瓜类蔬菜", "幼儿配方食品", "灭菌乳", "仁果类水果", "熟肉制品", "根茎类和薯芋类蔬菜", "豆类", "水产品", "茄果类蔬菜", "风味发酵乳"]
    category = F.element_at(F.array(*[F.lit(x) for x in names]), (1 + p % len(names)).cast("int"))
    content = F.concat(
        category, F.lit(" 检验项目<table><tr><th>检验项目</th><th>依据法律法规或标准</th><th>检测方法</th></tr><tr><td>维生素K"), (p % 3).cast("string"),
        F.lit("</td><td>GB "), (2000 + p % 50).cast("string"), F.lit("</td><td>GB 5009.158 第二法</td></tr><tr><td>硝酸盐（以NaNO3计）</td><td></td><td></td></tr><tr><td>"),
        F.lit("指标"), F.col("p_name"), F.lit("项</td><td>GB 2762</td><td></td></tr></table>"),
    )
    return table(spark, sf, "part").select(p.alias("chunk_id"), F.lit("细则").alias("doc_name"), F.col("p_size").alias("page_num"), content.alias("content"))


@query("e1_audit")
def audit(spark, sf):
    """Whole audit: report pages to results per report."""
    result = jobs.audit(
        spark, QL.report_pages(spark, sf), derived(spark, sf, "d_standard"), rule_book(spark, sf), limit_chunks(spark, sf)
    )
    return result["summary"].select(
        "report_id", "food_name", "production_date", "compliance_status", "regulatory_basis_consistent", "method_compliance_status",
        "standard_indicators_status", "issue_count", "status",
    )
