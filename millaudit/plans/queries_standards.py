"""Standards: codes, validity, verdict store, consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from millaudit.functions import codes, dates
from millaudit.operators import compliance, lines, standards
from millaudit.plans import sql_parts as S
from millaudit.plans.derived import derived
from millaudit.plans.registry import query
from millaudit.session import table

# Verdict per (code, production_date), used by several checks.
_JUDGED = f"""
a AS (SELECT DISTINCT c.code, r.production_date FROM d_cited c JOIN d_report r USING (report_id)),
g AS (SELECT {S.standard_number('code')} AS num, publish_date, implement_date, abolish_date, status AS st, detail_url FROM d_standard),
j AS (SELECT a.*, g.* EXCLUDE (num), num IS NULL AS emp, CASE WHEN st IS NOT NULL THEN st WHEN abolish_date IS NOT NULL THEN '已废止' WHEN implement_date IS NOT NULL THEN '现行有效' END AS s2,
        {S.flexible_date('production_date')} AS made, {S.flexible_date('implement_date')} AS since FROM a LEFT JOIN g ON {S.standard_number('a.code')} = num),
k AS (SELECT *, NOT emp AND made IS NULL AS unr, CASE WHEN s2 IN ('现行有效', '有效') THEN NULL ELSE '标准状态不是现行有效（当前为：' || coalesce(s2, '未知') || '）' END AS r1,
        CASE WHEN implement_date IS NULL THEN '缺少实施日期（implement_date）' WHEN since IS NULL THEN '实施日期无法解析（原值：' || implement_date || '）'
             WHEN made < since THEN '生产日期早于实施日期（生产日期：' || CAST(made AS VARCHAR) || '，实施日期：' || CAST(since AS VARCHAR) || '）' END AS r2 FROM j),
verdict AS (SELECT code, production_date, NOT emp AND NOT unr AND r1 IS NULL AND r2 IS NULL AS passed,
        CASE WHEN emp OR unr THEN 'error' WHEN r1 IS NULL AND r2 IS NULL THEN 'valid' WHEN contains(coalesce(s2, ''), '废止') THEN 'obsolete' ELSE 'invalid' END AS status,
        CASE WHEN emp THEN '无法获取标准信息' WHEN unr THEN '验证失败' ELSE coalesce(s2, '未知') END AS status_text,
        CASE WHEN emp THEN '未能提取到任何标准信息（日期、状态、详情页 URL 均为空），请稍后重试' WHEN unr THEN '验证过程出错: invalid date format: ' || production_date
             ELSE concat_ws('|', r1, r2) END AS reasons FROM k)
"""


def _cited_with_dates(spark, sf):
    return derived(spark, sf, "d_cited").join(derived(spark, sf, "d_report").select("report_id", "production_date"), "report_id")


def _judged(spark, sf):
    return standards.verdicts(_cited_with_dates(spark, sf), derived(spark, sf, "d_standard"))


@query("j7_validity", f"WITH {_JUDGED} SELECT * FROM verdict")
def validity(spark, sf):
    """Verdict and reasons for every (code, production date)."""
    return _judged(spark, sf).select(
        "code", "production_date", "passed", "status", "status_text", F.array_join("reasons", "|").alias("reasons")
    )


@query("f34_verdict_classes", f"WITH {_JUDGED} SELECT status, count(*) AS n FROM verdict GROUP BY status")
def verdict_classes(spark, sf):
    return _judged(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "a3_all_passed",
    f"WITH {_JUDGED} SELECT r.report_id, bool_and(v.passed) AS all_passed FROM d_report r LEFT JOIN d_cited c USING (report_id) LEFT JOIN verdict v ON v.code = c.code AND v.production_date = r.production_date GROUP BY r.report_id",
)
def all_passed(spark, sf):
    """Did all standards of a report pass? Null where a report cites none."""
    cited = _cited_with_dates(spark, sf)
    passed = standards.all_passed(standards.report_verdicts(cited, _judged(spark, sf)))
    return derived(spark, sf, "d_report").select("report_id").join(passed, "report_id", "left")


@query(
    "f9_f10_code_forms",
    f"""SELECT code, {S.standard_number('code')} AS number, CASE WHEN regexp_extract(code, '([0-9]+-[0-9]{{4}})', 1) <> '' THEN regexp_extract(code, '([0-9]+-[0-9]{{4}})', 1) ELSE trim(replace(replace(code, 'GB', ''), 'gb', '')) END AS short_number,
        {S.base_code('code')} AS base_code, regexp_extract(code, '([0-9]+([.][0-9]+)?)', 1) AS number_key, count(*) AS n FROM d_cited GROUP BY ALL""",
)
def code_forms(spark, sf):
    """Numbers and yearless forms of all cited codes."""
    return derived(spark, sf, "d_cited").groupBy("code").agg(F.count("*").alias("n")).select(
        "code", codes.standard_number("code").alias("number"), codes.standard_number_short("code").alias("short_number"),
        codes.without_trailing_year("code").alias("base_code"), codes.number_key("code").alias("number_key"), "n",
    )


@query(
    "p15_in_force",
    """SELECT s_suppkey, status, CASE WHEN contains(status, '废止') OR contains(status, '作废') OR contains(status, '停止') THEN false WHEN contains(status, '现行') AND contains(status, '有效') THEN true ELSE status = '有效' END AS in_force
       FROM (SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN '现行有效' WHEN 1 THEN '部分有效' WHEN 2 THEN '即将实施' WHEN 3 THEN '已废止' WHEN 4 THEN '' WHEN 5 THEN ' 有效 ' ELSE '停止执行' END AS raw, trim(raw) AS status FROM supplier)""",
)
def in_force(spark, sf):
    at = F.col("s_suppkey") % 7
    raw = (
        F.when(at == 0, "现行有效").when(at == 1, "部分有效").when(at == 2, "即将实施").when(at == 3, "已废止").when(at == 4, "")
        .when(at == 5, " 有效 ").otherwise("停止执行")
    )
    rows = table(spark, sf, "supplier").select("s_suppkey", raw.alias("raw"))
    return rows.select("s_suppkey", F.trim("raw").alias("status"), standards.in_force("raw").alias("in_force"))


@query(
    "f19_dates",
    f"""SELECT report_id, production_date, CAST({S.flexible_date('production_date')} AS VARCHAR) AS strict_day, CAST(made AS VARCHAR) AS loose_day,
        production_date AS found FROM d_report""",
)
def date_texts(spark, sf):
    """Production dates: strict and loose reading, and the date found in a sentence around it."""
    line = F.concat(F.lit("样品生产日期："), F.col("production_date"), F.lit(" 批号7"))
    return derived(spark, sf, "d_report").select(
        "report_id", "production_date", dates.flexible_date("production_date").cast("string").alias("strict_day"),
        dates.flexible_date("production_date", strict=False).cast("string").alias("loose_day"), dates.date_text(line).alias("found"),
    )


@query(
    "f33_inferred_status",
    """SELECT code, CASE WHEN coalesce(status, '') <> '' THEN status WHEN abolish_date IS NOT NULL THEN '已废止' WHEN implement_date IS NOT NULL THEN '现行有效' END AS status FROM d_standard""",
)
def inferred_status(spark, sf):
    return derived(spark, sf, "d_standard").select(
        "code", standards.inferred_status("status", "implement_date", "abolish_date").alias("status")
    )


@query(
    "a11_method_codes",
    """SELECT report_id, code FROM (SELECT DISTINCT report_id, regexp_replace(trim(unnest(regexp_extract_all(method, 'GB(?:/T)?\\s*[0-9]+(?:[.][0-9]+)?\\s*[—\\-‑–－]\\s*[0-9]{4}'))), '\\s+', ' ', 'g') AS code FROM d_item)""",
)
def method_codes(spark, sf):
    return lines.method_code_set(derived(spark, sf, "d_item"))


@query(
    "u1_all_codes",
    """WITH m AS (SELECT DISTINCT report_id, unnest(regexp_extract_all(method, 'GB(?:/T)?\\s*[0-9]+(?:[.][0-9]+)?\\s*[—\\-‑–－]\\s*[0-9]{4}')) AS code FROM d_item),
    c AS (SELECT DISTINCT report_id, code FROM d_cited)
    SELECT report_id, code, 'cited' AS role FROM c UNION ALL SELECT report_id, code, 'method' FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.report_id = m.report_id AND c.code = m.code)""",
)
def all_codes(spark, sf):
    """Cited codes and the method codes not cited."""
    return lines.all_codes(derived(spark, sf, "d_cited"), derived(spark, sf, "d_item"))


_NOW = 1700100000.0


@query(
    "j8_cache_hits",
    f"SELECT DISTINCT code, production_date, CAST(passed AS BOOLEAN) AS passed, status, ts FROM d_store s SEMI JOIN d_request q USING (code, production_date) WHERE {_NOW} - ts < 86400",
)
def cache_hits(spark, sf):
    """Requests answered by a verdict younger than a day."""
    return standards.cache_hits(derived(spark, sf, "d_request"), _store(spark, sf), _NOW)


def _store(spark, sf):
    return derived(spark, sf, "d_store").withColumn("ts", F.col("ts").cast("double"))


@query(
    "j8_u6_cache_misses",
    f"SELECT DISTINCT code, production_date FROM d_request q WHERE NOT EXISTS (SELECT 1 FROM d_store s WHERE s.code = q.code AND s.production_date = q.production_date AND {_NOW} - ts < 86400)",
)
def cache_misses(spark, sf):
    """Requests to be judged again."""
    return standards.cache_misses(derived(spark, sf, "d_request"), _store(spark, sf), _NOW)


@query(
    "u4_store_upsert",
    f"""WITH miss AS (SELECT DISTINCT code, production_date FROM d_request q WHERE NOT EXISTS (SELECT 1 FROM d_store s WHERE s.code = q.code AND s.production_date = q.production_date AND {_NOW} - ts < 86400)),
    n AS (SELECT code, production_date, false AS passed, CASE WHEN code = 'GB 9' THEN 'error' ELSE 'invalid' END AS status, {_NOW} - CASE WHEN code = 'GB 9' THEN 82800.0 ELSE 0.0 END AS ts FROM miss)
    SELECT code, production_date, passed, status, CAST(ts AS DOUBLE) AS ts FROM n
    UNION ALL SELECT code, production_date, passed, status, CAST(ts AS DOUBLE) FROM d_store s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.code = s.code AND n.production_date = s.production_date)""",
)
def store_upsert(spark, sf):
    """Store after the misses were judged; errors are dated back."""
    store = _store(spark, sf)
    new = standards.cache_misses(derived(spark, sf, "d_request"), store, _NOW).select(
        "*", F.lit(False).alias("passed"), F.when(F.col("code") == "GB 9", "error").otherwise("invalid").alias("status")
    )
    return standards.upserted(store, standards.stamped(new, _NOW))


@query(
    "e2_validate_standards",
    f"""WITH a AS (SELECT DISTINCT code, production_date FROM d_request),
    h AS (SELECT s.code, s.production_date, s.passed, s.status FROM d_store s SEMI JOIN a USING (code, production_date) WHERE {_NOW} - ts < 86400),
    m AS (SELECT a.* FROM a ANTI JOIN h USING (code, production_date)),
    g AS (SELECT {S.standard_number('code')} AS num, implement_date, abolish_date, status AS st FROM d_standard),
    j AS (SELECT m.*, num IS NULL AS emp, CASE WHEN st IS NOT NULL THEN st WHEN abolish_date IS NOT NULL THEN '已废止' WHEN implement_date IS NOT NULL THEN '现行有效' END AS s2,
        {S.flexible_date('production_date')} AS made, {S.flexible_date('implement_date')} AS since FROM m LEFT JOIN g ON {S.standard_number('m.code')} = num),
    v AS (SELECT code, production_date, NOT emp AND s2 IN ('现行有效', '有效') AND since IS NOT NULL AND made >= since AS ok, emp, s2 FROM j)
    SELECT code, production_date, passed, status FROM h UNION ALL
    SELECT code, production_date, coalesce(ok, false), CASE WHEN emp THEN 'error' WHEN coalesce(ok, false) THEN 'valid' WHEN contains(coalesce(s2, ''), '废止') THEN 'obsolete' ELSE 'invalid' END FROM v""",
)
def validate_standards(spark, sf):
    """Stored verdicts where fresh, new ones for the rest."""
    store = _store(spark, sf)
    full = store.select(
        "code", "production_date", "passed", "status", F.lit("").alias("status_text"),
        *[F.lit(None).cast("string").alias(c) for c in ["publish_date", "implement_date", "abolish_date", "detail_url"]],
        F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("string").alias("error"), "ts",
    )
    results, _ = standards.validated(derived(spark, sf, "d_request"), derived(spark, sf, "d_standard"), full, _NOW)
    return results.select("code", "production_date", "passed", "status")


@query(
    "w14_preferred_versions",
    f"""WITH r AS (SELECT report_id, pos, code, {S.base_code('code')} AS base_code FROM (SELECT report_id, pos, code FROM d_cited UNION ALL SELECT report_id, pos + 1000000, regexp_replace(code, '-\\s*2016$', '') FROM d_cited)),
    o AS (SELECT *, row_number() OVER (PARTITION BY report_id, base_code ORDER BY CASE WHEN regexp_matches(code, '-[0-9]{{4}}$') THEN 0 ELSE 1 END, pos) AS rn FROM r)
    SELECT report_id, base_code, pos, code FROM o WHERE rn = 1""",
)
def preferred_versions(spark, sf):
    """One verdict per code without year; the version with a year is preferred."""
    cited = derived(spark, sf, "d_cited").select("report_id", "pos", "code")
    bare = cited.select("report_id", (F.col("pos") + 1000000).alias("pos"), F.regexp_replace("code", r"-\s*2016$", "").alias("code"))
    return standards.preferred_versions(cited.unionByName(bare))


@query(
    "j10_code_consistency",
    f"""WITH c AS (SELECT report_id, {S.base_code('code')} AS base_code, arg_max(code, pos) AS report_code FROM d_cited GROUP BY 1, 2),
    m AS (SELECT report_id, part AS pos, line, 'GB ' || CAST(2000 + part % 120 AS VARCHAR) || CASE WHEN part % 2 = 0 THEN '-2014' ELSE '' END AS code FROM d_item),
    q AS (SELECT report_id, {S.base_code('code')} AS base_code, arg_max(code, {{'a': pos, 'b': code}}) AS rule_code FROM m GROUP BY 1, 2)
    SELECT c.report_id, c.base_code, report_code, rule_code, CASE WHEN rule_code IS NOT NULL THEN '一致' ELSE '细则无要求' END AS label FROM c LEFT JOIN q USING (report_id, base_code)""",
)
def code_consistency(spark, sf):
    """Cited codes against the codes rules require."""
    basis = F.concat(F.lit("GB "), (2000 + F.col("part") % 120).cast("string"), F.when(F.col("part") % 2 == 0, "-2014").otherwise(""))
    matched = derived(spark, sf, "d_item").select("report_id", F.col("part").alias("pos"), basis.alias("required_basis"))
    return standards.code_consistency(derived(spark, sf, "d_cited"), matched)


@query(
    "k12_first_stored_code",
    """SELECT report_id, coalesce(arg_min(code, pos) FILTER (pos % 3 = 0), arg_min(code, pos)) AS code, count(*) FILTER (pos % 3 = 0) > 0 AS stored FROM d_cited GROUP BY report_id""",
)
def first_stored_code(spark, sf):
    path = F.when(F.col("pos") % 3 == 0, F.lit("/files"))
    return compliance.first_stored_code(derived(spark, sf, "d_cited").withColumn("path", path))


@query(
    "f47_verdict_texts",
    f"""WITH {_JUDGED} SELECT code, production_date, '校验结论：' || CASE WHEN passed THEN '通过' ELSE '不通过' END AS head, CASE WHEN passed THEN 0 ELSE len(string_split(reasons, '|')) END AS n_reasons,
    '  - 标准状态：' || status_text AS state_line FROM verdict""",
)
def verdict_texts(spark, sf):
    """Readable verdict texts; the check reads back head, number of reasons and status line."""
    rows = standards.verdict_reports(_judged(spark, sf))
    text_lines = F.split("report_text", "\n")
    return rows.select(
        "code", "production_date", F.get(text_lines, F.lit(0)).alias("head"),
        F.size(F.filter(text_lines, lambda x: x.rlike(r"^  \d+\. "))).cast("long").alias("n_reasons"),
        F.get(F.filter(text_lines, lambda x: x.startswith("  - 标准状态")), F.lit(0)).alias("state_line"),
    )


@query(
    "e4_f51_check_rows",
    f"""WITH {_JUDGED}, q AS (SELECT c.report_id, c.code, coalesce(CASE WHEN r.report_id % 5 = 0 THEN NULL ELSE r.production_date END, '2025-01-01') AS production_date FROM d_cited c JOIN d_report r USING (report_id))
    SELECT q.report_id, q.code, q.production_date, coalesce(v.status, 'unknown') AS status, coalesce(v.passed, false) AS passed FROM q LEFT JOIN verdict v USING (code, production_date)""",
)
def check_rows(spark, sf):
    """Answer rows of standard checks; a missing date takes the default."""
    dated = F.when(F.col("report_id") % 5 != 0, F.col("production_date"))
    requests = _cited_with_dates(spark, sf).select("report_id", "code", dated.alias("production_date"))
    rows = standards.check_rows(requests, _judged(spark, sf))
    return rows.select("report_id", "code", "production_date", "status", "passed")
