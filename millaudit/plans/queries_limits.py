"""Measured values, limits and sampling plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from millaudit.functions import numbers as N
from millaudit.functions.text import half_width_signs
from millaudit.operators import limits
from millaudit.plans import sql_parts as S
from millaudit.plans.derived import derived
from millaudit.plans.registry import query
from millaudit.session import table


def _items(spark, sf):
    return derived(spark, sf, "d_item").select(
        "report_id", "line", "part", "supp", "category", "item", "unit", "value", F.col("standard").alias("limit"),
        F.lit("").alias("report_limit"),
    )


_DECIDED = f"""
WITH i AS (SELECT report_id, line, part, supp, item, value, standard AS lim FROM d_item),
p AS (SELECT *, {S.measured('value')} AS v, {S.samples('value')} AS smp,
        {S.plan_part('lim', 'n')} AS pn, {S.plan_part('lim', 'c')} AS pc, {S.plan_part('lim', 'm')} AS pm, {S.plan_part('lim', 'M')} AS ph,
        try_cast(regexp_extract(lim, '^([0-9]+)~[0-9]+$', 1) AS DOUBLE) AS lo, try_cast(regexp_extract(lim, '^[0-9]+~([0-9]+)$', 1) AS DOUBLE) AS hi,
        try_cast(regexp_extract(lim, '^≤([0-9]+)$', 1) AS DOUBLE) AS top, try_cast(regexp_extract(lim, '^≥([0-9]+)$', 1) AS DOUBLE) AS low FROM i),
r AS (SELECT *, CASE WHEN value = '' OR lim = '' THEN 'none'
        WHEN pn IS NOT NULL AND pc IS NOT NULL AND pm IS NOT NULL AND ph IS NOT NULL THEN CASE WHEN smp IS NOT NULL THEN 'plan' ELSE 'plan_single' END
        WHEN smp IS NOT NULL OR v IS NULL THEN 'undecided' WHEN contains(lim, '不得检出') THEN 'forbidden' WHEN lo IS NOT NULL THEN 'range'
        WHEN top IS NOT NULL THEN 'max' WHEN low IS NOT NULL THEN 'min' ELSE 'none' END AS limit_rule FROM p),
d AS (SELECT report_id, line, part, supp, item, value, lim, limit_rule,
   CASE limit_rule WHEN 'plan' THEN
       CASE WHEN len(list_filter(smp, lambda x: x > ph)) > 0 THEN '不合格：样品检出值 ' || CAST(list_filter(smp, lambda x: x > ph)[1] AS VARCHAR) || ' 超出M值上限 ' || CAST(ph AS VARCHAR) || ' (M=' || CAST(ph AS VARCHAR) || ')'
            WHEN len(list_filter(smp, lambda x: x > pm)) > pc THEN '不合格：介于m~M之间的样品数 ' || CAST(len(list_filter(smp, lambda x: x > pm)) AS VARCHAR) || ' 超过允许数 c=' || CAST(CAST(pc AS INT) AS VARCHAR) || ' (m=' || CAST(pm AS VARCHAR) || ', M=' || CAST(ph AS VARCHAR) || ')' END
     WHEN 'plan_single' THEN CASE WHEN v > ph THEN '不合格：实测值 ' || CAST(v AS VARCHAR) || ' 超出M值上限 ' || CAST(ph AS VARCHAR)
            WHEN v > pm THEN '警告：实测值 ' || CAST(v AS VARCHAR) || ' 介于m~M之间 (m=' || CAST(pm AS VARCHAR) || ', M=' || CAST(ph AS VARCHAR) || ')，需结合完整采样数据判定' END
     WHEN 'forbidden' THEN CASE WHEN v > 0 THEN '要求不得检出，实际检出 ' || value END
     WHEN 'range' THEN CASE WHEN v < lo THEN '低于最小值 (实测 ' || value || ' < ' || CAST(lo AS VARCHAR) || ')' WHEN v > hi THEN '超出最大值 (实测 ' || value || ' > ' || CAST(hi AS VARCHAR) || ')' END
     WHEN 'max' THEN CASE WHEN v > top THEN '超标 (实测 ' || value || ' > 限量 ' || CAST(top AS VARCHAR) || ')' END
     WHEN 'min' THEN CASE WHEN v < low THEN '低于最小值 (实测 ' || value || ' < ' || CAST(low AS VARCHAR) || ')' END END AS limit_issue FROM r)
"""


@query("f24_limit_decisions", _DECIDED + "SELECT report_id, line, part, supp, item, value, lim AS \"limit\", limit_rule, limit_issue FROM d")
def limit_decisions(spark, sf):
    """Decision and message for every measured value."""
    return limits.limit_decisions(_items(spark, sf)).select(
        "report_id", "line", "part", "supp", "item", "value", "limit", "limit_rule", "limit_issue"
    )


@query("a4_limit_issues_per_report", _DECIDED + "SELECT report_id, count(*) AS n_items, count(limit_issue) AS n_issues FROM d GROUP BY report_id")
def limit_issues_per_report(spark, sf):
    """Items and limit issues per report."""
    return limits.limit_decisions(_items(spark, sf)).groupBy("report_id").agg(
        F.count("*").alias("n_items"), F.count("limit_issue").alias("n_issues")
    )


@query(
    "f20_measured_values",
    f"""SELECT part, value, {S.measured('value')} AS v, CASE WHEN contains(value, '未检出') THEN 0.0 WHEN contains(value, ':') OR contains(value, ',') THEN NULL
        ELSE try_cast(regexp_extract(value, '([0-9.]+)', 1) AS DOUBLE) END AS review_v, count(*) AS n FROM d_item GROUP BY ALL""",
)
def measured_values(spark, sf):
    """Measured values, back-office and review reading."""
    return (
        _items(spark, sf)
        .select("part", "value", N.measured_value("value").alias("v"), N.review_number("value").alias("review_v"))
        .groupBy("part", "value", "v", "review_v").agg(F.count("*").alias("n"))
    )


@query(
    "f21_review_ranges",
    """SELECT standard, CASE WHEN starts_with(standard, '≤') THEN NULL WHEN starts_with(standard, '≥') THEN CAST(substr(standard, 2) AS DOUBLE)
          WHEN contains(standard, '~') THEN CAST(split_part(standard, '~', 1) AS DOUBLE) END AS lo,
        CASE WHEN starts_with(standard, '≤') THEN CAST(substr(standard, 2) AS DOUBLE) WHEN contains(standard, '~') THEN CAST(split_part(standard, '~', 2) AS DOUBLE) END AS hi,
        count(*) AS n FROM d_item GROUP BY ALL""",
)
def review_ranges(spark, sf):
    """Limit texts as ranges, with how often each occurs."""
    rows = derived(spark, sf, "d_item").groupBy("standard").agg(F.count("*").alias("n"))
    return rows.withColumn("r", N.review_range("standard")).select("standard", "r.lo", "r.hi", "n")


@query(
    "a10_sampling_plans",
    f"""WITH i AS (SELECT report_id, line, part, supp, value, 'n=5,c=' || CAST(supp % 3 AS VARCHAR) || ',m=14,M=' || CAST(20 + supp % 40 AS VARCHAR) AS plan FROM d_item),
    p AS (SELECT *, {S.samples('value')} AS smp, {S.plan_part('plan', 'c')} AS pc, {S.plan_part('plan', 'm')} AS pm, {S.plan_part('plan', 'M')} AS ph FROM i)
    SELECT report_id, line, part, supp, value, plan,
      CASE WHEN smp IS NOT NULL THEN len(list_filter(smp, lambda x: x > ph)) = 0 AND len(list_filter(smp, lambda x: x > pm)) <= pc END AS passes,
      CASE WHEN smp IS NULL THEN NULL WHEN len(smp) <> 5 THEN 'unknown' WHEN len(list_filter(smp, lambda x: x > ph)) > 0 OR len(list_filter(smp, lambda x: x > pm)) > pc THEN 'inconsistent' ELSE 'compliant' END AS review_class FROM p""",
)
def sampling_plans(spark, sf):
    """Sample lists against sampling plans."""
    plan = F.concat(F.lit("n=5,c="), (F.col("supp") % 3).cast("string"), F.lit(",m=14,M="), (20 + F.col("supp") % 40).cast("string"))
    rows = derived(spark, sf, "d_item").select("report_id", "line", "part", "supp", "value", plan.alias("plan"))
    return limits.sampling_verdicts(rows)


_REVIEW = f"""
WITH i AS (SELECT report_id, line, part, supp, value, standard AS rep, unit,
             CASE part % 6 WHEN 0 THEN '≤20' WHEN 1 THEN '≥12' WHEN 2 THEN '8~30' WHEN 3 THEN '未查到' WHEN 4 THEN '25' ELSE 'n=5,c=1,m=15,M=30' END AS gb FROM d_item),
p AS (SELECT *, CASE WHEN contains(value, '未检出') THEN 0.0 WHEN contains(value, ':') OR contains(value, ',') THEN NULL ELSE try_cast(regexp_extract(value, '([0-9.]+)', 1) AS DOUBLE) END AS m,
   CASE WHEN len(string_split(value, ',')) >= 2 THEN list_transform(string_split(value, ','), lambda x: CASE WHEN contains(x, '<') THEN 0.0 ELSE try_cast(x AS DOUBLE) END) END AS smp,
   CASE WHEN contains(rep, 'n=') THEN rep WHEN contains(gb, 'n=') THEN gb END AS plan,
   gb <> '未查到' AS found, rep <> '' AS rep_found,
   try_cast(regexp_extract(replace(value, '<', ''), '^([0-9]+[.]?[0-9]*)', 1) AS DOUBLE) AS single,
   CASE WHEN starts_with(gb, '≥') THEN CAST(substr(gb, 2) AS DOUBLE) WHEN contains(gb, '~') THEN CAST(split_part(gb, '~', 1) AS DOUBLE) END AS lo,
   CASE WHEN starts_with(gb, '≤') THEN CAST(substr(gb, 2) AS DOUBLE) WHEN contains(gb, '~') THEN CAST(split_part(gb, '~', 2) AS DOUBLE) END AS hi,
   CASE WHEN starts_with(rep, '≤') THEN CAST(substr(rep, 2) AS DOUBLE) WHEN contains(rep, '~') THEN CAST(split_part(rep, '~', 2) AS DOUBLE) END AS rep_hi,
   starts_with(rep, '≤') OR starts_with(rep, '≥') OR contains(rep, '~') AS rep_range,
   try_cast(regexp_extract(regexp_replace(gb, '[^0-9.]', '', 'g'), '^([0-9]+)', 1) AS DOUBLE) AS bare FROM i),
q AS (SELECT *, CASE WHEN plan IS NOT NULL THEN {S.plan_part('plan', 'n')} END AS pn, {S.plan_part('plan', 'c')} AS pc, {S.plan_part('plan', 'm')} AS pm, {S.plan_part('plan', 'M')} AS ph, lo IS NOT NULL OR hi IS NOT NULL AS ranged FROM p),
by_plan AS (SELECT *, CASE WHEN plan IS NOT NULL AND smp IS NOT NULL THEN
      CASE WHEN len(smp) <> pn THEN 'unknown' WHEN ph IS NULL THEN CASE WHEN len(list_filter(smp, lambda x: x > pm)) > 0 THEN 'inconsistent' ELSE 'compliant' END
           WHEN len(list_filter(smp, lambda x: x > ph)) > 0 OR len(list_filter(smp, lambda x: x > pm)) > pc THEN 'inconsistent' ELSE 'compliant' END
    WHEN plan IS NOT NULL AND single IS NOT NULL THEN
      CASE WHEN ph IS NULL THEN CASE WHEN single > pm THEN 'inconsistent' ELSE 'compliant' END WHEN single > ph THEN 'inconsistent' WHEN single > pm THEN 'unknown' ELSE 'compliant' END END AS c1 FROM q),
c AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN c1 WHEN NOT found THEN 'unknown'
    WHEN m IS NOT NULL AND ranged THEN CASE WHEN (lo IS NULL OR m >= lo) AND (hi IS NULL OR m <= hi) THEN 'compliant' ELSE 'inconsistent' END
    WHEN m IS NOT NULL AND NOT ranged AND bare IS NOT NULL AND m = bare THEN 'compliant'
    WHEN m IS NOT NULL AND NOT ranged AND bare IS NOT NULL AND starts_with(rep, '≥') THEN CASE WHEN m >= bare THEN 'compliant' ELSE 'inconsistent' END
    WHEN m IS NOT NULL AND NOT ranged AND bare IS NOT NULL AND starts_with(rep, '≤') THEN CASE WHEN m <= bare THEN 'compliant' ELSE 'inconsistent' END
    WHEN rep_found AND rep_range AND ranged THEN CASE WHEN hi IS NULL OR rep_hi IS NULL OR rep_hi <= hi THEN 'compliant' ELSE 'inconsistent' END
    WHEN rep_found AND regexp_replace(rep, '^[≤≥]', '') = regexp_replace(gb, '^[≤≥]', '') THEN 'compliant' ELSE 'unknown' END AS compliance FROM by_plan),
k AS (SELECT report_id, line, part, supp, value, rep, gb, unit, compliance, CASE WHEN NOT found THEN 'missing_standard'
    WHEN ranged AND m IS NOT NULL THEN CASE WHEN (lo IS NULL OR m >= lo) AND (hi IS NULL OR m <= hi) THEN 'compliant' ELSE 'exceeded' END
    WHEN compliance = 'compliant' THEN 'compliant' WHEN compliance = 'inconsistent' THEN 'standard_mismatch'
    WHEN unit <> '' THEN 'missing_standard' ELSE 'missing_unit' END AS row_class FROM c)
"""


def _review_rows(spark, sf):
    at = F.col("part") % 6
    gb = (
        F.when(at == 0, "≤20").when(at == 1, "≥12").when(at == 2, "8~30").when(at == 3, "未查到").when(at == 4, "25")
        .otherwise("n=5,c=1,m=15,M=30")
    )
    rows = derived(spark, sf, "d_item").select(
        "report_id", "line", "part", "supp", "value", F.col("standard").alias("rep"), gb.alias("gb"), "unit"
    )
    return limits.review_classes(rows, "value", "rep", "gb", "unit")


@query("f25_f26_review_classes", _REVIEW + "SELECT * FROM k")
def review_classes(spark, sf):
    """Review class of every measured value against the report's and the standard's limit."""
    return _review_rows(spark, sf)


@query("f26_class_counts", _REVIEW + "SELECT row_class, compliance, count(*) AS n FROM k GROUP BY ALL")
def class_counts(spark, sf):
    return _review_rows(spark, sf).groupBy("row_class", "compliance").agg(F.count("*").alias("n"))


@query(
    "f44_unit_classes",
    """SELECT report_id, line, part, supp, unit, std, CASE WHEN std IN ('–', '', '未查到') THEN 'unknown' WHEN unit <> '–' AND unit = std THEN 'match' ELSE 'differs' END AS unit_class
       FROM (SELECT *, CASE part % 4 WHEN 0 THEN 'mg/kg' WHEN 1 THEN '–' WHEN 2 THEN 'CFU/g' ELSE '未查到' END AS std FROM d_item)""",
)
def unit_classes(spark, sf):
    at = F.col("part") % 4
    std = F.when(at == 0, "mg/kg").when(at == 1, "–").when(at == 2, "CFU/g").otherwise("未查到")
    rows = derived(spark, sf, "d_item").withColumn("std", std)
    return rows.select("report_id", "line", "part", "supp", "unit", "std", N.unit_class("unit", "std").alias("unit_class"))


_SANE_ROWS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '4.' || CAST(p_size AS VARCHAR) WHEN 1 THEN '10767' WHEN 2 THEN '≤' || CAST(p_size AS VARCHAR) || '.0'
   WHEN 3 THEN '４.１' WHEN 4 THEN '未查到' ELSE '0.43 ~ 0.96' END AS sv,
   CASE p_partkey % 5 WHEN 0 THEN 'mg/kg' WHEN 1 THEN 'GB 4789.2' WHEN 2 THEN p_name WHEN 3 THEN '–' ELSE 'g/100kJ' END AS su FROM part"""


@query(
    "p16_f40_sane_limits",
    f"""WITH r AS ({_SANE_ROWS}),
    a AS (SELECT p_partkey, sv, su, translate(sv, '４１', '41') AS half FROM r),
    b AS (SELECT *, regexp_matches(half, '^4[.][0-9]*$') OR (length(regexp_replace(half, '[^0-9]', '', 'g')) >= 4 AND regexp_replace(half, '[^0-9]', '', 'g') = '10767') AS rej FROM a),
    c AS (SELECT p_partkey, CASE WHEN rej THEN '未查到' ELSE sv END AS v, CASE WHEN rej THEN '–' ELSE su END AS u FROM b),
    d AS (SELECT p_partkey, v, CASE WHEN u NOT IN ('–', '-', '', '未查到') AND (NOT regexp_matches(u, '(?i)mg|ug|IU|%|g/|/kg|/L|/g|/100|cfu|mL|kJ|RE|TE|/25g') OR regexp_matches(u, '(?i)GB\\s*[0-9]{{4}}')) THEN '–' ELSE u END AS u FROM c)
    SELECT p_partkey, v AS standard_value, u AS standard_unit, CASE WHEN v = '未查到' THEN '未查到' WHEN u NOT IN ('', '–', '-') THEN v || ' ' || u ELSE v END AS extracted_limit FROM d""",
)
def sane_limits(spark, sf):
    """Limit values and units after the sanity checks, with their display text."""
    at, unit = F.col("p_partkey") % 6, F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.when(at == 0, F.concat(F.lit("4."), size)).when(at == 1, "10767").when(at == 2, F.concat(F.lit("≤"), size, F.lit(".0")))
        .when(at == 3, "４.１").when(at == 4, "未查到").otherwise("0.43 ~ 0.96").alias("standard_value"),
        F.when(unit == 0, "mg/kg").when(unit == 1, "GB 4789.2").when(unit == 2, F.col("p_name")).when(unit == 3, "–")
        .otherwise("g/100kJ").alias("standard_unit"),
        F.lit("10767").alias("number_key"),
    )
    return limits.checked_limits(rows).drop("number_key")


@query(
    "f52_text_limits",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'mg/kg' ELSE '–' END AS unit, CASE p_partkey % 2 WHEN 0 THEN '≤' || CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) || '.5' END AS value FROM part""",
)
def text_limits(spark, sf):
    """Unit and value out of running text."""
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "（mg/kg）").otherwise(""), F.lit("限量 "),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("≤"), size)).otherwise(F.concat(size, F.lit(".5"))), F.lit("，见9.9"),
    )
    rows = table(spark, sf, "part").select("p_partkey", N.text_limit(text).alias("t"))
    return rows.select("p_partkey", "t.unit", "t.value")


@query(
    "f27_sign_forms",
    """SELECT part, supp, count(*) AS n, max(CAST(5 AS VARCHAR) || '~' || CAST(part % 10 AS VARCHAR) || ':' || CAST(supp AS VARCHAR)) AS form FROM d_item GROUP BY part, supp""",
)
def sign_forms(spark, sf):
    """Full-width digits, waves and colons to half-width, over all items."""
    wide = F.concat(F.lit(" ５　～ "), F.translate((F.col("part") % 10).cast("string"), "0123456789", "０１２３４５６７８９"), F.lit("："), F.col("supp").cast("string"))
    return derived(spark, sf, "d_item").groupBy("part", "supp").agg(F.count("*").alias("n"), F.max(half_width_signs(wide)).alias("form"))
