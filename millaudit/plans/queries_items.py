"""Required against reported items, methods, bases, and the lists built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millaudit.functions import codes
from millaudit.functions.text import composite_synonym, is_composite, name_core, name_parts
from millaudit.operators import compliance, lines, matching, review
from millaudit.plans import sql_parts as S
from millaudit.plans.derived import derived
from millaudit.plans.registry import query
from millaudit.session import by_report, stored




FIELDS = ("unit", "standard", "value", "method")


def reported(spark, sf, fields=FIELDS):
    """Reported items with their place as one comparable value."""
    return derived(spark, sf, "d_item").select(
        "report_id", "category", "item", F.struct("line", "part", "supp", "price").alias("pos"), *fields
    )


def rules(spark, sf):
    return matching.first_rule_items(derived(spark, sf, "d_rule"))


def last_reported(spark, sf, fields=FIELDS):
    return matching.last_items(reported(spark, sf, fields))


def pairs(spark, sf):
    names = derived(spark, sf, "d_item").where("item <> ''").select("category", F.col("item").alias("report_name"))
    return matching.name_pairs(names, rules(spark, sf))


def matched(spark, sf, fields=FIELDS, known=None):
    """Matched items with the report's fields that are asked for; the fields never decide a match."""
    known = pairs(spark, sf) if known is None else known
    return matching.matched_items(last_reported(spark, sf, fields), rules(spark, sf), known)


def reports(spark, sf):
    return by_report(derived(spark, sf, "d_item").select("report_id", "category")).distinct()


def _gc(s, long):
    return (
        f"(length({s}) >= 3 AND contains({long}, {s}) AND NOT regexp_matches(substr({long}, strpos({long}, {s}) + length({s}), 1), '^[0-9A-Za-z]'))"
    )


def _safe(a, b):
    return f"(CASE WHEN length({a}) <= length({b}) THEN {_gc(a, b)} ELSE {_gc(b, a)} END)"


def _names(table, col, out):
    """CTE body: distinct (category, name) with core, composite flag, synonym and parts."""
    return f"""SELECT category, {out}, core, {S.composite('core')} AS comp, regexp_replace(regexp_replace(core, '占(.+?)含量$', '占\\1总量'), '比例$', '比值') AS syn,
      CASE WHEN length(core) <= 6 OR {S.composite('core')} THEN [core]
           WHEN len(list_filter(string_split(core, '和'), lambda x: x <> '')) > 1 THEN list_filter(string_split(core, '和'), lambda x: x <> '')
           WHEN len(list_filter(string_split(core, '、'), lambda x: x <> '')) > 1 THEN list_filter(string_split(core, '、'), lambda x: x <> '') ELSE [core] END AS parts
    FROM (SELECT DISTINCT category, {col} AS {out}, {S.name_core(col)} AS core FROM {table})"""


# Name pairs by comparing all names of a category.
PAIRS = f"""
rep AS ({_names('d_item', 'item', 'report_name')}),
req AS ({_names('d_rule', 'item_name', 'item_name')}),
pair AS (SELECT category, report_name, item_name, CASE WHEN a_core = b_core THEN 'exact' ELSE 'fuzzy' END AS match_type FROM (
   SELECT a.category, a.report_name, b.item_name, a.core AS a_core, b.core AS b_core, a.comp AS a_comp, b.comp AS b_comp, a.syn AS a_syn, b.syn AS b_syn, a.parts AS pa, b.parts AS pb
   FROM rep a JOIN req b ON a.category = b.category)
  WHERE a_core = b_core OR CASE WHEN a_comp OR b_comp THEN a_syn = b_syn ELSE {_safe('a_core', 'b_core')}
     OR len(list_filter(pa, lambda x: len(list_filter(pb, lambda y: x = y OR {_safe('x', 'y')})) > 0)) > 0 END)
"""

# One row per (report, name): last item's fields at the first place; first rule per name; first match.
MATCHED = f"""
{PAIRS},
it AS (SELECT report_id, category, item, row_number() OVER (PARTITION BY report_id ORDER BY line, part, supp, price) AS pos, unit, standard, value, method FROM d_item),
last_item AS (SELECT report_id, category, item, min(pos) AS pos, arg_max(value, pos) AS value, arg_max(standard, pos) AS standard, arg_max(method, pos) AS method, arg_max(unit, pos) AS unit FROM it GROUP BY 1, 2, 3),
rule1 AS (SELECT category, item_name, min(pos) AS rule_pos, arg_min(condition, pos) AS condition, arg_min(standard_basis, pos) AS standard_basis, arg_min(test_method, pos) AS test_method, arg_min(source_page, pos) AS source_page FROM d_rule GROUP BY 1, 2),
m0 AS (SELECT l.report_id, l.category, p.item_name, l.item, l.pos, p.match_type, l.method, l.value, l.standard, l.unit, row_number() OVER (PARTITION BY l.report_id, p.item_name ORDER BY l.pos) AS rn
   FROM last_item l JOIN pair p ON p.category = l.category AND p.report_name = l.item),
matched AS (SELECT m.report_id, m.category, m.item_name AS name, m.item AS report_name, m.match_type, r.condition, m.method AS report_method, r.test_method AS required_method, r.standard_basis AS required_basis,
    r.source_page, r.rule_pos, m.value, m.standard AS report_standard, m.unit AS report_unit FROM m0 m JOIN rule1 r ON r.category = m.category AND r.item_name = m.item_name WHERE rn = 1),
rep_list AS (SELECT DISTINCT report_id, category FROM d_item),
open_rule AS (SELECT q.report_id, q.category, r.item_name AS name, r.condition, r.rule_pos, CASE WHEN coalesce(r.condition, '') = '' THEN 'missing' ELSE 'conditional' END AS kind
    FROM rep_list q JOIN rule1 r USING (category) WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.report_id = q.report_id AND m.name = r.item_name)),
extra AS (SELECT l.report_id, l.category, l.item FROM last_item l WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.category = l.category AND p.report_name = l.item))
"""

_GBP = "GB(?:/T|/Z)?\\s*[0-9][0-9.]*"


def method_ok(rep: str, req: str) -> str:
    """Method comparison for requirements with at most one code (as the derived rules have)."""
    norm = lambda c: f"lower(regexp_replace(regexp_replace({c}, '\\s*[-—–]\\s*[0-9]{{4}}', '', 'g'), '\\s+', '', 'g'))"
    gb = lambda c: f"lower(regexp_replace(regexp_extract({c}, '(?i)({_GBP})', 1), '\\s+', '', 'g'))"
    fa = lambda c: f"regexp_extract_all({c}, '第[一二三四五六七八九十百0-9]+法')"
    hit = f"({gb(rep)} <> '' AND (contains({gb(rep)}, {gb(req)}) OR contains({gb(req)}, {gb(rep)})))"
    return (
        f"CASE WHEN {norm(rep)} = {norm(req)} THEN true WHEN {gb(req)} = '' THEN contains({norm(rep)}, {norm(req)}) OR contains({norm(req)}, {norm(rep)}) "
        f"ELSE {hit} AND (len({fa(req)}) = 0 OR len(list_intersect({fa(req)}, {fa(rep)})) > 0) END"
    )


ISSUES = f"""
{MATCHED},
method_issue AS (SELECT report_id, name AS item, rule_pos FROM matched WHERE report_method <> '' AND required_method <> '' AND NOT ({method_ok(S.squeeze('report_method'), 'required_method')})),
good_basis AS (SELECT DISTINCT c.report_id, b.standard_basis FROM d_cited c JOIN (SELECT DISTINCT category, standard_basis FROM rule1 WHERE standard_basis <> '') b ON b.category = c.category WHERE {method_ok('c.code', 'b.standard_basis')}),
basis_issue AS (SELECT report_id, name AS item, rule_pos FROM matched m WHERE required_basis <> '' AND NOT contains(required_basis, '明示') AND NOT contains(required_basis, '企业标准')
   AND NOT EXISTS (SELECT 1 FROM good_basis g WHERE g.report_id = m.report_id AND g.standard_basis = m.required_basis))
"""


@query("f7_name_pairs", f"WITH {PAIRS} SELECT * FROM pair")
def name_pairs(spark, sf):
    """All matching (reported, required) names of each category."""
    return pairs(spark, sf)


@query("j1_matched_items", f"WITH {MATCHED} SELECT * FROM matched")
def matched_items(spark, sf):
    """First matching reported item of each required item."""
    return matched(spark, sf)


@query("j2_unmatched_rules", f"WITH {MATCHED} SELECT * FROM open_rule")
def unmatched_rules(spark, sf):
    """Missing and conditional required items per report."""
    return matching.unmatched_rules(reports(spark, sf), rules(spark, sf), matched(spark, sf, ()))


@query("j3_extra_items", f"WITH {MATCHED} SELECT report_id, category, item FROM extra")
def extra_items(spark, sf):
    """Reported items no rule asks for."""
    return matching.extra_items(last_reported(spark, sf, ()), pairs(spark, sf)).drop("pos")


@query("j4_synonym_items", f"""WITH {MATCHED}, x AS MATERIALIZED (SELECT e.report_id, e.item, p.item_name FROM extra e JOIN pair p ON p.category = e.category AND p.report_name = e.item)
  SELECT o.report_id, o.name, x.item FROM x JOIN open_rule o ON o.report_id = x.report_id AND o.name = x.item_name WHERE o.kind = 'missing'""")
def synonym_items(spark, sf):
    """Missing items matched by extra ones: empty by construction."""
    known = stored(spark, pairs(spark, sf), "pairs")
    found = matched(spark, sf, (), known)
    open_ = matching.unmatched_rules(reports(spark, sf), rules(spark, sf), found).where("kind = 'missing'")
    return matching.synonym_items(open_, matching.extra_items(last_reported(spark, sf, ()), known), known)


@query("j4_one_to_one", f"""WITH RECURSIVE {MATCHED},
  e AS (SELECT l.report_id, r.item_name AS name, r.rule_pos, l.item, l.pos, dense_rank() OVER (PARTITION BY l.report_id ORDER BY r.rule_pos, r.item_name) AS turn
    FROM last_item l JOIN pair p ON p.category = l.category AND p.report_name = l.item JOIN rule1 r ON r.category = p.category AND r.item_name = p.item_name),
  walk AS (SELECT report_id, 0::BIGINT AS turn, []::VARCHAR[] AS used, NULL::VARCHAR AS name, NULL::VARCHAR AS item FROM (SELECT DISTINCT report_id FROM e)
    UNION ALL
    SELECT report_id, turn, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, name, got FROM (
      SELECT w.report_id, e.turn, any_value(w.used) AS used, any_value(e.name) AS name, arg_min(e.item, e.pos) FILTER (NOT list_contains(w.used, e.item)) AS got
      FROM (SELECT *, turn + 1 AS next FROM walk) w JOIN e ON e.report_id = w.report_id AND e.turn = w.next GROUP BY w.report_id, e.turn))
  SELECT report_id, name, item FROM walk WHERE item IS NOT NULL""")
def one_to_one(spark, sf):
    """Required names in rule order each take the first reported item that matches and is still free."""
    met, numbered = matching.met_rules(last_reported(spark, sf, ()), rules(spark, sf), pairs(spark, sf))
    met = met.join(numbered.select("category", "rule_no", "item_name", F.col("pos").alias("rule_pos")), ["category", "rule_no"])
    return matching.one_to_one(met.select("report_id", F.col("item_name").alias("name"), "rule_pos", F.col("report_name").alias("item"), "pos"))


@query("f11_method_issues", f"WITH {ISSUES} SELECT report_id, item, rule_pos FROM method_issue")
def method_issues(spark, sf):
    """Matched items whose method does not satisfy the rule."""
    return matching.method_issues(matched(spark, sf, ("method",))).select("report_id", "item", "rule_pos")


@query("j16_method_flags", f"WITH {ISSUES} SELECT m.report_id, m.name, i.item IS NOT NULL AS has_issue FROM matched m LEFT JOIN method_issue i ON i.report_id = m.report_id AND i.item = m.name")
def method_flags(spark, sf):
    found = matched(spark, sf, ("method",))
    return matching.method_flags(found, matching.method_issues(found)).select("report_id", "name", "has_issue")


@query("j5_basis_issues", f"WITH {ISSUES} SELECT report_id, item, rule_pos FROM basis_issue")
def basis_issues(spark, sf):
    """Matched items whose required basis no cited code satisfies."""
    good = matching.satisfied_bases(derived(spark, sf, "d_cited"), rules(spark, sf))
    return matching.basis_issues(matched(spark, sf, ()), good).select("report_id", "item", "rule_pos")


def missing_lists(spark, sf, found):
    """Missing and conditional items: (report_id, kind, name, pos)."""
    open_ = matching.unmatched_rules(reports(spark, sf), rules(spark, sf), found)
    return open_.select("report_id", "kind", "name", F.col("rule_pos").alias("pos"))


def compliance_lists(spark, sf, found=None):
    """All compliance lists in one long table: (report_id, kind, name, pos)."""
    found = matched(spark, sf, ("method",)) if found is None else found
    good = matching.satisfied_bases(derived(spark, sf, "d_cited"), rules(spark, sf))
    methods = matching.method_issues(found)
    bases = matching.basis_issues(found, good)
    named = lambda df, kind: df.select("report_id", F.lit(kind).alias("kind"), F.col("item").alias("name"), F.col("rule_pos").alias("pos"))
    return missing_lists(spark, sf, found).unionByName(named(methods, "method")).unionByName(named(bases, "basis"))


LISTS = f"""
{ISSUES},
lists AS (SELECT report_id, kind, name, rule_pos AS pos FROM open_rule UNION ALL SELECT report_id, 'method', item, rule_pos FROM method_issue UNION ALL SELECT report_id, 'basis', item, rule_pos FROM basis_issue),
cnt AS (SELECT report_id, count(*) FILTER (kind = 'missing') AS n_missing, count(*) FILTER (kind = 'conditional') AS n_conditional, count(*) FILTER (kind = 'method') AS n_method, count(*) FILTER (kind = 'basis') AS n_basis, 0 AS n_indicator FROM lists GROUP BY 1),
five AS (SELECT report_id, string_agg(name, ', ' ORDER BY rn) AS names FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pos, name) AS rn FROM lists WHERE kind = 'missing') WHERE rn <= 5 GROUP BY 1),
three AS (SELECT report_id, string_agg(name, ', ' ORDER BY rn) AS names FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pos, name) AS rn FROM lists WHERE kind = 'conditional') WHERE rn <= 3 GROUP BY 1),
status AS (SELECT r.report_id, CASE WHEN r.food_name = '' THEN 'unknown' WHEN ruled.category IS NULL THEN 'warning' WHEN coalesce(n_missing, 0) > 0 THEN 'fail' WHEN coalesce(n_conditional, 0) + coalesce(n_method, 0) + coalesce(n_basis, 0) > 0 THEN 'warning' ELSE 'pass' END AS status,
   CASE WHEN r.food_name = '' THEN '缺少食品名称，无法查询细则' WHEN ruled.category IS NULL THEN '未能获取''' || r.food_name || '''的检验项目，请检查知识库内容' ELSE concat_ws('|',
     CASE WHEN n_conditional > 0 THEN '有条件检测项目未核实 (' || CAST(n_conditional AS VARCHAR) || '项): ' || three.names || CASE WHEN n_conditional > 3 THEN '...' ELSE '' END END,
     CASE WHEN n_missing > 0 THEN '缺少必检项目: ' || five.names || CASE WHEN n_missing > 5 THEN '...' ELSE '' END END,
     CASE WHEN n_method > 0 THEN '存在检测方法不一致 (' || CAST(n_method AS VARCHAR) || '项)' END,
     CASE WHEN n_basis > 0 THEN '存在判定依据不一致 (' || CAST(n_basis AS VARCHAR) || '项)' END) END AS issues
   FROM d_report r SEMI JOIN rep_list USING (report_id) LEFT JOIN (SELECT DISTINCT category FROM rule1) ruled ON ruled.category = r.category LEFT JOIN cnt USING (report_id) LEFT JOIN five ON five.report_id = r.report_id LEFT JOIN three ON three.report_id = r.report_id)
"""


def statuses(spark, sf):
    found = matched(spark, sf, ("method",))
    counts = rules(spark, sf).groupBy("category").agg(F.count("*").alias("n_required"))
    named = derived(spark, sf, "d_report").select("report_id", "food_name").join(reports(spark, sf), "report_id").join(counts, "category", "left")
    return compliance.compliance_status(named, compliance_lists(spark, sf, found))


@query("a4_a21_compliance_status", f"WITH {LISTS} SELECT report_id, status, issues FROM status")
def compliance_status(spark, sf):
    """Compliance status and messages per report."""
    return statuses(spark, sf).select("report_id", "status", F.array_join("issues", "|").alias("issues"))


@query("k9_first_names", f"WITH {LISTS} SELECT * FROM five")
def first_names(spark, sf):
    """The first five missing names of each report."""
    from millaudit.operators.common import first_names as few

    lists = missing_lists(spark, sf, matched(spark, sf, ())).where("kind = 'missing'")
    return few(lists, "report_id", "name", [F.col("pos"), F.col("name")], 5)


@query("a7_item_summary", f"""WITH {MATCHED}, l AS (SELECT report_id, 'matched' AS kind, name FROM matched UNION ALL SELECT report_id, kind, name FROM open_rule UNION ALL SELECT report_id, 'extra', item FROM extra),
  d AS (SELECT l.*, CASE (report_id + length(name)) % 4 WHEN 0 THEN 'condition_met' WHEN 1 THEN 'condition_not_applicable' WHEN 2 THEN 'rejected' END AS decision FROM l)
  SELECT report_id, count(*) FILTER (kind <> 'extra') AS n_required, count(*) FILTER (kind = 'matched' OR (kind = 'conditional' AND decision = 'condition_met')) AS n_matched, count(*) FILTER (kind = 'missing') AS n_missing,
   count(*) FILTER (kind = 'conditional' AND decision = 'condition_met') AS n_condition_met, count(*) FILTER (kind = 'conditional' AND decision = 'condition_not_applicable') AS n_not_applicable,
   count(*) FILTER (kind = 'conditional' AND decision = 'rejected') AS n_rejected, count(*) FILTER (kind = 'conditional' AND decision IS NULL) AS n_open, count(*) FILTER (kind = 'extra') AS n_extra FROM d GROUP BY 1""")
def item_summary(spark, sf):
    """Counts of matched, missing, conditional and extra items with decisions."""
    lists = item_lists(spark, sf)
    return review.item_summary(lists, decisions(lists))


def item_lists(spark, sf, found=None, known=None):
    known = stored(spark, pairs(spark, sf), "pairs") if known is None else known
    found = matched(spark, sf, (), known) if found is None else found
    open_ = matching.unmatched_rules(reports(spark, sf), rules(spark, sf), found)
    extra = matching.extra_items(last_reported(spark, sf, ()), known)
    return (
        found.select("report_id", F.lit("matched").alias("kind"), "name")
        .unionByName(open_.select("report_id", "kind", "name"))
        .unionByName(extra.select("report_id", F.lit("extra").alias("kind"), F.col("item").alias("name")))
    )


def decisions(lists):
    """Human decisions for conditional items, by report and name."""
    at = (F.col("report_id") + F.length("name")) % 4
    decision = F.when(at == 0, "condition_met").when(at == 1, "condition_not_applicable").when(at == 2, "rejected")
    return lists.where("kind = 'conditional'").select("report_id", F.col("name").alias("key"), decision.alias("decision")).where("decision IS NOT NULL")


@query("j14_accepted_conditions", f"""WITH {MATCHED} SELECT report_id, name, condition FROM open_rule WHERE kind = 'conditional' AND (report_id + length(name)) % 4 = 0""")
def accepted_conditions(spark, sf):
    """Conditional items a person accepted and that no table shows yet."""
    found = matched(spark, sf, ())
    open_ = matching.unmatched_rules(reports(spark, sf), rules(spark, sf), found).where("kind = 'conditional'")
    return review.accepted_conditions(open_, decisions(open_), found.select("report_id", "name")).select("report_id", "name", "condition")


@query("a9_evidence_pages", f"WITH {MATCHED}, p AS (SELECT DISTINCT report_id, source_page FROM matched) SELECT report_id, string_agg(CAST(source_page AS VARCHAR), ',' ORDER BY source_page) AS pages FROM p GROUP BY 1")
def evidence_pages(spark, sf):
    return review.evidence_pages(matched(spark, sf, ())).select("report_id", F.array_join("pages", ",").alias("pages"))


@query("f45_match_badges", f"""WITH {MATCHED} SELECT match_type, CASE WHEN match_type = 'exact' THEN '精确匹配' WHEN coalesce(condition, '') <> '' THEN '条件匹配' ELSE '模糊匹配' END AS badge, count(*) AS n FROM matched GROUP BY ALL""")
def match_badges(spark, sf):
    return matched(spark, sf, ()).groupBy("match_type", review.match_badge("match_type", "condition").alias("badge")).agg(F.count("*").alias("n"))


@query("a8_unified_basis", """WITH r AS (SELECT category, item_name, arg_min(standard_basis, pos) AS standard_basis FROM d_rule GROUP BY 1, 2),
  u AS (SELECT category, string_agg(DISTINCT trim(standard_basis), ' ' ORDER BY trim(standard_basis)) AS u FROM r WHERE regexp_matches(trim(standard_basis), '(?i)^GB') GROUP BY 1)
  SELECT r.category, item_name, CASE WHEN standard_basis <> '' THEN standard_basis ELSE coalesce(u, '') END AS required_basis FROM r LEFT JOIN u USING (category)""")
def unified_basis(spark, sf):
    """Required basis of every rule: its own or the category's distinct ones."""
    return matching.with_unified_basis(rules(spark, sf)).select("category", "item_name", "required_basis")


@query("f1_f6_name_forms", f"""WITH {PAIRS} SELECT category, report_name, core, comp AS composite, syn AS synonym, array_to_string(parts, '|') AS parts FROM rep""")
def name_forms(spark, sf):
    """Normal form, composite flag, synonym and parts of every reported name."""
    names = derived(spark, sf, "d_item").select("category", F.col("item").alias("report_name")).distinct()
    staged = names.withColumn("core", name_core("report_name"))
    return staged.select(
        "category", "report_name", "core", is_composite("core").alias("composite"), composite_synonym("core").alias("synonym"),
        F.array_join(name_parts("core"), "|").alias("parts"),
    )


@query("w12_first_items", """SELECT report_id, item, value, line, part, supp, unit FROM (SELECT *, row_number() OVER (PARTITION BY report_id, item, value ORDER BY line, part, supp, price) AS rn FROM d_item) WHERE rn = 1""")
def first_items(spark, sf):
    """First of equal (item, value) per report."""
    rows = derived(spark, sf, "d_item").select("report_id", "line", "part", "supp", "price", "item", "value", "unit")
    return lines.first_items(rows, ["line", "part", "supp", "price"]).drop("price")


@query("w13_last_items", """WITH i AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY line, part, supp, price) AS pos FROM d_item)
  SELECT report_id, category, item, arg_max(value, pos) AS value, arg_max(method, pos) AS method, arg_min(part, pos) AS first_part FROM i GROUP BY 1, 2, 3""")
def last_items(spark, sf):
    """Last value of a name at its first place."""
    return last_reported(spark, sf).select("report_id", "category", "item", "value", "method", F.col("pos.part").alias("first_part"))


@query("u3_evidence_fillers", f"""WITH {MATCHED} SELECT report_id, name AS item, report_name, required_basis, CASE WHEN cited THEN report_standard ELSE '未查到' END AS standard_value, CASE WHEN cited THEN report_unit ELSE '–' END AS standard_unit FROM (SELECT *, EXISTS (SELECT 1 FROM d_cited c WHERE c.report_id = matched.report_id AND starts_with(c.code, matched.required_basis || '-')) AND required_basis <> '' AS cited FROM matched)""")
def evidence_fillers(spark, sf):
    """One evidence row per matched item; those whose basis the report does not cite have none and say not found."""
    found = matched(spark, sf, ("standard", "unit"))
    codes_ = by_report(derived(spark, sf, "d_cited").select("report_id", F.regexp_extract("code", "^(.*)-", 1).alias("required_basis"))).distinct()
    evidence = found.where("required_basis <> ''").join(codes_, ["report_id", "required_basis"], "left_semi").select(
        "report_id", F.col("name").alias("item"), F.col("report_standard").alias("standard_value"), F.col("report_unit").alias("standard_unit")
    )
    return compliance.with_fillers(found, evidence)


@query("f41_query_codes", f"""WITH {MATCHED}, f AS (SELECT report_id, arg_min(code, {{'a': pos, 'b': code}}) AS first_code FROM d_cited GROUP BY 1)
  SELECT m.report_id, m.name, CASE WHEN regexp_matches(trim(required_basis), '[0-9]') THEN trim(required_basis) ELSE coalesce(first_code, '') END AS query_code FROM matched m LEFT JOIN f USING (report_id)""")
def query_codes(spark, sf):
    """Code each matched item's limit is looked up with."""
    first = derived(spark, sf, "d_cited").groupBy("report_id").agg(F.min(F.struct("pos", "code")).alias("f")).select("report_id", F.col("f.code").alias("first_code"))
    return matched(spark, sf, ()).join(first, "report_id", "left").select(
        "report_id", "name", codes.query_code("required_basis", "first_code").alias("query_code")
    )


@query("f42_method_tokens", """WITH d AS (SELECT DISTINCT test_method FROM d_rule WHERE test_method <> '')
  SELECT test_method, regexp_extract(test_method, '^(GB [0-9.]+ 第[^ ]*)', 1) AS tokens FROM d""")
def method_tokens(spark, sf):
    """Required methods as tokens: code and ordinal together."""
    distinct = derived(spark, sf, "d_rule").where("test_method <> ''").select("test_method").distinct()
    return distinct.select("test_method", F.array_join(codes.required_method_tokens("test_method"), "|").alias("tokens"))


@query("w16_section_numbers", f"""WITH {MATCHED}, l AS (SELECT report_id, 'matched' AS kind, name, rule_pos AS pos, 0 AS s FROM matched UNION ALL SELECT report_id, kind, name, rule_pos, CASE kind WHEN 'missing' THEN 1 ELSE 2 END FROM open_rule)
  SELECT report_id, kind, name, row_number() OVER (PARTITION BY report_id ORDER BY s, pos) AS no FROM l""")
def section_numbers(spark, sf):
    """Row numbers over the matched, missing and conditional sections of a report."""
    found = matched(spark, sf, ())
    open_ = matching.unmatched_rules(reports(spark, sf), rules(spark, sf), found)
    lists = found.select("report_id", F.lit("matched").alias("kind"), "name", F.col("rule_pos").alias("pos")).unionByName(
        open_.select("report_id", "kind", "name", F.col("rule_pos").alias("pos"))
    )
    return review.numbered_sections(lists).select("report_id", "kind", "name", "no")
