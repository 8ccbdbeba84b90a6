"""Report lines and tables: flat views, fields by priority, cited standards, items."""

from __future__ import annotations

from pyspark.sql import functions as F

from millaudit.functions import text as T
from millaudit.operators import compliance, lines
from millaudit.plans.derived import derived
from millaudit.plans.registry import query
from millaudit.session import table

NO_TABLES = "array<array<array<string>>>"


def document_pages(spark, sf):
    """One page per document: its text lines."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("report_id"), F.lit(1).alias("page"), F.split("text", "\n").alias("text_lines"),
        F.array().cast(NO_TABLES).alias("tables"),
    )


def report_pages(spark, sf):
    """One page per report with the usual lines and a table, built from the derived report rows."""
    o, food, day = F.col("report_id"), F.col("food_name"), F.col("production_date")
    name_line = (
        F.when(o % 3 == 0, F.concat(F.lit(" 样品名称："), food, F.lit("生产单位：甲厂")))
        .when(o % 3 == 1, F.concat(F.lit("样品名称 "), food)).otherwise(F.lit("受检单位：乙厂"))
    )
    day_line = F.when(o % 5 < 2, F.concat(F.lit("生产日期："), day)).otherwise(F.lit("抽样地点：市场"))
    code = F.concat(F.lit("GB "), (2000 + o % 50).cast("string"), F.lit("-2021"))
    method = F.concat(F.lit("GB/T "), (5000 + o % 30).cast("string"))
    text_lines = F.array(
        F.lit("检 验 报 告"), name_line, day_line, F.lit(""), F.lit("  检验结论：见下"),
        F.concat(F.lit("所检项目符合"), code, F.lit("《第"), (o % 50).cast("string"), F.lit("号限量》、"), method, F.lit("要求。")),
        F.concat(F.lit("方法 GB 1"), (100 + o % 9).cast("string")),
        F.when(o % 4 == 0, F.lit("结论：合格")).otherwise(F.lit("备注")), F.lit("一"), F.lit("二"), F.lit("三"), F.lit("四"),
        F.when(o % 4 == 0, F.lit("符合 GB 77-2001")).otherwise(F.lit("五")), F.lit("六"),
        F.when(o % 5 == 4, F.concat(F.lit("到货 "), day)).otherwise(F.lit("七")),
    )
    title = F.when(o % 5 == 4, "到货").otherwise("生产/加工日期")
    head = F.array(
        F.array(F.lit("编号"), F.lit("样品名称"), title), F.array(F.lit("1"), food, F.when(o % 5 == 4, F.lit("-")).otherwise(day))
    )
    items = F.array(
        F.array(*[F.lit(x) for x in ["序号", "检验项目", "计量单位", "标准要求", "实测值", "单项判定", "检验方法"]]),
        F.array(F.lit("1"), F.concat(F.lit("维生素K\n"), (o % 3).cast("string")), F.lit("mg/kg"), F.lit("≤5"), (o % 9).cast("string"), F.lit("合格"), F.lit("GB 5009.158\n第一法")),
        F.array(F.lit("2"), F.lit("硝酸盐(以NaNO 计)\n3"), F.lit(None).cast("string"), F.lit("≤200"), F.lit("未检出"), F.lit("合格"), F.lit("")),
        F.array(F.lit("3"), F.concat(F.lit("维生素K\n"), (o % 3).cast("string")), F.lit("g"), F.lit("≤6"), (o % 2).cast("string"), F.lit("合格"), F.lit("GB 1")),
        F.array(F.lit("4"), F.lit(""), F.lit("mg"), F.lit(""), F.lit(""), F.lit(""), F.lit("x")),
    )
    return derived(spark, sf, "d_report").select("report_id", F.lit(1).alias("page"), text_lines.alias("text_lines"), F.array(head, items).alias("tables"))


_LINES = """l0 AS (SELECT doc_id AS report_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
 lines AS (SELECT report_id, trim(raw, ' ' || chr(9) || chr(13)) AS line, row_number() OVER (PARTITION BY report_id ORDER BY n) - 1 AS line_no FROM l0 WHERE trim(raw, ' ' || chr(9) || chr(13)) <> '')"""


@query("s2_report_lines", f"WITH {_LINES} SELECT report_id, 1 AS page, line_no, line FROM lines")
def report_lines(spark, sf):
    """Non-empty stripped lines of all documents."""
    return lines.report_lines(document_pages(spark, sf))


@query("s3_report_cells", """WITH r AS (SELECT report_id, food_name, production_date AS d FROM d_report),
  c AS (SELECT report_id, 0 AS table_no, 0 AS row_no, 0 AS col_no, '编号' AS cell FROM r UNION ALL SELECT report_id, 0, 0, 1, '样品名称' FROM r UNION ALL SELECT report_id, 0, 0, 2, CASE WHEN report_id % 5 = 4 THEN '到货' ELSE '生产/加工日期' END FROM r
   UNION ALL SELECT report_id, 0, 1, 0, '1' FROM r UNION ALL SELECT report_id, 0, 1, 1, food_name FROM r UNION ALL SELECT report_id, 0, 1, 2, CASE WHEN report_id % 5 = 4 THEN '-' ELSE d END FROM r),
  m AS (SELECT r.report_id AS o, x.* FROM d_report r JOIN (VALUES (0, 0, '序号'), (0, 1, '检验项目'), (0, 2, '计量单位'), (0, 3, '标准要求'), (0, 4, '实测值'), (0, 5, '单项判定'), (0, 6, '检验方法'), (1, 0, '1'), (1, 1, '维生素K' || chr(10) || '?3'), (1, 2, 'mg/kg'), (1, 3, '≤5'), (1, 4, '?9'), (1, 5, '合格'), (1, 6, 'GB 5009.158' || chr(10) || '第一法'),
    (2, 0, '2'), (2, 1, '硝酸盐(以NaNO 计)' || chr(10) || '3'), (2, 2, NULL), (2, 3, '≤200'), (2, 4, '未检出'), (2, 5, '合格'), (2, 6, ''), (3, 0, '3'), (3, 1, '维生素K' || chr(10) || '?3'), (3, 2, 'g'), (3, 3, '≤6'), (3, 4, '?2'), (3, 5, '合格'), (3, 6, 'GB 1'), (4, 0, '4'), (4, 1, ''), (4, 2, 'mg'), (4, 3, ''), (4, 4, ''), (4, 5, ''), (4, 6, 'x')) AS x(row_no, col_no, cell) ON true)
  SELECT * FROM c UNION ALL SELECT o, 1, row_no, col_no, replace(replace(replace(cell, '?3', CAST(o % 3 AS VARCHAR)), '?9', CAST(o % 9 AS VARCHAR)), '?2', CAST(o % 2 AS VARCHAR)) FROM m""")
def report_cells(spark, sf):
    """Cells of all tables of each report."""
    return lines.report_cells(report_pages(spark, sf)).drop("page")


_TRIGGER, _BASIS, _CODE = ["que ", "the "], ["en,", "in,", "an."], "[A-Z][a-z]{5,}"


@query("w1_look_ahead_codes", f"""WITH {_LINES},
  t AS (SELECT *, CASE WHEN contains(line, 'que ') OR contains(line, 'the ') THEN line_no END AS own, contains(line, 'en,') OR contains(line, 'in,') OR contains(line, 'an.') AS basis FROM lines),
  w AS (SELECT *, min(own) OVER (PARTITION BY report_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS back FROM t),
  o AS (SELECT report_id, line_no AS "at", line, CASE WHEN basis AND back IS NOT NULL THEN back ELSE own END AS opened FROM w),
  c AS (SELECT report_id, opened, "at", unnest(regexp_extract_all(line, '{_CODE}')) AS code, generate_subscripts(regexp_extract_all(line, '{_CODE}'), 1) - 1 AS occurrence FROM o WHERE opened IS NOT NULL),
  f AS (SELECT *, row_number() OVER (PARTITION BY report_id, code ORDER BY opened, "at", occurrence) AS rn FROM c)
  SELECT report_id, code, opened, "at", occurrence FROM f WHERE rn = 1""")
def look_ahead_codes(spark, sf):
    """The look-ahead window over all document lines, with prose words for triggers, basis words and codes."""
    found = lines.cited_codes(document_pages(spark, sf), _TRIGGER, _BASIS, lambda c: F.regexp_extract_all(c, F.lit(_CODE), 0))
    return found.select("report_id", "code", "opened", "at", "occurrence")


@query("w1_cited_codes", """SELECT report_id, 'GB ' || CAST(2000 + report_id % 50 AS VARCHAR) || '-2021' AS code FROM d_report UNION ALL SELECT report_id, 'GB/T ' || CAST(5000 + report_id % 30 AS VARCHAR) FROM d_report
  UNION ALL SELECT report_id, 'GB 77-2001' FROM d_report WHERE report_id % 4 = 0""")
def cited_codes(spark, sf):
    """Codes of the conclusion passages of all reports."""
    return lines.cited_codes(report_pages(spark, sf)).select("report_id", "code")


@query("w2_codes_with_title", """SELECT report_id, 'GB ' || CAST(2000 + report_id % 50 AS VARCHAR) || '-2021' AS code, '第' || CAST(report_id % 50 AS VARCHAR) || '号限量' AS title FROM d_report
  UNION ALL SELECT report_id, 'GB/T ' || CAST(5000 + report_id % 30 AS VARCHAR), NULL FROM d_report
  UNION ALL SELECT report_id, 'GB 1' || CAST(100 + report_id % 9 AS VARCHAR), CASE WHEN report_id % 4 = 0 THEN '结论：合格 一 二' ELSE '备注 一 二' END FROM d_report
  UNION ALL SELECT report_id, 'GB 77-2001', NULL FROM d_report WHERE report_id % 4 = 0""")
def codes_with_title(spark, sf):
    """Codes and titles of the conclusion windows."""
    return lines.cited_codes_with_title(report_pages(spark, sf)).select("report_id", "code", "title")


@query("w3_production_dates", """SELECT report_id, production_date, CASE WHEN report_id % 5 < 2 THEN 1 WHEN report_id % 5 = 4 THEN 3 ELSE 2 END AS level FROM d_report""")
def production_dates(spark, sf):
    """Production date texts by keyword line, table column, any line."""
    return lines.production_dates(report_pages(spark, sf))


@query("w3_any_line", f"""WITH {_LINES}, m AS (SELECT report_id, line_no, regexp_extract(line, '[A-Z][a-z]+ing', 0) AS v, contains(line, 'tion') AS k FROM lines),
  c AS (SELECT report_id, v, CASE WHEN k THEN 1 ELSE 3 END AS level, line_no FROM m WHERE v <> ''),
  f AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY level, line_no) AS rn FROM c)
  SELECT d.doc_id AS report_id, f.v AS production_date, f.level FROM documents d LEFT JOIN f ON f.report_id = d.doc_id AND rn = 1""")
def any_line(spark, sf):
    """The same priority rule over document lines with prose words."""
    return lines.production_dates(document_pages(spark, sf), ["tion"], "[A-Z][a-z]+ing")


@query("w4_food_names", """SELECT report_id, nullif(food_name, '') AS food_name, CASE WHEN food_name = '' THEN NULL WHEN report_id % 3 = 2 THEN 2 ELSE 1 END AS level FROM d_report""")
def food_names(spark, sf):
    """Food names by line, then table column."""
    return lines.food_names(report_pages(spark, sf))


@query("w5_conclusions", """SELECT report_id, CASE WHEN report_id % 4 = 0 THEN '合格' ELSE '合格' END AS conclusion, CASE WHEN report_id % 4 = 0 THEN 1 ELSE 2 END AS level FROM d_report""")
def conclusions(spark, sf):
    """Conclusions by keyword line, table cell, any line."""
    return lines.conclusions(report_pages(spark, sf))


@query("f18_inspection_items", """WITH r AS (SELECT report_id AS o FROM d_report),
 i AS (SELECT o, 1 AS n, '维生素K' || CAST(o % 3 AS VARCHAR) AS item, CAST(o % 9 AS VARCHAR) AS value, 'mg/kg' AS unit, '≤5' AS standard, 'GB 5009.158第一法' AS method FROM r
  UNION ALL SELECT o, 2, '硝酸盐(以NaNO3计)', '未检出', '', '≤200', '' FROM r UNION ALL SELECT o, 3, '维生素K' || CAST(o % 3 AS VARCHAR), CAST(o % 2 AS VARCHAR), 'g', '≤6', 'GB 1' FROM r),
 f AS (SELECT *, row_number() OVER (PARTITION BY o, item, value ORDER BY n) AS rn FROM i)
 SELECT o AS report_id, item, value, unit, standard, method FROM f WHERE rn = 1""")
def inspection_items(spark, sf):
    """Items of all report tables: roles by title, repaired subscripts, first of equal items."""
    return lines.inspection_items(report_pages(spark, sf)).select("report_id", "item", "value", "unit", "standard", "method")


@query("p1_field_issues", """WITH s AS (SELECT r.report_id, r.food_name, CASE WHEN r.report_id % 4 = 3 THEN '' ELSE r.production_date END AS d, (SELECT count(*) FROM d_cited c WHERE c.report_id = r.report_id) AS nc, (SELECT count(*) FROM d_item i WHERE i.report_id = r.report_id) AS ni FROM d_report r)
  SELECT report_id, '缺少食品名称' AS issue FROM s WHERE food_name = '' UNION ALL SELECT report_id, '缺少生产日期' FROM s WHERE d = '' UNION ALL SELECT report_id, '缺少国标号' FROM s WHERE nc = 0 UNION ALL SELECT report_id, '未检测到检验项目表格' FROM s WHERE ni = 0""")
def field_issues(spark, sf):
    """Missing required fields of all reports."""
    return lines.field_issues(_summary(spark, sf)).select("report_id", "issue")


def _summary(spark, sf):
    n_codes = derived(spark, sf, "d_cited").groupBy("report_id").agg(F.count("*").alias("n_codes"))
    n_items = derived(spark, sf, "d_item").groupBy("report_id").agg(F.count("*").alias("n_items"))
    dated = F.when(F.col("report_id") % 4 == 3, "").otherwise(F.col("production_date"))
    return (
        derived(spark, sf, "d_report").select("report_id", "food_name", dated.alias("production_date"))
        .join(n_codes, "report_id", "left").join(n_items, "report_id", "left")
    )


@query("p24_gates", """WITH s AS (SELECT r.report_id, r.food_name, CASE WHEN r.report_id % 4 = 3 THEN '' ELSE r.production_date END AS d, (SELECT count(*) FROM d_cited c WHERE c.report_id = r.report_id) AS nc, (SELECT count(*) FROM d_item i WHERE i.report_id = r.report_id) AS ni FROM d_report r)
  SELECT report_id, d <> '' AND nc > 0 AS run_standards, food_name <> '' AND ni > 0 AS run_compliance FROM s""")
def gates(spark, sf):
    return compliance.gated(_summary(spark, sf)).select("report_id", "run_standards", "run_compliance")


@query("p2_valid_names", f"""WITH {_LINES} SELECT line, NOT (length(line) < 2 OR length(line) > 50 OR regexp_matches(line, '^[0-9\\s]+$') OR regexp_matches(line, '^[A-Za-z\\s]+$')) AS valid, count(*) AS n FROM lines GROUP BY ALL""")
def valid_names(spark, sf):
    """Name check over all document lines."""
    rows = lines.report_lines(document_pages(spark, sf)).groupBy("line").agg(F.count("*").alias("n"))
    return rows.select("line", lines.valid_food_name("line").alias("valid"), "n")


@query("p3_until_label", """SELECT report_id, food_name AS value FROM d_report""")
def until_label(spark, sf):
    """Values cut at the next field label."""
    labels = ["生产单位", "商标", "规格型号", "批号"]
    tail = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("report_id") % 4 + 1).cast("int"))
    merged = F.concat(F.col("food_name"), F.lit("（"), tail, F.lit("：某某"))
    return derived(spark, sf, "d_report").select("report_id", lines.until_next_label(merged).alias("value"))


@query("p4_basis_lines", f"""WITH {_LINES} SELECT report_id, count(*) AS n_lines, count(*) FILTER (contains(line, 'en,') OR contains(line, 'in,') OR contains(line, 'an.')) AS n_basis FROM lines GROUP BY 1""")
def basis_lines(spark, sf):
    """Lines with a basis word, per document (prose words)."""
    rows = lines.report_lines(document_pages(spark, sf))
    return rows.groupBy("report_id").agg(F.count("*").alias("n_lines"), F.count_if(T.contains_any("line", _BASIS)).alias("n_basis"))


@query("f17_cell_lines", """SELECT doc_id, coalesce(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')), 0) AS n, replace(text, chr(10), '') <> '' AS any_text FROM documents""")
def cell_lines(spark, sf):
    """Cleaned lines of multi-line cells (whole document texts)."""
    return table(spark, sf, "documents").select(
        "doc_id", F.size(T.cell_lines("text")).cast("long").alias("n"), (T.joined_cells(T.cell_lines("text"), "") != "").alias("any_text")
    )


@query("f16_repaired_cells", """SELECT p_partkey, '维生素' || upper(substr(p_name, 1, 1)) || CAST(p_size AS VARCHAR) || '片 剂' AS cell FROM part""")
def repaired_cells(spark, sf):
    """Wrapped subscripts back behind their letter."""
    raw = F.concat(F.lit(" 维生素"), F.upper(F.substring("p_name", 1, 1)), F.lit("\n"), F.col("p_size").cast("string"), F.lit("\n片  剂"))
    return table(spark, sf, "part").select("p_partkey", T.repaired_cell(raw).alias("cell"))
