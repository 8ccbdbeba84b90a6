"""HTML rule tables: flattening and required items."""

from __future__ import annotations

from pyspark.sql import functions as F

from millaudit.functions import html
from millaudit.functions.text import without_bracket_blanks
from millaudit.operators import matching, rule_tables
from millaudit.plans.derived import derived
from millaudit.plans.registry import query
from millaudit.session import table


def _td(*cells):
    return F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit('<td class="c">'), c, F.lit("</td>"))], F.lit("</tr>\n"))


def _line_chunks(spark, sf):
    """One small table per line item."""
    head = F.lit('前文 <TABLE border="1"><tr><th>名称</th><th>数量</th><th>名称</th></tr>')
    c = lambda x: F.col(x).cast("string")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.concat(
            head, _td(F.concat(F.lit("项目&lt;"), c("l_partkey"), F.lit(">\n")), c("l_suppkey"), F.lit("b&amp;c")),
            _td(F.lit(" "), F.lit(""), F.lit("")), _td(c("l_linenumber"), F.concat(F.lit("<b>"), c("l_returnflag"), F.lit("</b>")), F.lit("尾"), F.lit("多")),
            F.lit("</TABLE>后文"),
        ).alias("content"),
    )
    return rows


_T1 = """WITH c AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, l_returnflag AS f FROM lineitem)
  SELECT o, l, p, s, 1 AS row_no, 0 AS col_no, '名称' AS header, '项目<' || CAST(p AS VARCHAR) || '>' AS text FROM c UNION ALL SELECT o, l, p, s, 1, 1, '数量', CAST(s AS VARCHAR) FROM c UNION ALL SELECT o, l, p, s, 1, 2, '名称', 'b&c' FROM c
  UNION ALL SELECT o, l, p, s, 3, 0, '名称', CAST(l AS VARCHAR) FROM c UNION ALL SELECT o, l, p, s, 3, 1, '数量', f FROM c UNION ALL SELECT o, l, p, s, 3, 2, '名称', '尾' FROM c"""


@query("t1_html_cells", _T1)
def html_cells(spark, sf):
    """All cells of all tables: one built table per line item, read back."""
    return rule_tables.html_cells(_line_chunks(spark, sf)).drop("table_no")


@query("t1_html_row_maps", """SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, 1 AS row_no, 'b&c' AS name, CAST(l_suppkey AS VARCHAR) AS quantity FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 3, '尾', l_returnflag FROM lineitem""")
def html_row_maps(spark, sf):
    """Rows as maps; of equal headers the last value stays."""
    rows = rule_tables.html_row_maps(_line_chunks(spark, sf))
    return rows.select("o", "l", "p", "s", "row_no", F.col("row")["名称"].alias("name"), F.col("row")["数量"].alias("quantity"))


@query("t2_simple_rows", """SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) AS row_text FROM lineitem""")
def simple_rows(spark, sf):
    """Plain rows without attributes."""
    content = F.concat(F.lit("<table><tr><td>"), F.col("l_partkey").cast("string"), F.lit("</td><td>"), F.col("l_suppkey").cast("string"), F.lit("</td></tr><tr></tr></table>"))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.explode(html.simple_rows(content)).alias("r"),
    )
    return rows.select("o", "l", "p", "s", F.array_join("r", "|").alias("row_text"))


def rule_chunks(spark, sf):
    """One rule table per part, with every kind of row the extraction tells apart."""
    p = F.col("p_partkey")
    n, size = p.cast("string"), F.col("p_size").cast("string")
    blank = F.lit("")
    basis, method = F.concat(F.lit("GB "), size, F.lit(" GB "), size), F.concat(F.lit("GB 5009."), size)
    no = lambda k: F.lit(str(k))
    content = F.concat(
        F.lit("<p>四、肉制品 检验项目</p><table><tr><th>序号</th><th>检验项目</th><th>依据法律法规或标准</th><th>检测方法</th></tr>"),
        _td(no(0), F.when(p % 2 == 0, F.concat(F.lit("适用于第"), n, F.lit("类"))).otherwise(F.lit("备注说明")), blank, blank),
        _td(no(1), F.concat(F.lit("1 蛋白质甲"), n, F.when(p % 3 == 0, "b").otherwise("")), basis, method),
        _td(no(2), F.concat(F.lit("限"), F.col("p_brand"), F.lit("产品")), blank, blank),
        _td(no(3), F.lit("甜蜜素（以环己"), blank, blank),
        _td(no(4), F.concat(F.lit("基氨基"), n, F.lit("磺酸计）ck")), F.lit("GB 2760"), F.lit("GB 5009.97")),
        _td(no(5), F.lit("阿维菌素 哒螨灵"), F.lit("GB2763 GB2763.1"), F.lit("GB 23200.19 GB 23200.20 GB 23200.121")),
        _td(no(6), F.lit("反式脂肪酸与总脂肪 酸比值"), blank, method),
        _td(no(7), F.lit("（续）"), blank, blank),
        _td(no(8), F.lit("铁"), blank, F.when(p % 4 == 0, method).otherwise(blank)),
        _td(no(9), F.lit("GB 10767"), blank, blank),
        _td(no(10), F.concat(F.lit("b. 限第"), size, F.lit("种")), blank, blank),
        _td(no(11), F.lit("注：c. 仅限冷藏产品"), blank, blank),
        F.lit("</table>"),
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), content.alias("content"))


ITEMS = """WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS n, CAST(p_size AS VARCHAR) AS size, p_brand FROM part),
 i AS (SELECT k AS chunk_id, '蛋白质甲' || n AS item_name, CASE WHEN k % 3 = 0 THEN '限第' || size || '种；' WHEN k % 2 = 0 THEN '适用于第' || n || '类；' ELSE '' END || '限' || p_brand || '产品' AS condition, 'GB ' || size AS standard_basis, 'GB 5009.' || size AS test_method, CASE WHEN k % 3 = 0 THEN 'b' ELSE '' END AS footnote_keys FROM p
  UNION ALL SELECT k, '甜蜜素（以环己基氨基' || n || '磺酸计）', '仅限冷藏产品', 'GB 2760', 'GB 5009.97', 'ck' FROM p
  UNION ALL SELECT k, '阿维菌素', CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN '适用于第' || n || '类' ELSE '' END, 'GB2763', 'GB 23200.19', '' FROM p
  UNION ALL SELECT k, '哒螨灵', CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN '适用于第' || n || '类' ELSE '' END, 'GB2763.1', 'GB 23200.20 GB 23200.121', '' FROM p
  UNION ALL SELECT k, '反式脂肪酸与总脂肪酸比值', '', '', 'GB 5009.' || size, '' FROM p
  UNION ALL SELECT k, '铁', '', '', CASE WHEN k % 4 = 0 THEN 'GB 5009.' || size ELSE '' END, '' FROM p) """


@query("t4_t5_required_items", ITEMS + "SELECT chunk_id, item_name, condition, standard_basis, test_method, footnote_keys FROM i")
def required_items(spark, sf):
    """Required items of all rule tables: numbering, footnotes, carried names, bound conditions, merged names."""
    return rule_tables.required_items(rule_chunks(spark, sf)).select(
        "chunk_id", "item_name", "condition", "standard_basis", "test_method", "footnote_keys"
    )


@query("t3_footnotes", """SELECT p_partkey AS chunk_id, 'b' AS letter, '限第' || CAST(p_size AS VARCHAR) || '种' AS text FROM part UNION ALL SELECT p_partkey, 'c', '仅限冷藏产品' FROM part""")
def footnotes(spark, sf):
    """Footnote definitions of all rule tables."""
    return rule_tables.footnotes(rule_chunks(spark, sf))


@query("w11_visible_footnotes", """WITH c AS (SELECT p_type AS t, p_brand AS b, p_partkey AS k, p_size, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) - 1 AS place, place // 8 AS g, place % 8 + 1 AS chunk_rank, 'abcdefgh'[CAST(1 + p_partkey % 4 AS INT)] AS own FROM part),
   top AS (SELECT * FROM c),
   d AS (SELECT t, b, g, chunk_rank, own AS letter, '定义' || CAST(k AS VARCHAR) AS text FROM top),
   v AS (SELECT x.t, x.b, x.g, x.chunk_rank, x.k, arg_max(d.text, d.chunk_rank) AS text FROM top x JOIN d ON d.t = x.t AND d.b = x.b AND d.g = x.g AND d.chunk_rank <= x.chunk_rank AND d.letter = 'b' GROUP BY ALL)
   SELECT top.t || '/' || top.b || '/' || CAST(top.g AS VARCHAR) AS question_id, top.chunk_rank, '指标项' || CAST(top.k AS VARCHAR) AS item_name, coalesce(v.text, '') AS condition FROM top LEFT JOIN v USING (t, b, g, chunk_rank)""")
def visible_footnotes(spark, sf):
    """Footnotes over the chunks of a question (eight each): later definitions win, earlier chunks do not see them."""
    from millaudit.operators.common import block_positions

    k = F.col("p_partkey").cast("string")
    letter = F.substring(F.lit("abcdefgh"), (1 + F.col("p_partkey") % 4).cast("int"), F.lit(1))
    content = F.concat(
        F.lit("<table><tr><th>检验项目</th></tr><tr><td>指标项"), k, F.lit("b</td></tr><tr><td>"), letter, F.lit(". 定义"), k, F.lit("</td></tr></table>"),
    )
    blocks = table(spark, sf, "part").withColumn("block", F.floor(F.col("p_partkey") / 50_000))
    parts = block_positions(blocks, ["p_type", "p_brand"], ["block"], ["p_partkey"], "rank")
    chunks = parts.select(F.concat_ws("/", "p_type", "p_brand", F.floor((F.col("rank") - 1) / 8).cast("string")).alias("question_id"),
        (1 + (F.col("rank") - 1) % 8).cast("int").alias("chunk_rank"), content.alias("content"))
    return rule_tables.question_items(chunks).select("question_id", "chunk_rank", "item_name", "condition")


@query("p9_reject_reasons", """WITH n AS (SELECT p_partkey, CASE p_partkey % 16 WHEN 0 THEN '或其盐' WHEN 1 THEN '与总脂肪酸比值' WHEN 2 THEN '酸比' WHEN 3 THEN '以铅计）' WHEN 4 THEN '备注' || CAST(p_size AS VARCHAR) WHEN 5 THEN '指标'
    WHEN 6 THEN CAST(p_size AS VARCHAR) WHEN 7 THEN 'GB ' || CAST(p_size AS VARCHAR) WHEN 8 THEN '4.1）' WHEN 9 THEN '蛋白质' WHEN 10 THEN 'DDT' WHEN 11 THEN p_name WHEN 12 THEN '铅（以Pb计）' WHEN 13 THEN '锌' WHEN 14 THEN '——' ELSE p_name || p_name || p_name || p_name || p_name || p_name || p_name || p_name END AS name, p_partkey % 3 = 0 AS has_other FROM part)
  SELECT p_partkey, name, CASE p_partkey % 16 WHEN 0 THEN 'fragment' WHEN 1 THEN 'ratio_remnant' WHEN 2 THEN 'short_ratio' WHEN 3 THEN 'bracket_remnant' WHEN 4 THEN 'forbidden_part' WHEN 5 THEN 'forbidden_word' WHEN 6 THEN CASE WHEN length(name) = 1 AND NOT has_other THEN 'single_char' ELSE 'digits' END
    WHEN 7 THEN 'standard' WHEN 8 THEN 'few_cjk' WHEN 11 THEN 'few_cjk' WHEN 13 THEN CASE WHEN has_other THEN NULL ELSE 'single_char' END WHEN 14 THEN 'symbols' WHEN 15 THEN CASE WHEN length(name) > 50 THEN 'too_long' ELSE 'few_cjk' END END AS reason FROM n""")
def reject_reasons(spark, sf):
    """Why rule rows are no items."""
    at = F.col("p_partkey") % 16
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    cases = [
        F.lit("或其盐"), F.lit("与总脂肪酸比值"), F.lit("酸比"), F.lit("以铅计）"), F.concat(F.lit("备注"), size), F.lit("指标"), size,
        F.concat(F.lit("GB "), size), F.lit("4.1）"), F.lit("蛋白质"), F.lit("DDT"), name, F.lit("铅（以Pb计）"), F.lit("锌"), F.lit("——"),
        F.repeat(name, 8),
    ]
    text = F.element_at(F.array(*cases), (at + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", text.alias("name"), (F.col("p_partkey") % 3 == 0).alias("has_other"))
    return rule_tables.rejected_rows(rows).drop("has_other")


@query("p8_conditions", """SELECT p_partkey, p_partkey % 7 IN (0, 1, 2, 5) AS is_condition FROM part""")
def conditions(spark, sf):
    """Condition sentences among rule rows."""
    at = F.col("p_partkey") % 7
    text = (
        F.when(at == 0, F.concat(F.lit("适用于"), F.col("p_name"))).when(at == 1, F.concat(F.lit("仅限"), F.col("p_name")))
        .when(at == 2, F.concat(F.lit("当产品含有"), F.col("p_name"), F.lit("时"))).when(at == 3, F.lit("限量值要求"))
        .when(at == 4, F.col("p_name")).when(at == 5, F.lit("以下三类产品除外")).otherwise(F.lit("限量"))
    )
    return table(spark, sf, "part").select("p_partkey", rule_tables.is_condition(text).alias("is_condition"))


@query("f15_f14_split_cells", """SELECT p_partkey, '亚硝酸盐 号|黄曲霉毒素M1 或黄曲霉 毒素B1' AS parts, '甜蜜素（以环己基' || replace(p_name, ' ', '') || '（甲乙）计） 尾' AS flat FROM part""")
def split_cells(spark, sf):
    """Cells naming several items, and blanks inside nested brackets."""
    merged = F.concat(F.lit("亚硝酸盐"), F.col("p_size").cast("string"), F.lit("号e 黄曲霉毒素M1 或黄曲霉 51 毒素B1"))
    bracketed = F.concat(F.lit("甜蜜素（以环己 基"), F.col("p_name"), F.lit("（甲 乙）计） 尾"))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(rule_tables.split_cell_items(merged), "|").alias("parts"), without_bracket_blanks(bracketed).alias("flat")
    )


@query("j13_footnote_conditions", """WITH k AS (SELECT p_partkey AS item_id, 'a' || CASE WHEN p_partkey % 2 = 0 THEN 'c' ELSE 'b' END || CASE WHEN p_partkey % 3 = 0 THEN 'z' ELSE '' END AS letters FROM part)
  SELECT item_id, '注0' || '；注' || CASE WHEN item_id % 2 = 0 THEN '2' ELSE '1' END AS condition FROM k""")
def footnote_conditions(spark, sf):
    """Footnote letters of all items to condition texts."""
    keys = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.lit("a"), F.when(F.col("p_partkey") % 2 == 0, "c").otherwise("b"), F.when(F.col("p_partkey") % 3 == 0, "z").otherwise("")).alias("letters"),
    )
    notes = table(spark, sf, "region").select(
        F.substring(F.lit("abcde"), F.col("r_regionkey") + 1, F.lit(1)).alias("letter"), F.concat(F.lit("注"), F.col("r_regionkey").cast("string")).alias("text")
    )
    return rule_tables.conditions_of(keys, notes)


@query("p17_first_rules", """SELECT category, item_name, min(pos) AS pos FROM d_rule GROUP BY 1, 2""")
def first_rules(spark, sf):
    """Required items without title rows, the first of each name."""
    titles = derived(spark, sf, "d_rule").withColumn("item_name", F.when(F.col("pos") % 2 == 0, "检验项目").otherwise(F.lit(" 序号 ")))
    both = derived(spark, sf, "d_rule").unionByName(titles)
    return matching.first_rule_items(both).select("category", "item_name", "pos")
