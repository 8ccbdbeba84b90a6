"""Retrieval, chunk choices and limits found in chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millaudit import fixed_values as V
from millaudit.operators import limits, retrieval as R
from millaudit.plans import sql_parts as S
from millaudit.plans.derived import derived
from millaudit.plans.registry import query
from millaudit.session import table

_WORDS = "list_filter(string_split_regex(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13))), '\\s+'), lambda w: w <> '')"


def three_words(c):
    return R.word_grams(c, 3)


def document_chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")


def benchmark_questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


_HITS = f"""WITH qw AS (SELECT item_id, {_WORDS.format(c='text')} AS w FROM benchmark), cw AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents),
 q AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM qw)),
 c AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM cw)),
 n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
 s AS (SELECT q.item_id AS question_id, c.doc_id AS chunk_id, count(*) / max(n.n) AS score FROM q JOIN c USING (g) JOIN n ON n.item_id = q.item_id GROUP BY 1, 2),
 hit AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s)
"""


@query("k1_top_chunks", _HITS + "SELECT question_id, chunk_id, score, rank FROM hit WHERE rank <= 30")
def top_chunks(spark, sf):
    """Best 30 documents for every benchmark passage, by shared runs of three words."""
    return R.top_chunks(benchmark_questions(spark, sf), document_chunks(spark, sf), three_words, 30)


@query("a15_result_counts", _HITS + "SELECT question_id, count(*) AS n FROM hit WHERE rank <= 30 GROUP BY 1")
def result_counts(spark, sf):
    return top_chunks(spark, sf).groupBy("question_id").agg(F.count("*").alias("n"))


@query("k2_p11_on_target", _HITS + """, t AS (SELECT h.*, d.source, d.lang FROM hit h JOIN documents d ON d.doc_id = h.chunk_id WHERE rank <= 30 AND contains(replace('doc ' || d.source, ' ', ''), '1')),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM t) SELECT question_id, chunk_id, score, place FROM r WHERE place <= 8""")
def on_target(spark, sf):
    """The first eight hits whose document name holds a number."""
    from millaudit.operators.common import first_k

    hits = R.with_chunks(top_chunks(spark, sf), document_chunks(spark, sf))
    named = hits.where(R.in_document(F.concat(F.lit("doc "), F.col("source")), F.lit("1"))).withColumnRenamed("rank", "found")
    return first_k(named, ["question_id"], [F.asc("found")], 8).select("question_id", "chunk_id", "score", F.col("rank").alias("place"))


@query("k1_nearest_chunks", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  u AS (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(generate_series(1, 64)) AS i FROM e) GROUP BY 1, 2),
  q AS (SELECT label, list(x ORDER BY i) AS c FROM u GROUP BY 1),
  s AS (SELECT q.label AS question_id, e.vec_id AS chunk_id, round(list_cosine_similarity(q.c, e.v), 9) AS score FROM q, e),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s)
  SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def nearest_chunks(spark, sf):
    """Ten nearest vectors to the mean vector of every label, exact cosine."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    mean = F.array(*[F.avg(F.get("vector", F.lit(i))) for i in range(64)])
    questions = vectors.groupBy("label").agg(mean.alias("vector")).withColumnRenamed("label", "question_id")
    found = R.nearest_chunks(questions, vectors.select("chunk_id", "vector"), 10)
    return found.withColumn("score", F.round("score", 6))


@query("j6_food_categories", f"""WITH f AS (SELECT DISTINCT food_name FROM d_report), k AS (SELECT * FROM {S.category_values()}),
  m AS (SELECT food_name, cats, row_number() OVER (PARTITION BY food_name ORDER BY length(kw) DESC, kw_pos) AS rn FROM f JOIN k ON contains(food_name, kw))
  SELECT r.report_id, coalesce(m.cats, r.food_name) AS categories FROM d_report r LEFT JOIN m ON m.food_name = r.food_name AND rn = 1""")
def food_categories(spark, sf):
    """Categories of the food of every report."""
    return derived(spark, sf, "d_report").select("report_id", F.array_join(R.food_categories("food_name"), "|").alias("categories"))


@query("f35_questions", f"""WITH k AS (SELECT * FROM {S.category_values()}), f AS (SELECT DISTINCT food_name FROM d_report),
  m AS (SELECT food_name, string_split(cats, '|')[1] AS cat, row_number() OVER (PARTITION BY food_name ORDER BY length(kw) DESC, kw_pos) AS rn FROM f JOIN k ON contains(food_name, kw)),
  n AS (SELECT f.food_name, CASE WHEN EXISTS (SELECT 1 FROM k WHERE kw = f.food_name) THEN f.food_name ELSE coalesce(m.cat, f.food_name) END AS q FROM f LEFT JOIN m ON m.food_name = f.food_name AND rn = 1)
  SELECT r.report_id, q || ' 检验项目表 必检项目 限量指标' AS inspection, q || ' 依据法律法规 判定依据 标准' AS basis, q || ' 检测方法 检验方法 国标方法' AS method, r.food_name || '检验项目' AS items FROM d_report r JOIN n USING (food_name)""")
def questions(spark, sf):
    """Question texts for every report."""
    return derived(spark, sf, "d_report").select(
        "report_id", *[R.food_question("food_name", k).alias(k) for k in ["inspection", "basis", "method"]],
        R.lookup_question("items", "food_name").alias("items"),
    )


def _rule_hits(spark, sf):
    """Hits per order, built from its line items."""
    li = table(spark, sf, "lineitem")
    p = F.col("l_partkey")
    return li.select(
        F.col("l_orderkey").alias("subject"),
        F.when(F.col("l_linestatus") == "O", "direct").otherwise("category").alias("variant"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ["l_linenumber", "l_partkey", "l_suppkey"]]).alias("chunk_id"),
        F.round(F.col("l_discount") * 10).alias("score"), (p % 40).cast("int").alias("page_num"),
        F.when(p % 3 == 0, "<TABLE>x</TABLE>").otherwise("文字").alias("content"), (p % 2 == 0).alias("on_target"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("position"),
    )


@query("k2_k3_k4_rule_chunks", """WITH h AS (SELECT l_orderkey AS subject, l_linestatus = 'O' AS direct, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS chunk_id, round(l_discount * 10) AS score, l_partkey % 40 AS page, l_partkey % 3 = 0 AS tab, l_partkey % 2 = 0 AS tgt,
     l_linenumber AS a, l_partkey AS b, l_suppkey AS c, l_extendedprice AS d FROM lineitem),
  dd AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, a, b, c, d) AS rk FROM h WHERE direct AND tgt),
  ca AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, a, b, c, d) AS rk FROM h x WHERE NOT direct AND (tgt OR NOT EXISTS (SELECT 1 FROM h y WHERE y.subject = x.subject AND NOT y.direct AND y.tgt))),
  u AS (SELECT * FROM dd WHERE rk <= 8 UNION ALL SELECT * FROM ca WHERE rk <= 8),
  g AS (SELECT subject, bool_or(tab) FILTER (direct) AS dt, count(*) FILTER (NOT direct) AS nc FROM u GROUP BY 1),
  w AS (SELECT u.*, coalesce(dt, false) OR (dt IS NOT NULL AND nc = 0) AS usd FROM u JOIN g USING (subject)),
  t AS (SELECT *, first_value(page) OVER (PARTITION BY subject ORDER BY CASE WHEN tab THEN 0 ELSE 1 END, rk ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS anchor FROM w WHERE usd = direct),
  n AS (SELECT *, anchor = 0 OR abs(page - anchor) <= 10 AS near FROM t), m AS (SELECT *, bool_or(near) OVER (PARTITION BY subject) AS any_near FROM n)
  SELECT subject, chunk_id, score, rk AS rank, CAST(anchor AS INT) AS anchor_page FROM m WHERE near OR NOT any_near""")
def rule_chunks(spark, sf):
    """Chunks the rules of a subject are read from: fallback question, table retry, pages near the anchor."""
    return R.rule_chunks(_rule_hits(spark, sf)).select("subject", "chunk_id", "score", "rank", "anchor_page")


def _lookup_rows(spark, sf):
    """Chunks per lookup (one per order), built from its items."""
    i = derived(spark, sf, "d_item")
    part = F.col("part")
    text = F.when(part % 5 == 0, F.concat(F.lit("铅 限量≤0."), part.cast("string"), F.lit(" 蔬菜"))).when(
        part % 5 == 1, F.concat(F.lit("铅 0.5 mg/kg 应符合"), part.cast("string"))
    ).when(part % 5 == 2, F.concat(F.lit("铅 应符合表 "), (part % 7).cast("string"), F.lit("的规定"))).when(part % 5 == 3, "铅含量").otherwise("其他")
    return i.select(
        F.col("report_id").alias("lookup_id"), F.struct("line", "part", "supp", "price").alias("position"), text.alias("content"),
        F.lit("铅（以Pb计）").alias("item"), F.array(F.lit("叶菜类蔬菜"), F.lit("蔬菜")).alias("categories"), part.alias("chunk_id"),
    )


_PRIORITY = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY line, part, supp, price) AS rn, CASE part % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE 5 END AS priority FROM d_item),
  b AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY priority, rn) AS k FROM r)"""


@query("k5_best_chunks", _PRIORITY + " SELECT report_id AS lookup_id, priority, part AS chunk_id FROM b WHERE k = 1")
def best_chunks(spark, sf):
    """Best chunk of every lookup by the priority rules."""
    return R.best_chunks(R.chunk_priorities(_lookup_rows(spark, sf))).select("lookup_id", "priority", "chunk_id")


@query("k5_described_chunks", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY line, part, supp, price) AS rn, CASE part % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE 5 END AS priority FROM d_item),
  t AS (SELECT report_id, arg_min(part % 7, rn) AS table_no FROM r WHERE part % 5 = 2 GROUP BY 1),
  e AS (SELECT report_id, priority, rn, part AS chunk_id FROM r UNION ALL SELECT report_id, 3, 1, -table_no FROM t WHERE table_no % 2 = 0),
  b AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY priority, rn) AS k FROM e) SELECT report_id AS lookup_id, priority, chunk_id FROM b WHERE k = 1""")
def described_chunks(spark, sf):
    """The same with the tables description pages point to (found for even table numbers)."""
    rows = R.chunk_priorities(_lookup_rows(spark, sf))
    tables = R.described_tables(rows).withColumn("n", F.col("table_no").cast("long")).where("n % 2 = 0")
    at = F.struct(F.lit(1).alias("line"), (-F.col("n")).alias("part"), F.lit(0).cast("long").alias("supp"), F.lit(0.0).alias("price"))
    hits = tables.select("lookup_id", at.alias("position"), F.lit("<table>铅</table>").alias("content"), (-F.col("n")).alias("chunk_id"))
    hits = hits.withColumn("position", F.col("position").cast(rows.schema["position"].dataType))
    return R.best_chunks(rows, hits).select("lookup_id", "priority", "chunk_id")


@query("k6_first_level", """WITH r AS (SELECT report_id AS lookup_id, part, line, supp, price, part % 4 AS level FROM d_item), l AS (SELECT lookup_id, min(level) AS m FROM r GROUP BY 1)
  SELECT lookup_id, level, count(*) AS n FROM r JOIN l USING (lookup_id) WHERE level = m GROUP BY 1, 2""")
def first_level(spark, sf):
    """Rows of the first question level that found any."""
    rows = derived(spark, sf, "d_item").select(F.col("report_id").alias("lookup_id"), (F.col("part") % 4).alias("level"))
    return R.first_level(rows, "lookup_id").groupBy("lookup_id", "level").agg(F.count("*").alias("n"))


def _lookups(spark, sf):
    """Lookups: one per distinct (rule item, basis)."""
    rule = derived(spark, sf, "d_rule")
    code = F.when(F.col("pos") % 2 == 0, "GB 2763-2021").otherwise("GB 10767")
    table_no = F.when(F.col("pos") % 3 == 0, F.col("pos").cast("string"))
    query_text = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("查"), F.col("item_name")))
    return rule.select(
        F.col("pos").alias("lookup_id"), F.concat(F.lit("铅"), F.col("item_name")).alias("item"), F.lit("黄瓜").alias("food"),
        R.food_categories(F.lit("黄瓜")).alias("categories"), code.alias("query_code"), table_no.alias("table_no"), query_text.alias("cfg_query"),
    )


@query("k6_question_ladder", """WITH l AS (SELECT pos AS lookup_id, '铅' || item_name AS item, pos % 2 = 0 AS pest, CASE WHEN pos % 3 = 0 THEN '表' || CAST(pos AS VARCHAR) END AS tab, CASE WHEN pos % 5 = 0 THEN '查' || item_name END AS cfg FROM d_rule),
  p AS (SELECT lookup_id, list_concat(CASE WHEN tab IS NOT NULL THEN [tab || ' 瓜类蔬菜'] ELSE [] END, [item || ' 瓜类蔬菜 限量', item || ' 黄瓜 限量', item || ' 蔬菜 限量']) AS qs FROM l WHERE pest
   UNION ALL SELECT lookup_id, list_concat([coalesce(tab, cfg, item), item || ' 黄瓜'], CASE WHEN regexp_replace(item, '[^\\x{4e00}-\\x{9fa5}]', '', 'g') <> item THEN [regexp_replace(item, '[^\\x{4e00}-\\x{9fa5}]', '', 'g')] ELSE [] END) FROM l WHERE NOT pest)
  SELECT lookup_id, unnest(qs) AS question, generate_subscripts(qs, 1) - 1 AS level FROM p""")
def question_ladder(spark, sf):
    """All questions of every lookup, in order."""
    return R.question_ladder(_lookups(spark, sf))


@query("j9_configured_queries", """WITH c AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN '黄瓜' WHEN p_partkey % 3 = 1 THEN '蔬菜' ELSE '瓜类蔬菜' END AS category, p_name AS item, min(p_partkey) AS k FROM part GROUP BY 1, 2),
  l AS (SELECT p_partkey AS lookup_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '铅' || 'bk' END AS item FROM part),
  m AS (SELECT l.lookup_id, c.k, row_number() OVER (PARTITION BY l.lookup_id ORDER BY CASE c.category WHEN '瓜类蔬菜' THEN 0 WHEN '黄瓜' THEN 1 ELSE 2 END) AS rn FROM l JOIN c ON c.item = l.item)
  SELECT lookup_id, 'q' || CAST(k AS VARCHAR) AS query, 'GB ' || CAST(k AS VARCHAR) AS standard FROM m WHERE rn = 1 UNION ALL SELECT p_partkey, 'q铅', 'GB 2762' FROM part WHERE p_partkey % 2 = 1""")
def configured_queries(spark, sf):
    """Configured question of every lookup: categories in order, then the food; name, then its bare form."""
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    category = F.when(k % 3 == 0, "黄瓜").when(k % 3 == 1, "蔬菜").otherwise("瓜类蔬菜")
    config = part.groupBy(category.alias("category"), F.col("p_name").alias("item")).agg(F.min("p_partkey").alias("k")).select(
        "category", "item", F.concat(F.lit("q"), F.col("k").cast("string")).alias("query"), F.concat(F.lit("GB "), F.col("k").cast("string")).alias("standard")
    )
    lead = spark.createDataFrame([("蔬菜", "铅", "q铅", "GB 2762")], config.schema)
    lookups = part.select(
        k.alias("lookup_id"), F.when(k % 2 == 0, F.col("p_name")).otherwise("铅bk").alias("item"), F.lit("黄瓜").alias("food"),
        R.food_categories(F.lit("黄瓜")).alias("categories"),
    )
    return R.configured_queries(lookups, config.unionByName(lead))


@query("j24_contents_tables", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY line, part, supp, price) AS rn, part % 40 AS page FROM d_item),
  m AS (SELECT report_id, rn, CASE part % 4 WHEN 0 THEN CAST(100 + part % 800 AS VARCHAR) WHEN 1 THEN CAST(part % 50 AS VARCHAR) WHEN 2 THEN CAST(100 + part % 90 AS VARCHAR) END AS t FROM c WHERE page BETWEEN 1 AND 30)
  SELECT report_id AS lookup_id, arg_min(t, rn) AS table_no FROM m WHERE t IS NOT NULL GROUP BY 1""")
def contents_tables(spark, sf):
    """Table number of an item from contents pages, three spellings."""
    part = F.col("part")
    item = F.lit("毒死蜱(a.b)")
    n3 = (100 + part % 800).cast("string")
    content = (
        F.when(part % 4 == 0, F.concat(F.lit("目次 4."), n3, F.lit(" "), item))
        .when(part % 4 == 1, F.concat(item, F.lit(" ...... 4."), (part % 50).cast("string")))
        .when(part % 4 == 2, F.concat(item, F.lit(" ...... "), (100 + part % 90).cast("string"))).otherwise("毒死蜱 4.5")
    )
    rows = derived(spark, sf, "d_item").select(
        F.col("report_id").alias("lookup_id"), item.alias("item"), F.struct("line", "part", "supp", "price").alias("position"),
        (part % 40).cast("int").alias("page_num"), content.alias("content"),
    )
    return R.contents_table(rows)


@query("p13_p14_chunk_kinds", """SELECT part % 5 AS kind, count(*) AS n, part % 5 = 0 AS contents, part % 5 = 1 AS description, CASE WHEN part % 5 = 1 THEN CAST(part % 9 AS VARCHAR) WHEN part % 5 = 2 THEN CAST(part % 9 AS VARCHAR) END AS table_no, part % 5 IN (2, 3) AS has_table FROM d_item GROUP BY ALL""")
def chunk_kinds(spark, sf):
    """Contents chunks, description pages and table marks."""
    from millaudit.functions import html

    part = F.col("part")
    content = (
        F.when(part % 5 == 0, "4.12 毒死蜱 4.13乐果").when(part % 5 == 1, F.concat(F.lit("铅应符合表 "), (part % 9).cast("string"), F.lit(" 的规定")))
        .when(part % 5 == 2, F.concat(F.lit("铅应符合表"), (part % 9).cast("string"), F.lit("的规定<TABLE></TABLE>")))
        .when(part % 5 == 3, "4.1毒死蜱 4.2乐果 <table> ≤ 0.5").otherwise("4.1 毒死蜱")
    )
    rows = derived(spark, sf, "d_item").select((part % 5).alias("kind"), content.alias("content"))
    return rows.groupBy(
        "kind", R.is_contents_chunk("content").alias("contents"), R.is_description("content").alias("description"),
        R.described_table("content").alias("table_no"), html.has_table("content").alias("has_table"),
    ).agg(F.count("*").alias("n"))


@query("p7_p12_structured_chunks", """SELECT source, lang, count(*) AS n, count(*) FILTER (contains(text, source) OR contains(text, 'que ') OR contains(text, 'the ')) AS named FROM documents GROUP BY 1, 2""")
def structured_chunks(spark, sf):
    """Documents naming a subject or a category word."""
    rows = document_chunks(spark, sf).withColumn("categories", F.array(F.lit("que "), F.lit("the ")))
    return rows.groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.count_if(R.is_structured("content", "source", "categories")).alias("named")
    )


@query("p23_confirmed_sections", """WITH h AS (SELECT report_id AS subject, supp % 3 AS section_pos, l.discount AS score, line, part, supp, price FROM d_item JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount AS discount FROM lineitem) l ON l_orderkey = report_id AND l_linenumber = line AND l_partkey = part AND l_suppkey = supp AND l_extendedprice = price),
  g AS (SELECT *, row_number() OVER (PARTITION BY subject, section_pos ORDER BY line, part, supp, price) AS rn FROM h WHERE score >= 0.04),
  c AS (SELECT subject, min(section_pos) AS p FROM g WHERE rn <= 3 AND part % 4 = 0 GROUP BY 1)
  SELECT r.report_id AS subject, CASE WHEN c.p IS NOT NULL THEN '节' || CAST(c.p AS VARCHAR) WHEN r.report_id % 10 = 0 THEN r.food_name ELSE '节0' END AS section FROM d_report r LEFT JOIN c ON c.subject = r.report_id""")
def confirmed_sections(spark, sf):
    """Section confirmed by a good chunk, else the first candidate, else the food."""
    li = table(spark, sf, "lineitem")
    pos = F.col("l_suppkey") % 3
    section = F.concat(F.lit("节"), pos.cast("string"))
    hits = li.select(
        F.col("l_orderkey").alias("subject"), pos.alias("section_pos"), section.alias("section"), F.col("l_discount").alias("score"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("position"),
        F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("产品种类 "), section)).otherwise("无").alias("content"),
    )
    sections = F.when(F.col("report_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("节0"), F.lit("节1"), F.lit("节2")))
    subjects = derived(spark, sf, "d_report").select(F.col("report_id").alias("subject"), F.col("food_name").alias("food"), sections.alias("sections"))
    return R.confirmed_section(hits, subjects, least=0.04)


@query("k7_sampled_names", """WITH n AS (SELECT p_brand AS query_code, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
  SELECT query_code, pos, k FROM n WHERE pos % greatest(1, CAST(floor(n / 4) AS BIGINT)) = 0 AND pos < 6 * greatest(1, CAST(floor(n / 4) AS BIGINT))""")
def sampled_names(spark, sf):
    """Every n-th name of a group, at most six."""
    from millaudit.operators.common import block_positions

    rows = table(spark, sf, "part").select(F.col("p_brand").alias("query_code"), F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 50_000).alias("block"))
    names = block_positions(rows, ["query_code"], ["block"], ["k"], "pos")
    return R.sampled_names(names.select("query_code", "k", (F.col("pos") - 1).cast("long").alias("pos")))


@query("f36_chunk_records", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type END AS content, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 7 END END AS page_num, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE p_retailprice END AS score FROM part""")
def chunk_records(spark, sf):
    """Raw chunks with content from three fields and the page from positions, two fields or 1."""
    k = F.col("p_partkey")
    raw = table(spark, sf, "part").select(
        F.when(k % 3 == 0, F.col("p_name")).otherwise("").alias("content"), F.when(k % 3 == 1, F.col("p_brand")).alias("content_with_weight"),
        F.col("p_type").alias("content_ltks"), F.when(k % 4 != 0, F.col("p_retailprice")).alias("similarity"),
        k.cast("string").alias("id"), F.lit(None).cast("string").alias("chunk_id"), F.col("p_brand").alias("document_keyword"),
        F.lit("").alias("docnm_kwd"), F.lit("").alias("document_id"),
        F.when(k % 2 == 0, F.array(F.array(F.col("p_size").cast("double"), F.lit(1.0)))).otherwise(F.array().cast("array<array<double>>")).alias("positions"),
        F.when(k % 5 == 0, 0).otherwise(7).alias("page_num"), F.lit(None).cast("int").alias("page_num_int"),
    )
    return R.chunk_records(raw).select(F.col("chunk_id").cast("long").alias("p_partkey"), "content", "page_num", "score")


@query("s14_document_chunks", """SELECT doc_id AS chunk_id, source AS document_id, 1.0 AS score FROM documents WHERE source = 'src3'""")
def document_export(spark, sf):
    """All chunks of one document (source), each with score 1."""
    chunks = document_chunks(spark, sf).withColumnRenamed("source", "document_id")
    return R.document_chunks(chunks, "src3").select("chunk_id", "document_id", "score")


@query("a12_combined_texts", """WITH p AS (SELECT doc_id, source, text, n_chars % 7 AS page, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN n_chars % 7 = 0 THEN 999 ELSE n_chars % 7 END, doc_id) - 1 AS pos FROM documents)
  SELECT source AS query_code, CAST(min(page) FILTER (page > 0) AS INT) AS page_num, sum(length(text)) + 2 * (count(*) FILTER (text <> '') - 1) AS n_chars, arg_min(CAST(doc_id AS VARCHAR), pos) AS doc_name FROM p GROUP BY 1""")
def combined_texts(spark, sf):
    """Documents of a source joined in page order, with lowest page and first document."""
    from millaudit.operators.common import block_positions

    page = (F.col("n_chars") % 7).cast("int")
    chunks = table(spark, sf, "documents").select(
        "source", "doc_id", F.col("text").alias("content"), page.alias("page_num"), R.page_order(page).alias("place"), F.floor(F.col("doc_id") / 50_000).alias("block")
    )
    chunks = block_positions(chunks, ["source"], ["place", "block"], ["doc_id"], "position").withColumn("position", F.col("position") - 1)
    chunks = chunks.select(F.col("source").alias("query_code"), "position", "content", "page_num", F.col("doc_id").cast("string").alias("doc_name"))
    parts = R.combined_text(chunks, part=1000)
    return parts.groupBy("query_code").agg(
        F.min("page_num").alias("page_num"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("n_chars"), F.min("doc_name").alias("doc_name")
    )


def _food_chunks(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    content = F.concat(
        F.lit("甲胺磷 <table><tr><th>食品类别</th><th>最大残留限量(mg/L)</th></tr><tr><td>水果</td><td>9</td></tr></table> 铅 "),
        F.when(k % 4 == 0, "").otherwise("说明"), F.lit("<table><tr><th>食品类别</th><th>限量"), F.when(k % 2 == 0, "（μg/kg）").otherwise(""),
        F.lit("</th></tr><tr><td>水果"), size, F.lit("</td><td>1</td></tr><tr><td>叶菜类蔬菜</td><td>—</td></tr><tr><td>"),
        F.when(k % 3 == 0, "其他").otherwise("各种蔬菜"), F.lit("</td><td>0."), size, F.lit("</td></tr></table>"),
    )
    return table(spark, sf, "part").select(
        k.alias("k"), content.alias("content"), F.lit("铅（以Pb计）").alias("item"), F.array(F.lit("叶菜类蔬菜"), F.lit("蔬菜")).alias("categories"),
        F.lit("GB 2762-2017").alias("query_code"),
    )


@query("j18_limits_by_food", """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'μg/kg' ELSE 'mg/kg' END AS standard_unit, CASE WHEN p_partkey % 3 = 0 THEN '未查到' ELSE '0.' || CAST(p_size AS VARCHAR) END AS standard_value FROM part""")
def limits_by_food(spark, sf):
    """Limits of limit standards: the table behind the item name, the row of the food's category."""
    return limits.limits_by_food(_food_chunks(spark, sf)).select("k", "standard_unit", "standard_value")


def _item_chunks(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    unit_column = k % 3 == 0
    content = F.concat(
        F.lit("<table><tr><th>项目</th>"), F.when(unit_column, "<th>单位</th>").otherwise(""),
        F.when(k % 3 == 1, "<th>最小值（g/100kJ）</th>").otherwise("<th>最小值</th>"), F.lit("<th>最大值</th></tr><tr><td>蛋白质</td>"),
        F.when(unit_column, "<td>g</td>").otherwise(""), F.lit("<td>9</td><td>99</td></tr><tr><td>"), F.col("p_name"), F.lit("（以干基计）</td>"),
        F.when(unit_column, "<td>mg</td>").otherwise(""), F.lit("<td>0."), size, F.when(k % 3 == 2, " mg/100g").otherwise(""), F.lit("</td><td>"),
        F.when(k % 2 == 0, "—").otherwise("8"), F.lit("</td></tr></table>"),
    )
    return table(spark, sf, "part").select(
        k.alias("k"), content.alias("content"), F.when(k % 5 == 0, "无此项").otherwise(F.col("p_name")).alias("item"),
        F.array(F.lit("乳制品")).alias("categories"), F.lit("GB 10767-2021").alias("query_code"),
    )


_J19 = """SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN '–' WHEN p_partkey % 3 = 0 THEN 'mg' WHEN p_partkey % 3 = 1 THEN 'g/100kJ' ELSE 'mg/' END AS standard_unit,
  CASE WHEN p_partkey % 5 = 0 THEN '未查到' ELSE '0.' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ~ 8' END END AS standard_value FROM part"""


@query("j19_limits_by_item", _J19)
def limits_by_item(spark, sf):
    """Limits of product standards: the row of the item, its unit and first two values."""
    return limits.limits_by_item(_item_chunks(spark, sf)).select("k", "standard_unit", "standard_value")


@query("j18_j19_f52_limit_fields", f"""{_J19} UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'μg/kg' ELSE 'mg/kg' END, CASE WHEN p_partkey % 3 = 0 THEN '未查到' ELSE '0.' || CAST(p_size AS VARCHAR) END FROM part
  UNION ALL SELECT p_partkey, 'mg/kg', '≤' || CAST(p_size AS VARCHAR) FROM part""")
def limit_fields(spark, sf):
    """All three ways of finding a limit in a chunk."""
    plain = table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), F.concat(F.lit("铅（mg/kg） ≤"), F.col("p_size").cast("string")).alias("content"), F.lit("铅").alias("item"),
        F.array(F.lit("蔬菜")).alias("categories"), F.lit("GB 2762").alias("query_code"),
    )
    rows = _item_chunks(spark, sf).unionByName(_food_chunks(spark, sf)).unionByName(plain)
    return limits.limit_fields(rows).select("k", "standard_unit", "standard_value")


@query("j20_limit_texts", """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '0.' || CAST(p_size AS VARCHAR) || ' mg/L' WHEN 1 THEN CAST(p_size AS VARCHAR) || ' mg/kg' WHEN 2 THEN '≤' || CAST(p_size AS VARCHAR) || ' ppm' WHEN 3 THEN CAST(p_size AS VARCHAR) || ' %' ELSE '未找到限量值' END AS limit_text FROM part""")
def limit_texts(spark, sf):
    """Limit texts on three levels: food row, any row, running text."""
    at, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    content = (
        F.when(at == 0, F.concat(F.lit("<table><tr><th>作物</th><th>最大限量(mg/L)</th></tr><tr><td>蔬菜</td><td>0."), size, F.lit("</td></tr></table>")))
        .when(at == 1, F.concat(F.lit("<table><tr><th>作物</th><th>值</th></tr><tr><td>甲</td><td>蔬菜"), size, F.lit("</td></tr></table>")))
        .when(at == 2, F.concat(F.lit("说明\n蔬菜 ≤"), size, F.lit(" ppm\n其他")))
        .when(at == 3, F.concat(F.lit("水果 "), size, F.lit("%"))).otherwise("无")
    )
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), content.alias("content"), F.array(F.lit("叶菜"), F.lit("蔬菜")).alias("categories"))
    return limits.limit_text_by_food(rows).select("k", "limit_text")


@query("j25_corrected_pages", """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 80 WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 1 THEN 262 ELSE p_size END AS page_num FROM part""")
def corrected_pages(spark, sf):
    """Fixed pages of known items of one standard."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        k.alias("k"), F.when(k % 2 == 0, "GB 2763-2021").otherwise("GB 2762").alias("gb_code"),
        F.when(k % 3 == 0, "哒螨灵").when(k % 3 == 1, "乐果").otherwise("其他").alias("item"), F.col("p_size").alias("page_num"),
    )
    return limits.corrected_pages(rows).select("k", "page_num")


@query("e5_lookup_questions", """SELECT p_partkey AS k, p_name || '检测方法' AS methods, 'GB ' || CAST(p_size AS VARCHAR) AS standard, p_brand || ' ' || p_name || ' 标准限量 指标要求' AS limit_question, 'GB 2763 ' || p_name || ' 标准限量 指标要求' AS indicator FROM part""")
def lookup_questions(spark, sf):
    """Question texts of the lookup requests."""
    none = F.lit(None).cast("string")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), R.lookup_question("methods", "p_name").alias("methods"),
        R.lookup_question("standard", F.col("p_size").cast("string")).alias("standard"),
        R.lookup_question("limit", "p_brand", "p_name").alias("limit_question"), R.lookup_question("indicator", none, "p_name").alias("indicator"),
    )


@query("e5_method_lookup", """WITH g AS (SELECT DISTINCT p_name, replace(p_name, ' ', '') || '检测方法' AS t FROM part), q AS (SELECT DISTINCT p_name, substr(t, CAST(i AS INT), 3) AS gram FROM (SELECT p_name, t, unnest(generate_series(1, length(t) - 2)) AS i FROM g)),
  n AS (SELECT p_name, count(*) AS n FROM q GROUP BY 1), d AS (SELECT p_partkey, replace(p_name, ' ', '') || '检测方法' || CAST(p_size AS VARCHAR) AS t FROM part WHERE p_partkey IS NOT NULL),
  c AS (SELECT DISTINCT p_partkey, substr(t, CAST(i AS INT), 3) AS gram FROM (SELECT p_partkey, t, unnest(generate_series(1, length(t) - 2)) AS i FROM d)),
  s AS (SELECT q.p_name, c.p_partkey AS chunk_id, count(*) / max(n.n) AS score FROM q JOIN c USING (gram) JOIN n ON n.p_name = q.p_name GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, chunk_id) AS rank FROM s)
  SELECT p_name, chunk_id, score, rank FROM r WHERE rank <= 30""")
def method_lookup(spark, sf):
    """Chunks answering 'which methods test this item', for every item name."""
    part = table(spark, sf, "part")
    chunks = part.select(F.col("p_partkey").alias("chunk_id"), F.concat(F.col("p_name"), F.lit(" 检测方法"), F.col("p_size").cast("string")).alias("content"))
    hits = R.lookup(part, "methods", ["p_name"], chunks, lambda c: R.char_grams(c, 3), 30)
    return hits.select("p_name", "chunk_id", "score", "rank")


@query("e5_lookups", """WITH a AS (SELECT 'items' AS kind, p_name || '检验项目' AS question FROM part UNION SELECT 'standard', 'GB ' || CAST(p_size AS VARCHAR) FROM part
   UNION SELECT 'limit', p_brand || ' ' || p_name || ' 标准限量 指标要求' FROM part UNION SELECT 'indicator', 'GB 2763 ' || p_name || ' 标准限量 指标要求' FROM part),
  t AS (SELECT *, lower(replace(question, ' ', '')) AS t FROM a), q AS (SELECT DISTINCT kind, question, substr(t, CAST(i AS INT), 3) AS gram FROM (SELECT *, unnest(generate_series(1, length(t) - 2)) AS i FROM t)),
  n AS (SELECT kind, question, count(*) AS n FROM q GROUP BY 1, 2), d AS (SELECT p_partkey, lower(replace(p_name || '检验项目标准限量指标要求' || p_brand || 'GB' || CAST(p_size AS VARCHAR), ' ', '')) AS t FROM part),
  c AS (SELECT DISTINCT p_partkey, substr(t, CAST(i AS INT), 3) AS gram FROM (SELECT p_partkey, t, unnest(generate_series(1, length(t) - 2)) AS i FROM d)),
  s AS (SELECT kind, question, p_partkey AS chunk_id, count(*) AS shared FROM q JOIN c USING (gram) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY kind, question ORDER BY shared DESC, chunk_id) AS rank FROM s)
  SELECT kind, question, chunk_id, shared / n AS score, rank FROM r JOIN n USING (kind, question) WHERE rank <= 10""")
def lookups(spark, sf):
    """The lookups of required items, standards, limits and indicators, each with its ten best chunks."""
    part = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    content = F.concat(F.col("p_name"), F.lit(" 检验项目 标准限量 指标要求 "), F.col("p_brand"), F.lit(" GB "), size)
    chunks = part.select(F.col("p_partkey").alias("chunk_id"), content.alias("content"))
    names = part.select("p_name", "p_brand", size.alias("size"), F.lit(None).cast("string").alias("code"))
    asked = {"items": ["p_name"], "standard": ["size"], "limit": ["p_brand", "p_name"], "indicator": ["code", "p_name"]}
    hits = [
        R.lookup(names, kind, columns, chunks, lambda c: R.char_grams(c, 3), 10).select(F.lit(kind).alias("kind"), "question", "chunk_id", "score", "rank")
        for kind, columns in asked.items()
    ]
    return reduce(DataFrame.unionByName, hits)
