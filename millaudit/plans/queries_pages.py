"""Pages, labels, answers, text boxes and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millaudit.functions import answers as A, dates, html, labels as L, text as T
from millaudit.operators import answers, page_tables as P, standards
from millaudit.plans import sql_parts as S
from millaudit.plans.derived import derived
from millaudit.plans.registry import query
from millaudit.session import table


@query("f29_page_titles", """SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g')), '') AS title, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '') AS heading FROM pages""")
def page_titles(spark, sf):
    """Text between markers in whole pages."""
    return table(spark, sf, "pages").select(
        "page_id", html.text_between("html", "<title>", "</title>").alias("title"), html.text_between("html", "<h1>", "</h1>").alias("heading")
    )


@query("p22_cropped_pages", """SELECT page_id, length(CASE WHEN strpos(html, '<article>') = 0 THEN html WHEN strpos(substr(html, strpos(html, '<article>')), '</article>') > 0 THEN substr(html, strpos(html, '<article>'), strpos(substr(html, strpos(html, '<article>')), '</article>') - 1) ELSE substr(html, strpos(html, '<article>')) END) AS n FROM pages""")
def cropped_pages(spark, sf):
    """Length of the page part between two markers, the whole page without them."""
    return table(spark, sf, "pages").select("page_id", F.length(html.cropped("html", "<article>", "</article>")).cast("long").alias("n"))


@query("k10_page_links", """SELECT page_id, least(50, len(list_distinct(regexp_extract_all(html, '<a href="/[A-Za-z]+')))) AS n, coalesce(regexp_extract_all(html, '<a href="/[A-Za-z]+')[1], '') AS first_link FROM pages""")
def page_links(spark, sf):
    """Distinct links of each page in order, at most fifty."""
    links = html.detail_links("html", '<a href="/[A-Za-z]+', 50)
    return table(spark, sf, "pages").select(
        "page_id", F.size(links).cast("long").alias("n"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link")
    )


@query("k11_first_links", """SELECT length(url) % 13 AS query_id, arg_min(url, page_id) AS url FROM pages WHERE regexp_matches(url, '[0-9]*[02468]$|html$|/[a-m]') GROUP BY 1""")
def first_links(spark, sf):
    """First result with a wanted link per search."""
    rows = table(spark, sf, "pages").select((F.length("url") % 13).cast("long").alias("query_id"), F.col("page_id").alias("pos"), "url")
    return standards.first_links(rows, "[0-9]*[02468]$|html$|/[a-m]")


def _standard_pages(spark, sf):
    k = F.col("page_id")
    day = F.concat(F.lit("2021-0"), (1 + k % 9).cast("string"), F.lit("-15"))
    status = F.when(k % 4 == 0, '<img src="xxyx.gif">').when(k % 4 == 1, "<td>已废止").when(k % 4 == 2, "<td>现行有效").otherwise("<td>未知")
    head = F.concat(
        F.lit("<h2><span>GB "), (2000 + k).cast("string"), F.lit("-2021 标准</span></h2><table><tr><TH bgcolor='#fff'> 发布日期 </TH>\n<td class=x><b>"), day,
        F.lit("</b></td></tr><tr><th>废止日期</th><td>"), F.when(k % 3 == 0, "暂无").otherwise(day),
        F.lit("</td></tr><tr><th>标准状态</th>"), status, F.lit('</td></tr></table><a href="https://down.foodmate.net/standard/down.php?auth='),
        k.cast("string"), F.lit('">x</a>'),
    )
    return table(spark, sf, "pages").select("page_id", F.concat(head, F.col("html")).alias("html"))


_PAGE = """SELECT page_id, 'GB ' || CAST(2000 + page_id AS VARCHAR) || '-2021' AS number, '2021-0' || CAST(1 + page_id % 9 AS VARCHAR) || '-15' AS publish_date, CAST(NULL AS VARCHAR) AS implement_date, CASE WHEN page_id % 3 <> 0 THEN '2021-0' || CAST(1 + page_id % 9 AS VARCHAR) || '-15' END AS abolish_date, CASE page_id % 4 WHEN 0 THEN '现行有效' WHEN 1 THEN '已废止' WHEN 2 THEN '现行有效' END AS status FROM pages"""


@query("f29_f30_page_records", _PAGE)
def page_records(spark, sf):
    """Standard fields read from whole detail pages."""
    r = standards.page_records(_standard_pages(spark, sf))
    return r.select(
        "page_id", F.col("page_number").alias("number"), F.col("page_publish_date").alias("publish_date"), F.col("page_implement_date").alias("implement_date"),
        F.col("page_abolish_date").alias("abolish_date"), F.col("page_status").alias("status"),
    )


@query("f29_f30_marked_fields", """SELECT page_id, '2020-0' || CAST(1 + page_id % 9 AS VARCHAR) || '-01' AS publish_date, CASE WHEN page_id % 2 = 0 THEN '2030-01-01' END AS abolish_date, CASE page_id % 3 WHEN 0 THEN '已废止' WHEN 1 THEN '现行有效' END AS status FROM pages""")
def marked_fields(spark, sf):
    """The older reading of detail pages, by fixed markup."""
    k, th = F.col("page_id"), '<th bgcolor="#FFFFFF">'
    head = F.concat(
        F.lit(f"{th}发布日期</th><td>2020-0"), (1 + k % 9).cast("string"), F.lit(f"-01</td>{th}废止日期</th><td>"), F.when(k % 2 == 0, "2030-01-01").otherwise("暂无"),
        F.lit(f"</td>{th}标准状态</th><td>"), F.when(k % 3 == 0, "yjfz.gif").when(k % 3 == 1, "xxyx.gif").otherwise("jjss.gif"), F.lit(f"</td>{th}实施日期</th>"),
    )
    rows = table(spark, sf, "pages").select("page_id", F.concat(head, F.col("html")).alias("html"))
    return rows.select(
        "page_id", html.marked_cell("html", "发布日期").alias("publish_date"), html.marked_cell("html", "废止日期").alias("abolish_date"),
        html.marked_status("html").alias("status"),
    )


@query("f48_download_links", "SELECT page_id, 'https://down.foodmate.net/standard/down.php?auth=' || CAST(page_id AS VARCHAR) AS link FROM pages")
def download_links(spark, sf):
    return _standard_pages(spark, sf).select("page_id", html.download_link("html").alias("link"))


@query("e9_overlaid_records", f"""WITH p AS ({_PAGE}) SELECT page_id, coalesce(number, 'old') AS gb_number, coalesce(publish_date, '1999-01-01') AS publish_date, coalesce(implement_date, '1999-02-01') AS implement_date, abolish_date, coalesce(status, '旧') AS status, 'https://x.example/' || CAST(page_id AS VARCHAR) AS detail_url FROM p""")
def overlaid_records(spark, sf):
    """Records with the fields of their detail page over their own."""
    records = table(spark, sf, "pages").select(
        "page_id", F.lit("old").alias("gb_number"), F.lit("1999-01-01").alias("publish_date"), F.lit("1999-02-01").alias("implement_date"),
        F.lit(None).cast("string").alias("abolish_date"), F.lit("旧").alias("status"),
        F.concat(F.lit("https://x.example/"), F.col("page_id").cast("string")).alias("detail_url"),
    )
    return standards.overlaid_records(records, _standard_pages(spark, sf), "page_id")


@query("f31_f32_e10_search_records", """SELECT page_id, CAST(2000 + page_id AS VARCHAR) || '-2016' AS gb_number, 'https://down.foodmate.net/standard/search.php?kw=' || CAST(2000 + page_id AS VARCHAR) || '-2016' AS search_url, CASE WHEN page_id % 2 = 0 THEN '2016-01-02' ELSE '2015-05-05' END AS publish_date, CASE WHEN page_id % 2 = 0 THEN '2017-03-04' ELSE '2016-06-06' END AS implement_date,
  CASE WHEN page_id % 5 = 0 THEN '2030-01-01' END AS abolish_date, CASE WHEN page_id % 3 = 0 THEN '部分有效' WHEN page_id % 3 = 1 THEN '已废止' ELSE '现行有效' END AS status, 'https://down.foodmate.net/standard/sort/3/' || CAST(page_id AS VARCHAR) || '.html' AS detail_url FROM pages""")
def search_records(spark, sf):
    """Records of search pages: dates by label or near the code, link, status image or words."""
    k = F.col("page_id")
    number = F.concat((2000 + k).cast("string"), F.lit("-2016"))
    link = F.concat(F.lit("https://down.foodmate.net/standard/sort/3/"), k.cast("string"), F.lit(".html"))
    first = F.when(k % 2 == 0, F.concat(F.lit("发布日期 2016-01-02 实施日期 2017-03-04 "), F.col("html"))).otherwise(F.col("html"))
    second = F.concat(F.lit("列表 GB "), number, F.lit(" 2015-05-05 2016-06-06 "), F.when(k % 3 == 0, "bfyx.gif").otherwise(""), F.lit(" "), link)
    third = F.concat(F.when(k % 3 == 1, "作废").otherwise("现行有效"), F.col("url"))
    rows = table(spark, sf, "pages").select(
        "page_id", number.alias("gb_number"), first.alias("a"), second.alias("b"), third.alias("c"),
        F.when(k % 5 == 0, "停止实施日期：2030-01-01").otherwise("无").alias("d"), F.col("html").alias("e"),
    )
    return standards.search_records(rows, ["a", "b", "c"], ["d", "e"])


@query("f31_nearby_status", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '即将废止' END AS status FROM pages""")
def nearby_status(spark, sf):
    """Status image within 400 characters of the code."""
    k = F.col("page_id")
    text = F.concat(
        F.col("html"), F.lit(" GB 77-2001 "), F.when(k % 3 == 0, "jjfz.gif").otherwise(""), F.repeat(F.lit("."), 500), F.lit("yjfz.gif")
    )
    return table(spark, sf, "pages").select("page_id", html.search_page_status(text, F.lit("77-2001")).alias("status"))


@query("f28_e6_labels", """SELECT p_partkey AS label_id, p_name || '乳' AS product_type, CASE p_partkey % 3 WHEN 0 THEN 'GB ' || CAST(25000 + p_size AS VARCHAR) WHEN 1 THEN 'GB/T ' || CAST(19000 + p_size AS VARCHAR) ELSE 'GB ' || CAST(10000 + p_size AS VARCHAR) || '-2010' END AS standard_code,
  CASE WHEN p_partkey % 2 = 0 THEN '2024-1-' || CAST(1 + p_size % 28 AS VARCHAR) ELSE '20240115' END AS production_date, CASE WHEN p_partkey % 4 = 0 THEN '常温半年' ELSE CAST(p_size AS VARCHAR) || '个月' END AS shelf_life FROM part""")
def labels(spark, sf):
    """Label texts to fields."""
    k, size = F.col("p_partkey"), F.col("p_size")
    n = lambda base: (base + size).cast("string")
    code = F.when(k % 3 == 0, F.concat(F.lit("产品标准号：gb"), n(25000))).when(k % 3 == 1, F.concat(F.lit("执行标准：\nGB/T"), n(19000))).otherwise(
        F.concat(F.lit("见 GB."), n(10000), F.lit("-2010"))
    )
    day = F.when(k % 2 == 0, F.concat(F.lit("2024年1月"), (1 + size % 28).cast("string"), F.lit("日"))).otherwise("20240115")
    life = F.when(k % 4 == 0, "常温半年").otherwise(F.concat(F.lit("冷藏"), size.cast("string"), F.lit("个月内")))
    text = F.concat(F.lit("产品类型："), F.col("p_name"), F.lit("乳，配料\n"), code, F.lit("\n生产日期："), day, F.lit("\n保质期："), life)
    return table(spark, sf, "part").select(
        k.alias("label_id"), L.product_type(text).alias("product_type"), L.standard_code(text).alias("standard_code"),
        dates.label_date(text).alias("production_date"), L.shelf_life(text).alias("shelf_life"),
    )


def _answers(spark, sf):
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    as_json = F.concat(F.lit('说明 ```json\n[{"item_name": " '), name, F.lit('", "test_method": "GB '), size, F.lit('"}, {"item_name": ""}]\n``` 完'))
    as_lines = F.concat(F.lit("1. "), name, F.lit("：GB/T "), size, F.lit(".1-2016\n\n- 铅：x\n* "), size, F.lit("\n！"))
    return table(spark, sf, "part").select(k.alias("answer_id"), F.when(k % 2 == 0, as_json).otherwise(as_lines).alias("text"))


@query("f37_answered_items", """SELECT p_partkey AS answer_id, 0 AS pos, p_name AS item_name, CASE WHEN p_partkey % 2 = 0 THEN 'GB ' || CAST(p_size AS VARCHAR) ELSE 'GB/T ' || CAST(p_size AS VARCHAR) || '.1-2016' END AS test_method FROM part
  UNION ALL SELECT p_partkey, 1, CAST(p_size AS VARCHAR), '' FROM part WHERE p_partkey % 2 = 1 AND p_size >= 10""")
def answered_items(spark, sf):
    """Items in stored answers, JSON or lines."""
    return answers.answered_items(_answers(spark, sf)).select("answer_id", "pos", "item_name", "test_method")


@query("f38_answered_categories", """SELECT p_partkey AS answer_id, 0 AS pos, p_name AS category FROM part UNION ALL SELECT p_partkey, 1, '乳制品' FROM part UNION ALL SELECT p_partkey, 2, p_brand FROM part""")
def answered_categories(spark, sf):
    """Categories in stored answers."""
    text = F.concat(F.lit(" 三十、"), F.col("p_name"), F.lit("（说明）,五、乳制品，甲、"), F.col("p_brand"), F.lit("\n其余"))
    return answers.answered_categories(table(spark, sf, "part").select(F.col("p_partkey").alias("answer_id"), text.alias("text")))


@query("f39_answered_limits", """SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '未查到' ELSE '<=' || CAST(p_size AS VARCHAR) END AS value, CASE p_partkey % 3 WHEN 0 THEN '–' WHEN 1 THEN 'mg/kg' ELSE '–' END AS unit FROM part""")
def answered_limits(spark, sf):
    """First flat JSON object of an answer as a limit."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "没有").otherwise(
        F.concat(F.lit('答：{"standard_value": "<='), F.col("p_size").cast("string"), F.lit('", "standard_unit": "'), F.when(k % 3 == 1, "mg/kg").otherwise(""), F.lit('"} // 示例'))
    )
    return table(spark, sf, "part").select(k.alias("k"), A.answer_limit(text).alias("a")).select("k", "a.value", "a.unit")


@query("j21_answer_lookup", """SELECT p_partkey AS answer_id, p_name AS item, '≤' || CAST(p_size AS VARCHAR) AS standard_value, 'mg' AS standard_unit FROM part
  UNION ALL SELECT p_partkey, '铅（以Pb计）', '0.1', '–' FROM part UNION ALL SELECT p_partkey, '锌', '未查到', '–' FROM part""")
def answer_lookup(spark, sf):
    """Limits of asked items in answers: by name, else without bracket text."""
    text = F.concat(
        F.lit('好的 {"'), F.col("p_name"), F.lit('": {"standard_value": "≤'), F.col("p_size").cast("string"), F.lit('", "standard_unit": "mg"}, "铅（总量）": {"standard_value": "0.1", "standard_unit": ""}, "铅": {"standard_value": "9"}} 完')
    )
    part = table(spark, sf, "part")
    asked = part.select(F.col("p_partkey").alias("answer_id"), F.explode(F.array(F.col("p_name"), F.lit("铅（以Pb计）"), F.lit("锌"))).alias("item"))
    return answers.answered_limits(part.select(F.col("p_partkey").alias("answer_id"), text.alias("text")), asked)


# --- text boxes ---------------------------------------------------------------------------------

def boxes(spark, sf):
    seconds = F.unix_timestamp("ts")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.floor(seconds / 86400).cast("long").alias("page"), F.col("value").alias("x"),
        (seconds % 86400 / 8.0).alias("y"), "event_id", F.col("event_type").alias("text"),
    )


_BOXES = "b AS (SELECT user_id AS doc_id, CAST(floor(floor(epoch(ts)) / 86400) AS BIGINT) AS page, value AS x, (CAST(floor(epoch(ts)) AS BIGINT) % 86400) / 8.0 AS y, event_id, event_type AS text FROM events)"


@query("w6_clustered_rows", f"""WITH {_BOXES}, g AS (SELECT *, CASE WHEN y - lag(y) OVER w < 25 THEN 0 ELSE 1 END AS s FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, event_id))
  SELECT doc_id, page, event_id, CAST(sum(s) OVER (PARTITION BY doc_id, page ORDER BY y, event_id) AS BIGINT) AS row_no FROM g""")
def clustered_rows(spark, sf):
    """Text boxes to rows by vertical gaps."""
    return P.clustered_rows(boxes(spark, sf)).select("doc_id", "page", "event_id", F.col("row_no").cast("long").alias("row_no"))


def _found(spark, sf):
    every = boxes(spark, sf)
    boxed = every.select("doc_id", "page", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 10).alias("x2"), (F.col("y") + 4).alias("y2"), "text", "event_id")
    cells = every.select("doc_id", "page").distinct().withColumn("cell_id", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
        "doc_id", "page", "cell_id", F.lit(0.0).alias("cx1"), (F.col("cell_id") * 3600.0).alias("cy1"), F.lit(60.0).alias("cx2"), (F.col("cell_id") * 3600.0 + 3000).alias("cy2")
    )
    return P.boxes_in_cells(boxed, cells)


@query("j22_boxes_in_cells", f"""WITH {_BOXES}, c AS (SELECT DISTINCT doc_id, page, unnest([0, 1, 2]) AS cell_id FROM b)
  SELECT doc_id, page, cell_id, event_id FROM b JOIN c USING (doc_id, page) WHERE (x + (x + 10)) / 2 BETWEEN 0 AND 60 AND (y + (y + 4)) / 2 BETWEEN cell_id * 3600 AND cell_id * 3600 + 3000""")
def boxes_in_cells(spark, sf):
    """Boxes whose centre lies in a cell."""
    return _found(spark, sf).select("doc_id", "page", "cell_id", "event_id")


@query("w15_cell_texts", f"""WITH {_BOXES}, c AS (SELECT DISTINCT doc_id, page, unnest([0, 1, 2]) AS cell_id FROM b),
  f AS (SELECT doc_id, page, cell_id, x, y, text, (row_number() OVER (PARTITION BY doc_id, page, cell_id ORDER BY y, x, text) - 1) // 3 AS part FROM b JOIN c USING (doc_id, page) WHERE (x + (x + 10)) / 2 BETWEEN 0 AND 60 AND (y + (y + 4)) / 2 BETWEEN cell_id * 3600 AND cell_id * 3600 + 3000)
  SELECT doc_id, page, cell_id, part, count(*) AS line_count, string_agg(text, chr(10) ORDER BY y, x, text) AS text FROM f GROUP BY 1, 2, 3, 4""")
def cell_texts(spark, sf):
    """Lines of each cell from top to bottom."""
    return P.cell_text_lines(_found(spark, sf), part=3)


# --- page tables --------------------------------------------------------------------------------

def page_rows(spark, sf):
    """Rows of one table per page: a conversation is a document, a turn a page, a line a row."""
    words = F.filter(F.split("line", " "), lambda w: w != "")
    return (
        table(spark, sf, "conversations")
        .select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("table_no"), F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
        .withColumn("cells", F.slice(words, F.lit(1), (2 + F.length("line") % 2).cast("int")))
        .drop("line")
    )


def page_headers(spark, sf):
    return page_rows(spark, sf).where("row_no = 0").select("doc_id", "page", "table_no", F.col("cells").alias("header"))


_ROWS = """r0 AS (SELECT conv_id AS doc_id, turn AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row_no FROM conversations),
  r AS (SELECT doc_id, page, row_no, list_filter(string_split(line, ' '), lambda w: w <> '')[1:2 + length(line) % 2] AS cells FROM r0),
  h AS (SELECT doc_id, page, cells AS header, len(cells) AS width FROM r WHERE row_no = 0 AND len(cells) > 0),
  p AS (SELECT a.doc_id, a.page, a.width, a.header = b.header AS same FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.page = a.page + 1 AND a.width = b.width)"""


@query("j17_width_pairs", f"WITH {_ROWS} SELECT doc_id, page, width FROM p")
def width_pairs(spark, sf):
    """Tables of equal width on neighbouring pages (rows as objects: headers always equal)."""
    return P.cross_page_pairs(page_headers(spark, sf), 0.0).select("doc_id", "page", F.col("width").cast("long").alias("width"))


def _ratio(a: str, b: str) -> str:
    """Edit ratio in SQL: characters are renumbered per pair, since the function there compares bytes."""
    known = f"list_distinct(string_split({a} || {b}, ''))"
    short = lambda c: f"array_to_string(list_transform(string_split({c}, ''), lambda x: chr(CAST(list_position({known}, x) AS INTEGER))), '')"
    return f"1 - levenshtein({short(a)}, {short(b)}) / greatest(length({a}), length({b}))"


_CELLS = """c AS (SELECT a.doc_id, a.page, a.width, b.width AS next_width, unnest(a.header[1:least(a.width, b.width)]) AS a, unnest(b.header[1:least(a.width, b.width)]) AS b FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.page = a.page + 1)"""


@query("j17_f50_similar_pairs", f"""WITH {_ROWS}, {_CELLS}, s AS (SELECT doc_id, page, width, avg({_ratio('a', 'b')}) AS similarity FROM c WHERE width = next_width GROUP BY 1, 2, 3)
  SELECT doc_id, page, width, 0 AS table_no, 0 AS next_table_no, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.15""")
def similar_pairs(spark, sf):
    """Tables whose header cells are similar by edit distance."""
    pairs = P.cross_page_pairs(page_headers(spark, sf), 0.15)
    return pairs.select("doc_id", "page", "width", "table_no", "next_table_no", F.round("similarity", 6).alias("similarity"))


@query("a14_equal_headers", f"WITH {_ROWS} SELECT doc_id, page, 1.0 AS similarity FROM p WHERE same")
def equal_headers(spark, sf):
    """Pairs with the full similarity of 1."""
    return P.cross_page_pairs(page_headers(spark, sf), 1.0).select("doc_id", "page", "similarity")


@query("f50_edit_ratio", f"""WITH {_ROWS}, {_CELLS}, t AS (SELECT DISTINCT a, b FROM c) SELECT a, b, round({_ratio('a', 'b')}, 6) AS ratio FROM t""")
def edit_ratio(spark, sf):
    """Edit ratio of the header cells at equal places of neighbouring pages, in any script."""
    head = page_headers(spark, sf).where(F.size("header") > 0).select("doc_id", "page", F.posexplode("header").alias("at", "a"))
    nxt = head.select("doc_id", (F.col("page") - 1).alias("page"), "at", F.col("a").alias("b"))
    pairs = head.join(nxt, ["doc_id", "page", "at"]).select("a", "b").distinct()
    return pairs.select("a", "b", F.round(P.edit_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("w7_merged_pairs", f"""WITH {_ROWS} SELECT p.doc_id, p.page AS first_page, r.page AS source_page, r.row_no, array_to_string(r.cells, '|') AS cells FROM p JOIN r ON r.doc_id = p.doc_id AND (r.page = p.page OR (r.page = p.page + 1 AND r.row_no > 0))""")
def merged_pairs(spark, sf):
    """Rows of tables merged over two pages, repeated header dropped."""
    pairs = P.cross_page_pairs(page_headers(spark, sf), 0.0)
    rows = P.merged_pairs(page_rows(spark, sf), pairs)
    return rows.select("doc_id", "first_page", "source_page", "row_no", F.array_join("cells", "|").alias("cells"))


@query("w7_single_tables", f"""WITH {_ROWS} SELECT doc_id, page, row_no FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = r.doc_id)""")
def single_tables(spark, sf):
    """Tables of documents without any pair."""
    rows = page_rows(spark, sf)
    return P.single_tables(rows, P.cross_page_pairs(page_headers(spark, sf), 0.0)).select("doc_id", "page", "row_no")


@query("w7_chained_tables", f"""WITH {_ROWS}, t AS (SELECT DISTINCT doc_id, page FROM r), s AS (SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.doc_id = t.doc_id AND p.page = t.page - 1) THEN 0 ELSE 1 END AS starts FROM t),
  n AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS chain_no FROM s)
  SELECT n.doc_id, n.chain_no, n.page, r.row_no FROM n JOIN r USING (doc_id, page) WHERE starts = 1 OR r.row_no > 0""")
def chained_tables(spark, sf):
    """Whole chains of tables over pages."""
    pairs = P.cross_page_pairs(page_headers(spark, sf), 0.0)
    rows = P.chained_tables(page_rows(spark, sf), pairs)
    return rows.select("doc_id", F.col("chain_no").cast("long").alias("chain_no"), "page", "row_no")


@query("a13_table_statistics", f"""WITH {_ROWS}, m AS (SELECT p.doc_id, p.page AS first_page, r.page AS source_page, r.row_no, len(r.cells) AS w FROM p JOIN r ON r.doc_id = p.doc_id AND (r.page = p.page OR (r.page = p.page + 1 AND r.row_no > 0)))
  SELECT doc_id, first_page, count(*) AS total_rows, arg_min(w, source_page * 1000000 + row_no) AS column_count, count(DISTINCT source_page) AS page_count, true AS is_valid, min(w) <> max(w) AS uneven FROM m GROUP BY 1, 2""")
def table_statistics(spark, sf):
    """Rows, widths, pages and warnings of merged tables."""
    pairs = P.cross_page_pairs(page_headers(spark, sf), 0.0)
    stats = P.table_statistics(P.merged_pairs(page_rows(spark, sf), pairs), ["doc_id", "first_page"])
    return stats.withColumn("column_count", F.col("column_count").cast("long"))


@query("f43_first_rows", """SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, 2 + l_partkey % 2 AS width, CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) || CASE WHEN l_partkey % 2 = 1 THEN '|尾' ELSE '' END AS header FROM lineitem""")
def first_rows(spark, sf):
    """Width and header of the first row of HTML tables."""
    content = F.concat(
        F.lit("<table><tr class='h'><th>"), F.col("l_partkey").cast("string"), F.lit("</th><td> <b>"), F.col("l_suppkey").cast("string"), F.lit("</b></td>"),
        F.when(F.col("l_partkey") % 2 == 1, "<td>尾</td>").otherwise(""), F.lit("</tr><tr><td>x</td></tr></table>"),
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        html.first_row_width(content).cast("long").alias("width"), F.array_join(html.first_row_texts(content), "|").alias("header"),
    )


@query("p5_keyword_rows", f"""WITH {_ROWS} SELECT doc_id, cells[1] AS name, arg_max(coalesce(cells[2], ''), page * 1000000 + row_no) AS value FROM r WHERE len(cells) > 0 AND (contains(cells[1], 'e') OR contains(cells[1], 'a')) GROUP BY 1, 2""")
def keyword_rows(spark, sf):
    """Name and value of rows whose name holds a keyword, the last row of a name counts."""
    return P.rows_with_keyword(page_rows(spark, sf), ["e", "a"])


@query("p6_section_rows", """WITH RECURSIVE l AS (SELECT source AS doc_id, doc_id AS table_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row_no FROM documents),
  w AS (SELECT doc_id, table_no, row_no, list_filter(string_split(trim(line, ' ' || chr(9) || chr(13)), ' '), lambda x: x <> '') AS cells FROM l),
  n AS (SELECT doc_id, table_no, row_no, cells[1] AS name, coalesce(cells[2], '') AS value FROM w WHERE len(cells) > 0),
  t AS (SELECT doc_id, table_no, min(row_no) FILTER (name = 'The') AS opens, min(row_no) FILTER (name IN ('La', 'Les', 'Die', 'Der', 'Los', 'In', 'And', 'En', 'Is')) AS other FROM n GROUP BY 1, 2),
  c AS (SELECT doc_id, table_no, min(row_no) AS closes FROM t JOIN n USING (doc_id, table_no) WHERE name IN ('La', 'Les', 'Die', 'Der', 'Los', 'In', 'And', 'En', 'Is') AND row_no > opens GROUP BY 1, 2),
  s AS (SELECT t.*, closes, row_number() OVER (PARTITION BY doc_id ORDER BY table_no) AS k FROM t LEFT JOIN c USING (doc_id, table_no)),
  r AS (SELECT doc_id, k, false AS is_open FROM s WHERE k = 1 UNION ALL SELECT s.doc_id, s.k + 1, CASE WHEN is_open THEN other IS NULL ELSE opens IS NOT NULL AND closes IS NULL END FROM r JOIN s ON s.doc_id = r.doc_id AND s.k = r.k)
  SELECT doc_id, name, arg_max(value, {'t': table_no, 'r': row_no}) AS value FROM n JOIN s USING (doc_id, table_no) JOIN r USING (doc_id, k)
  WHERE CASE WHEN is_open THEN other IS NULL OR row_no < other ELSE row_no > opens AND (closes IS NULL OR row_no < closes) END
    AND name <> 'The' AND value <> '' AND (contains(name, 'a') OR contains(name, 'e')) AND length(name) <= 10 GROUP BY 1, 2""")
def section_rows(spark, sf):
    """Rows inside a section that opens and closes at headings, over all document lines of a source."""
    words = F.filter(F.split(T.strip("line"), " "), lambda w: w != "")
    rows = table(spark, sf, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line")).select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("table_no"), "row_no", words.alias("cells")
    )
    return P.rows_of_section(rows, "The", ["a", "e"], ["La", "Les", "Die", "Der", "Los", "In", "And", "En", "Is"])


@query("f49_safe_names", """SELECT code, replace(code, '/', '-') AS safe, 'gb_' || replace(replace(trim(regexp_replace(code, '^\\s*GB(/T)?\\s*', '', 'i')), ' ', ''), '/', '-') || '_detail.png' AS shot, count(*) AS n FROM d_cited GROUP BY 1""")
def safe_names(spark, sf):
    """File names of all cited codes."""
    return derived(spark, sf, "d_cited").groupBy("code").agg(F.count("*").alias("n")).select(
        "code", T.safe_file_name("code").alias("safe"), T.screenshot_name("code").alias("shot"), "n"
    )
