"""Retrieval: questions, top-k chunks, and the choices made on them.

The score is exact lexical containment: the share of a question's distinct grams that a chunk holds. It
is an equi-join on grams, so no question is compared with a chunk it shares nothing with, and only
grams that occur in a question leave the chunk side. Frequent grams are compared once per distinct set of them,
not once per question. Ranks are cut per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millaudit import fixed_values as V
from millaudit.functions import html
from millaudit.functions.text import col, contains_any, let, name_without_unit_note, strip
from millaudit.operators.common import first_k


# --- categories and questions -------------------------------------------------------------------

def food_categories(food, table: dict[str, list[str]] = V.FOOD_CATEGORIES) -> Column:
    """Categories of a food, exact to broad: the longest keyword in the name decides, ties by table order."""
    food = col(food)
    first, *others = sorted(table, key=len, reverse=True)
    holds = lambda keyword: F.contains(food, F.lit(keyword))
    names = lambda keyword: F.array(*[F.lit(x) for x in table[keyword]])
    result = F.when(holds(first), names(first))
    for keyword in others:
        result = result.when(holds(keyword), names(keyword))
    return result.otherwise(F.array(food))


def food_question(food, kind: str = "inspection", table: dict[str, list[str]] = V.FOOD_CATEGORIES) -> Column:
    """Question of a kind; known food names stand for themselves, others for their first category."""
    food = col(food)
    name = F.when(food.isin(list(table)), food).otherwise(F.get(food_categories(food, table), F.lit(0)))
    tails = {
        "inspection": " 检验项目表 必检项目 限量指标",
        "basis": " 依据法律法规 判定依据 标准",
        "method": " 检测方法 检验方法 国标方法",
    }
    return F.concat(name, F.lit(tails.get(kind, "")))


def lookup_question(kind: str, *names) -> Column:
    """Question texts of the five lookups."""
    c = [col(n) for n in names]
    texts = {
        "items": lambda: F.concat(c[0], F.lit("检验项目")),
        "methods": lambda: F.concat(c[0], F.lit("检测方法")),
        "standard": lambda: F.concat(F.lit("GB "), c[0]),
        "limit": lambda: F.concat(c[0], F.lit(" "), c[1], F.lit(" 标准限量 指标要求")),
        "indicator": lambda: F.concat(F.coalesce(c[0], F.lit("GB 2763")), F.lit(" "), c[1], F.lit(" 标准限量 指标要求")),
    }
    return texts[kind]()


def section_table(spark) -> DataFrame:
    """Rule book sections: (no, name, members)."""
    lines = spark.createDataFrame([(x,) for x in V.RULE_BOOK_SECTIONS.splitlines()], "line string")
    return lines.select(
        F.regexp_extract("line", "^([一二三四五六七八九十]+)、", 1).alias("no"),
        F.regexp_extract("line", "、([^（]+)", 1).alias("name"),
        F.filter(F.split(F.regexp_extract("line", "（(.*)）", 1), "、"), lambda x: x != "").alias("members"),
    )


# --- scoring ------------------------------------------------------------------------------------

def word_grams(c, n: int) -> Column:
    """Distinct runs of n words; a shorter text is one gram."""
    words = F.filter(F.split(F.lower(strip(c)), r"\s+"), lambda w: w != "")
    return _runs(words, n, " ")


def char_grams(c, n: int) -> Column:
    """Distinct runs of n characters, blanks dropped (for texts without word breaks)."""
    return _runs(F.split(F.regexp_replace(F.lower(col(c)), r"\s+", ""), ""), n, "")


def _runs(parts: Column, n: int, glue: str) -> Column:
    def runs(items):
        starts = F.sequence(F.lit(1), F.greatest(F.size(items) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), glue))

    return F.array_distinct(let(parts, runs))


def _question_grams(questions: DataFrame, grams) -> DataFrame:
    return questions.select("question_id", F.explode(grams("question")).alias("gram"))


def top_chunks(
    questions: DataFrame, chunks: DataFrame, grams, k: int = 30, least: float = 0.0, hot: int = 1000
) -> DataFrame:
    """Top k chunks per question by score, ties by chunk: (question_id, chunk_id, score, rank).

    questions: (question_id, question). Every gram weighs, however frequent. A gram that more than ``hot`` chunks
    hold makes no pairs with questions; ``hot`` shapes the plan and never the result. A chunk that shares nothing but
    such grams with a question ranks as it does for every question with the same set of them, and k chunks before
    it there are before it here too. So the k best chunks of each distinct set (few, as questions follow
    templates) and the chunks that share a rarer gram are all that can rank; both are scored on all grams.
    """
    asked = _question_grams(questions, grams)
    held = chunks.select("chunk_id", F.explode(grams("content")).alias("gram")).join(
        asked.select("gram").distinct(), "gram", "left_semi"
    )
    frequent = held.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("gram")
    sets = asked.join(frequent, "gram").groupBy("question_id").agg(F.array_sort(F.collect_list("gram")).alias("asked_hot"))
    held_hot = held.join(frequent, "gram")
    chunk_sets = held_hot.groupBy("chunk_id").agg(F.collect_list("gram").alias("held_hot"))
    rare = (
        held.join(asked.join(frequent, "gram", "left_anti"), "gram")
        .groupBy("question_id", "chunk_id").agg(F.count("*").alias("rare"))
    )
    by_set = (
        sets.select("asked_hot").distinct().withColumn("gram", F.explode("asked_hot")).join(held_hot, "gram")
        .groupBy("asked_hot", "chunk_id").agg(F.count("*").alias("shared"))
    )
    best = first_k(by_set, ["asked_hot"], [F.desc("shared"), F.asc("chunk_id")], k).select("asked_hot", "chunk_id")
    candidates = (
        rare.unionByName(best.join(sets, "asked_hot").select("question_id", "chunk_id", F.lit(0).cast("long").alias("rare")))
        .groupBy("question_id", "chunk_id").agg(F.max("rare").alias("rare"))
    )
    both = F.coalesce(F.size(F.array_intersect("asked_hot", "held_hot")), F.lit(0))
    sizes = asked.groupBy("question_id").agg(F.count("*").alias("n_grams"))
    scored = (
        candidates.join(sets, "question_id", "left").join(chunk_sets, "chunk_id", "left")
        .withColumn("shared", F.col("rare") + F.when(F.col("asked_hot").isNotNull() & F.col("held_hot").isNotNull(), both).otherwise(0))
        .join(sizes, "question_id")
        .select("question_id", "chunk_id", (F.col("shared") / F.col("n_grams")).alias("score"))
        .where(F.col("score") >= least)
    )
    return first_k(scored, ["question_id"], [F.desc("score"), F.asc("chunk_id")], k)


def lookup(names: DataFrame, kind: str, columns, chunks: DataFrame, grams, k: int = 30) -> DataFrame:
    """Retrieval request: question of a kind over name columns, its top chunks with their columns.

    Equal questions are asked once: (…name columns, question, chunk_id, score, rank, chunk columns).
    """
    asked = names.select(*columns).distinct().withColumn("question", lookup_question(kind, *columns))
    distinct = asked.select("question").distinct().withColumn("question_id", F.col("question"))
    hits = top_chunks(distinct, chunks, grams, k).withColumnRenamed("question_id", "question")
    return asked.join(with_chunks(hits, chunks), "question")


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the chunk columns."""
    return hits.join(chunks, "chunk_id")


def nearest_chunks(questions: DataFrame, chunks: DataFrame, k: int, blocks: int = 16, groups: int = 64, tile: int = 1024) -> DataFrame:
    """Exact top k by cosine: questions (question_id, vector) against chunks (chunk_id, vector).

    Questions are cut into ``blocks`` and chunks into ``groups`` by hash; each pair of them meets in a task, which
    multiplies tiles of ``tile`` vectors and sends on k rows per question, so neither side is broadcast or held whole,
    no pair table is built and a score matrix never exceeds tile x tile. Both counts are parameters: let a block and a
    group fit a task.
    """
    import numpy as np
    import pandas as pd

    q = questions.withColumn("b", F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int")).withColumn(
        "s", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    c = chunks.withColumn("s", F.pmod(F.xxhash64("chunk_id"), F.lit(groups)).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    q_type, c_type = questions.schema["question_id"].dataType, chunks.schema["chunk_id"].dataType

    def unit(vectors):
        m = np.array(vectors.tolist(), dtype=np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best_of(scores, ids):
        """Places of the k best, ties to smaller ids: all at least as good as the k-th, then sorted."""
        places = np.arange(len(ids))
        if len(ids) > k:
            places = np.flatnonzero(scores >= np.partition(scores, len(ids) - k)[len(ids) - k])
        return places[np.lexsort((ids[places], -scores[places]))[:k]]

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"question_id": [], "chunk_id": [], "score": []})
        if left.empty or right.empty:
            return none
        asked, names, held = unit(left["vector"]), left["question_id"].to_numpy(), right["chunk_id"].to_numpy()
        best = [(np.empty(0), held[:0])] * len(names)
        for start in range(0, len(held), tile):
            ids, vectors = held[start:start + tile], unit(right["vector"].iloc[start:start + tile])
            for low in range(0, len(names), tile):
                for i, row in enumerate(np.round(asked[low:low + tile] @ vectors.T, 9), low):
                    scores, found = np.concatenate([best[i][0], row]), np.concatenate([best[i][1], ids])
                    few = best_of(scores, found)
                    best[i] = scores[few], found[few]
        return pd.DataFrame({
            "question_id": np.repeat(names, [len(x[0]) for x in best]), "chunk_id": np.concatenate([x[1] for x in best]),
            "score": np.concatenate([x[0] for x in best]),
        })

    schema = f"question_id {q_type.simpleString()}, chunk_id {c_type.simpleString()}, score double"
    local = (
        q.select("b", "s", "question_id", "vector").groupBy("b", "s")
        .cogroup(c.select("b", "s", "chunk_id", "vector").groupBy("b", "s"))
        .applyInPandas(product, schema)
    )
    return first_k(local, ["question_id"], [F.desc("score"), F.asc("chunk_id")], k)


# --- predicates on chunks -----------------------------------------------------------------------

def in_document(doc_name, number, year=None) -> Column:
    """Document name (blanks dropped) holds the number, and the year when one is given."""
    hit = F.contains(F.replace(col(doc_name), F.lit(" "), F.lit("")), col(number))
    if year is None:
        return hit
    return hit & (col(year).isNull() | F.contains(col(doc_name), col(year)))


def names_category(content, categories) -> Column:
    return F.exists(col(categories), lambda k: F.contains(col(content), k))


def is_contents_chunk(content) -> Column:
    """Table of contents: at least two entries and no limit number."""
    entries = F.regexp_count(col(content), F.lit(V.CONTENTS_FORWARD)) + F.regexp_count(col(content), F.lit(V.CONTENTS_REVERSE))
    return (entries >= 2) & ~col(content).rlike(V.LIMIT_NUMBER)


def is_description(content) -> Column:
    """Says 'shall satisfy table N' and has no table."""
    return col(content).rlike(V.DESCRIPTION_PAGE) & ~html.has_table(content)


def described_table(content) -> Column:
    number = F.regexp_extract(col(content), V.DESCRIPTION_PAGE, 1)
    return F.when(number != "", number)


def is_structured(content, food, categories, strict: bool = False) -> Column:
    """Names the food or a category; strict also wants an item word and a table mark."""
    named = F.contains(col(content), col(food)) | names_category(content, categories)
    if not strict:
        return named
    return named & contains_any(content, V.ITEM_SECTION_WORDS) & contains_any(content, V.TABLE_MARKS)


def chunk_records(raw: DataFrame) -> DataFrame:
    """Raw chunks with one content, score, id, document and page each."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    page = F.coalesce(F.get(F.get("positions", F.lit(0)), F.lit(0)).cast("int"), F.nullif("page_num", F.lit(0)), F.nullif("page_num_int", F.lit(0)))
    return raw.select(
        F.coalesce(filled("content"), filled("content_with_weight"), filled("content_ltks"), F.lit("")).alias("content"),
        F.coalesce("similarity", F.lit(0.0)).alias("score"),
        F.coalesce("id", "chunk_id", F.lit("")).alias("chunk_id"),
        F.coalesce("document_keyword", "docnm_kwd", F.lit("")).alias("doc_name"),
        F.coalesce("document_id", F.lit("")).alias("document_id"),
        F.coalesce(F.nullif(page, F.lit(0)), F.lit(1)).alias("page_num"),
    )


def document_chunks(chunks: DataFrame, document_id) -> DataFrame:
    """All chunks of a document, each with score 1."""
    return chunks.where(F.col("document_id") == document_id).withColumn("score", F.lit(1.0))


# --- choices per question -----------------------------------------------------------------------

def rule_chunks(hits: DataFrame, keep: int = 8, near: int = 10) -> DataFrame:
    """The rule chunks of a subject from a direct and a category question.

    hits: (subject, variant 'direct' | 'category', chunk_id, score, page_num, content, on_target,
    position), position being the place in the retrieval list. Chosen: the direct on-target chunks, else
    the category's on-target ones, else all of the category's; the first ``keep`` by score. When none of
    them has a table, the category choice replaces them if it has rows. Then pages near the page of the
    first chunk with a table (else of the first chunk).
    """
    order = [F.desc("score"), F.asc("position")]
    target = hits.where(F.col("on_target"))
    direct = first_k(target.where("variant = 'direct'"), ["subject"], order, keep)
    # Of the category list the on-target rows outrank the others, and others count only without them.
    category = first_k(
        hits.where("variant = 'category'"), ["subject"], [F.desc("on_target"), *order], keep
    )
    has_target = category.groupBy("subject").agg(F.max("on_target").alias("any_target"))
    category = category.join(has_target, "subject").where(F.col("on_target") | ~F.col("any_target")).drop("any_target")
    kept = direct.unionByName(category).withColumn("has_table", html.has_table("content"))
    # At most 2 * keep rows per subject from here on, so windows over a subject stay small.
    one = Window.partitionBy("subject")
    is_direct = F.col("variant") == "direct"
    direct_ok = F.max(F.when(is_direct, F.col("has_table"))).over(one)
    any_category = F.count_if(~is_direct).over(one)
    use_direct = F.coalesce(direct_ok, F.lit(False)) | (direct_ok.isNotNull() & (any_category == 0))
    chosen = kept.withColumn("_direct", use_direct).where(F.col("_direct") == is_direct).drop("_direct")
    by_rank = Window.partitionBy("subject").orderBy(F.desc("has_table"), F.asc("rank")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    anchored = chosen.withColumn("anchor_page", F.first("page_num").over(by_rank))
    close = anchored.withColumn(
        "_near",
        F.col("anchor_page").isNull() | (F.col("anchor_page") == 0)
        | (F.abs(F.coalesce("page_num", F.lit(0)) - F.col("anchor_page")) <= near),
    )
    any_near = F.max("_near").over(one)
    return close.withColumn("_any", any_near).where(F.col("_near") | ~F.col("_any")).drop("_near", "_any")


def first_level(rows: DataFrame, key: str, level: str = "level") -> DataFrame:
    """Rows of the lowest level that has any, per key; the level is found by an aggregate and joined back."""
    lowest = rows.groupBy(key).agg(F.min(level).alias("_lowest"))
    return rows.join(lowest, key).where(F.col(level) == F.col("_lowest")).drop("_lowest")


def chunk_priorities(rows: DataFrame) -> DataFrame:
    """Adds priority 1, 2, 4 or 5 of a chunk for an item; rows: content, item, categories."""
    text = F.col("content")
    core = name_without_unit_note("item")
    named = ((F.col("item") != "") & F.contains(text, F.col("item"))) | ((core != "") & F.contains(text, core))
    limited = text.rlike(V.LIMIT_NUMBER) & ~is_description("content")
    return (
        rows.withColumn("named", named)
        .withColumn("described", F.when(named & is_description("content"), described_table("content")))
        .withColumn(
            "priority",
            F.when(named & limited & names_category("content", "categories"), 1)
            .when(named & limited, 2)
            .when(named, 4)
            .otherwise(5),
        )
    )


def best_chunks(rows: DataFrame, described_hits: DataFrame | None = None) -> DataFrame:
    """Best chunk per lookup.

    rows: chunk_priorities() with lookup_id and position; described_hits: chunks found for the table a
    description page names (lookup_id, position, content, …), which come in as priority 3.
    """
    every = rows
    if described_hits is not None:
        extra = described_hits.where(html.has_table("content") & ~is_contents_chunk("content")).withColumn("priority", F.lit(3))
        every = rows.unionByName(extra, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in {"lookup_id", "priority", "position"}]
    return (
        every.groupBy("lookup_id")
        .agg(F.min_by(F.struct("priority", "position", *rest), F.struct("priority", "position")).alias("b"))
        .select("lookup_id", "b.*")
    )


def described_tables(rows: DataFrame) -> DataFrame:
    """The table a description page names, from the first such page per lookup."""
    return (
        rows.where(F.col("described").isNotNull())
        .groupBy("lookup_id")
        .agg(F.min_by("described", "position").alias("table_no"))
    )


def contents_table(rows: DataFrame, most_page: int = 30) -> DataFrame:
    """Table number of an item from contents pages: the first chunk (by position) whose text has one.

    rows: (lookup_id, item, position, page_num, content). Three forms: '4.N item', 'item … 4.N', 'item … NNN'.
    """
    # The pattern holds the item, so it is a column.
    number = F.expr(
        r"""coalesce(
            nullif(regexp_extract(content, concat('4\\.(\\d+)\\s*\\Q', item, '\\E'), 1), ''),
            nullif(regexp_extract(content, concat('\\Q', item, '\\E[^\\n]{0,30}4\\.(\\d+)'), 1), ''),
            nullif(regexp_extract(content, concat('\\Q', item, '\\E[^\\n]{0,30}(\\d{3})'), 1), ''))"""
    )
    return (
        rows.where(F.col("page_num").between(1, most_page))
        .withColumn("table_no", number)
        .where(F.col("table_no").isNotNull())
        .groupBy("lookup_id")
        .agg(F.min_by("table_no", "position").alias("table_no"))
    )


def configured_queries(lookups: DataFrame, config: DataFrame) -> DataFrame:
    """Configured question per lookup: categories in order then the food, item name then its bare form.

    lookups: (lookup_id, item, food, categories); config: (category, item, query, standard).
    """
    bare = strip(F.regexp_replace("item", "[a-z]+$", ""))
    keys = lookups.select(
        "lookup_id", F.posexplode(F.concat("categories", F.array("food"))).alias("cat_pos", "category"),
        F.array("item", bare).alias("_names"),
    ).select("lookup_id", "cat_pos", "category", F.posexplode("_names").alias("key_pos", "item"))
    return (
        keys.join(config, ["category", "item"])
        .groupBy("lookup_id")
        .agg(F.min_by(F.struct("query", "standard"), F.struct("cat_pos", "key_pos")).alias("q"))
        .select("lookup_id", "q.query", "q.standard")
    )


def question_ladder(lookups: DataFrame) -> DataFrame:
    """All questions of a lookup with their level, most wanted first.

    lookups: (lookup_id, item, food, categories, query_code, table_no, cfg_query). Pesticide standards ask
    the table number and then each category; product standards the configured question (else the item),
    item and food, and the item's CJK characters.
    """
    pesticide = F.contains(F.replace("query_code", F.lit(" "), F.lit("")), F.lit("2763"))
    table_text = F.concat(F.lit("表"), F.col("table_no"))
    by_category = F.concat(
        F.when(F.col("table_no").isNotNull(), F.array(F.concat_ws(" ", table_text, F.get("categories", F.lit(0)))))
        .otherwise(F.array().cast("array<string>")),
        F.transform("categories", lambda k: F.concat_ws(" ", F.col("item"), k, F.lit("限量"))),
    )
    cjk = F.regexp_replace("item", r"[^\x{4e00}-\x{9fa5}]", "")
    by_item = F.array_compact(
        F.array(
            F.coalesce(table_text, F.when(F.col("cfg_query") != "", F.col("cfg_query")), F.col("item")),
            F.concat_ws(" ", "item", "food"),
            F.when((cjk != "") & (cjk != F.col("item")), cjk),
        )
    )
    return lookups.select(
        "lookup_id", F.posexplode(F.when(pesticide, by_category).otherwise(by_item)).alias("level", "question")
    )


def confirmed_section(hits: DataFrame, subjects: DataFrame, least: float = 0.40, k: int = 3) -> DataFrame:
    """The first candidate section that a good chunk confirms, else the first candidate, else the food.

    hits: (subject, section_pos, section, score, position, content); subjects: (subject, food, sections).
    """
    good = hits.where((F.col("score") >= least) & (F.coalesce("content", F.lit("")) != ""))
    best = first_k(good, ["subject", "section_pos"], [F.asc("position")], k)
    confirmed = (
        best.where(F.contains("content", F.col("section")))
        .groupBy("subject").agg(F.min_by("section", "section_pos").alias("confirmed"))
    )
    return subjects.join(confirmed, "subject", "left").select(
        "subject", F.coalesce("confirmed", F.get("sections", F.lit(0)), "food").alias("section")
    )


def sampled_names(names: DataFrame, key: str = "query_code", most: int = 6) -> DataFrame:
    """Every n-th name of a group, n a quarter of its size, at most six; names: (key, pos, name), pos from 0."""
    sizes = names.groupBy(key).agg(F.count("*").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / 4).cast("long"))
    return (
        names.join(sizes, key)
        .where((F.col("pos") % step == 0) & (F.col("pos") < step * most))
        .drop("_n")
    )


def combined_text(chunks: DataFrame, key: str = "query_code", part: int = 1000) -> DataFrame:
    """Chunks of a group joined in page order (unknown last), with the lowest page and first document.

    The text comes in parts of ``part`` chunks (part 0, 1, …) so that a huge group is never one value;
    chunks carry a position (0, 1, …) in page order.
    """
    parts = chunks.withColumn("part", F.floor(F.col("position") / part).cast("long"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("position", "content"))))
    facts = chunks.groupBy(key).agg(
        F.min(F.when(F.col("page_num") > 0, F.col("page_num"))).alias("page_num"),
        F.min_by("doc_name", F.when(F.col("doc_name") != "", F.col("position"))).alias("doc_name"),
    )
    texts = parts.groupBy(key, "part").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n").alias("text"))
    return texts.join(facts, key)


def page_order(c="page_num") -> Column:
    """Page for sorting; unknown pages come last."""
    return F.coalesce(F.nullif(col(c), F.lit(0)), F.lit(999))
