"""The registered queries of the operators, thin digests of their outputs, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millaudit.llm import chat_format, decontaminate, html_text, language_id, lines, near_dup, packing, periodic, quality, repair, substrings, topk, toxicity
from millaudit.llm.common import table

#: Vocabulary files; parameters of the operators.
PACKING_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LANGUAGE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in the messages layout, conversation -1 in the prompt and response layout."""
    records = chat_format.message_records(table(spark, sf_dir, "conversations"))
    extra = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(CONTROL_TEXT).alias("prompt"), F.lit(CONTROL_TEXT).alias("response"))
    turns = chat_format.canonical_turns(records.unionByName(extra, allowMissingColumns=True))
    read = chat_format.read_back(chat_format.formatted(turns).select("conv_id", "layout", "text", "loss_spans"))
    digest = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id", F.size("read_turns").cast("bigint").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("text").cast("bigint").alias("formatted_chars"), "layout",
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.predicted(documents, language_id.fit(documents, LANGUAGE_VOCABULARY))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), PACKING_VOCABULARY)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.judged(documents, table(spark, sf_dir, "labels"), ["doc_id"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"), as_text=False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.without_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), damage=True, as_text=False)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.scored(documents, toxicity.fit(documents, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_html_extraction, op3_language_id, op4_decontamination, op5_top_k, op6_packing, op7_near_duplicates, op8_quality_classifier,
        op9_substring_dedup, op10_line_dedup, op11_periodic_runs, op12_toxicity, op13_conversation_repair,
    )
}


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat_format.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_MARKS = sum(map(len, (chat_format.START, chat_format.HEAD_END, chat_format.END)))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAM_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

CHECKS = {
    "op1_chat_formatting": f"""
        WITH every AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
        said AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
                sum({_MARKS} + length({_escaped_sql('role')}) + length({_escaped_sql('text')}))::BIGINT AS formatted_chars
            FROM every GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars,
            CASE WHEN conv_id = -1 THEN 'prompt_response' ELSE 'messages' END AS layout
        FROM said""",
    "op4_decontamination": f"""
        WITH items AS (SELECT item_id, {_GRAM_WORDS} AS w FROM benchmark),
        grams AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS k, w[i : i + least(10, len(w)) - 1] AS gram
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
        docs AS (SELECT doc_id, {_GRAM_WORDS} AS w FROM documents),
        windows AS (
            SELECT doc_id, k, i, w[i : i + k - 1] AS gram
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)),
        hits AS (SELECT doc_id, i, windows.k, item_id FROM windows JOIN grams USING (k, gram)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            n_hit IS NOT NULL AS contaminated
        FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op5_top_k": """
        WITH ints AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5""",
    "op7_near_duplicates": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM docs WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
        reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a),
        least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM docs LEFT JOIN sizes USING (doc_id) JOIN least_of USING (doc_id)""",
    "op9_substring_dedup": f"""
        WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
        repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id),
        gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM repeated) GROUP BY doc_id),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body
            FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs)
            WHERE (doc_id, p) NOT IN (SELECT doc_id, unnest(places) FROM gone) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)""",
    "op10_line_dedup": f"""
        WITH split_lines AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
        every AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split_lines),
        spread AS (
            SELECT trim(line, ' ') AS t, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM every
            WHERE length(trim(line, ' ')) >= {lines.MIN_CHARS} GROUP BY t HAVING count(DISTINCT source) >= {lines.SITES}),
        marked AS (
            SELECT every.*, first IS NOT NULL AND first <> struct_pack(doc_id := doc_id, pos := pos) AS gone
            FROM every LEFT JOIN spread ON trim(line, ' ') = t),
        kept AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS body
            FROM marked GROUP BY doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(body) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE said AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
            FROM conversations),
        drawn AS (
            SELECT *, xor(list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(k, '')], lambda crc, b: list_reduce(
                [xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS d
            FROM said),
        rows AS (
            SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
                CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM drawn),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i,
                substr(role, 1, 1) AS initial
            FROM rows),
        faulty AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
                lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS bad
            FROM numbered),
        counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (bad) AS illegal
            FROM faulty GROUP BY conv_id),
        inserts(f, g, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
        edits(f, initial, letter, price, t) AS (
            VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3), (3, 'u', 'K', 0, 2), (0, '', 'R', 2, 2), (1, '', 'R', 2, 2),
                (2, '', 'R', 2, 3), (3, '', 'R', 2, 2), (0, '', 'D', 3, 0), (1, '', 'D', 3, 1), (2, '', 'D', 3, 2), (3, '', 'D', 3, 3)),
        moves AS (SELECT inserts.f, initial, letter, 2 * n + price AS price, repeat('I', n) || letter AS letters, t FROM inserts JOIN edits ON g = edits.f),
        walk AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM counted
            UNION ALL
            SELECT walk.conv_id, walk.i + 1, t, min({'cost': best.cost + price + (fault = 't' AND letter <> 'D')::BIGINT, 'audit': best.audit || letters})
            FROM walk JOIN faulty ON walk.conv_id IS NOT DISTINCT FROM faulty.conv_id AND faulty.i = walk.i + 1
            JOIN moves ON f = state AND (letter = 'D' OR (fault NOT IN ('b', 'd') AND (letter = 'R' OR moves.initial = faulty.initial)))
            GROUP BY walk.conv_id, walk.i, t),
        chosen AS (
            SELECT counted.conv_id, min({'cost': best.cost + 2 * inserts.n, 'audit': best.audit || repeat('I', inserts.n)}) AS best
            FROM counted JOIN walk ON counted.conv_id IS NOT DISTINCT FROM walk.conv_id AND counted.n = walk.i JOIN inserts ON f = state AND g IN (0, 3)
            GROUP BY counted.conv_id),
        letters AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS p FROM chosen WHERE best.audit <> ''),
        placed AS (
            SELECT *, count(*) FILTER (letter <> 'I') OVER so_far AS i, count(*) FILTER (letter <> 'D') OVER so_far AS k
            FROM letters WINDOW so_far AS (PARTITION BY conv_id ORDER BY p)),
        given AS (
            SELECT placed.*, faulty.role, faulty.text,
                max((k = 1 AND letter = 'K' AND initial = 's')::INT) OVER (PARTITION BY placed.conv_id) AS has_system
            FROM placed LEFT JOIN faulty ON letter <> 'I' AND placed.conv_id IS NOT DISTINCT FROM faulty.conv_id AND placed.i = faulty.i),
        texts AS (
            SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
            FROM given WHERE letter <> 'D' GROUP BY conv_id),
        every AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
        FROM every LEFT JOIN counted ON every.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN chosen ON every.conv_id IS NOT DISTINCT FROM chosen.conv_id
            LEFT JOIN texts ON every.conv_id IS NOT DISTINCT FROM texts.conv_id""",
}
