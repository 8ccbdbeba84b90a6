"""The training-data operators on awkward rows, against brute force and by round trips."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from millaudit.llm import chat_format, decontaminate, html_text, language_id, lines, near_dup, packing, quality, queries, substrings, topk
from millaudit.llm.common import Words, hashed_words, table

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{(i or 0) % 12}", len(t or "")) for i, t in texts]
    out = spark.createDataFrame(rows, DOCUMENTS)
    if extra:  # columns that operators use inside
        for c in ("key", "bit", "body", "positions", "spans", "set_id", "kept", "n_removed", "pos", "anchor"):
            out = out.withColumn(c, F.lit("x"))
    return out


AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (None, "one two"), (4, "x " * 40_000), (5, "Same words here"), (5, "other words"), (6, "Same words here"), (7, "\x00　é" * 30)]


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(queries.CHECKS[name])
    found = [d[0] for d in cursor.description]
    want = sorted((tuple(r[found.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_operators_take_awkward_and_empty_documents(spark):
    for rows in (AWKWARD, []):
        d = docs(spark, rows, extra=True)
        bench = spark.createDataFrame([(1, "one two"), (None, "other words"), (2, None)] if rows else [], "item_id bigint, text string")
        assert decontaminate.digest(decontaminate.contamination(d, bench)).count() == len(rows)
        assert lines.without_boilerplate(d).count() == len(rows)
        assert lines.deduplicated(d).columns == d.columns
        assert decontaminate.clean_documents(d, bench).columns == d.columns
        found = near_dup.near_duplicates(d).collect()
        assert len(found) == len(rows)
        assert substrings.without_repeats(d).count() == len(rows)
        assert packing.pack_documents(d, queries.PACKING_VOCABULARY).count() >= len(rows)
        model = language_id.fit(d, queries.LANGUAGE_VOCABULARY)
        by_id = {r.doc_id: r for r in language_id.predicted(d, model).collect()}
        if rows:
            assert (by_id[1].lang_pred, by_id[1].score) == ("und", 0.0) and by_id[3].lang_pred == "und"
            # Document 5 is one document in two rows, and 6 equals one of them.
            assert {(r.doc_id, r.component_id, r.kept) for r in found if r.doc_id in (5, 6)} == {(5, 5, True), (6, 5, False)}
        none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
        assert quality.scored(d, quality.fit(d, none)).where("kept").count() == len(rows)


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    data = np.frombuffer(("ab cd\n" * 50 + "w" * 300 + " z").encode(), np.uint8)
    from millaudit.llm import common

    whole = hashed_words(data, common.WHITE)
    monkeypatch.setattr(common, "BLOCK", 64)
    monkeypatch.setattr(common, "_POWERS", {})
    for a, b in zip(whole, hashed_words(data, common.WHITE)):
        assert (a == b).all()
    assert Words([b"a b", None, b"c"]).count.tolist() == [2, 0, 1]


def test_benchmark_in_many_passes_gives_the_same(spark):
    d, b = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    one = sorted(map(repr, decontaminate.contamination(d, b).collect()))
    assert one == sorted(map(repr, decontaminate.contamination(d, b, broadcast_bytes=3000).collect()))


def test_chat_layouts_and_round_trip(spark):
    schema = "id int, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, instruction string, input string, output string, prompt string, response string, system string, note string"
    nasty = "a\\b <|im_end|> <<s>[INST]\\<s> é😀\n</s>"
    rows = [
        (1, [("user", "q"), ("assistant", nasty)], None, None, None, None, None, None, None, "n"),
        (2, None, [("human", nasty), ("gpt", None)], None, None, None, None, None, "be nice", None),
        (3, None, None, "do", "this", nasty, None, None, None, None), (4, None, None, None, None, None, nasty, nasty, None, None),
        (5, None, None, None, None, None, None, None, None, "nothing known"),
    ]
    records = chat_format.canonical_turns(spark.createDataFrame(rows, schema))
    read = {r.id: r for r in chat_format.read_back(chat_format.formatted(records)).collect()}
    turns = {i: [(t.role, t.text) for t in r.read_turns] for i, r in read.items()}
    assert turns[1] == [("user", "q"), ("assistant", nasty)] and read[1].learned == [nasty]
    assert turns[2] == [("system", "be nice"), ("user", nasty), ("assistant", "")] and read[2].layout == "shared"
    assert turns[3] == [("user", "do\n\nthis"), ("assistant", nasty)]
    assert turns[4] == [("user", nasty), ("assistant", nasty)] and read[4].learned == [nasty]
    assert turns[5] == [] and read[5].layout is None and read[5].text == ""
    assert read[1].text.count("<|im_start|>") == 2


def test_main_text_of_pages():
    page = """<html><body class="has-sidebar"><header>Site</header><nav><a href=x>Home</a></nav><div id=cookie-notice>We use cookies</div>
    <div class=wrap><h1>Title &amp; more</h1><p>First  paragraph of the article with many words in it, long enough.<p>Second<br>paragraph &#8804; 5,
    with <a href=y>a link</a> and many more words to read here.<ul><li>One item of a list<li>Another item</ul><script>"</p>"</script>
    <form><input>Search</form></div><div class="comments"><p>Nice article, thanks for it!</p></div><aside>More</aside><footer>&copy; us</footer>"""
    blocks = html_text.main_text(page).split("\n\n")
    assert blocks[0] == "Title & more" and blocks[2].startswith("Second paragraph ≤ 5, with a link and")
    assert blocks[3:] == ["One item of a list", "Another item"]
    for empty in (None, "", "<html><body></body></html>", "<!-- only", "<p", "<script>x"):
        assert html_text.main_text(empty) in ("", "<p")
    assert html_text.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"


def test_density_leaves_out_unnamed_blocks_without_links():
    box = "<div class=q7><span>Buy now</span><span>Only 5.99</span><span>Order</span><b>Hot</b></div>"
    parts = ["Title", "A first paragraph of the article with a good number of words in it, as articles have them.", "Short one.", "Part", "Another paragraph that goes on for a while with words and more words, and ends here.", "Yes."]
    inside = f"<h1>{parts[0]}</h1><section><p>{parts[1]}</p><p>{parts[2]}</p></section><section><h2>{parts[3]}</h2><p>{parts[4]}</p></section><section><p>{parts[5]}</p></section>"
    for tag in ("div", "article", "main", "td"):
        around = ("<table><tr>", "</table>") if tag == "td" else ("", "")
        page = f"<html><body>{box}{around[0]}<{tag}>{inside}</{tag}>{around[1]}{box}<x-ad>Hot offers</x-ad></body></html>"
        assert html_text.main_text(page).split("\n\n") == parts
    density, total, body = html_text.densities(html_text.Page(f"<body><p>{parts[1]}</p>{box}"), np.ones(8, bool))
    assert density[2] > density[3] > 1e-3


def test_marked_blocks_go_whatever_their_share():
    article = "<h1>Title</h1><p>A short article of a few words.</p>"
    said = "".join(f"<li><p>Reader {i} says a good deal more than the article does, and goes on.</p></li>" for i in range(20))
    want = "Title\n\nA short article of a few words."
    for block in (f"<ol class=commentlist>{said}</ol>", f"<div class=comments><h3>20</h3><ul>{said}</ul></div>", f"<div role=complementary>{said}</div>", f"<div class=notice>{said}</div>"):
        for around in ("<div class=c>%s</div>", "%s", "<article>%s</article>", "<div class=has-sidebar>%s</div>"):
            assert html_text.main_text(f"<body>{around % article}{block}</body>") == want
        assert html_text.main_text(f"<body><div id=widget>{article}{block}</div></body>") == want
    # Wrappers that hold the article stay.
    for name in ("has-sidebar", "page with-comments", "widget", "notice"):
        page = f"<body><div class='{name}'>{article}<p>{'More of it. ' * 9}</p></div><p>© 2020</p></body>"
        assert html_text.main_text(page).startswith(want)
    assert html_text.main_text("<body><div class=banner><p>All there is.</p></div></body>") == "All there is."


def test_pages_equal_their_article(spark):
    import html

    got = {r.page_id: r.text for r in queries.op2_html_extraction(spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        inside = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def test_language_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    held = [r for r in queries.op3_language_id(spark, SF).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_forward_sums_all_segmentations():
    model = language_id.Model(["x"], np.array([1.0]), ["▁", "a", "b", "ab", "▁a"], {})
    model.p[:5, 0] = [0.1, 0.2, 0.3, 0.25, 0.15]
    want = 0.1 * 0.2 * 0.3 + 0.1 * 0.25 + 0.15 * 0.3
    assert np.isclose(np.exp(model.word_scores(["▁ab"])[0, 0]), want, rtol=1e-5)


def test_top_k_ties_nulls_and_few_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [inf, 0.0]), (5, [nan, 0.0]), (None, [-1.0, 2.0])]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(e, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 81920), (0, 2, 1, 81920), (0, 3, None, 0)]
    assert topk.top_k(e.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_equals_brute_force_over_many_tiles(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 7)).round(2)
    e = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>")
    ints = np.floor(256 * v).astype(np.int64)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(e, F.col("vec_id") % 50 == 0, tile=40, query_tile=2).collect()}
    for q in range(0, 300, 50):
        scores = sorted(((-int(s), i) for i, s in enumerate(ints @ ints[q]) if i != q))[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in scores]


def test_packing_is_whole_gapless_and_tight(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    rows = queries.op6_packing(spark, SF).collect()
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want = [(n, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_document[doc_id]) == want
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


def test_words_are_encoded_like_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), packing.WordIds(path)
    for text in ("Don't 'LL it''s!!x9", "É é ﬁ   a b\x1cc\x85", "<|endoftext|> <|endoftext|>x", "Σς İ ½ª 漢字 한 하", "a" * 200):
        assert words.text(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_near_copies_in_one_large_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        own = list(base)
        for at in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            own[at] = f"e{i}x{at}"
        texts.append((i, " ".join(own)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in texts}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, texts)).collect()}
    assert got == root


def test_repeated_passages_with_hot_anchors(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [(i, f"a{i} b{i} " + passage + f" c{i} " + " ".join(f"u{i}x{j}" for j in range(i))) for i in range(12)]
    for hot in (1, 1000):
        got = {r.doc_id: r for r in substrings.without_repeats(docs(spark, texts), hot=hot, shard_words=500).collect()}
        assert got[0].n_removed == 0 and got[0].kept_text == " ".join(texts[0][1].split())
        assert all(got[i].n_removed == 70 and got[i].kept_text.split()[:3] == [f"a{i}", f"b{i}", f"c{i}"] for i in range(1, 12))


def test_boilerplate_stays_once(spark):
    line = "Accept all cookies to go on reading"
    texts = [(i, f"own text number {i} of this document\n {line} \nshort") for i in range(11)] + [(20, line)]
    got = {r.doc_id: r for r in lines.deduplicated(docs(spark, texts)).collect()}
    assert line in got[0].text and got[0].n_chars == len(texts[0][1])
    assert all(got[i].text == f"own text number {i} of this document\nshort" and got[i].n_chars == len(got[i].text) for i in range(1, 11))
    assert 20 not in got  # nothing but boilerplate
    assert hashlib.sha256(got[3].text.encode()).hexdigest()


def test_classifier_finds_toxic_and_poor_documents(spark):
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(600):
        words = [f"w{x}" for x in rng.integers(0, 300, 60)]
        bad, poor = i % 6 == 0, i % 5 == 0
        if bad:
            words[7] = "scum"
        texts.append((i, " ".join(w + "***" if poor else w for w in words)))
        if i % 2 or i % 3 == 0:
            labels.append((i, int(not poor), int(bad)))
    d, known = docs(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.scored(d, quality.fit(d, known)).collect()}
    assert sum(got[i] == (i % 6 != 0 and i % 5 != 0) for i in got) >= 590


def test_classifier_learns_from_every_unlabelled_document(spark):
    rows, labels = [], []
    for i in range(8600):
        bad = i % 20 == 0
        words = [f"w{(i * 7 + j * j) % 300}" for j in range(8)]
        if i < 600:
            labels.append((i, 1, int(bad)))
        elif bad:  # words that only unlabelled documents hold, each eight of them
            words.append(f"bad{i // 20 % 50}")
        rows.append((i, " ".join(words), "en", f"bad{i % 3}" if bad else f"s{i % 7}", 60))
    model = quality.fit(spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert {quality._hash(f"bad{j}") for j in range(50)} <= set(model.views["toxic"][0].features.tolist())


def test_pipeline_runs_every_stage(spark):
    import corpus_pipeline

    sizes, d = [], table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        d = spark.createDataFrame(out.collect(), d.schema)
        sizes.append(d.count())
    assert sizes == sorted(sizes, reverse=True)
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
