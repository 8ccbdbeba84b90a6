"""Periodic runs, toxicity and conversation repair: brute force, held-out accuracy, awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millaudit.llm import periodic, queries, repair, toxicity
from millaudit.llm.common import table

SF = "/root/testdata/sf0.01"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_runs(s):
    n, out = len(s), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(6, 4 * p) and not any(all(s[k] == s[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                out.add((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, k = rng.randint(0, 70), rng.choice((1, 2, 2, 3, 6))
    s = [rng.randint(1, k) for _ in range(n)]
    if n > 5 and rng.random() < 0.5:
        a, p = rng.randrange(n), 1 + rng.randrange(7)
        s = [s[i] if i < a else s[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return s


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        s = random_words(rng)
        assert periodic.runs(s) == plain_runs(s), s


def test_extensions_and_tree():
    rng = random.Random(6)
    for _ in range(200):
        s = random_words(rng)
        if len(s) < 2:
            continue
        found = periodic.Extensions(s, both_orders=True)
        suffixes = sorted(range(len(s) + 1), key=lambda i: s[i:])
        assert [int(r) for r in np.argsort(found.rank)] == suffixes
        assert [int(r) for r in np.argsort(found.opposite)] == sorted(range(len(s) + 1), key=lambda i: [-x for x in s[i:]])
        a, b = rng.sample(range(len(s) + 1), 2)
        common = next((k for k in range(len(s)) if s[a + k : a + k + 1] != s[b + k : b + k + 1] or a + k >= len(s) or b + k >= len(s)), len(s))
        assert found.common(np.array([a]), np.array([b])).tolist() == [common]


def test_stretches_of_several_texts_keep_every_run():
    rng = random.Random(7)
    for _ in range(300):
        rows = [random_words(rng) for _ in range(rng.randint(1, 6))]
        texts = [" \n".join(map(str, s)).encode() if s else rng.choice((None, b"", b" \t")) for s in rows]
        for s, (found, kept) in zip(rows, periodic.text_runs(texts, [None] * len(texts))):
            assert found == plain_runs(s)
            gone = {k for a, n, p in found for k in range(a + p, a + n)}
            assert kept == b" ".join(str(x).encode() for i, x in enumerate(s) if i not in gone)


def plain_periodic(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    found = plain_runs([number[w] for w in words])
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {k for a, m, p in found for k in range(a + p, a + m)}
    listed = "".join(f"{a},{m},{p}\n" for a, m, p in found)
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed)]
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, *digests)


def test_op11_equals_brute_force(spark):
    documents = table(spark, SF, "documents")
    few = {r.doc_id: r.text for r in documents.where(F.length("text") < 3000).collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == documents.count()
    assert sum(r[0] > 0 for r in got.values()) > 20
    for doc_id, text in few.items():
        assert got[doc_id] == plain_periodic(doc_id, text), doc_id


def test_op11_awkward_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x " * 50, "a"), (3, "word " * 30_000, "a"), (4, "é　é " * 9, "a"), (4, "é　é " * 9, "a"), (5, " ".join(map(str, range(40_000))), "a")]
    for found in (rows, []):
        d = spark.createDataFrame(found, "doc_id bigint, text string, start string").withColumn("n_runs", F.lit("x"))
        out = periodic.periodic_runs(d).collect()
        assert len(out) == len(found)
    by_id = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string, start string")).collect()}
    assert (by_id[3].start, by_id[3].length, by_id[3].period, by_id[3].collapsed) == (0, 30_000, 1, "word")
    assert by_id[None].n_runs == 1 and by_id[1].n_runs == by_id[2].n_runs == by_id[5].n_runs == 0
    assert by_id[4].collapsed == "é　é" and by_id[1].start is None


def test_windows_hold_the_whole_text():
    for text in ("", "a", "word " * 500, "x" * 300, "é" * 100 + " b"):
        data = toxicity.normalised(text)
        found = toxicity.windows(data)
        assert b"".join(found) == data and all(len(w) <= toxicity.WINDOW for w in found)


def test_op12_held_out_accuracy(spark):
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    documents = table(spark, "/root/testdata/sf0.1", "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.fit(documents, labels)
    judged = toxicity.scored(documents.select("doc_id", "text"), model).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    assert (judged["predicted"] == judged["toxic"]).mean() > 0.93
    order = judged["score"].rank().to_numpy()
    bad = judged["toxic"].to_numpy() > 0
    # Measured: 95.1 % right, area under the curve 0.9197; few labels of three languages are what it lacks.
    assert (order[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum()) > 0.9
    assert len(model.toxic) <= toxicity.TOXIC_BYTES and judged["score"].between(0, 1).all()


def test_op12_takes_awkward_rows_and_no_labels(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (3, "x" * 100_000), (4, "a b"), (4, "a b"), (5, "é " * 30_000)]
    for found in (rows, []):
        d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in found], DOCUMENTS).withColumn("score", F.lit("x")).withColumn("other", F.lit(1))
        for labels in ([], [(1, 0, 1), (3, 1, 0), (3, 1, 1), (4, None, None), (None, 1, 1)]):
            known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
            out = toxicity.scored(d, toxicity.fit(d, known))
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "other", "held_out", "score", "predicted"]
            got = out.collect()
            assert len(got) == len(found) and all(0 <= r.score <= 1 for r in got)
            assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def plain_repair(rows):
    """Cheapest edits and their least letters for (initial, must go, truncated), by costs to go and a walk."""
    n, far = len(rows), 10**9
    to_go = [None] * n + [[0, far, far, 0]]
    for i in range(n, -1, -1):
        now = to_go[i] or [far] * 4
        if i < n:
            initial, gone, cut = rows[i]
            for s in range(4):
                ways = [3 + to_go[i + 1][s]]
                if not gone:
                    ways.append(2 + cut + to_go[i + 1][repair.GIVEN[s]])
                    if (s, initial) in repair.NEXT:
                        ways.append(cut + to_go[i + 1][repair.NEXT[s, initial]])
                now[s] = min(ways)
        for _ in range(4):
            now = [min(now[s], 2 + now[repair.GIVEN[s]]) for s in range(4)]
        to_go[i] = now
    s, i, out = 0, 0, ""
    while i < n or s not in (0, 3):
        c, ways = to_go[i][s], []
        if i < n:
            initial, gone, cut = rows[i]
            ways.append(("D", 3, i + 1, s))
            if not gone:
                ways.append(("R", 2 + cut, i + 1, repair.GIVEN[s]))
                if (s, initial) in repair.NEXT:
                    ways.append(("K", cut, i + 1, repair.NEXT[s, initial]))
        ways.append(("I", 2, i, repair.GIVEN[s]))
        letter, _, i, s = min(w for w in ways if w[1] + to_go[w[2]][w[3]] == c)
        out += letter
    return to_go[0][0], out


def plain_conversations(rows):
    said = {}
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        said.setdefault(conv_id, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for conv_id, turns in said.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        seen, counts, told = set(), [0, 0, 0], []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            told.append((role[:1], fault in (0, 1), int(fault == 2)))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = plain_repair(told)
        state, at, body = 0, 0, []
        for letter in audit:
            if letter == "K":
                body.append(f"{turns[at][1]}:{turns[at][2]}")
                state = repair.NEXT[state, turns[at][1][:1]]
            elif letter in "RI":
                state = repair.GIVEN[state]
                body.append(f"{'user' if state == 2 else 'assistant'}:{turns[at][2] if letter == 'R' else ''}")
            at += letter != "I"
        out[conv_id] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest())
    return out


def awkward_turns():
    rng = random.Random(8)
    rows = []
    for c in range(120):
        for t in range(rng.choice((1, 2, 5, 20))):
            for _ in range(rng.choice((1, 1, 2))):
                role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
                text = rng.choice(("Hi.", "Ok!", "no", " \t ", "", None, "What? \n", f"x{rng.random()}.", "é" * 50))
                rows.append((c or None, rng.choice((t, t, t, None)), role, text))
    rows += [(999, t, rng.choice(("user", "assistant")), f"text {rng.randint(0, 1500)}.") for t in range(1800)]  # several blocks
    return rows


def test_matrices_equal_plain_programming():
    rng = random.Random(9)
    grammar = [("ua", "一"), ("AU", "丁"), ("一一", "丂")]
    known = repair.matrices(grammar)
    for _ in range(1500):
        sequence = "".join(rng.choice(repair.SYMBOLS) for _ in range(rng.randint(0, 14)))
        cost, rope = repair.last_inserts(repair.over(repair.FROM_START, sequence, grammar, known))
        assert (cost, repair.spelled(rope)) == plain_repair([(x.lower(), x == repair.GONE, int(x.isupper())) for x in sequence]), sequence


@pytest.mark.parametrize("rows", [awkward_turns(), []], ids=["awkward", "empty"])
def test_op13_equals_brute_force(spark, rows):
    turns = spark.createDataFrame(rows, TURNS).withColumn("copies", F.lit("x")).withColumn("said", F.lit("y"))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(repair.damaged(turns)).collect()}
    assert got == plain_conversations(rows)


def test_repaired_rows_follow_the_pattern(spark):
    turns = repair.damaged(spark.createDataFrame(awkward_turns(), TURNS))
    told = repair.repair_reports(turns)
    rows = repair.repaired_rows(turns, told).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "edit", "role", "text"))).alias("rows"))
    found = rows.collect()
    assert found
    for r in found:
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in r.rows))
        assert [x.position for x in r.rows] == list(range(len(r.rows)))


def test_grammar_does_not_change_a_repair(spark):
    turns = repair.damaged(table(spark, SF, "conversations"))
    blocks = repair.written(repair.blocks(repair._said_before(repair._narrow(turns))), "test-blocks")
    grammar = repair.fitted_grammar(blocks)
    assert grammar and all(len(pair) == 2 for pair, _ in grammar)
    bare, full = repair.matrices([]), repair.matrices(grammar)
    for (symbols,) in blocks.select("symbols").distinct().collect():
        short = repair.compressed(symbols, grammar)
        assert len(short) <= len(symbols)
        a, b = (repair.last_inserts(repair.over(repair.FROM_START, symbols, g, m)) for g, m in (([], bare), (grammar, full)))
        assert (a[0], repair.spelled(a[1])) == (b[0], repair.spelled(b[1]))


def test_numerals_are_no_letters(spark):
    from millaudit.llm import language_id

    assert language_id.words_of("½ ² ① 12 _ -") == [] and language_id.words_of("x²y ab½ É") == ["▁x", "▁y", "▁ab", "▁é"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["the words of a text", "some other words", "½ ² ①", None, "12"] * 4)]
    d = spark.createDataFrame(rows, DOCUMENTS)
    got = {r.doc_id: r.lang_pred for r in language_id.predicted(d, language_id.fit(d, queries.LANGUAGE_VOCABULARY)).collect()}
    assert [got[i] for i in range(5)] == ["en", "en", "und", "und", "und"]
