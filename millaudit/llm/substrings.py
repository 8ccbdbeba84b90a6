"""Substring dedup with compressed FM-indexes.

Words are runs of `[^\\x20\\x09-\\x0D]`. Every window of WINDOW words is assigned to the smallest word-gram hash in it (its
anchor), so equal windows share an anchor. The windows of one anchor that follow each other in a document form a segment. Segments whose
anchor occurs in several documents go to shards by anchor; each shard builds an FM-index of its distinct segments and streams them
through it by backward search. Matching statistics of at least WINDOW words are reported with the smallest document they start in.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millaudit.llm.common import Words, bit_place, bitmap, has_bit, mixed, row_groups, sequence_hashes, written
from millaudit.llm.fm_index import FMIndex

#: Words of a window, and of the grams among which the anchor is chosen.
WINDOW = 50
GRAM = 8
#: Words of a shard, and distinct segments of an anchor beyond which its windows are spread over shards one by one.
SHARD_WORDS = 250_000
HOT_SEGMENTS = 3_000
_NO_DOC = np.int64(np.iinfo(np.int64).max)


def _first_least(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the first smallest of each ``span`` neighbouring values (by their high 40 bits)."""
    place = np.uint64((1 << 24) - 1)
    key = (values & ~place) | np.arange(values.size, dtype=np.uint64)
    have = 1
    while have * 2 <= span:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < span:
        key = np.minimum(key[: key.size - (span - have)], key[span - have :])
    return (key & place).astype(np.int64)


def segments_of(words: Words, window: int = WINDOW, gram: int = GRAM):
    """Row, first word in the row, number of windows, anchor and content hash of every segment."""
    parts = []
    hashes = words.hashes
    long_rows = np.flatnonzero(words.count >= window)
    # Rows are taken together up to 2^22 words; a longer row goes alone, in overlapping stretches that cut no segment
    # differently, because the anchor of a window depends on the window alone.
    at = 0
    while at < long_rows.size:
        row, last = long_rows[at], at
        begin = int(words.first[row])
        limit = begin + (1 << 22)
        while last + 1 < long_rows.size and words.first[long_rows[last + 1]] + words.count[long_rows[last + 1]] <= limit:
            last += 1
        end = int(words.first[long_rows[last]] + words.count[long_rows[last]])
        for stretch in range(begin, max(begin + 1, end - window + 1), 1 << 22):
            parts.append(_stretch(words, hashes, stretch, min(end, stretch + (1 << 22) + window - 1), window, gram))
        at = last + 1
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2


def _stretch(words: Words, hashes: np.ndarray, begin: int, end: int, window: int, gram: int):
    own = hashes[begin:end]
    n = own.size - window + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    grams, whole = sequence_hashes(own, gram), sequence_hashes(own, window)
    anchor = _first_least(grams, window - gram + 1)[:n]
    row = words.row[begin : begin + n]
    inside = row == words.row[begin + window - 1 : begin + window - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    stop = np.append(np.flatnonzero(new | ~inside), n)
    last = stop[np.searchsorted(stop, first, side="right")] - 1
    count = last - first + 1
    content = mixed(whole[first] * np.uint64(3) + whole[last] * np.uint64(5) + count.astype(np.uint64))
    return row[first], begin + first - words.first[row[first]], count, grams[anchor[first]], content


def occurrences(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(anchor, segment, doc_id, text_key, first, n): every segment of every document that has an id."""

    def run(batches):
        for batch in batches:
            texts = batch.column("body").to_pylist()
            for begin, end in row_groups(texts):
                row, first, n, anchor, content = segments_of(Words(texts[begin:end]), window, gram)
                take = pa.array(row + begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column("doc_id").take(take),
                        batch.column("text_key").take(take), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)),
                    ],
                    names=["anchor", "segment", "doc_id", "text_key", "first", "n"],
                )

    rows = _rows(documents).where("doc_id is not null").drop("bit")
    return rows.mapInArrow(run, "anchor bigint, segment bigint, doc_id bigint, text_key bigint, first int, n int")


def _rows(documents: DataFrame) -> DataFrame:
    """Document rows as the functions here read them; rows of one id are told apart by a hash of the text."""
    return documents.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("body"), bit_place("doc_id"))


def _spread(rows: DataFrame, extra: DataFrame, handed) -> DataFrame:
    """Rows whose bit is set, joined with the extra columns of their (doc_id, text_key)."""

    def run(batches):
        bits = np.frombuffer(handed.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(has_bit(bits, batch.column("bit").to_numpy())))

    return rows.mapInArrow(run, rows.schema).drop("bit").join(extra, ["doc_id", "text_key"])


def segment_texts(documents: DataFrame, chosen: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, segment, doc_id, hot, part, body) with the words of the chosen segments (doc_id, text_key, first, n, anchor, segment, hot).

    A hot anchor's segments come as single windows, ``part`` telling which.
    """
    lists = chosen.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "n", "anchor", "segment", "hot")).alias("wanted"))  # bounded by the document's length
    handed = documents.sparkSession.sparkContext.broadcast(bitmap(chosen.select("doc_id"), "doc_id"))

    def run(batches):
        for batch in batches:
            texts, wanted, docs = batch.column("body").to_pylist(), batch.column("wanted").to_pylist(), batch.column("doc_id").to_pylist()
            for begin, end in row_groups(texts):
                words = Words(texts[begin:end])
                out: list[tuple] = []
                for i in range(begin, end):
                    base = int(words.first[i - begin])
                    for w in wanted[i]:
                        at = base + w["first"]
                        if w["hot"]:
                            out += [(w["anchor"], w["segment"], docs[i], True, j, words.window(at + j, at + j + window)) for j in range(w["n"])]
                        else:
                            out.append((w["anchor"], w["segment"], docs[i], False, 0, words.window(at, at + w["n"] + window - 1)))
                columns = list(zip(*out)) or [[]] * 6
                types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor", "segment", "doc_id", "hot", "part", "body"])

    rows = _spread(_rows(documents), lists, handed).dropDuplicates(["doc_id", "text_key"])
    return rows.mapInArrow(run, "anchor bigint, segment bigint, doc_id bigint, hot boolean, part int, body binary")


def matching_statistics(bodies: list[bytes], docs: np.ndarray, window: int = WINDOW):
    """For each text and each of its windows the smallest document in which the window starts.

    Builds one FM-index of all texts and streams every text through it from right to left: each backward step adds one word
    to the match; a match of ``window`` words is reported and shortened by its last word.
    """
    words = Words(bodies)
    known, code = np.unique(words.hashes, return_inverse=True)
    # One separator after each text.
    place = np.arange(words.hashes.size) + words.row
    codes = np.zeros(words.hashes.size + len(bodies), np.int64)
    codes[place] = code + 1
    index = FMIndex(codes, known.size + 1, window)
    doc_of = np.repeat(docs, words.count + 1)
    ordered_docs = doc_of[index.order]
    order = np.argsort(-words.count, kind="stable")
    counts = words.count[order]
    at = words.first[order] + order + counts - 1  # last word of each text among the codes
    lo, hi = np.zeros(order.size, np.int64), np.full(order.size, codes.size, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in range(int(counts[0]) if order.size else 0):
        live = int(np.searchsorted(-counts, -step, side="left"))  # texts with more than ``step`` words
        lo, hi = index.extend(codes[at[:live] - step], lo[:live], hi[:live])
        if step + 1 >= window:
            found.append((order[:live], lo, hi))
            lo, hi = index.shorten(lo)
    if not found:
        return [np.zeros(0, np.int64) for _ in bodies]
    lo_all, hi_all = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
    smallest = _range_least(ordered_docs, lo_all, hi_all)
    out = [np.empty(max(0, int(c) - window + 1), np.int64) for c in words.count]
    taken = 0
    for step, (texts, lo_part, _) in enumerate(found):
        for t, v in zip(texts.tolist(), smallest[taken : taken + lo_part.size].tolist()):
            out[t][out[t].size - 1 - step] = v
        taken += lo_part.size
    return out


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest value of each range [lo, hi); equal ranges are worked out once."""
    begins, back = np.unique(lo, return_inverse=True)
    ends = np.zeros(begins.size, np.int64)
    ends[back] = hi
    edges = np.stack((begins, ends), axis=1).ravel()  # ranges never overlap: they are classes of equal windows
    padded = np.append(values, _NO_DOC)
    return np.minimum.reduceat(padded, edges)[::2][back]


def _search(window: int):
    def run(group: pa.Table) -> pa.Table:
        least = matching_statistics(group.column("body").to_pylist(), group.column("doc_id").to_numpy(), window)
        anchor, segment, out = group.column("anchor").to_pylist(), group.column("segment").to_pylist(), []
        for a, s, values in zip(anchor, segment, least):
            edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
            out += [(a, s, int(b), int(e - b), int(values[b])) for b, e in zip(edges, edges[1:])]
        columns = list(zip(*out)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor", "segment", "begin", "windows", "least"])

    return run


def repeated_intervals(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, text_key, spans): word ranges [begin, end] covered by windows that also start in a smaller doc_id."""
    every = written(occurrences(documents, window, gram), "occurrences")
    several = every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    shared = written(every.join(several, "anchor"), "shared")
    # One occurrence of each distinct segment, in its smallest document, stands for all.
    distinct = shared.groupBy("anchor", "segment").agg(F.min(F.struct("doc_id", "text_key", "first", "n")).alias("o")).select("anchor", "segment", "o.*")
    distinct = written(distinct, "distinct")
    heavy = distinct.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("anchor", F.lit(True).alias("heavy"))
    chosen = written(distinct.join(heavy, "anchor", "left").withColumn("hot", F.coalesce("heavy", F.lit(False))).drop("heavy"), "chosen")
    texts = written(segment_texts(documents, chosen, window), "texts")

    total = chosen.agg(F.sum(F.when(F.col("hot"), F.col("n").cast("bigint") * window).otherwise(F.col("n") + window - 1))).first()[0] or 0
    shards = int(max(1, -(-total // shard_words)))
    windows = (
        texts.where("hot").groupBy(F.xxhash64("body").alias("anchor"), F.lit(0).cast("bigint").alias("segment"), "body").agg(F.min("doc_id").alias("doc_id"))
    )
    found = []
    for rows in (texts.where("not hot"), windows):
        dealt = rows.select("anchor", "segment", "doc_id", "body", F.pmod(F.hash("anchor"), F.lit(shards)).alias("shard"))
        found.append(dealt.groupBy("shard").applyInArrow(_search(window), "anchor bigint, segment bigint, begin int, windows int, least bigint"))
    of_windows = (
        texts.where("hot").select("anchor", "segment", "part", F.xxhash64("body").alias("key"))
        .join(found[1].select(F.col("anchor").alias("key"), "least"), "key").select("anchor", "segment", F.col("part").alias("begin"), F.lit(1).alias("windows"), "least")
    )
    matches = found[0].unionByName(of_windows)
    hits = shared.join(matches, ["anchor", "segment"]).where("least < doc_id")
    begin = F.col("first") + F.col("begin")
    return (
        hits.select("doc_id", "text_key", F.struct(begin.alias("b"), (begin + F.col("windows") + (window - 1)).alias("e")).alias("span"))
        .groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"))  # bounded by the document's length
    )


def _kept(with_spans: bool, as_text: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column("body").to_pylist()
            spans = batch.column("spans").to_pylist() if with_spans else [()] * len(texts)
            n_words, n_removed, kept = [], [], []
            for begin, end in row_groups(texts):
                for text, own in zip(texts[begin:end], spans[begin:end]):
                    words = (text or b"").split()
                    n_words.append(len(words))
                    if own:
                        keep = np.ones(len(words), bool)
                        for s in own:
                            keep[s["b"] : s["e"]] = False
                        words = [w for w, k in zip(words, keep.tolist()) if k]
                    n_removed.append(n_words[-1] - len(words))
                    body = b" ".join(words)
                    kept.append(body.decode() if as_text else hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text" if as_text else "kept_sha256"],
            )

    return run


def without_repeats(documents: DataFrame, window: int = WINDOW, as_text: bool = True, **search) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per document row; with ``as_text=False`` the digest of the text instead.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id; windows are judged
    on the input. Null and empty texts have no words. Rows of one doc_id are one document. A row without doc_id is neither smaller nor
    larger than any and stays whole. Repeated rows come back as often as they came; extra columns are left out.
    """
    spans = written(repeated_intervals(documents, window, **search), "spans")
    handed = documents.sparkSession.sparkContext.broadcast(bitmap(spans.select("doc_id"), "doc_id"))
    out = "doc_id bigint, n_words bigint, n_removed bigint, " + ("kept_text string" if as_text else "kept_sha256 string")

    def where(set_bit):
        def run(batches):
            bits = np.frombuffer(handed.value, np.uint8)
            for batch in batches:
                yield batch.filter(pa.array(has_bit(bits, batch.column("bit").to_numpy()) == set_bit))

        return run

    rows = _rows(documents).withColumn("bit", F.coalesce("bit", F.lit(0)))
    maybe = rows.mapInArrow(where(True), rows.schema).drop("bit").join(spans, ["doc_id", "text_key"], "left").mapInArrow(_kept(True, as_text), out)
    surely_whole = rows.mapInArrow(where(False), rows.schema).drop("bit").mapInArrow(_kept(False, as_text), out)
    return maybe.unionByName(surely_whole)
