"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned over token windows, hits verified.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window is N consecutive words of an
item; an item of fewer words, but not none, is one window.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millaudit.llm.common import Words, row_groups, separators, sequence_hashes

#: Words of a window.
N = 10
#: Text bytes of benchmark items that go out in one broadcast; more items go out in further passes.
BROADCAST_BYTES = 2 << 20
#: Bytes that belong to words once A-Z are lower case.
WORD = separators(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


class Grams:
    """Windows of benchmark items: sorted hashes per window length, and the items of each window's words."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        self.items: dict[bytes, set] = {}
        hashes: dict[int, set] = {}
        for item_id, text in items:
            words = Words([text.lower()], WORD)
            size = min(n, words.hashes.size)
            if size:
                for at, h in enumerate(sequence_hashes(words.hashes, size).tolist()):
                    hashes.setdefault(size, set()).add(h)
                    self.items.setdefault(words.window(at, at + size), set()).add(item_id)
        self.hashes = {k: np.array(sorted(v), np.uint64) for k, v in sorted(hashes.items())}

    def hits(self, words: Words):
        """(row, first word, size, items) of every window that occurs, verified on its words."""
        for size, known in self.hashes.items():
            found = sequence_hashes(words.hashes, size)
            if not found.size:
                continue
            place = np.minimum(np.searchsorted(known, found), known.size - 1)
            for at in np.flatnonzero((known[place] == found) & (words.row[: found.size] == words.row[size - 1 :])).tolist():
                items = self.items.get(words.window(at, at + size))
                if items is not None:
                    yield int(words.row[at]), at, size, items


def _found(grams: Grams, texts: list):
    """Per text: number of words, hit spans, items."""
    for first, last in row_groups(texts):
        words = Words([(t or b"").lower() for t in texts[first:last]], WORD)
        spans: list[list] = [[] for _ in range(first, last)]
        items: list[set] = [set() for _ in range(first, last)]
        for row, at, size, found in grams.hits(words):
            begin = at - int(words.first[row])
            spans[row].append((begin, begin + size))
            items[row] |= found
        for count, row_spans, row_items in zip(words.count.tolist(), spans, items):
            yield count, row_spans, row_items


def _scan(handed, last_pass):
    """Arrow batches of (doc_id, body, n_words, spans, items): adds what this pass of the benchmark finds."""

    def run(batches):
        grams = pickle.loads(handed.value)
        for batch in batches:
            texts = batch.column("body").to_pylist()
            counts, spans, items = [], [], []
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            for (count, row_spans, row_items), (old_spans, old_items) in zip(_found(grams, texts), before):
                counts.append(count)
                row_spans += zip(old_spans[::2], old_spans[1::2])
                spans.append([x for s in _union(row_spans) for x in s])
                items.append(sorted({str(i) for i in row_items if i is not None} | set(old_items)))
            columns = {
                "doc_id": batch.column("doc_id"), "body": batch.column("body"), "n_words": pa.array(counts, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string())),
            }
            if last_pass:
                del columns["body"]
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _keep(handed):
    def run(batches):
        grams = pickle.loads(handed.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not spans for _, spans, _ in _found(grams, texts)], pa.bool_()))

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlaps, in order."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def passes(benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> list:
    """The benchmark's windows as broadcasts of at most ``broadcast_bytes`` of item text each (one item at least)."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", F.col("text").cast("binary").alias("body"))
    out, size, held = [], 0, []
    for item_id, body in items.toLocalIterator():
        if held and size + len(body) > broadcast_bytes:
            out.append(context.broadcast(pickle.dumps(Grams(held, n))))
            size, held = 0, []
        size += len(body)
        held.append((item_id, bytes(body)))
    out.append(context.broadcast(pickle.dumps(Grams(held, n))))
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) per document row: hit word ranges (begin, end, begin, end, ...) and item ids.

    The benchmark goes out in passes of bounded size; each pass adds to what the passes before it found, so the
    result does not depend on how the benchmark was split. Null texts have no words. Items without id give hits but are
    not listed. Repeated rows come back as often as they came; extra columns are left out. An empty benchmark hits
    nothing.
    """
    rows = documents.select(
        "doc_id", F.col("text").cast("binary").alias("body"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    handed = passes(benchmark, n, broadcast_bytes)
    for i, p in enumerate(handed):
        last = i == len(handed) - 1
        rows = rows.mapInArrow(_scan(p, last), rows.drop("body").schema if last else rows.schema)
    return rows


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``contamination``."""
    hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), F.lit(0).cast("bigint"), lambda s, i: s + F.col("spans")[i + 1] - F.col("spans")[i])
    n_hit = F.when(F.size("spans") == 0, F.lit(0).cast("bigint")).otherwise(hit)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents in which no benchmark window occurs, with the columns they came with; a null text is clean."""
    for p in passes(benchmark, n, broadcast_bytes):
        documents = documents.mapInArrow(_keep(p), documents.schema)
    return documents
