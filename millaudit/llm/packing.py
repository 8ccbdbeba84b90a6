"""Best-fit packing: pattern packing by non-negative least squares.

Documents become token pieces of at most SIZE tokens. Only the histogram of piece lengths (SIZE numbers, however many
documents) reaches the driver. There, patterns of few lengths that fill a sequence are enumerated, repeat counts are fitted to the
histogram by non-negative least squares and rounded, and what is left is packed best-fit, pattern by pattern. The executors
then number the pieces of each length and read their place from the plan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millaudit.llm.common import written

#: Tokens of a sequence.
SIZE = 2048
#: The id that ends each document.
END_ID = 0
#: Words, and parts of words, whose ids a Python worker remembers: about 40 MB, which it keeps for later tasks.
REMEMBERED = 100_000
#: Documents cut together.
CHUNK = 500
#: Most documents of an enumerated pattern, and most patterns fitted at once.
PATTERN_DOCS = 3
FITTED_PATTERNS = 40_000
#: Pieces numbered together in one group.
NUMBERED = 50_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: Words whose spelling the tokenizer does not change but for lower case: printable ASCII and Latin-1 letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's parts of such a word.
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9]|[^a-z0-9ªµºß-öø-ÿ]+")


class PartIds(dict):
    """Token ids of a part of a plain word as bytes."""

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255 in order
        self.letters = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in visible)}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        spelled = part.encode().decode("latin-1").translate(self.letters)
        ids = self[part] = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        return ids


class WordIds(dict):
    """Token ids of a word as bytes. Words are remembered; the tokenizer never joins across a space, tab or line end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = PartIds(self.tokenizer)
        # The short way is taken only where it gives the tokenizer's own answer.
        probe = "Don't stop's It'LL !!x'9a#[] Größe,ÀÉ.ª½".split(" ")
        self.plain = all(self._plain_ids(w) == self._ids(w) for w in probe if _PLAIN.fullmatch(w))

    def _ids(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain_ids(self, word: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PART.findall(word.lower())))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        plain = self.plain and len(word) <= 64 and "<|" not in word and _PLAIN.fullmatch(word)
        ids = self._plain_ids(word) if plain else self._ids(word)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per vocabulary and Python worker, so that tasks go on with what earlier ones remembered."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def _pieces(path: str, size: int, with_ids: bool):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for whole in batches:
            for first in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(first, CHUNK)
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = words.text(text or "") + end
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                columns = list(zip(*rows)) or [[]] * 6
                kinds = [("doc_id", batch.schema.field("doc_id").type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
                kinds = kinds[: 6 if with_ids else 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    return run


def token_pieces(documents: DataFrame, tokenizer_path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of each document row: (doc_id, piece, start, length, ids_crc32), with the ids as bytes if asked for.

    A null or empty text is the end id alone. Only documents longer than ``size`` tokens are cut. Repeated rows give
    repeated pieces; extra columns are left out.
    """
    rows = documents.select("doc_id", "text")
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    schema = PIECES.replace("doc_id bigint", f"doc_id {doc_type}") + (", ids binary" if with_ids else "")
    return rows.mapInArrow(_pieces(tokenizer_path, size, with_ids), schema)


def _patterns(lengths: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Patterns of up to PATTERN_DOCS lengths that occur and fill a sequence exactly, most frequent lengths first."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    out = [(size,)] if have[size] else []
    out += [(int(a), size - int(a)) for a in lengths if size - a <= a < size and have[size - a]]
    common = lengths[np.argsort(-counts, kind="stable")]
    for a in common:
        b = lengths[lengths <= a]
        c = size - a - b
        fits = (c > 0) & (c <= b)
        fits[fits] = have[c[fits]]
        out += [(int(a), int(x), int(y)) for x, y in zip(b[fits], c[fits])]
        if len(out) >= FITTED_PATTERNS:
            break
    return out


def fitted_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that make the patterns' lengths meet the histogram, least squares.

    Projected gradient with momentum on 0.5 |A x - histogram|^2; A is never built, its columns are the patterns.
    """
    width = max(map(len, patterns))
    slots = np.array([p + (0,) * (width - len(p)) for p in patterns])
    live = slots > 0
    n = histogram.size

    def forward(x):
        return np.bincount(slots.ravel(), np.repeat(x, width) * live.ravel(), n)

    def back(r):
        return (r[slots] * live).sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue of A'A gives the step
        w = back(forward(v))
        v = w / max(np.linalg.norm(w), 1e-12)
    step = 1 / max(np.linalg.norm(back(forward(v))) * 1.05, 1e-12)
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(forward(y) - histogram), 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def packing_plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) that use every piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(pattern, times):
        if times > 0:
            plan.append((pattern, int(times)))
            for length in pattern:
                left[length] -= times

    lengths = np.flatnonzero(left)
    patterns = _patterns(lengths, left[lengths], size) if lengths.size else []
    if patterns:
        x = fitted_counts(patterns, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            p, need = patterns[i], round(x[i])
            if need <= 0:
                break
            use(p, min([need, *(left[length] // p.count(length) for length in p)]))
    while (lengths := np.flatnonzero(left)).size:  # the residue: longest first, then the best fit
        pattern, room = [], size
        free = left.copy()
        while (fit := np.flatnonzero(free[: room + 1])).size:
            best = int(fit[-1])
            pattern.append(best)
            free[best] -= 1
            room -= best
        use(tuple(pattern), min(left[length] // pattern.count(length) for length in set(pattern)))
    return plan


class Places:
    """Where the n-th piece of a length goes: runs of pieces per length, each run one slot of one pattern."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], size: int = SIZE):
        taken = np.zeros(size + 1, np.int64)
        first_sequence, keys, begins, sequences, offsets = 0, [], [], [], []
        for pattern, times in plan:
            offset = 0
            for length in pattern:
                keys.append(length)
                begins.append(int(taken[length]))
                sequences.append(first_sequence)
                offsets.append(offset)
                taken[length] += times
                offset += length
            first_sequence += times
        order = np.lexsort((begins, keys))
        self.keys, self.begins, self.sequences, self.offsets = (np.array(x, np.int64)[order] for x in (keys, begins, sequences, offsets))
        self.first = np.searchsorted(self.keys, np.arange(size + 2))
        self.sequences_used = first_sequence

    def of(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((numbers, lengths))
        run = np.empty(lengths.size, np.int64)
        for length in np.unique(lengths):
            own = order[np.searchsorted(lengths[order], length) : np.searchsorted(lengths[order], length, "right")]
            a, b = self.first[length], self.first[length + 1]
            run[own] = a + np.searchsorted(self.begins[a:b], numbers[own], side="right") - 1
        return self.sequences[run] + numbers - self.begins[run], self.offsets[run]


def packed(pieces: DataFrame, size: int = SIZE, numbered: int = NUMBERED) -> DataFrame:
    """The pieces with sequence_id and offset: every piece once, sequences gapless from 0 and at most ``size`` long.

    ``pieces`` is read three times, so it should be a written table. Pieces of a length are numbered in groups of about ``numbered``
    by a hash of the whole row, so that a frequent length is spread over many groups; group counts give the
    offsets. Equal rows are interchangeable. No pieces give no rows.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``size`` rows
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counted:
        histogram[length] = n
    places = spark.sparkContext.broadcast(Places(packing_plan(histogram, size), size))  # grows with size, not with documents
    groups = int(max(1, -(-histogram.sum() // numbered)))
    by_hash = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = by_hash.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = (
        by_hash.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, ["length", "part"])
        .withColumn("number", F.col("before") + F.col("inside")).select(*pieces.columns, "number")
    )

    def place(batches):
        where = places.value
        for batch in batches:
            sequences, at = where.of(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            kept = batch.select(pieces_columns)
            yield kept.append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(at))

    pieces_columns = pieces.columns
    schema = pieces.limit(0).select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).schema
    return ranked.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; see ``token_pieces`` and ``packed``."""
    return packed(written(token_pieces(documents, tokenizer_path, size, with_ids), "pieces"), size)
