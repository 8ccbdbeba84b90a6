"""Shared pieces: tables, the shared folder, word hashes over raw bytes, bounded bitmaps."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes hashed at once; longer texts go through in blocks cut between words.
BLOCK = 1 << 18
#: Bytes of text handled together inside a task.
GROUP = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session without one, as in tests, must be local and gets its own, removed when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return base


@functools.cache
def _own_folder(application: str) -> str:
    base = tempfile.mkdtemp(prefix="millaudit-llm-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again: worked out once, and safe when executors are lost."""
    spark = rows.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def separators(keep) -> np.ndarray:
    """256 flags: which byte ends a word. ``keep(byte)`` says which bytes belong to words."""
    return np.array([not keep(b) for b in range(256)])


#: Bytes outside `[^\x20\x09-\x0D]+`.
WHITE = separators(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > BLOCK:
        return _make_powers(n)
    if BLOCK not in _POWERS:
        _POWERS[BLOCK] = _make_powers(BLOCK)
    return _POWERS[BLOCK]


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _block_words(data: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(data.size + 2, np.int8)
    inside[1:-1] = ~is_sep[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not starts.size:
        return starts, ends, np.zeros(0, np.uint64)
    up, down = _powers(data.size)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(data: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word in the bytes; memory beside the result is bounded by blocks."""
    parts, at = [], 0
    while at < data.size:
        end = min(data.size, at + BLOCK)
        if end < data.size:
            cut = np.flatnonzero(is_sep[data[at:end]])
            while not cut.size and end < data.size:  # one word longer than a block
                more = min(data.size, end + BLOCK)
                cut = np.flatnonzero(is_sep[data[end:more]]) + (end - at)
                end = more
            if cut.size:
                end = at + int(cut[-1]) + 1
        starts, ends, hashes = _block_words(data[at:end], is_sep)
        parts.append((starts + at, ends + at, hashes))
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def row_groups(texts: list, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together stay near the limit; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


class Words:
    """The words of several texts side by side: row of each word, its bytes' place and its hash."""

    def __init__(self, texts: list, is_sep: np.ndarray = WHITE):
        lengths = np.array([len(t or b"") for t in texts], np.int64)
        self.raw = b"\n".join(t or b"" for t in texts)
        self.starts, self.ends, self.hashes = hashed_words(np.frombuffer(self.raw, np.uint8), is_sep)
        first_byte = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.row = np.searchsorted(first_byte, self.starts, side="right") - 1
        #: Number of words per row, and the place of each row's first word.
        self.count = np.bincount(self.row, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))[:-1]

    def window(self, first: int, last: int) -> bytes:
        """The words first to last - 1, joined by one space."""
        return b" ".join(self.raw[s:e] for s, e in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist()))


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbouring words, by doubling."""
    n = hashes.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    result, have, power, span, step = None, 0, hashes, 1, _STEP
    while True:
        if k & span:  # put this power of two behind what there is
            result = power[:n].copy() if result is None else result * step + power[have : have + n]
            have += span
        if span * 2 > k:
            return mixed(result + np.uint64(k))
        power = power[:-span] * step + power[span:]
        span, step = span * 2, np.uint64(int(step) ** 2 % (1 << 64))


def bitmap(ids: DataFrame, id_column: str, bits: int = 1 << 23) -> bytes:
    """A bitmap of fixed size over hashed ids: bounded however many ids there are.

    A row whose bit is not set is surely not among the ids; one whose bit is set may be. It only saves work before
    an exact join.
    """
    return gathered_bitmap(ids.select(bit_place(id_column, bits)), "bit", bits)


def gathered_bitmap(places: DataFrame, column: str, bits: int) -> bytes:
    """The bitmap of the places 0 to bits - 1 in a column: bits / 32768 rows of 4 KB on their way."""
    number = F.col(column) + 1  # Spark's first full bucket begins at 1
    parts = places.groupBy(F.bitmap_bucket_number(number).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("m"))
    whole = bytearray(bits // 8 + 4096)
    for b, m in parts.toLocalIterator():
        whole[(b - 1) * 4096 : b * 4096] = m
    return bytes(whole)


def bit_place(id_column: str, bits: int = 1 << 23) -> Column:
    """The place of a row's id in a bitmap, as a column to hand to ``has_bit``."""
    return F.pmod(F.xxhash64(id_column), F.lit(bits)).alias("bit")


def has_bit(whole: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (whole[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
