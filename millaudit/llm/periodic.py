"""Periodic runs in texts by longest common extensions on suffix trees.

A run's root, as the least rotation under one of two opposite orders of words, is the longest Lyndon word at its place. So the longest Lyndon word at
every place and order is a candidate, and two longest common extensions, to the right in the tree of the text and to the left in the tree of its reversal, tell
how far its period goes. Trees are Ukkonen's; their Euler tours are kept as leaves with the least depth between neighbours, on
which a table of minima answers every extension in constant time. A text's trees are built over its stretches where three neighbouring words keep coming back at
distances that a run of that stretch can have; no run lies outside them, and each stretch ends one word beyond what it can hold, so that a run cut
off by it is told apart.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millaudit.llm.common import Words, mixed, row_groups, sequence_hashes

#: A run repeats its period so often at least, and has so many words.
EXPONENT, LEAST = 4, 6
#: Words compared when looking for stretches, and rounds of narrowing them; further ones would only save work.
GRAM, ROUNDS = 3, 20


def suffix_tree(s: list[int]) -> tuple[array, array, dict[int, int], int]:
    """Ukkonen's tree of numbers that end in a 0 which occurs once: begins and ends of the edges into nodes, children by node and number."""
    n, width = len(s), max(s) + 1
    begin, end, link, child = array("q", [0]), array("q", [0]), array("q", [0]), {}
    node = edge = size = open_suffixes = 0
    for i, c in enumerate(s):
        open_suffixes += 1
        unlinked = 0
        while open_suffixes:
            if not size:
                edge = i
            key = node * width + s[edge]
            to = child.get(key)
            if to is None:
                child[key] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                span = end[to] - begin[to]
                if size >= span:
                    edge += span
                    size -= span
                    node = to
                    continue
                at = begin[to]
                if s[at + size] == c:
                    size += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                middle = len(begin)
                child[key] = middle
                begin.append(at)
                end.append(at + size)
                link.append(0)
                child[middle * width + c] = middle + 1
                begin.append(i)
                end.append(n)
                link.append(0)
                begin[to] = at + size
                child[middle * width + s[at + size]] = to
                if unlinked:
                    link[unlinked] = middle
                unlinked = middle
            open_suffixes -= 1
            if node:
                node = link[node]
            elif size:
                size -= 1
                edge = i - open_suffixes + 1
    return begin, end, child, width


class Extensions:
    """Suffix orders and longest common extensions of a sequence of numbers from 1."""

    def __init__(self, s: list[int], both_orders: bool = False):
        n = len(s)
        begin, end, child, width = suffix_tree([*s, 0])
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        keys, to = keys[order], np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        del child
        first = np.searchsorted(keys, np.arange(len(begin) + 1) * width).tolist()
        ends_text = (keys % width == 0).tolist()
        lengths = (np.frombuffer(end, np.int64) - np.frombuffer(begin, np.int64)).tolist()
        leaves, depths = _tour(to, first, ends_text, lengths, n, False)
        #: The rank of every suffix, the empty one least, in rising order and in that of the opposite numbers.
        self.rank = _ranks(leaves)
        self.opposite = _ranks(_tour(to, first, ends_text, lengths, n, True)[0]) if both_orders else None
        self.least, span = [depths], 1
        while 2 * span <= n:
            self.least.append(np.minimum(self.least[-1][:-span], self.least[-1][span:]))
            span *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the longest common beginning of the suffixes a and b, pair by pair, a and b different."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out


def _ranks(leaves: np.ndarray) -> np.ndarray:
    rank = np.empty(leaves.size, np.int64)
    rank[leaves] = np.arange(leaves.size)
    return rank


def _tour(to: list[int], first: list[int], ends_text: list[bool], lengths: list[int], n: int, opposite: bool) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of an Euler tour as suffixes, and the least depth between each and the next."""
    leaves, least = array("q"), array("q")
    shallow, stack = 0, [(0, 0, 0)]
    while stack:
        node, depth, above = stack.pop()
        if above < shallow:
            shallow = above
        low, high = first[node], first[node + 1]
        if low == high:
            if leaves:
                least.append(shallow)
            leaves.append(n + 1 - depth)
            shallow = depth
            continue
        below = to[low:high]
        if not opposite:
            below.reverse()
        elif ends_text[low]:  # the end of the text comes first in both orders
            below.append(below.pop(0))
        for b in below:
            stack.append((b, depth + lengths[b], depth))
    return np.array(leaves, np.int64), np.array(least, np.int32)


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word at every place ends: at the next smaller suffix."""
    ranks, out, waiting = rank.tolist(), np.empty(len(rank), np.int64), []
    for j, r in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > r:
            out[waiting.pop()] = j
        waiting.append(j)
    return out[:-1]  # the empty suffix is smaller than every other and ends the last words


def runs(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of numbers from 1, by start, then period."""
    n = len(s)
    if n < LEAST:
        return []
    right, left = Extensions(s, both_orders=True), Extensions(s[::-1])
    found = []
    for rank in (right.rank, right.opposite):
        begin, end = np.arange(n), lyndon_ends(rank)
        period = end - begin
        may = np.flatnonzero(EXPONENT * period <= n)
        begin, end, period = begin[may], end[may], period[may]
        after, before = right.common(begin, end), left.common(n - begin, n - end)
        length = period + after + before
        is_run = length >= np.maximum(LEAST, EXPONENT * period)
        found += zip((begin - before)[is_run].tolist(), length[is_run].tolist(), period[is_run].tolist())
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """Places [low, high) that hold every run of texts side by side; a row's stretches neither overlap nor leave it.

    In a run of period q and length L, L - q - GRAM + 1 neighbouring places repeat their GRAM words at distance q. So a place belongs to no run if its
    words come back later than the places around it that come back at all allow.
    """
    n = hashes.size
    if n < LEAST:
        return []
    grams = sequence_hashes(hashes, GRAM)
    at = np.flatnonzero(row[: n - GRAM + 1] == row[GRAM - 1 :])
    key = grams[at] ^ mixed(row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    distance = np.zeros(n + 1, np.int64)
    distance[at[order[same]]] = at[order[same + 1]] - at[order[same]]
    back = distance > 0
    for _ in range(ROUNDS):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], back.view(np.int8)))))
        low, high = edges[::2], edges[1::2]
        farthest = np.repeat((high - low + GRAM - 1) // (EXPONENT - 1), high - low)
        places = np.flatnonzero(back)
        kept = (distance[places] <= farthest) & (np.repeat(high - low, high - low) >= LEAST - GRAM)
        if kept.all():
            break
        back[places[~kept]] = False
    edges = np.flatnonzero(np.diff(np.concatenate(([0], back.view(np.int8)))))
    out: list[tuple[int, int]] = []
    ends = np.concatenate((np.flatnonzero(np.diff(row)) + 1, [n]))
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
        k = int(np.searchsorted(ends, low, side="right"))
        first, last = int(ends[k - 1]) if k else 0, int(ends[k])
        a, b = max(first, low - 1), min(last, high + (high - low + GRAM - 1) // (EXPONENT - 1) + GRAM)
        if out and a < out[-1][1] and out[-1][0] >= first:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def damaged(n: int, doc_id) -> tuple[int, int] | None:
    """(a, p) where a text's words from a on are replaced by its p words from there, over and over; nothing for a null id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _best(found: list[tuple[int, int, int]]) -> tuple:
    """The run with the greatest length by period; of equal ones the first, then that of the smallest period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_runs(texts: list[bytes | None], replaced: list[tuple[int, int] | None]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """By text all runs and the words that are left when every run keeps its first period, joined by spaces."""
    words = Words(texts)
    source = np.arange(words.row.size)
    for i, how in enumerate(replaced):
        if how:
            a, p = how
            first, n = int(words.first[i]), int(words.count[i])
            source[first + a : first + n] = first + a + np.arange(n - a) % p
    by_row: dict[int, list[tuple[int, int]]] = {}
    for low, high in stretches(words.hashes[source], words.row):
        by_row.setdefault(int(words.row[low]), []).append((low, high))
    for i, text in enumerate(texts):
        first, n = int(words.first[i]), int(words.count[i])
        own = (text or b"").split()
        if replaced[i]:
            own = [own[k] for k in (source[first : first + n] - first).tolist()]
        found = set()
        for low, high in by_row.get(i, []):
            numbers: dict[bytes, int] = {}
            s = [numbers.setdefault(w, len(numbers) + 1) for w in own[low - first : high - first]]
            for start, length, period in runs(s):
                if (start or low == first) and (start + length < len(s) or high == first + n):  # else it goes on beyond the stretch
                    found.add((low - first + start, length, period))
        dropped = np.zeros(n, bool)
        for start, length, period in found:
            dropped[start + period : start + length] = True
        kept = [own[k] for k in np.flatnonzero(~dropped).tolist()] if found else own
        yield sorted(found, key=lambda r: (r[0], r[2])), b" ".join(kept)


def periodic_runs(documents: DataFrame, damage: bool = False, as_text: bool = True) -> DataFrame:
    """Per document its runs' number, the best run (start, length, period, exponent_milli), a digest of all, and the collapsed text or its digest.

    ``damage`` first makes some texts periodic, by their ids, as the registered query asks. A null or empty text has no words and no run; a
    null id damages nothing; repeated rows give equal rows; other columns are left out. Texts are looked through whole; what a task holds at once is one
    group of texts, or one text, and the trees of one stretch of it.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    last = "collapsed" if as_text else "collapsed_sha256"
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", last]
    schema = f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, {last} string"

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            for low, high in row_groups(texts.to_pylist()):
                part = texts.slice(low, high - low).to_pylist()
                keys = ids.slice(low, high - low).to_pylist()
                replaced = [damaged(len((t or b"").split()), k) if damage else None for t, k in zip(part, keys)]
                rows = []
                for key, (found, kept) in zip(keys, text_runs(part, replaced)):
                    start, length, period = _best(found)
                    milli = 1000 * length // period if found else None
                    listed = _sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode())
                    rows.append((key, len(found), start, length, period, milli, listed, kept.decode("utf-8", "replace") if as_text else _sha256(kept)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (ids.type, *[pa.int64()] * 5, pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)
