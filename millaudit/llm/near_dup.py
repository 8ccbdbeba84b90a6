"""MinHash near-dedup with HyperMinHash registers.

Words are runs of `[^\\x20\\x09-\\x0D]` after lower-casing A-Z; a document's set holds its distinct 5-word shingles (fewer words: the
whole sequence as one). Each shingle falls into one of REGISTERS buckets; a bucket keeps its smallest hash as leading-zero
count plus MANTISSA bits. Bands of compressed registers name candidates, a collision-corrected Jaccard estimate
drops hopeless ones, and full sets confirm the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millaudit.llm.common import Words, bit_place, bitmap, gathered_bitmap, has_bit, mixed, row_groups, sequence_hashes, written
from millaudit.llm.graph import components, fitted_shuffles

#: Words of a shingle, and the similarity that links, in hundredths.
SHINGLE = 5
LINK = 75
#: Registers, registers of a band, and orders of the registers cut into bands. The 63 bands share registers: by simulation (2,000,000
#: large pairs each) a pair at 0.75 shares none of them with a chance of about 1 in 7,000, one at 0.8 with about 1 in 300,000.
REGISTERS, BAND, ORDERS = 126, 6, 3
MANTISSA = 26
EMPTY = np.uint32(0xFFFFFFFF)
#: Candidates whose estimate lies so many standard errors below the link are dropped before the full sets are compared.
ERRORS = 6.0
#: Slots of the table that tells shingles held by one set from those held by several.
SLOTS = 1 << 26
#: Parts of the hashes by which such shingles are counted.
PROFILE = 64
_SPREAD = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list, k: int = SHINGLE):
    """Row of each shingle and its hash: distinct and sorted per row; the number per row."""
    words = Words([(t or b"").lower() for t in texts])
    hashes = sequence_hashes(words.hashes, k)
    whole = words.row[: hashes.size] == words.row[k - 1 :] if hashes.size else np.zeros(0, bool)
    rows, values = [words.row[: hashes.size][whole]], [hashes[whole]]
    for few in range(1, k):
        own = np.flatnonzero(words.count == few)
        if own.size:
            rows.append(own)
            values.append(sequence_hashes(words.hashes, few)[words.first[own]])
    row, value = np.concatenate(rows), np.concatenate(values)
    if len(rows) > 1:
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    edges = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(edges, edges[1:]):
        value[a:b].sort()
    first = np.ones(value.size, bool)
    first[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    row, value = row[first], value[first]
    return row, value, np.bincount(row, minlength=len(texts))


def set_ids(row: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One 64-bit id per row for its whole set; rows without shingles get 0."""
    out = np.zeros(count.size, np.uint64)
    np.add.at(out, row, mixed(value ^ _SPREAD) * (value | np.uint64(1)))
    return np.where(count > 0, mixed(out + count.astype(np.uint64)), 0)


def registers(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """rows x REGISTERS compressed minima: leading zeros above MANTISSA bits; EMPTY where no shingle fell."""
    none = np.uint64(1) << np.uint64(53)
    least = np.full(rows * REGISTERS, none)
    bucket = ((value >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    np.minimum.at(least, row * REGISTERS + bucket.astype(np.int64), mixed(value + _SPREAD) >> np.uint64(11))
    fraction, exponent = np.frexp(least.astype(np.float64))  # exact below 2^53
    zeros = np.clip(53 - exponent, 0, 53).astype(np.uint32)
    bits = np.floor(np.maximum(2 * fraction - 1, 0) * (1 << MANTISSA)).astype(np.uint32)
    packed = (zeros << np.uint32(MANTISSA)) | np.minimum(bits, np.uint32((1 << MANTISSA) - 1))
    return np.where(least == none, EMPTY, packed).reshape(rows, REGISTERS)


def _orders() -> np.ndarray:
    rng = np.random.default_rng(20240501)
    return np.concatenate([rng.permutation(REGISTERS) for _ in range(ORDERS)])


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bands, and which of them hold a shingle at all."""
    bands = regs[:, _orders()].reshape(len(regs), -1, BAND)
    key = np.broadcast_to(mixed(np.arange(1, bands.shape[1] + 1, dtype=np.uint64)), bands.shape[:2]).copy()
    for i in range(BAND):
        key = mixed(key + bands[:, :, i].astype(np.uint64) * _SPREAD)
    return key, (bands != EMPTY).any(axis=2)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, less the expected chance collisions, and the registers they rest on."""
    both = (a != EMPTY) & (b != EMPTY)
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    chance = both.sum(axis=1) * 2.0**-MANTISSA / 3  # two unequal minima share zeros about one time in three
    return np.maximum(((a == b) & both).sum(axis=1) - chance, 0) / np.maximum(used, 1), used


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def sketches(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_id, registers) per document row; without words set_id and registers are null."""

    def run(batches):
        for batch in batches:
            texts = batch.column("body").to_pylist()
            for first, last in row_groups(texts):
                row, value, count = shingle_sets(texts[first:last], k)
                regs = registers(row, value, last - first)
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first), pa.array(count.astype(np.int64)),
                        pa.array(set_ids(row, value, count).view(np.int64), mask=none),
                        pa.array([None if x else r.tobytes() for x, r in zip(none, regs)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "registers"],
                )

    rows = documents.select("doc_id", F.col("text").cast("binary").alias("body"))
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {doc_type}, n_shingles bigint, set_id bigint, registers binary")


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, REGISTERS)


def bands(sets: DataFrame) -> DataFrame:
    """(key, set_id): one row per band that holds a shingle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                key, full = band_keys(_regs(part.column("registers")))
                ids = np.repeat(part.column("set_id").to_numpy(), full.sum(axis=1))
                yield pa.RecordBatch.from_arrays([_signed(key[full]), pa.array(ids)], names=["key", "set_id"])

    return sets.select("set_id", "registers").mapInArrow(run, "key bigint, set_id bigint")


def _may_link(a: np.ndarray, b: np.ndarray, link: int) -> np.ndarray:
    """Which register rows have an estimate that does not rule the link out."""
    share, used = estimate(a, b)
    t = link / 100
    return share >= t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(used, 1))


def likely(pairs: DataFrame, sets: DataFrame, link: int = LINK) -> DataFrame:
    """The pairs (a, b) whose estimate does not rule the link out."""
    regs = sets.select("set_id", "registers")
    joined = pairs.join(regs.toDF("a", "left"), "a").join(regs.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(_may_link(_regs(batch.column("left")), _regs(batch.column("right")), link)))

    return joined.mapInArrow(run, "a bigint, b bigint")


def full_sets(documents: DataFrame, wanted: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(set_id, shingles as sorted 64-bit hashes) of the wanted sets (set_id, doc_id), built from their documents.

    A bitmap of fixed size spares most other documents the work; the join on both ids is what decides.
    """
    handed = documents.sparkSession.sparkContext.broadcast(bitmap(wanted, "doc_id"))

    def run(batches):
        bits = np.frombuffer(handed.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(bits, batch.column("bit").to_numpy())))
            texts = batch.column("body").to_pylist()
            for first, last in row_groups(texts):
                row, value, count = shingle_sets(texts[first:last], k)
                edges = np.concatenate(([0], np.cumsum(count))).tolist()
                blobs = [value[a:b].tobytes() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(set_ids(row, value, count).view(np.int64)), pa.array(blobs, pa.binary())],
                    names=["doc_id", "set_id", "shingles"],
                )

    rows = documents.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("body"), bit_place("doc_id"))
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    built = rows.mapInArrow(run, f"doc_id {doc_type}, set_id bigint, shingles binary")
    return built.join(wanted, ["set_id", "doc_id"], "left_semi").select("set_id", "shingles")


def linked(x: np.ndarray, y: np.ndarray, link: int = LINK) -> bool:
    """100 * intersection >= link * union of two sorted sets."""
    if x.size > y.size:
        x, y = y, x
    if 100 * x.size < link * y.size:
        return False
    place = np.minimum(np.searchsorted(y, x), y.size - 1)
    common = int((y[place] == x).sum())
    return 100 * common >= link * (x.size + y.size - common)


def confirmed(pairs: DataFrame, shingles: DataFrame, link: int = LINK) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= link * union of the full sets."""
    joined = pairs.join(shingles.toDF("b", "right"), "b").join(shingles.toDF("a", "left"), "a").select("a", "b", "left", "right")

    def run(batches):
        for batch in batches:
            both = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), link) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def _labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """With the component of ``column`` as ``<column>_root``; a set outside all links is its own."""
    found = labels.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    return rows.join(found, column, "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column))


def held_elsewhere(shingles: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(set_id, elsewhere): how many of a set's shingles may occur in another of the sets, never too few, by PROFILE parts of the hashes.

    Shingles are counted by slot of a table of fixed size, whose slots with two or more fill a bitmap; strangers in one slot
    can only raise a number. Two sets share at most the sum of the smaller numbers of all parts.
    """

    def places(column):
        hashes = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
        return (hashes % np.uint64(slots)).astype(np.int64)

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_arrays([pa.array(places(batch.column("shingles").slice(at, 500)))], names=["slot"])

    several = shingles.select("shingles").mapInArrow(spread, "slot bigint").groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    handed = shingles.sparkSession.sparkContext.broadcast(gathered_bitmap(several, "slot", slots))

    def count(batches):
        bits = np.frombuffer(handed.value, np.uint8)
        for batch in batches:
            column, found = batch.column("shingles"), []
            for i in range(batch.num_rows):
                hashes = np.frombuffer(column[i].as_py(), np.uint64)
                held = hashes[has_bit(bits, places(column.slice(i, 1)))]
                found.append(np.bincount((held >> np.uint64(40)).astype(np.int64) % PROFILE, minlength=PROFILE))
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(found, pa.list_(pa.int64()))], names=["set_id", "elsewhere"])

    return shingles.mapInArrow(count, "set_id bigint, elsewhere array<bigint>")


#: Members of a bucket in one block, and shingles that they hold elsewhere (8 bytes each).
TILE, TILE_SHINGLES = 1024, 2_000_000


def set_links(documents: DataFrame, sets: DataFrame, first_links: DataFrame, k: int = SHINGLE, link: int = LINK) -> DataFrame:
    """(node, root) over set ids: every link between different sets is confirmed or lies inside a component.

    In a bucket of equal bands, members are compared with the bucket's smallest set first: one smallest partner per set, then the partners
    of all its buckets. What is left are pairs in a bucket whose components still differ; of those, only pairs that can reach
    the link at all are compared: their shingles that occur elsewhere, counted by parts of the hashes, must allow it. These
    are compared where their bucket's members meet, so that a task sends on the links that join components and no pairs. So
    a bucket of many copies costs about as many comparisons as it has members, and no pair that could join two
    components is left out.
    """
    keys = bands(sets)
    buckets = keys.groupBy("key").agg(F.min("set_id").alias("first"), F.max("set_id").alias("last")).where("first < last")
    shared = written(keys.join(buckets.select("key", "first"), "key").select("key", "set_id", "first"), "shared")
    with fitted_shuffles(documents.sparkSession, shared.count()):  # a set is there once per band it shares, so a task holds few sets
        near = written(sets.join(shared.select("set_id").distinct(), "set_id", "left_semi"), "near")
        shingles = written(full_sets(documents, near.select("set_id", "doc_id"), k), "shingles")

        def check(pairs):
            return confirmed(likely(pairs, near, link), shingles, link)

        stars = shared.where("set_id <> first").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
        links = written(check(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), "links")
        parents = links.select(F.col("b").alias("node"), F.col("a").alias("root"))  # one smaller partner each
        apart = _labelled(_labelled(stars.distinct(), parents, "a"), parents, "b").where("a_root <> b_root and a <> b_root").select("a", "b")
        labels = components(links.unionByName(check(apart)).unionByName(first_links))

        open_members = written(_open(shared.select("key", "set_id"), labels), "open")
        elsewhere = held_elsewhere(shingles.join(open_members.select("set_id").distinct(), "set_id", "left_semi"))
        total = F.aggregate("elsewhere", F.lit(0).cast("bigint"), lambda s, x: s + x)
        able = near.select("set_id", "n_shingles", "registers").join(elsewhere.withColumn("total", total), "set_id").where(f"100 * total >= {link} * n_shingles")
        rest = _several_roots(open_members.join(able, "set_id"))
        across = joining_links(able_partners(written(rest, "rest"), link), shingles, link)
        old = labels.select(F.col("root").alias("a"), F.col("node").alias("b"))
        return components(written(across, "across").unionByName(old))


def able_partners(members: DataFrame, link: int, tile: int = TILE, most: int = TILE_SHINGLES) -> DataFrame:
    """(key, i, j, set_id, set_id_root, partners): by two blocks i and j of a bucket, its members that have to be compared, and with which others.

    members: (key, set_id, set_id_root, n_shingles, total, elsewhere, registers). A pair is compared if its components differ and neither its shingles
    that occur elsewhere nor its estimate rule the link out, in the first bucket that holds both. A bucket's members are dealt to blocks of
    about ``tile`` members and ``most`` shingles, and every two blocks meet in a task, which compares their counts as matrices, a few rows at a
    time. Partners are listed with one member of a pair; the other one may have an empty list.
    """
    blocks = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("total") / most)).cast("int").alias("blocks")
    dealt = members.join(members.groupBy("key").agg(blocks), "key").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "set_id_root", "n_shingles", "total", "elsewhere", "registers"
    )

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        block, root, size, total = (rows.column(c).to_numpy() for c in ("block", "set_id_root", "n_shingles", "total"))
        counts = rows.column("elsewhere").combine_chunks().flatten().to_numpy().reshape(-1, PROFILE).astype(np.int32)
        regs = _regs(rows.column("registers"))
        keys, full = band_keys(regs)
        key, i, j = (rows.column(c)[0].as_py() for c in ("key", "i", "j"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        partners = [np.zeros(0, np.int64)] * rows.num_rows
        wanted = np.zeros(rows.num_rows, bool)
        for at in range(0, left.size, 64):
            some = left[at : at + 64]
            needed = link * (size[some][:, None] + size[right][None, :])
            may = (root[some][:, None] != root[right][None, :]) & ((100 + link) * np.minimum(total[some][:, None], total[right][None, :]) >= needed)
            if i == j:
                may &= some[:, None] < right[None, :]
            if may.any():
                common = np.minimum(counts[some][:, None, :], counts[right][None, :, :]).sum(2)
                x, y = np.nonzero(may & ((100 + link) * common >= needed))
                for part in range(0, x.size, 4096):
                    a, b = some[x[part : part + 4096]], right[y[part : part + 4096]]
                    first = np.where((keys[a] == keys[b]) & full[a], keys[a].view(np.int64), np.iinfo(np.int64).max).min(axis=1) == key
                    a, b = a[first], b[first]
                    near = _may_link(regs[a], regs[b], link)
                    a, b = a[near], b[near]
                    wanted[a] = wanted[b] = True
                    edges = np.flatnonzero(np.diff(a, prepend=-1))
                    for m, own in zip(a[edges].tolist(), np.split(b, edges[1:]) if a.size else []):
                        partners[m] = np.concatenate((partners[m], own))
        sets, keep = rows.column("set_id").to_numpy(), np.flatnonzero(wanted)
        lists = pa.array([sets[partners[m]] for m in keep.tolist()], pa.list_(pa.int64()))
        return rows.select(["key", "i", "j", "set_id", "set_id_root"]).take(pa.array(keep)).append_column("partners", lists)

    return tiles.groupBy("key", "i", "j").applyInArrow(compare, "key bigint, i int, j int, set_id bigint, set_id_root bigint, partners array<bigint>")


def joining_links(members: DataFrame, shingles: DataFrame, link: int) -> DataFrame:
    """(a, b): confirmed links between components, enough of them to join all that the links of each task join.

    members: see ``able_partners``. Components that earlier links of the task have joined are not compared again, so that a task sends on fewer
    links than it has members.
    """

    def confirm(rows: pa.Table) -> pa.Table:
        ids, roots = rows.column("set_id").to_pylist(), rows.column("set_id_root").to_pylist()
        hashes = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        place = {s: n for n, s in enumerate(ids)}
        joined = {r: r for r in roots}

        def top(r):
            while joined[r] != r:
                joined[r] = r = joined[joined[r]]
            return r

        found = []
        for n, others in enumerate(rows.column("partners").to_pylist()):
            for other in others:
                m = place[other]
                a, b = top(roots[n]), top(roots[m])
                if a != b and linked(hashes[n], hashes[m], link):
                    joined[a] = b
                    found.append((min(ids[n], other), max(ids[n], other)))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return members.join(shingles, "set_id").groupBy("key", "i", "j").applyInArrow(confirm, "a bigint, b bigint")


def _several_roots(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    several = members.groupBy("key").agg(F.min("set_id_root").alias("lo"), F.max("set_id_root").alias("hi")).where("lo < hi").select("key")
    return members.join(several, "key")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    return _several_roots(_labelled(members, labels, "set_id"))


def near_duplicates(documents: DataFrame, k: int = SHINGLE, link: int = LINK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document row.

    component_id is the smallest doc_id reachable over links, itself included. Documents without words link with nothing. Rows of one
    doc_id are one document. A null doc_id links with nothing, has a null component_id and is kept. Repeated rows come
    back as often as they came; extra columns are left out.
    """
    base = written(sketches(documents, k), "sketches")
    known = base.where("set_id is not null and doc_id is not null")
    sets = written(
        known.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("registers").alias("registers")),
        "sets",
    )
    several = known.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a < b").select("doc_id", "a")
    same_document = known.join(several, "doc_id").select("a", F.col("set_id").alias("b")).distinct()
    labels = set_links(documents, sets, same_document, k, link)
    roots = _labelled(sets.select("set_id", "doc_id"), labels, "set_id")
    smallest = roots.groupBy("set_id_root").agg(F.min("doc_id").alias("component_id"))
    of_set = roots.join(smallest, "set_id_root").select("set_id", "component_id")
    linked = base.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return linked.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(documents: DataFrame, k: int = SHINGLE, link: int = LINK) -> DataFrame:
    """The documents with their columns, one of each group of near duplicates: the smallest doc_id."""
    found = near_duplicates(documents, k, link)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone.hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti")
