"""Exact top-k by inner product with a three-phase uniform threshold.

The dimensions are cut into LISTS parts; the partial scores of a tile of vectors in one part are a score list. Phase 1 gathers the
k best entries of every list and scores those vectors in full: the k-th best total is a safe cutoff. Phase 2 sends
cutoff / LISTS to every list, which collects all entries at least as high; a vector whose total reaches the cutoff has such an
entry in some list. Phase 3 resolves the collected vectors exactly where their lists lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millaudit.llm.common import written

LISTS = 2
#: Vectors of a candidate tile and of a query tile; a task holds one pair of tiles.
TILE, QUERY_TILE = 8192, 1024
#: Queries multiplied at once inside a task.
STRIP = 128


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(row_id, vec_id, v): floor(scale * x) of every vector without null or non-finite components.

    row_id tells rows of one vec_id apart; write the result before using it twice.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select(F.monotonically_increasing_id().alias("row_id"), "vec_id", ints.alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    rows = [np.asarray(x, np.int64) for x in column.to_pylist()]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : r.size] = r
    return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where every sum is exact there."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    if not width or not left.size or not right.size:
        return np.zeros((left.shape[0], right.shape[0]), np.int64)
    if float(np.abs(left).max()) * float(np.abs(right).max()) * width < 2.0**53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


def _nodes(vectors: DataFrame, queries: DataFrame, n_tiles: int, n_query_tiles: int):
    """Queries and candidates dealt to (query tile, tile): each pair of tiles meets once."""
    right = (
        vectors.select("row_id", "vec_id", "v", F.pmod(F.xxhash64("row_id"), F.lit(n_tiles)).alias("tile"))
        .withColumn("query_tile", F.explode(F.sequence(F.lit(0), F.lit(n_query_tiles - 1))))
    )
    left = (
        queries.select("row_id", "cutoff", "v", F.pmod(F.xxhash64("row_id"), F.lit(n_query_tiles)).cast("int").alias("query_tile"))
        .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_tiles - 1).cast("bigint"))))
    )
    return left.groupBy("query_tile", "tile").cogroup(right.groupBy("query_tile", "tile"))


def _strips(left: pa.Table, right: pa.Table):
    """Queries in strips: their ids, cutoffs and vectors, and which candidate is the query's own row."""
    queries, rows = left.column("row_id").to_numpy(), right.column("row_id").to_numpy()
    cutoffs, vectors = left.column("cutoff").to_pylist(), _matrix(left.column("v"))
    for at in range(0, len(queries) if len(rows) else 0, STRIP):
        part = slice(at, at + STRIP)
        yield queries[part], cutoffs[part], vectors[part], rows[None, :] == queries[part, None]


def _columns(parts: list[tuple], n: int) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * n


def _best_entries(k: int, lists: int, width: int):
    """Phase 1: the k best entries of each list and query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, c, out = right.column("row_id").to_numpy(), _matrix(right.column("v")), []
        for queries, _, q, own in _strips(left, right):
            for part in range(lists):
                dims = slice(part * width, (part + 1) * width)
                scores = np.where(own, np.iinfo(np.int64).min, _products(q[:, dims], c[:, dims]))
                m = min(k, len(rows))
                j = np.argpartition(-scores.astype(np.float64), m - 1, axis=1)[:, :m].ravel()
                i = np.repeat(np.arange(len(queries)), m)
                real = ~own[i, j]
                i, j = i[real], j[real]
                out.append((queries[i], rows[j], np.full(i.size, part), scores[i, j]))
        return pa.table(dict(zip(("query", "row", "list", "part"), _columns(out, 4))))

    return run


def _collected(k: int, lists: int, width: int):
    """Phases 2 and 3: vectors with an entry of at least cutoff / lists, resolved; the k best of a tile go on."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, c, out = right.column("row_id").to_numpy(), _matrix(right.column("v")), []
        names = right.column("vec_id").to_pylist()
        order = np.array([x if x is not None else np.iinfo(np.int64).max for x in names], np.int64)
        for queries, cutoffs, q, own in _strips(left, right):
            least = np.array([np.iinfo(np.int64).min if x is None else -(-x // lists) for x in cutoffs], np.int64)
            reached = np.zeros(own.shape, bool)
            for part in range(lists):
                dims = slice(part * width, (part + 1) * width)
                reached |= _products(q[:, dims], c[:, dims]) >= least[:, None]
            for i, marked in enumerate(reached & ~own):
                j = np.flatnonzero(marked)
                total = _products(q[i : i + 1], c[j])[0]
                enough = np.flatnonzero(total >= cutoffs[i]) if cutoffs[i] is not None else np.arange(j.size)
                j, total = j[enough], total[enough]
                best = np.lexsort((rows[j], order[j], -total))[:k]
                out.append((np.full(best.size, queries[i]), rows[j[best]], total[best]))
        return pa.table(dict(zip(("query", "row", "score"), _columns(out, 3))))

    return run


def _resolved(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (query, row) with their exact totals."""
    left = vectors.select(F.col("row_id").alias("query"), F.col("v").alias("a"))
    right = vectors.select(F.col("row_id").alias("row"), F.col("v").alias("b"))
    products = F.zip_with("a", "b", lambda x, y: F.coalesce(x * y, F.lit(0).cast("bigint")))
    total = F.aggregate(products, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return pairs.join(right, "row").join(left, "query").select("query", "row", total.alias("score"))


def _first(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, is_query, k: int = 5, scale: int = 256, lists: int = LISTS, tile: int = TILE, query_tile: int = QUERY_TILE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k highest integer inner products with the other rows.

    Ties go to the smaller vec_id (a null one last). With fewer than k other rows, all come back. Rows of one vec_id are
    candidates of their own, also for each other. Components missing in the shorter of two vectors count as zero. Vectors that are null
    or hold null or non-finite components take no part. Scores must fit a long. Extra columns are left out.
    """
    vectors = written(integer_vectors(embeddings, scale), "vectors")
    size = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("v")).alias("d")).first()
    width = max(1, -(-(size["d"] or 0) // lists))
    n_tiles, n_query_tiles = max(1, -(-size["n"] // tile)), max(1, -(-size["q"] // query_tile))
    queries = vectors.where(is_query)

    # Phase 1: the k best entries of each list, scored in full; their k-th best total is the cutoff.
    unlimited = _nodes(vectors, queries.withColumn("cutoff", F.lit(None).cast("bigint")), n_tiles, n_query_tiles)
    local = unlimited.applyInArrow(_best_entries(k, lists, width), "query bigint, row bigint, list bigint, part bigint")
    gathered = _first(local, ["query", "list"], [F.desc("part")], k).select("query", "row").distinct()
    ranked = _first(_resolved(gathered, vectors), ["query"], [F.desc("score")], k)
    cutoff = ranked.where(F.col("rank") == k).select(F.col("query").alias("row_id"), F.col("score").alias("cutoff"))

    # Phases 2 and 3: the cutoff goes to every list; what reaches its share is resolved.
    limited = written(queries.join(cutoff, "row_id", "left"), "cutoffs")
    scored = _nodes(vectors, limited, n_tiles, n_query_tiles).applyInArrow(_collected(k, lists, width), "query bigint, row bigint, score bigint")
    scored = scored.join(vectors.select(F.col("row_id").alias("row"), "vec_id"), "row")
    best = _first(scored, ["query"], [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")], k)
    query_names = queries.select(F.col("row_id").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(query_names, "query").select("query_id", F.col("rank").cast("int"), "vec_id", "score")
