"""Exact top-k by inner product with pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import ranked, written

SCALE = 1024
PIVOTS, PIVOT_SAMPLE = 24, 2048
# Rows of a block; blocks whose queries go together; blocks whose extents are looked at together.
BLOCK, TOGETHER, EXTENTS = 2048, 12, 64
_STEP = 128
_MOST = 2**63 - 1


def scaled(column: str) -> Column:
    """``floor(1024 * x)`` of each component, null where the vector is null or holds a null or a non-finite component."""
    x = F.col(column).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v).cast("long")))


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: the first, then always the one farthest from those taken."""
    points = vectors.astype(np.float64)
    taken, near = [0], np.linalg.norm(points - points[0], axis=1)
    while len(taken) < min(count, len(points)) and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(points - points[taken[-1]], axis=1))
    return points[taken]


def _placed(pivots: dict[int, np.ndarray]):
    """Adds each vector's distances to the pivots, the nearest pivot and the distance to it; columns vec_id, dim, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                points = part.column(2).flatten().to_numpy().reshape(part.num_rows, dim).astype(np.float64)
                far = np.stack([np.linalg.norm(points - p, axis=1) for p in pivots.get(int(dim), np.zeros((1, dim)))], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(far.argmin(1)), pa.array(far.min(1))], names=["vec_id", "dim", "v", "far", "near", "least_far"])

    return run


def _block(batch: pa.RecordBatch, i: int, ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors, distances to pivots and squared lengths of row ``i``; columns from ``ids`` on."""
    col = [batch.column(ids + k)[i].values.to_numpy(zero_copy_only=False) for k in range(3)]
    x, far = col[1].reshape(len(col[0]), -1), col[2].reshape(len(col[0]), -1)
    return col[0], x, far, (x.astype(np.float64) ** 2).sum(1)


def _most(both: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The inner product is (|x|2 + |q|2 - distance2) / 2; the largest gap to a pivot bounds the distance from below."""
    return (both - gap * gap) / 2 + 1e-9 * both + 1


def _best(k: int, rows: tuple, asked: tuple, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of ``asked`` the places and scores of its best ``rows``, of those at least as good as its floor: candidates come in the order of their bounds, until none can count."""
    (ids, x, far, squares), (q_ids, q, q_far, q_squares) = rows, asked
    if x.size and q.size and x.shape[1] * float(np.abs(x.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).max()) >= 2.0**62:
        x, q = x.astype(object), q.astype(object)
    for j, own in enumerate(q_ids):
        most = _most(squares + q_squares[j], np.abs(far - q_far[j]).max(1))
        order = np.argsort(-most, kind="stable")
        order = order[ids[order] != own]
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), _STEP):
            if most[order[at]] < max(score[-1] if len(score) >= k else -_MOST, floor[j]):
                break
            part = order[at : at + _STEP]
            product = (x[part] * q[j]).sum(1) if x.shape[1] else np.zeros(len(part), np.int64)
            best, score = np.concatenate([best, part]), np.concatenate([score, np.clip(product, -_MOST, _MOST).astype(np.int64)])
            top = np.lexsort((ids[best], -score))[:k]
            best, score = best[top], score[top]
        yield j, best, score


def _floors(k: int):
    """The queries of each block, with the k-th score they find in it; columns dim, block, ids, flat, far, asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, asked = _block(batch, i, 2), batch.column(5)[i].values.to_numpy(zero_copy_only=False)
                mine = tuple(c[asked] for c in rows)
                none = np.full(len(mine[0]), -_MOST)
                floor = np.array([score[-1] if len(score) >= k else -_MOST for _, _, score in _best(k, rows, mine, none)], np.int64)
                if asked.any():
                    lists = [pa.array([c.reshape(-1)], pa.list_(kind)) for c, kind in ((mine[0], pa.int64()), (mine[1], pa.int64()), (mine[2], pa.float64()), (floor, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *lists], names=["dim", "block", "q_ids", "q_flat", "q_far", "floor"])

    return run


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the least and greatest distance to each pivot and the greatest squared length."""
    for batch in batches:
        for i in range(batch.num_rows):
            _, _, far, squares = _block(batch, i, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([far.min(0)], pa.list_(pa.float64())), pa.array([far.max(0)], pa.list_(pa.float64())), pa.array([squares.max()])],
                names=["dim", "block", "lo", "hi", "square"],
            )


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block those queries whose floor its bound reaches; columns dim, q_ids, q_flat, q_far, floor, extents."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, q, q_far, q_squares = _block(batch, i, 1)
            floor, extents = batch.column(4)[i].values.to_numpy(), batch.column(5)[i].values
            lo, hi = (extents.field(n).flatten().to_numpy().reshape(len(extents), -1) for n in ("lo", "hi"))
            for block, low, high, square in zip(extents.field("block").to_pylist(), lo, hi, extents.field("square").to_pylist(), strict=True):
                gap = np.maximum(np.maximum(low - q_far, q_far - high), 0).max(1)
                kept = _most(square + q_squares, gap) >= floor
                if kept.any():
                    lists = [pa.array([c[kept].reshape(-1)], pa.list_(kind)) for c, kind in ((ids, pa.int64()), (q, pa.int64()), (q_far, pa.float64()), (floor, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([block], pa.int64()), *lists], names=["dim", "block", "q_ids", "q_flat", "q_far", "floor"])


def _search(k: int):
    """The best rows of a block for some queries; columns ids, flat, far, q_ids, q_flat, q_far, floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, asked = _block(batch, i, 0), _block(batch, i, 3)
                out = [(np.full(len(best), asked[0][j]), rows[0][best], score) for j, best, score in _best(k, rows, asked, batch.column(6)[i].values.to_numpy())]
                parts = [np.concatenate(p) for p in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 10, column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of the largest integer inner product with each query, ties to the smaller vec_id.

    ``vectors`` (vec_id long, an array column; further columns are ignored), ``queries`` a condition on
    vec_id.  Components are scaled by 1024 and floored.  Null vectors, vectors with null or non-finite
    components and rows without vec_id take no part; rows repeated under one
    vec_id are one (the smallest vector); vectors of different length do not meet;
    empty vectors score 0 with each other; scores beyond 2^63 - 1 either
    way end there.  An empty table gives no rows.

    Pivots are chosen from a bounded sample of 2048 rows; every row's distances to them are computed once.  Rows
    are ordered by their nearest pivot and the distance to it, and cut into blocks, so that a block's distances to the pivots
    lie close together.  A query's k-th score in its own block is a floor: only blocks whose bound reaches it are searched, and in
    a block candidates are taken in the order of their bounds, until the next bound lies under the floor or the k-th score: no candidate that
    could count is left out.  Vectors are shuffled into blocks once, from then on queries travel to the blocks they need.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(column).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    sample: dict[int, list] = {}
    for (v,) in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect():
        sample.setdefault(len(v), []).append(v)
    pivots = {dim: choose_pivots(np.array(vs, np.int64).reshape(len(vs), dim), PIVOTS) for dim, vs in sample.items()}
    placed = rows.select("vec_id", F.size("v").alias("dim"), "v").mapInArrow(_placed(pivots), "vec_id long, dim int, v array<long>, far array<double>, near long, least_far double")
    ordered = ranked(placed, ["dim"], ["near", "least_far", "vec_id"], "placed").withColumn("asked", F.coalesce(queries, F.lit(False)))
    gathered = ordered.groupBy("dim", F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v", "far", "asked"))).alias("r"))
    blocks = written(gathered.select("dim", "block", F.col("r.vec_id").alias("ids"), F.flatten("r.v").alias("flat"), F.flatten("r.far").alias("far"), F.col("r.asked").alias("asked")), "blocks")
    lists = "q_ids array<long>, q_flat array<long>, q_far array<double>, floor array<long>"
    found = blocks.mapInArrow(_floors(k), f"dim int, block long, {lists}")
    together = found.groupBy("dim", F.floor(F.col("block") / TOGETHER).alias("group")).agg(F.collect_list(F.struct("q_ids", "q_flat", "q_far", "floor")).alias("q"))
    asked = written(together.select("dim", *(F.flatten(F.col(f"q.{c}")).alias(c) for c in ("q_ids", "q_flat", "q_far", "floor"))), "queries")
    extents = blocks.mapInArrow(_extents, "dim int, block long, lo array<double>, hi array<double>, square double")
    parts = extents.groupBy("dim", F.floor(F.col("block") / EXTENTS).alias("part")).agg(F.collect_list(F.struct("block", "lo", "hi", "square")).alias("extents"))
    parts = written(parts, "extents")
    most = parts.groupBy("dim").agg(F.max("part").alias("last"))
    spread = asked.join(most, "dim").select(*asked.columns, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"))
    reaching = spread.join(parts, ["dim", "part"]).select("dim", "q_ids", "q_flat", "q_far", "floor", "extents").mapInArrow(_reaching, f"dim int, block long, {lists}")
    pairs = reaching.join(blocks, ["dim", "block"]).select("ids", "flat", "far", "q_ids", "q_flat", "q_far", "floor")
    scored = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
