"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import components, written

COSINE = 0.98
# A pair of cosine 0.98 agrees on one sign with 1 - acos(0.98) / pi = 0.936, on the 24 of a table with 0.205, in one of 24 tables at least with 0.996.
BITS, TABLES = 24, 24
SEED = 12
BLOCK = 2048
_STRIP = 128


def planes(dim: int) -> np.ndarray:
    """The normals of all tables' hyperplanes for vectors of length ``dim``, a column each."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, BITS * TABLES))


def slots(vectors: np.ndarray) -> np.ndarray:
    """For each vector and table the table's number and the signs in it, as one integer."""
    signs = (vectors @ planes(vectors.shape[1]) >= 0).reshape(len(vectors), TABLES, BITS)
    return (signs @ (1 << np.arange(BITS, dtype=np.int64))) + (np.arange(TABLES, dtype=np.int64) << 32)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; a power of two first brings their components into a range in which squares are safe."""
    largest = np.abs(vectors).max(1, keepdims=True)
    safe = np.ldexp(vectors, -np.frexp(largest)[1])
    return safe / np.sqrt((safe * safe).sum(1, keepdims=True))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``dim`` and ``slots`` to the last column, v."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        sizes = np.diff(lists.offsets.to_numpy())
        for dim in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dim))
            v = part.column(part.num_columns - 1).flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * TABLES), pa.array(slots(unit(v)).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(v), dim, np.int32)), made], names=[*part.schema.names, "dim", "slots"])


def _reached(hits: np.ndarray, same: bool) -> np.ndarray:
    """For each row and then each column of ``hits`` the node its connected component is first seen from; of one block with itself rows and columns are the same nodes."""
    n = len(hits)
    if same:
        hits = hits | hits.T
    root = np.arange(n if same else n + hits.shape[1])
    open_ = np.ones(len(root), bool)
    for start in range(n):
        if not open_[start]:
            continue
        rows = np.array([start])
        open_[start] = False
        while len(rows):
            cols = np.flatnonzero(hits[rows].any(0))
            if same:
                rows = cols[open_[cols]]
                open_[rows], root[rows] = False, start
                continue
            cols = cols[open_[n + cols]]
            open_[n + cols], root[n + cols] = False, start
            rows = np.flatnonzero(hits[:, cols].any(1) & open_[:n])
            open_[rows], root[rows] = False, start
    return root


def _links(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between two blocks of a bucket: for each vector that has any their number and one vector of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                slot, lo, hi = (batch.column(c)[i].as_py() for c in range(3))
                rows = batch.column(3)[i].values
                ids, copies, own = (rows.field(n).to_numpy() for n in ("id", "copies", "own"))
                x = unit(rows.field("v").flatten().to_numpy().astype(np.float64).reshape(len(ids), -1))
                # Tables before this one: a pair that shares a bucket there was counted there.
                before = rows.field("slots").flatten().to_numpy().reshape(len(ids), TABLES)[:, : slot >> 32]
                a = np.flatnonzero(own == lo)
                b = a if lo == hi else np.flatnonzero(own == hi)
                hits, links = np.zeros((len(a), len(b)), bool), np.zeros(len(ids), np.int64)
                for at in range(0, len(a), _STRIP):
                    s = a[at : at + _STRIP]
                    near = x[s] @ x[b].T >= cosine
                    if lo == hi:
                        near &= s[:, None] < b[None, :]
                    r, c = np.nonzero(near)
                    new = ~(before[s[r]] == before[b[c]]).any(1)
                    r, c = r[new], c[new]
                    hits[at + r, c] = True
                    np.add.at(links, s[r], copies[b[c]])
                    np.add.at(links, b[c], copies[s[r]])
                nodes = a if lo == hi else np.concatenate([a, b])
                root = nodes[_reached(hits, lo == hi)]
                some = links[nodes] > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[nodes][some]), pa.array(links[nodes][some]), pa.array(ids[root][some])], names=["id", "links", "other"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: a row for each vector of ``vectors`` (vec_id long, label, an array column; further ones are ignored).

    Vectors of equal label and length are linked where their cosine, in double precision, is ``cosine`` or
    more and they share the signs of one table at least.  Null and zero vectors, those with null or non-finite components
    and those without label link with nothing.  ``n_links`` counts the vectors linked directly, ``component_id`` is the smallest
    vec_id reachable.  Rows repeated under one vec_id are one vector (the smallest by label and components);
    each row without vec_id is returned, unlinked and kept.  An empty table gives no rows.

    Equal vectors are one class, compared once and counted by its size.  Buckets with one class only are
    dropped before any vector is shuffled; a bucket of many is cut into blocks of about 2048, and a task
    compares two blocks; it returns a count and one edge a vector, never the pairs.
    """
    kind = vectors.schema[column].dataType.simpleString()
    v = F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fit = F.when(F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0), v)
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", fit.alias("v"))
    one = named.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.*")
    rows = written(one.select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2")), "vectors")
    classes = rows.filter("v IS NOT NULL").groupBy("label", "h1", "h2").agg(F.min(F.struct("vec_id", "v")).alias("m"), F.count("*").alias("copies"))
    listed = classes.select(F.col("m.vec_id").alias("id"), "copies", "label", "h1", "h2", F.col("m.v").alias("v"))
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema.fields)
    signed = written(listed.mapInArrow(_sign, f"{spec}, dim int, slots array<long>"), "signed")

    places = signed.select("id", "label", "dim", F.explode("slots").alias("slot"))
    full = written(places.groupBy("label", "dim", "slot").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    shared = places.join(full, ["label", "dim", "slot"]).groupBy("id").agg(F.collect_list(F.struct("slot", "m")).alias("s"))
    members = signed.join(shared, "id").select("id", "copies", "label", "dim", "slots", "v", F.inline("s"))
    blocks = F.ceil(F.col("m") / BLOCK)
    dealt = members.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    pair = dealt.groupBy("label", "dim", "slot", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"))
    compared = pair.agg(F.collect_list(F.struct("id", "copies", "own", "slots", "v")).alias("rows")).select("slot", "lo", "hi", "rows")
    found = written(compared.mapInArrow(_links(cosine), "id long, links long, other long"), "links")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.filter("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    # Most classes are single vectors without a link, and need no row here.
    told = signed.select("label", "h1", "h2", "id", "copies").join(links, "id", "left").join(comps, "id", "left").filter("copies > 1 OR links > 0")
    told = told.select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("comp", "id").alias("c"))
    linked = rows.filter("v IS NOT NULL").select("vec_id", "label", "h1", "h2").join(told, ["label", "h1", "h2"], "left").select("vec_id", "n", "c")
    none = F.lit(None).cast("long")
    every = linked.unionByName(rows.filter("v IS NULL").select("vec_id", none.alias("n"), none.alias("c"))).unionByName(named.filter("vec_id IS NULL").select("vec_id", none.alias("n"), none.alias("c")))
    component = F.coalesce("c", "vec_id")
    return every.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
