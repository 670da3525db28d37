import math

import duckdb
import numpy as np

from alertloom.llm import vecdedup

SCHEMA = "vec_id long, label int, embedding array<float>, m long, slot string"


def fit(label, v):
    return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain(rows):
    good = [(i, label, np.array(v, float)) for i, label, v, *_ in rows if fit(label, v)]
    links = {r[0]: set() for r in rows}
    for x in good:
        for y in good:
            if x[0] != y[0] and x[1] == y[1] and len(x[2]) == len(y[2]) and x[2] @ y[2] / math.sqrt((x[2] @ x[2]) * (y[2] @ y[2])) >= vecdedup.COSINE:
                links[x[0]].add(y[0])
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return sorted(out)


def rows():
    rng = np.random.default_rng(1)
    made = []
    for center in range(12):
        c = rng.standard_normal(32)
        for _ in range([1, 2, 5, 90][center % 4]):
            made.append((len(made), center % 3, [float(np.float32(x)) for x in c + rng.standard_normal(32) * 0.06]))
    made += [(1000 + i, 1, made[3][2]) for i in range(30)] + [(2000 + i, 1, [x * 2 for x in made[3][2]]) for i in range(3)]
    made += [(3000, 1, None), (3001, 1, [0.0] * 32), (3002, 1, [None] + [1.0] * 31), (3003, 1, [math.nan] + [1.0] * 31), (3004, 1, [math.inf] * 32), (3005, 1, [])]
    made += [(3006 + i, None, made[3][2]) for i in range(2)] + [(3010 + i, 2, [1e-38, 2e-38]) for i in range(2)] + [(3012, 2, [1.0, 2.0]), (3013, 2, [1.0, 2.0, 3.0])]
    return [(*r, 1, "x") for r in made]


def test_equals_all_pairs(spark, monkeypatch):
    want = plain(rows())
    assert sum(r[1] for r in want) > 1000 and sum(not r[3] for r in want) > 100
    made = spark.createDataFrame(rows(), SCHEMA)
    assert sorted(map(tuple, vecdedup.near_vectors(made).collect())) == want
    # Buckets cut into many blocks.
    monkeypatch.setattr(vecdedup, "BLOCK", 7)
    assert sorted(map(tuple, vecdedup.near_vectors(made).collect())) == want


def test_repeated_and_missing_ids(spark):
    made = [(1, 0, [1.0, 0.0], 1, "x"), (1, 0, [0.0, 1.0], 1, "x"), (2, 0, [0.0, 1.0], 1, "x"), (None, 0, [0.0, 1.0], 1, "x"), (None, 0, None, 1, "x")]
    got = vecdedup.near_vectors(spark.createDataFrame(made, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True), (None, 0, None, True)], key=str)
    assert vecdedup.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = vecdedup.unit(rng.standard_normal((4000, 64)))
    y = rng.standard_normal((4000, 64))
    y = vecdedup.unit(y - (x * y).sum(1, keepdims=True) * x)
    near = vecdedup.COSINE * x + math.sqrt(1 - vecdedup.COSINE**2) * y
    assert (vecdedup.slots(x) == vecdedup.slots(near)).any(1).mean() >= 0.99


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = vecdedup.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(vecdedup.ORACLE).fetchall())
