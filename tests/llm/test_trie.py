import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from alertloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, block long, said string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, said, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return made


def plain(rows):
    members = {}
    for c, ts in sequences(rows).items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    full = {c: tuple(ts) for c, ts in sequences(rows).items()}
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        children = sum(len(q) == len(p) + 1 for q in below)
        saved = sum((len(members[q]) - 1) * words(q) for q in below)
        ends = ",".join(str(c) for c in sorted(cs) if full[c] == p)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(5)
    made = []
    for c in range(1, 150):
        kind = rng.randrange(4)
        for t in range(rng.randrange(1, 6)):
            text = ["hello there", "a b  c", "é ü", ""][(kind + t) % 4 if rng.random() < 0.8 else 0]
            made.append((c, t, "user" if t % 2 == 0 else "assistant", text, 1, "x"))
    # Copies of one conversation, a family without its first one, turns null, repeated and tied, and a very long one.
    made += [(c, t, "user", f"same {t}", 1, "x") for c in range(1000, 1060) for t in range(3)]
    made += [(2000 + i, 0, "user", "only", 1, "x") for i in range(1, 20)]
    made += [(3000, None, None, None, 1, "x"), (3000, 2, "user", "z", 1, "x"), (3000, 2, "user", "a", 1, "x"), (3000, 2, "user", "a", 1, "x"), (None, 1, "user", "a", 1, "x")]
    made += [(4000, t, "user", "w " * (t % 50), 1, "x") for t in range(300)] + [(-7, 0, "user", "w " * 40000, 1, "x")]
    return made


@pytest.mark.parametrize("bits", [2, 4, 12])
def test_equals_plain_prefixes(spark, monkeypatch, bits):
    want = plain(rows())
    monkeypatch.setattr(trie, "BITS", bits)
    got = trie.conversation_trie(spark.createDataFrame(rows(), SCHEMA))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_range_minimum():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 5, 60)
    table = trie.RangeMinimum(values)
    at = np.repeat(np.arange(60), 5)
    floor = np.tile(np.arange(5), 60)
    for a, f, left, right in zip(at, floor, table.left(at, floor), table.right(at, floor), strict=True):
        assert left == min(i for i in range(a + 1) if all(values[i + 1 : a + 1] >= f))
        assert right == max(i for i in range(a, 60) if all(values[a + 1 : i + 1] >= f))
    first, last = np.minimum(at, floor), np.maximum(at, floor)
    assert (table.least(first, last) == [values[a : b + 1].min() for a, b in zip(first, last, strict=True)]).all()


def test_empty_table(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    cursor = con.execute(trie.ORACLE)
    assert [c[0] for c in cursor.description] == COLUMNS
    want = sorted(cursor.fetchall(), key=str)
    got = trie.conversation_trie(spark.read.parquet(f"{sf}/conversations.parquet"))
    assert sorted(map(tuple, got.collect()), key=str) == want
