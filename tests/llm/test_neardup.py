"""Near-duplicates against brute force over all pairs."""

import random
import re
from collections import defaultdict

from alertloom.llm import neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def expected(rows):
    """rows: (doc_id, text), doc_ids unique."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    tried = set()
    for ids in holders.values():
        for i, b in enumerate(ids):
            for a in ids[:i]:
                if (a, b) in tried:
                    continue
                tried.add((a, b))
                same = len(sets[a] & sets[b])
                if 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {(d, len(sets[d]), root(d), root(d) == d) for d in sets}


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in neardup.near_duplicates(docs).collect()}
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_group_of_near_copies_with_edits_of_every_size(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(150)]
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "a b c"), (4, "A  b\tC"), (5, "x" * 300_000)]
    for i in range(250):
        copy = list(words)
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [copy[k], copy[k]]])
        rows.append((10 + i, " ".join(copy)))
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, node int")
    assert {tuple(r) for r in neardup.near_duplicates(docs).collect()} == expected(rows)


def test_nulls_repeats_and_empty_table(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(7, text), (7, text), (9, text.upper()), (None, text), (None, "else"), (11, None)], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 3, 7, True), (7, 3, 7, True), (9, 3, 7, False), (None, 3, 7, False), (None, 1, None, True), (11, 0, 11, True)], key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces(spark):
    text = " ".join(f"k{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, "start " + text), (2, text), (3, text + " tail"), (4, "short one")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == {1: (199_997, 1), 2: (199_996, 1), 3: (199_997, 1), 4: (1, 4)}
