"""Contained test items against brute force."""

import random
import re

from alertloom.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain(docs, items):
    sets = [(i, shingles(t)) for i, t in items if i is not None]
    return {d: sorted({i for i, s in sets if s and 100 * len(s & shingles(t)) >= 80 * len(s)}) for d, t in docs}


def test_random_passages(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 4, 5, 6, 9, 10, 15, 16, 31, 32, 60, 200])] + [(90, None), (91, ""), (None, "left out entirely by rule one")]
    docs = [(1000, None), (1001, ""), (1002, items[1][1].upper()), (1003, items[0][1])]
    for d in range(150):
        words = [word() for _ in range(rng.choice([0, 20, 3000]))]
        for _ in range(2):
            part = (rng.choice(items[:13])[1]).split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = rng.choice(["edited", "EDITED\n"])
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, " ".join(words)))
    frame = spark.createDataFrame([(d, t, 1, "h") for d, t in docs], "doc_id long, text string, n int, hash string")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, size int")
    got = {r.doc_id: (r.n_items, list(r["items"]), r.contaminated) for r in decontam.decontaminate(frame, bench).collect()}
    assert got == {d: (len(x), x, bool(x)) for d, x in plain(docs, items).items()}


def test_repeats_nulls_and_empty_tables(spark):
    item = "one two three four five six"
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (None, item), (2, "else")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    got = sorted(((r.doc_id, list(r["items"])) for r in decontam.decontaminate(docs, bench).collect()), key=str)
    assert got == sorted([(1, [7, 8]), (1, [7, 8]), (None, []), (2, [])], key=str)
    assert not any(r.contaminated for r in decontam.decontaminate(docs, bench.limit(0)).collect())
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_given_documents(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: list(r["items"]) for r in decontam.decontaminate(docs, items).collect()}
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
