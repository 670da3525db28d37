"""Repeated windows of three lines against a plain pass, and the query's SQL."""

import random
import re

from alertloom.llm import linedup


def plain(rows):
    """rows: (doc_id, text) with unique ids."""
    first, gone = {}, {}
    for d, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        for k in range(len(full) - 2):
            window = tuple(lines[i] for i in full[k : k + 3])
            if first.setdefault(window, (d, k)) != (d, k):
                gone.setdefault(d, set()).update(full[k : k + 3])
    return {d: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(d, ())) if text is not None else None for d, text in rows}


def test_random_lines(spark):
    rng = random.Random(5)
    rows = [(d, "\n".join(rng.choice(["a", "b", "c", "d", "", " ", "é x", "[z]"]) for _ in range(rng.randrange(30)))) for d in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n\n"), (503, "a\na\na\na\na")]
    docs = spark.createDataFrame([(d, t, 7, 8) for d, t in rows], "doc_id long, text string, h1 int, n_removed int")
    got = linedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "h1", "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in got.collect()} == plain(rows)


def test_rows_without_id_repeats_and_empty_table(spark):
    text = "one\ntwo\nthree"
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "zero\n" + text + "\nfour")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in linedup.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(None, text, 0), (1, text, 0), (1, text, 0), (2, "zero\nfour", 3)], key=str)
    assert linedup.dedup_lines(docs.limit(0)).count() == 0


def test_long_text(spark):
    text = "\n".join(f"line {i}" for i in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nmore")], "doc_id long, text string")
    assert {r.doc_id: len(r.text) for r in linedup.dedup_lines(docs).collect()} == {1: len(text), 2: 4}
