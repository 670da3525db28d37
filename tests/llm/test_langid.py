"""Cross parsing against a plain substring search, and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from alertloom.llm import langid


def plain_phrases(text, sample):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


@pytest.mark.parametrize("block, ahead, few", [(384, 48, 48), (8, 3, 0), (2, 1, 2)])
def test_phrases_are_those_of_the_whole_text(monkeypatch, block, ahead, few):
    monkeypatch.setattr(langid, "FEW", few)
    monkeypatch.setattr(langid, "MANY", few)
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "AHEAD", ahead)
    rng = random.Random(3)
    text = lambda symbols: "".join(map(chr, symbols))
    for _ in range(60):
        sample = [rng.randrange(3, 6) for _ in range(rng.randrange(1, 200))]
        texts = [[rng.randrange(3, 8) for _ in range(rng.randrange(0, 60))] for _ in range(4)] + [[rng.randrange(3, 6) for _ in range(300)], sample, sample * 3, []]
        got = langid.phrases([np.array(t, np.uint8) for t in texts], langid.automaton(sample, 9))
        assert got.tolist() == [plain_phrases(text(t), text(sample)) for t in texts]


def test_identify_equals_plain_cross_parsing(spark):
    rng = random.Random(6)
    words = {"de": "der hund und die katze gehen in den wald".split(), "en": "the dog and the cat walk into the wood".split(), "es": "el perro y el gato van al bosque".split()}
    made = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    samples = [("de", made("de", 60)), ("en", made("en", 400)), ("es", made("es", 9))]
    rows = [(i, " ".join(made(lang, rng.randrange(1, 30)) for lang in rng.sample(sorted(words), rng.randrange(1, 4)))) for i in range(40)] + [(40, made("es", 3000)), (41, "perro"), (42, "xx")]
    bits = {lang: math.log2(len(sample) + 1) for lang, sample in samples}
    for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect():
        cost = sorted((plain_phrases(dict(rows)[r.doc_id], sample) * bits[lang], lang) for lang, sample in samples)
        assert (r.lang_pred, round(r.score, 9)) == (cost[0][1], round(1 - cost[0][0] / cost[1][0], 9))


def test_samples_are_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 1000)
    rows = [(i, "x" * n, lang) for i, (n, lang) in enumerate([(400, "a"), (500, "a"), (900, "a"), (5000, "a"), (3000, "b"), (2000, "b")] * 3) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows += [(r[0], r[1].replace("x", "é", 1), r[2]) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = {t for _, t, _ in rows}
    got = dict(langid.learn(docs))
    assert set(got) == {"a", "b"} and all(t in texts for sample in got.values() for t in sample.split("\n"))
    assert len(got["a"].replace("\n", "")) <= 1000 and len(got["b"]) == 2000


def test_large_alphabets(spark):
    rng = random.Random(5)
    words = {"ja": [0x4E00 + 2 * k for k in range(3000)], "zh": [0x4E01 + 2 * k for k in range(3000)]}
    samples = [("de", "der hund und die katze " * 40), *((lang, "".join(chr(rng.choice(codes)) for _ in range(20_000))) for lang, codes in words.items())]
    table, made, _ = langid._model(tuple(samples))
    for (_, sample), moves in zip(samples, made, strict=True):
        text = samples[2][1][5_000:5_050] + samples[1][1][7_000:7_040] + "hund" + samples[2][1][:60]
        assert langid.phrases([langid._symbols(text, table)], moves)[0] == plain_phrases(text, sample)
    pieces = lambda sample: "".join(sample[k : k + 4] for k in (rng.randrange(19_000) for _ in range(50)))
    rows = [(i, pieces(dict(samples)[lang]), lang) for i, lang in enumerate(["zh", "ja"] * 3)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), samples, keep=("doc_id", "lang")).collect()
    assert all(r.lang == r.lang_pred and r.score > 0 for r in got)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = langid.identify(docs, langid.learn(docs), keep=("doc_id", "lang")).withColumn("out", langid.held_out()).collect()
    assert len(judged) == docs.count()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in judged)
    held = [r for r in judged if r.out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in judged)


def test_labels_of_held_out_rows_say_nothing(spark):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, f"der hund und die katze {i}", "de") if i not in held else (i, "el perro y el gato", "zz") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(docs)).collect()} == {"de"}


def test_edge_cases(spark):
    rows = [(0, "guten tag und guten abend", "de"), (2, "good day and good evening", "en"), (3, None, "en"), (5, "", "de"), (6, " 12 !? ", "en"), (None, "GOOD EVENING", None), (8, "漢字", None), (8, "漢字", None), (9, "and good " * 60_000, None)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string").drop("score", "lang_pred")
    samples = [("de", "guten tag und guten abend"), ("en", "good day and good evening")]
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, samples).collect()]
    assert sorted(got, key=str) == sorted([(0, "de"), (2, "en"), (3, "und"), (5, "und"), (6, "und"), (None, "en"), (8, "de"), (8, "de"), (9, "en")], key=str)
    assert {r.lang_pred for r in langid.identify(docs, []).collect()} == {"und"}
    assert langid.learn(docs.limit(0)) == [] and langid.identify(docs.limit(0), samples).count() == 0
