"""Each stage of the pipeline against brute force over its own input."""

import re

import corpus_pipeline
import test_decontam
import test_linedup
import test_neardup
from pyspark.sql import functions as F

from alertloom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, sf, docs):
    """The rows each stage got and gave."""
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), name)
        yield name, docs.collect(), out
        docs = out


def test_stages(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(900_001, None, "en", "s", None), (900_002, " 12 !", "en", "s", 5), (900_003, "word", None, "s", 4), (None, "the word of and the", None, None, None)]
    docs = given.union(spark.createDataFrame(extra, given.schema))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, before, out in stages(spark, sf, docs):
        after = out.collect()
        texts = {r.doc_id: r.text for r in after}
        assert len(texts) == len(after)
        pairs = [(r.doc_id, r.text) for r in before]
        if name != "token_ids":
            assert out.columns == COLUMNS
        if name == "language":
            assert set(texts) == {d for d, t in pairs if t and any(c.isalpha() for c in t)}
            assert all(r.lang for r in after)
        elif name == "repeated_lines":
            plain = test_linedup.plain([p for p in pairs if p[0] is not None]) | {d: t for d, t in pairs if d is None}
            old = dict(pairs)
            assert texts == {d: t for d, t in plain.items() if t == old[d] or re.search(r"[^\x20\x09-\x0D]", t)}
            assert all(r.n_chars == len(r.text) for r in after if r.n_chars is not None)
        elif name == "near_copies":
            kept = {d for d, _, _, k in test_neardup.expected([p for p in pairs if p[0] is not None]) if k}
            assert set(texts) == kept | {d for d, _ in pairs if d is None}
        elif name == "benchmark_passages":
            held = test_decontam.plain(pairs, items)
            assert set(texts) == {d for d, _ in pairs if d is None or not held[d]}
        else:
            assert texts == dict(pairs) and all(r.n_tokens == len(r.ids) for r in after)


def test_run_and_empty_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids", "text"]


def test_lettered_texts_stay_where_no_language_is_known(spark):
    rows = [(1, "the word", None), (2, " 12 !", None), (3, None, None), (None, "mot", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.language(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text, r.lang) for r in got), key=str) == [(1, "the word", None), (None, "mot", None)] and list(got[0].asDict()) == COLUMNS


CLASHING = ["lang_pred", "score", "n_lines", "n_removed", "starts", "_starts", "cover_id", "_cover_id", "h1", "h2", "own_id", "first", "comp", "kept", "hash", "hits", "items", "_text"]


def test_clashing_columns_and_repeated_rows(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 150")
    docs = written(given.union(given).withColumns({c: F.lit("mine") for c in CLASHING}), "docs")
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), name)
        if name != "token_ids":
            assert out.columns == docs.columns
            assert out.filter(" OR ".join(f"{c} <> 'mine'" for c in CLASHING)).count() == 0
        if name in ("language", "repeated_lines"):
            assert out.count() == 2 * out.select("doc_id").distinct().count()
        else:
            assert out.count() == out.select("doc_id").distinct().count() > 50
        docs = out
