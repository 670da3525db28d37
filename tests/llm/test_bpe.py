"""Byte-level BPE against tiktoken."""

import random
import time

import public_tokenizers
import pytest
import regex
import tiktoken

from alertloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces(ranks, library):
    rng = random.Random(1)
    memory, pieces = bpe.Memory(ranks), regex.compile(public_tokenizers.PATTERN)
    for _ in range(800):
        text = "".join(rng.choice("abcdeé漢字 \n\t  !?'sre12😀") for _ in range(rng.randrange(120)))
        assert bpe.encode_text(text, memory, pieces).tolist() == library.encode_ordinary(text)
    assert bpe.merge(bytes(range(256)), ranks) == library._encode_single_piece(bytes(range(256)))


def test_a_long_piece_takes_little_time(ranks):
    began = time.time()
    assert len(bpe.merge(b"ab" * 50_000, ranks)) > 0
    assert time.time() - began < 20


def test_rows(spark, library):
    texts = [None, "", "Hello  wörld\n\n", "<|endoftext|>", "x" * 100_000, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, ids int, bytes int")
    both = bpe.encode(docs, PATH, public_tokenizers.PATTERN, decoded=True)
    got = both.collect()
    assert sorted(bytes(r.bytes) for r in bpe.decode(both, PATH).collect()) == sorted(bytes(r.bytes) for r in got)
    want = {(i if i else None): t or "" for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.bytes).decode() for r in got} == want
    assert {r.doc_id: r.ids for r in got} == {i: library.encode_ordinary(t) for i, t in want.items()}
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_given_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts) and all(r.ids == library.encode_ordinary(texts[r.doc_id]) for r in got)


def test_memory_forgets_and_stays_right(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    memory, pieces = bpe.Memory(ranks), regex.compile(public_tokenizers.PATTERN)
    text = "zaqwsx plokij zaqwsx mnbvcx qazwsx edcrfv zaqwsx " * 5
    assert bpe.encode_text(text, memory, pieces).tolist() == library.encode_ordinary(text)
    assert len(memory) <= 3 and len(memory.old) <= 3
