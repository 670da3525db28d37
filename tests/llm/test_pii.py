"""Personal data against the plain patterns, and disclosure of terms."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alertloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.B@-+ 0123459()é\n_%", max_size=60))
def test_base_spans_are_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.255", "10.0.0.256", "1.2.3.4.5.6.7.8", "+1 (386) 555-3733", "a.b@c.de", "a@b@c.d.", " ", "x", "0"]), max_size=8))
def test_planted_pieces(parts):
    assert pii.base_spans("".join(parts)) == plain("".join(parts))


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 200_000, "+" * 200_000, "1 " * 150_000, "a@" * 100_000):
        pii.base_spans(text)


def test_terms_that_reveal_an_entity(spark):
    filler = "plain words stand around everything that people write today"
    rows = [(i, f"number {i} says {filler}") for i in range(40)]
    rows += [(100, f"{filler} contact zanzibar at big.boss@corp.example now"), (101, f"the zanzibar mail is big.boss@corp.example says {filler}"), (102, "we met zanzibar again"), (103, None), (None, "write to big.boss@corp.example"), (105, "")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, h1 int, spans string")
    got = {r.doc_id: r for r in pii.listing(pii.private_spans(docs)).collect()}
    assert len(got) == len(rows)
    assert got[102].spans == "term:7:15" and got[102].n_term == 1 and got[102].n_email == 0
    at = rows[40][1].index("big.boss")
    assert got[100].base_sha256 == pii.digest([("email", at, at + len("big.boss@corp.example"))])
    assert "term" in got[100].spans and got[5].spans == "" and got[103].n_email == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "zanzibar" not in clean[102] and "[EMAIL]" in clean[None] and clean[3] == rows[3][1]
    assert pii.listing(pii.private_spans(docs.limit(0))).count() == 0


def plain_terms(rows):
    """Share by term, counted over whole documents."""
    texts = [t or "" for _, t in rows]
    entities = [{pii._entity(t, *s) for s in pii.base_spans(t)} for t in texts]
    outside = [pii.context_terms(t, pii.base_spans(t)) for t in texts]
    inside = [{w.lower() for w in pii.TERM.findall(t)} for t in texts]
    out = {}
    for e in set().union(*entities):
        of = [i for i, es in enumerate(entities) if e in es]
        for term in set().union(*(outside[i] for i in of)):
            both = [i for i in of if term in outside[i]]
            if len({texts[i] for i in both}) > 1 and len(of) < len(texts):
                gain = math.log(len(texts) * len(both) / (len(of) * sum(term in w for w in inside)))
                out[term] = max(out.get(term, -9), gain / math.log(len(texts) / len(of)))
    return out


def test_disclosure_counts_whole_documents(spark):
    rng = random.Random(8)
    mails = [f"p{i}.q@corp{i % 3}.example" for i in range(6)]
    secret = [f"name{chr(97 + i)}x" for i in range(6)]
    rows = []
    for i in range(150):
        k = rng.randrange(12)
        words = [rng.choice("time word place year hand part case point".split()) for _ in range(rng.randrange(5, 400))]
        if k < 6:
            words.insert(0, mails[k])
            words.append(secret[k])
            if rng.random() < 0.3:
                words.insert(3, mails[(k + 1) % 6])
        elif k == 6:
            words.insert(2, rng.choice(secret))
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[0][1]) for i in range(9)] + [(300, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.term: round(r.share, 9) for r in pii.disclosure(docs, pii.find(docs)).collect()}
    want = {t: round(s, 9) for t, s in plain_terms(rows).items()}
    assert got == want and sum(s >= pii.DISCLOSURE for s in want.values()) >= 3
    named = {t for t, s in want.items() if s >= pii.DISCLOSURE}
    for r in pii.private_spans(docs).collect():
        text = dict(rows)[r.doc_id] or ""
        base = pii.base_spans(text)
        terms = [("term", m.start(), m.end()) for m in pii.TERM.finditer(text) if m[0].lower() in named and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert [(s.kind, s.start, s.end) for s in r.spans] == base + terms


def test_copies_of_one_text_reveal_nothing(spark):
    docs = spark.createDataFrame([(i, "ask zanzibar at a@b.cd") for i in range(9)] + [(50 + i, f"other text {i}") for i in range(30)], "doc_id long, text string")
    assert all(r.n_term == 0 for r in pii.listing(pii.private_spans(docs)).collect())


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.listing(pii.private_spans(docs)).collect():
        spans = plain(texts[r.doc_id])
        assert r.base_sha256 == pii.digest(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PLAIN]


@pytest.mark.parametrize("text", ["a b.c@d.e f", "ab@c.d"])
def test_redacted(text):
    spans = [(*s, "mask") for s in pii.base_spans(text)]
    assert "@" not in pii.redact(text, spans)


def test_frequent_terms_need_no_count(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = pii.find(docs)
    every = {r.term: round(r.share, 9) for r in pii.disclosure(docs, found).collect()}
    assert {r.term: round(r.share, 9) for r in pii.disclosure(docs, found, 0.8).collect()} == {t: s for t, s in every.items() if s >= 0.8}
