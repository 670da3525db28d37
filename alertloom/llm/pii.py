"""Personal data: base patterns, and information-theoretic sanitisation of terms that reveal them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm import bits
from alertloom.llm.common import written

# fixed values: the kinds in the order of a digest, and their patterns
KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TERM = re.compile(r"[^\W\d_]{3,}")
DIGIT = re.compile(r"[0-9]")
# A term reveals an entity if knowing it gives this share of the entity's information, seen in at least two different texts.
DISCLOSURE = 0.8
# From this share on a term is removed, below it is replaced by a general word.
REMOVAL = 0.95
REMEMBERED = 500_000


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left and right: the leftmost matches, in linear time."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        if domain:
            done = at = domain.end()
            yield start, done


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of the base kinds, by kind and start; matches that fail their test are dropped."""
    found = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for kind, pattern, least, most in (("card", CARD, 13, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or _luhn(digits)):
                found.append((kind, *m.span()))
    return found


def context_terms(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """The terms of a text outside the spans, in lower case."""
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        parts.append(text[at : max(at, start)])
        at = max(at, end)
    return {t.lower() for t in set(TERM.findall("\n".join([*parts, text[at:]])))}


def _entity(text: str, kind: str, start: int, end: int) -> str:
    value = text[start:end].lower()
    return f"{kind} {re.sub('[^0-9]', '', value) if kind in ('card', 'phone') else value}"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        spans, entities, terms = [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            found = base_spans(text)
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            entities.append(sorted({_entity(text, k, a, b) for k, a, b in found}))
            terms.append(sorted(context_terms(text, found)) if found else [])
        words = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), pa.array(spans, pa.list_(span)), pa.array(entities, words), pa.array(terms, words)], names=["doc_id", "h1", "h2", "spans", "entities", "terms"]
        )


class _Known:
    """Whether a term may be in a filter of term hashes, remembered for a bounded number of terms."""

    def __init__(self, filter_bits) -> None:
        self.bits, self.seen = filter_bits, {}

    def __call__(self, term: str) -> bool:
        known = self.seen.get(term)
        if known is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            known = self.seen[term] = bits.holds(self.bits, xxhash.xxh64_intdigest(term.encode(), 42))
        return known


def _with_hashes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("other"), "text").alias("h2"))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, h1, h2, spans, entities, terms`` for each row: a hash of its text, the base spans, what they name, and, of texts with any, all terms outside them."""
    spec = "doc_id long, h1 long, h2 long, spans array<struct<kind:string,start:long,end:long>>, entities array<string>, terms array<string>"
    return _with_hashes(docs).mapInArrow(_find, spec)


def disclosure(docs: DataFrame, found: DataFrame, least: float | None = None) -> DataFrame:
    """``term, share``: how much of a protected entity's information a term gives away, at most, over the entities it is in documents with.

    Of an entity e in df(e) of N documents and a term t in df(t), both together in
    df(e, t), t tells log(N df(e,t) / (df(e) df(t))) of the log(N / df(e)) that e holds.  Both may stand anywhere in
    a document.  Only terms that are with e in two different texts count, so that copies of one
    text say nothing, and so only entities that are in two: the pairs of the others are not made.  Copies are counted, not
    repeated.  Counts are over all documents.  With ``least`` terms whose share is lower are left out; those that, by the
    documents with entities alone, are too frequent go first.
    """
    n = found.count()
    holding = found.filter(F.size("entities") > 0)
    told = holding.select("h1", "h2", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("of_entity"), F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi"))
    holders = written(told.filter("lo <> hi").select("entity", "of_entity"), "holders")
    texts = holding.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    shared = texts.withColumn("entity", F.explode("entities")).join(holders.select("entity"), "entity").select("h1", "copies", "entity", F.explode("terms").alias("term"))
    both = shared.groupBy("entity", "term").agg(F.sum("copies").alias("together"), F.count("*").alias("n_texts")).filter("n_texts > 1").drop("n_texts")
    # An entity of every document holds no information.
    both = both.join(holders.filter(F.col("of_entity") < n), "entity")
    gain = lambda of: F.log(F.lit(float(n)) * F.col("together") / (F.col("of_entity") * F.col(of)))
    held = F.log(F.lit(float(n)) / F.col("of_entity"))
    if least is not None:
        known = texts.select("copies", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("copies").alias("of_known"))
        both = both.join(known, "term").filter(gain("of_known") >= (least - 1e-9) * held).drop("of_known")
    both = written(both, "together")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for value in batch.column(0):
                sums.update({t.lower() for t in set(TERM.findall(value.as_py() or ""))})
                if len(sums) > REMEMBERED:
                    yield out()
                    sums.clear()
        yield out()

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("of_term"))
    told = both.join(counted, "term")
    shares = told.groupBy("term").agg(F.max(gain("of_term") / held).alias("share"))
    return shares if least is None else shares.filter(F.col("share") >= least)


def private_spans(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """``doc_id, spans`` for each row of ``docs`` (doc_id long, text string): spans are (kind, start, end, action), by kind and start.

    The base kinds are always there (action ``mask``).  Terms whose disclosure reaches
    ``threshold`` are added wherever they stand in any document, outside the base
    spans, with the action ``generalise`` or, from 0.95 on, ``remove``.  Places count
    code points, the end exclusive.  Null texts are empty.  Spans depend on
    the text only, so repeated rows and rows without doc_id get theirs as any other.
    """
    found = written(find(docs), "found")
    terms = written(disclosure(docs, found, threshold), "terms")
    wanted = docs.sparkSession.sparkContext.broadcast(bits.build(terms.select(F.xxhash64("term").alias("hash"))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(wanted.value)
        for batch in batches:
            rows: list[tuple] = []
            for value, h1, h2 in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                text = value.as_py()
                if any(known(t.lower()) for t in set(TERM.findall(text))):
                    base = base_spans(text)
                    for m in TERM.finditer(text):
                        if known(m[0].lower()) and not any(a < m.end() and m.start() < b for _, a, b in base):
                            rows.append((h1.as_py(), h2.as_py(), m[0].lower(), *m.span()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["h1", "h2", "term", "start", "end"])

    at = _with_hashes(docs).mapInArrow(places, "h1 long, h2 long, term string, start long, end long").join(terms, "term")
    action = F.when(F.col("share") >= REMOVAL, "remove").otherwise("generalise").alias("action")
    added = at.groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct("start", "end", action))).alias("added"))
    one = lambda s, kind, act: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), act.alias("action"))
    base = F.transform("spans", lambda s: one(s, s["kind"], F.lit("mask")))
    more = F.transform("added", lambda s: one(s, F.lit("term"), s["action"]))
    joined = found.select("doc_id", "h1", "h2", "spans").join(added, ["h1", "h2"], "left")
    return joined.select("doc_id", "h1", "h2", F.concat(base, F.coalesce(more, F.array().cast("array<struct<kind:string,start:long,end:long,action:string>>"))).alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """The text with base spans masked by their kind, terms generalised to a word or removed; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, end, action in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], "" if action == "remove" else "[TERM]" if action == "generalise" else f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """``doc_id, text``: the sanitised text of each row; null texts become empty."""
    spans = private_spans(docs, threshold).drop("doc_id").dropDuplicates(["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t.as_py(), [tuple(x.values()) for x in s.as_py() or ()]) for t, s in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _with_hashes(docs).join(spans, ["h1", "h2"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def listing(spans: DataFrame) -> DataFrame:
    """The counts by base kind, the digest of the base spans and the list of all spans of ``private_spans``."""
    base = F.filter("spans", lambda s: s["kind"] != "term")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.array_remove(F.transform("spans", lambda s: F.when(s["kind"] == kind, kind).otherwise("")), "")).cast("long").alias(f"n_{kind}") for kind in KINDS]  # noqa: B023
    return spans.select("doc_id", *counts[:-1], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), counts[-1])


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of ``base_spans`` as in ``listing``."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
