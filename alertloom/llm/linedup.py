"""Line deduplication by overlapping windows of three consecutive lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import tidy, unused

WINDOW = 3
BLANK = r"[^\x20\x09-\x0D]"
_NOT_BLANK = re.compile(BLANK)
# Rows of an Arrow batch that are worked on at a time.
ROWS = 256


def numbered(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text, and the places of those that are not blank."""
    lines = text.split("\n")
    return lines, [i for i, line in enumerate(lines) if _NOT_BLANK.search(line)]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            row, at, digests = [], [], []
            for i, text in enumerate(part.column(1)):
                lines, full = numbered(text.as_py())
                for k in range(len(full) - WINDOW + 1):
                    row.append(i)
                    at.append(k)
                    digests.append(xxhash.xxh3_128_digest("\n".join([lines[p] for p in full[k : k + WINDOW]])))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["doc_id", "at", "h1", "h2"]
            )


def covered_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, starts``: where (among its lines that are not blank) later occurrences of windows begin in a document.

    A window's hash has 128 bits, so windows of a very large corpus do not meet by chance.
    """
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    windows = named.mapInArrow(_windows, "doc_id long, at int, h1 long, h2 long")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("first")).filter("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).filter(F.struct("doc_id", "at") != F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, added: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The rows of ``docs`` (doc_id long, text string, any further columns) with ``text`` shortened, ``n_lines`` and ``n_removed`` (or the names in ``added``) added.

    Lines end at newlines; blank ones are not counted and stay.  Of
    equal windows of three consecutive lines the first by (doc_id, place) stays, and every
    line that lies in a later one is removed; overlapping later windows remove their
    union.  Texts of fewer than three lines have no window.  Null texts stay null and have no line; rows
    without doc_id stay as they are; rows repeated under one doc_id are one
    document and get the same text.  Columns that have the added names are replaced.
    """
    keep = [c for c in docs.columns if c not in added]
    place = keep.index("text") + 1
    # Names that no column of the documents has.
    own, starts = unused(docs, "cover_id"), unused(docs, "starts")
    cover = covered_lines(docs).select(F.col("doc_id").alias(own), F.col("starts").alias(starts))
    joined = docs.join(cover, F.col("doc_id").cast("long") == F.col(own), "left").select(starts, *[F.col(c).cast("string") if c == "text" else F.col(c) for c in keep])

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                texts, counts, removed = [], [], []
                for starts, value in zip(part.column(0).to_pylist(), part.column(place), strict=True):
                    text = value.as_py()
                    counts.append(0 if text is None else text.count("\n") + 1)
                    gone: set[int] = set()
                    if starts and text is not None:
                        lines, full = numbered(text)
                        gone = {full[k + d] for k in starts for d in range(WINDOW) if k + d < len(full)}
                        text = "\n".join([line for i, line in enumerate(lines) if i not in gone])
                    texts.append(text)
                    removed.append(len(gone))
                columns = list(part.columns)
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns[1:], pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*keep, *added])

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[1:])
    return joined.mapInArrow(shorten, f"{spec}, `{added[0]}` long, `{added[1]}` long")


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, k, line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS body FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
o AS (SELECT doc_id, k, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS nth FROM w WHERE body IS NOT NULL),
g AS (SELECT DISTINCT doc_id, k + j.d AS k FROM o, (VALUES (0), (1), (2)) j(d) WHERE nth > 1),
m AS (SELECT f.doc_id, f.i FROM f JOIN g USING (doc_id, k)),
t AS (SELECT l.doc_id, string_agg(CASE WHEN m.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS text, count(*) AS n_lines, count(m.i) AS n_removed
      FROM l LEFT JOIN m USING (doc_id, i) GROUP BY l.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM t
"""
