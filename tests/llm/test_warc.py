"""Archives: round trips, and reading of hand-made and broken segments."""

import base64
import glob
import gzip
import hashlib
import io

import pytest

from alertloom.llm import warc
from alertloom.llm.common import scratch


def plain(rows):
    """rows: (page_id, html) with unique ids."""
    out = {}
    for page, html in rows:
        payload = (html or "").encode()
        last = max(p for p, h in rows if (h or "") == (html or ""))
        out[page] = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if page == last else "revisit", None if page == last else last)
    return out


def round_trip(spark, pages):
    path = scratch(spark, "warc")
    warc.write_archive(pages, path)
    return path, warc.read_archive(spark, path)


def test_pages(spark):
    long = "".join(f"<p>é{i} WARC/1.1\r\n\r\n</p>" for i in range(20_000))
    rows = [(0, None), (1, ""), (2, "one\r\n\r\n0\r\n\r\n"), (3, long), (4, long), (5, "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "é" * 20_000), (-7, "minus")]
    pages = spark.createDataFrame([(p, None if p == 1 else f"http://a/{p}\r\nX: y", h, 1) for p, h in rows], "page_id long, url string, html string, sha int")
    path, records = round_trip(spark, pages)
    assert {r.page_id: tuple(r)[1:] for r in warc.page_listing(records).collect()} == plain(rows)
    got = records.collect()
    assert all(r.problem is None for r in got)
    texts = {h or "" for _, h in rows}
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == texts
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.gz"))
    assert data.count(b"WARC-Type: continuation") > 5 and max(len(b) for _, b in warc.parse(io.BytesIO(data))) <= warc.SEGMENT


def test_repeated_ids_null_ids_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "u", "y"), (2, "v", "z" * 100_000), (None, "u", "x"), (None, "u", "n"), (3, "http://a/" + "p" * 100_000, "y")], "page_id long, url string, html string")
    path, records = round_trip(spark, pages)
    got = warc.page_listing(records).collect()
    # Every row has its record, and every payload is there once.
    shown = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got]
    assert sorted(shown, key=str) == sorted([(1, 1, "response", None), (1, 1, "revisit", 1), (None, 1, "revisit", 1), (None, 1, "response", None), (2, 1, "revisit", 3), (3, 1, "response", None), (2, 100_000, "response", None)], key=str)
    assert len({r.record_id for r in records.collect()}) == 7
    assert warc.page_listing(round_trip(spark, pages.limit(0))[1]).count() == 0


def test_records_of_other_types_are_passed_over(spark, tmp_path):
    info = warc._record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x>")], b"software: x\r\n")
    records = [info, *warc.page_records(4, "http://a/", b"payload", None), info]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + warc.END) for r in records))
    (row,) = warc.read_archive(spark, str(tmp_path)).collect()
    assert (row.payload, row.problem) == (b"payload", None)


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in warc.page_listing(round_trip(spark, pages)[1]).collect()}
    assert got == plain([(r.page_id, r.html) for r in pages.collect()])


@pytest.mark.parametrize("broken,problem", [("missing", "segments are missing"), ("short", "length differs"), ("framing", "chunk"), ("digest", "digest"), ("first", "segments are missing")])
def test_broken_segments_are_named(spark, broken, problem, tmp_path):
    records = list(warc.page_records(9, "http://a/", b"payload " * 10_000, None))
    if broken == "missing":
        del records[1]
    elif broken == "first":
        del records[0]
    elif broken == "short":
        records[-1] = records[-1].replace(b"Total-Length: ", b"Total-Length: 1")
    elif broken == "framing":
        records[0] = records[0].replace(b"2000\r\n", b"1fff\r\n", 1)
    else:
        records[0] = records[0].replace(b"sha1:", b"sha1:A", 1)
    (tmp_path / "a.warc").write_bytes(b"".join(r + warc.END for r in reversed(records)))
    (row,) = warc.read_archive(spark, str(tmp_path)).collect()
    assert row.payload is None and problem in row.problem


def test_chunks():
    for n in (0, 1, warc.CHUNK, warc.CHUNK + 1, 3 * warc.CHUNK):
        assert warc.unchunk(warc.chunked(b"x" * n)) == b"x" * n
    assert warc.unchunk(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
