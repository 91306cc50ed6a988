from __future__ import annotations

import io

import pytest
from pyspark.sql import functions as F

from bibspark.llm import files, queries, warc

from .helpers import saved

PAGES = [(3, "http://x/a b\r\n", "same"), (1, "http://x/1", "same"), (2, None, None), (5, "http://x/5", ""), (7, "u", "é" * 70000), (8, "u", "é" * 70000), (9, "u", "only"), (None, "n", "same"), (9, "u", "only"), (10, "u", "only")]


def test_round_trip(spark, tmp_path):
    sf = saved(spark.createDataFrame(PAGES, "page_id long, url string, html string"), tmp_path, "pages")
    got = sorted(map(tuple, queries.op5_warc(spark, sf).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for page_id, _, html in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(html or "", page_id)
    want = []
    for page_id, _, html in sorted(PAGES, key=lambda p: (p[0] is not None, p[0] or 0)):
        data, of = (html or "").encode(), first[html or ""]
        again = page_id is not None and page_id > of
        want.append((page_id, "revisit" if again else "response", len(data), warc.base32_sha1(data), of if again else None))
    assert got == want


def test_payloads_and_small_ones(spark):
    uri = files.scratch(spark, "warc")
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    names = [n for n, _ in warc.write(pages, uri, min_bytes=3)]
    got = {r.page_id: (r.record_type, r.payload and bytes(r.payload), r.refers_to) for r in warc.read(spark, uri, names).collect()}
    assert got == {1: ("response", b"aa", None), 2: ("response", b"aa", None), 3: ("response", b"aaaa", None), 4: ("revisit", None, 3)}


def test_other_columns_are_never_read(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(9) for c in ("payload", "digest", "first", "n", "__id", "record_type")})
    plain, uri, other = spark.createDataFrame(PAGES, "page_id long, url string, html string"), files.scratch(spark, "warc"), files.scratch(spark, "warc")
    got, want = (sorted(map(str, warc.read(spark, at, [n for n, _ in warc.write(t, at)]).collect())) for t, at in ((pages, uri), (plain, other)))
    assert got == want


def test_empty_table(spark):
    uri = files.scratch(spark, "warc")
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"), uri) == []
    assert warc.read(spark, uri, []).count() == 0


def test_many_archives(spark):
    uri = files.scratch(spark, "warc")
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], "page_id long, url string, html string")
    names = warc.write(pages, uri, archive_bytes=1000)
    assert len(names) > 4 and sum(n for _, n in names) == 50
    assert sorted(r.page_id for r in warc.read(spark, uri, [n for n, _ in names]).collect()) == list(range(50))


def test_members_across_chunks():
    data = b"".join(warc.record(i, f"http://x/{i}", bytes([i % 251]) * i * 3001, None) for i in range(1, 120))
    got = list(warc.records(io.BytesIO(data)))
    assert [(r.page_id, r.payload_bytes) for r in got] == [(i, i * 3001) for i in range(1, 120)]


@pytest.mark.parametrize("harm", ["cut", "flip", "length", "trail"])
def test_harm_is_found(harm):
    good = warc.record(1, "http://x", b"payload" * 100, None)
    data = good + good
    if harm == "cut":
        data = data[:-9]
    elif harm == "flip":
        data = good + good[:60] + bytes([good[60] ^ 255]) + good[61:]
    elif harm == "trail":
        data += b"junk"
    else:
        import gzip

        data = gzip.compress(gzip.decompress(good).replace(b"payloadpayload", b"payload", 1))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data)))
