from __future__ import annotations

import json

import pytest

from bibspark.plans import enrich
from bibspark.sources import online

BOOK = "id long, title string, authors array<string>, genres array<string>, annotation string, series string, series_number double, language string, publisher string, year int, identifiers map<string,string>, content_hash string, metadata_checked int, enrichment_checked int, manually_matched int"
RECORD = "id long, title string, authors array<string>, genres array<string>, annotation string, series string, series_number double, language string, publisher string, year int, identifiers array<struct<type:string,value:string>>"


@pytest.fixture
def books(spark):
    return spark.createDataFrame([(1, "T", ["A"], [], None, None, None, "und", None, None, {"isbn": "1"}, "h", 0, 0, 0), (2, "U", ["B"], ["History"], "own", "S", 1.0, "en", "P", 1990, {}, "h", 1, 0, 0), (3, "V", [], [], None, None, None, "en", None, None, None, "h", 0, 0, 0)], BOOK)


@pytest.fixture
def records(spark):
    one = ("New", ["C"], ["sf", "junk"], " text", "R", 0.0, "de", "Q", 2001, [("isbn", "9780306406157"), ("ASIN", "b1")])
    return spark.createDataFrame([(1, *one), (2, *one)], RECORD)


def rows(df):
    return {r.id: r.asDict() for r in df.collect()}


def test_gaps(books, records):
    out = rows(enrich.enriched(books, records))
    assert out[1] | {"content_hash": None} == {"id": 1, "title": "T", "authors": ["A"], "genres": ["Science Fiction"], "annotation": " text", "series": None, "series_number": None, "language": "und", "publisher": "Q", "year": 2001, "identifiers": {"isbn": "1", "amazon": "B1"}, "content_hash": None, "metadata_checked": 0, "enrichment_checked": 1, "manually_matched": 0}
    assert (out[2]["genres"], out[2]["annotation"], out[2]["content_hash"], out[2]["identifiers"]) == (["History"], "own", "h", {"isbn": "9780306406157", "amazon": "B1"})
    assert out[3]["enrichment_checked"] == 0 and out[1]["content_hash"] != "h"


def test_overwrite_and_edit(spark, books, records):
    out = rows(enrich.enriched(books, records, overwrite=True))
    assert (out[2]["title"], out[2]["authors"], out[2]["series"], out[2]["series_number"], out[2]["language"], out[2]["genres"], out[2]["manually_matched"]) == ("New", ["C"], "R", 1.0, "de", ["Science Fiction"], 1)
    nothing = ("", [], [], "", "", 0.0, "", "", 0)
    edits = spark.createDataFrame([(1, *nothing, []), (2, *nothing, None)], RECORD)
    kept = rows(enrich.edited(books, edits))
    assert kept[1]["identifiers"] == {} and kept[1]["title"] == "T" and kept[1]["manually_matched"] == 1 and kept[1]["content_hash"] == "h"
    assert kept[2]["identifiers"] == {} and kept[3] == rows(books)[3]


def test_backfill(books, records):
    out = rows(enrich.backfilled(books, records))
    assert (out[1]["annotation"], out[1]["identifiers"], out[1]["metadata_checked"]) == (" text", {"isbn": "1", "amazon": "B1"}, 1)
    assert out[2] == rows(books)[2]


def test_volumes(spark):
    answer = {"items": [{"id": "gid", "volumeInfo": {"title": " Dune ", "authors": ["Frank"], "publishedDate": "1965-08", "description": "d", "categories": ["Fiction / Science Fiction / Epic"], "industryIdentifiers": [{"type": "ISBN_13", "identifier": "978-0-306-40615-7"}], "imageLinks": {"thumbnail": "http://b/x?id=1&edge=curl&z=1"}}}, {}]}
    df = spark.createDataFrame([(1, json.dumps(answer)), (2, "{broken"), (3, "{}")], "book long, json string")
    one, two = online.volumes(df).collect()
    assert (one.book, one.title, one.authors, one.year, one.genres, one.cover_url) == (1, "Dune", ["Frank"], 1965, ["Science Fiction"], "https://b/x?id=1&z=1")
    assert [tuple(i) for i in one.identifiers] == [("google", "gid"), ("isbn", "9780306406157")]
    assert (two.title, two.identifiers, two.year, two.cover_url) == ("", [], 0, None)


def test_candidates(spark):
    docs = spark.createDataFrame([(1, json.dumps({"docs": [{"title": "A", "cover_i": 5}, {"title": "B"}, {"title": "C", "cover_i": 0}]}))], "request long, json string")
    assert [(r.request, r.title, r.full_url[-8:]) for r in online.library_covers(docs).collect()] == [(1, "A", "/5-L.jpg")]
    assert online.library_covers(docs, by_isbn=True).first().title == ""
    items = spark.createDataFrame([(json.dumps([{"imageUrl": "https://i/1._SX50_.JPG", "title": "", "bookTitleBare": "Bare"}, {"title": "none"}]),)], "json string")
    assert [(r.title, r.full_url, r.thumb_url) for r in online.completion_covers(items).collect()] == [("Bare", "https://i/1.jpg", "https://i/1._SY450_.jpg")]
