from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bibspark.plans import editions as ed
from bibspark.plans import reconcile as rc
from bibspark.schema import TABLES

EDITION = "book int, arrival long, source_path string, file_format string, title string, series string, series_number double, language string, annotation string, publisher string, year int, rating int, authors array<string>, genres array<string>, identifiers array<struct<type:string,value:string>>, content_hash string, lock boolean"


def edition(arrival, fmt, **more):
    base = {"book": 1, "arrival": arrival, "source_path": f"p{arrival}", "file_format": fmt, "title": "", "series": "", "series_number": None, "language": "", "annotation": "", "publisher": "", "year": 0, "rating": None, "authors": [], "genres": [], "identifiers": [], "content_hash": f"h{arrival}", "lock": False}
    return tuple((base | more).values())


def merge(spark, *rows):
    return ed.merged(spark.createDataFrame(list(rows), EDITION), ["book"], locked=F.col("lock")).first()


def test_order_matters(spark):
    epub, fb2, pdf = ({"title": "E"}, {"title": "F", "publisher": "P2"}, {"title": "P", "publisher": "P1"})
    first = merge(spark, edition(1, "pdf", **pdf), edition(2, "epub", **epub), edition(3, "fb2", **fb2))
    other = merge(spark, edition(1, "pdf", **pdf), edition(2, "fb2", **fb2), edition(3, "epub", **epub))
    assert (first.publisher, first.title, first.metadata_format) == ("P1", "E", "epub")
    assert (other.publisher, other.title, other.metadata_format) == ("P2", "E", "epub")


def test_gaps(spark):
    r = merge(
        spark,
        edition(1, "epub", title="T", authors=["A"], identifiers=[("isbn", "1")]),
        edition(2, "pdf", title="X", authors=["B"], genres=["G"], language="de", year=1999, annotation=" note", series="S", series_number=2.0, identifiers=[("isbn", "2"), ("doi", "d")]),
    )
    assert (r.title, r.authors, r.genres, r.language, r.year, r.annotation, r.series, r.series_number) == ("T", ["A"], None, "de", 1999, " note", "S", 2.0)
    assert [tuple(x) for x in r.identifiers] == [("doi", "d"), ("isbn", "1")]


def test_overwriting_never_erases(spark):
    r = merge(spark, edition(1, "pdf", title="T", authors=["A"], year=1990, language="fr", identifiers=[("isbn", "1"), ("doi", "d")]), edition(2, "epub", identifiers=[("isbn", "2")]))
    assert (r.title, r.authors, r.year, r.language, r.metadata_format, r.content_hash) == ("T", ["A"], 1990, "fr", "epub", "h2")
    assert [tuple(x) for x in r.identifiers] == [("doi", "d"), ("isbn", "2")]


def test_edit_in_place_and_sibling(spark):
    edited = merge(spark, edition(1, "epub", title="Old", source_path="a"), edition(2, "epub", title="New", source_path="a"))
    sibling = merge(spark, edition(1, "epub", title="Old", source_path="a"), edition(2, "epub", title="New", source_path="b"))
    assert (edited.title, sibling.title) == ("New", "Old")


def test_locked_fills_gaps_alone(spark):
    r = merge(spark, edition(1, "pdf", title="Mine"), edition(2, "epub", title="Theirs", publisher="P", lock=True))
    assert (r.title, r.publisher) == ("Mine", "P")


def test_unknown_language(spark):
    assert merge(spark, edition(1, "epub", title="T")).language == "und"


def plain_merge(rows):
    """The fold, row by row."""
    names = [c.split()[0] for c in EDITION.split(", ")]
    book, prio = None, {"epub": 4, "fb2": 3, "mobi": 2, "pdf": 1}
    for e in (dict(zip(names, r, strict=True)) for r in sorted(rows, key=lambda r: r[1])):
        if book is None or prio[e["file_format"]] > prio[book["fmt"]]:
            old = book or {"title": None, "publisher": None, "year": None}
            book = {"fmt": e["file_format"], "title": e["title"] or old["title"], "publisher": e["publisher"] or old["publisher"], "year": e["year"] or old["year"]}
        else:
            book |= {"publisher": book["publisher"] or e["publisher"] or None, "year": book["year"] or e["year"] or None}
    return book


def test_merge_against_plain_fold(spark):
    rng, rows = random.Random(1), []
    for book in range(60):
        for i in range(rng.randint(1, 6)):
            rows.append(edition(i, rng.choice(["epub", "fb2", "mobi", "pdf"]), book=book, title=rng.choice(["", f"t{i}"]), publisher=rng.choice(["", f"p{i}"]), year=rng.choice([0, 1990 + i]), content_hash="same"))
    got = {r.book: r for r in ed.merged(spark.createDataFrame(rows, EDITION), ["book"]).collect()}
    for book in range(60):
        want = plain_merge([r for r in rows if r[0] == book])
        assert (got[book].title, got[book].publisher, got[book].year, got[book].metadata_format) == (want["title"], want["publisher"], want["year"], want["fmt"])


def test_identity(spark):
    spec = "library_key string, derive_identity boolean, title string, authors array<string>, genres array<string>, series string, series_number double, language string, annotation string, publisher string, year int, rating int, identifiers array<struct<type:string,value:string>>"
    rows = [(None, True, "Dune", ["Herbert, Frank", "FRANK Herbert "], ["sf"], "", None, "EN-us", "", "", 0, None, [("asin", "b1")]), ("calibre:7", False, "Dune", None, None, None, None, None, None, None, None, None, None), (None, True, "dune ", ["Frank Herbert"], [], "", 2.0, "eng", "", "", 0, None, [])]
    a, b, c = ed.with_identity(spark.createDataFrame(rows, spec)).collect()
    assert a.genres == ["Science Fiction"] and a.language == "en" and [tuple(i) for i in a.identifiers] == [("amazon", "B1")]
    assert b.library_key == "calibre:7" and b.language == "" and a.content_hash != c.content_hash
    assert c.library_key == "dune\x1ffrank herbert\x1fen"


def test_resolution_settles_on_chains(spark):
    ids = [(1, 1, "isbn", "9780306406157"), (2, 1, "amazon", "B2"), (3, 1, "isbn", "9780306406157"), (3, 1, "amazon", "B2"), (4, 2, "amazon", "B2"), (5, 1, "isbn", "9780306406158"), (6, 1, "isbn", "9780306406158"), (7, 1, "doi", "d"), (8, 1, "doi", "d")]
    ids += [(100 + i, 1, "google", f"g{j}") for i in range(20) for j in (i, i + 1)]
    pairs = ed.strong_pairs(spark.createDataFrame(ids, "id long, lib long, type string, value string"), id_col="id", scope="lib")
    got = {r.id: r.book for r in ed.resolve(pairs).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4 and not {5, 6, 7, 8} & got.keys()
    assert {got[100 + i] for i in range(20)} == {100}


def test_resolution_settles_on_descending_chains(spark):
    """1, n, n - 1, ..., 2: the least label is next to the greatest, so that it would walk one step a round."""
    n = 300
    chain = [1, *range(n, 1, -1)]
    rows = [(r, 1, "google", f"g{j}") for i, r in enumerate(chain) for j in (i, i + 1)]
    pairs = ed.strong_pairs(spark.createDataFrame(rows, "id long, lib long, type string, value string"), id_col="id", scope="lib")
    got = {r.id: r.book for r in ed.resolve(pairs).collect()}
    assert got == dict.fromkeys(range(1, n + 1), 1)


def test_dimensions(spark):
    old = spark.createDataFrame([(4, "Ann", "ANN")], "id long, name string, name_fold string")
    names = spark.createDataFrame([("ann", "ANN", 1), ("Bob", "BOB", 3), ("BOB", "BOB", 2), ("Cy", "CY", 1)], "name string, name_fold string, arrival long")
    out = ed.upserted(old, names)
    assert sorted(map(tuple, out.collect())) == [(4, "Ann", "ANN"), (5, "Cy", "CY"), (6, "BOB", "BOB")]
    links = ed.linked(spark.createDataFrame([(1, "BOB"), (1, "BOB"), (2, "CY")], "book_id long, name_fold string"), out, "author")
    assert sorted(map(tuple, links.collect())) == [(1, 6), (2, 5)]


def test_covers(spark):
    rows = spark.createDataFrame([(1, 1, 2, 0), (1, 2, 1, 0), (1, 3, 4, 0), (2, 1, 3, 4)], "book_id long, arrival long, prio int, stored_prio int")
    assert sorted((r.book_id, r.prio) for r in ed.chosen_covers(rows).collect()) == [(1, 2), (1, 4)]


def test_checkpoint():
    assert rc.must_run(None, "1:2") and rc.must_run("1:2", "1:3") and rc.must_run("1:2", "1:2", force=True)
    assert not rc.must_run("1:2", rc.checkpoint(1, 2))


def test_diff_and_prune(spark):
    spec = "path string, file_size long, mtime long"
    known = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], spec)
    found = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("d", 1, 1)], spec)
    diff = rc.file_diff(known, found, key=["path"])
    assert {tuple(r) for r in diff.collect()} == {("a", "same"), ("b", "changed"), ("c", "gone"), ("d", "new")}
    assert rc.counters(diff).first().asDict() == {"added": 1, "removed": 1, "changed": 1, "kept": 1}
    assert [r.path for r in rc.pruned(known, found.filter("path <> 'b'"), key=["path"]).collect()] == ["a"]


def test_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(rc.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(rc.insert_absent(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(rc.updated(old, new, "k", ["v"])) == [(1, "a"), (2, "B")]
    assert rows(rc.deleted(old, new, "k")) == [(1, "a")]


def test_snapshots(spark, tmp_path):
    store = rc.Store(spark, str(tmp_path))
    assert store.version() == 0 and store.read()["books"].count() == 0
    library = spark.createDataFrame([(i, f"l{i}", "folder", f"/{i}", 3600, "active", None, None, None, None, 0) for i in (1, 2)], TABLES["libraries"])
    books = spark.createDataFrame([(i, i % 2 + 1, str(i), f"t{i}", 9, None, "en", None, 0, 0, None, None, None, None, "h", None, 0, 0, 0, 0, 0) for i in range(4)], TABLES["books"])
    files = spark.createDataFrame([(i, i, "epub", 1, f"/{i}", None, 0) for i in range(6)], TABLES["book_files"])
    assert store.commit(rc.cascaded({"libraries": library, "books": books, "book_files": files, "series": spark.createDataFrame([], TABLES["series"])})) == 1
    first = store.read()
    assert first["book_files"].count() == 4 and first["books"].filter("series_id is not null").count() == 0
    assert store.commit(rc.purged(first, F.col("id") == 2)) == 2
    assert (store.read()["books"].count(), store.read()["book_files"].count(), store.read()["libraries"].count()) == (2, 2, 1)
    assert first["books"].count() == 4  # the old version is still there


@pytest.mark.parametrize(("fmt", "prio"), [("EPUB", 4), ("fb2", 3), ("azw3", 2), ("pdf", 1), ("txt", 0)])
def test_format_priority(spark, fmt, prio):
    assert spark.range(1).select(ed.format_priority(F.lit(fmt))).first()[0] == prio


def test_resolution_of_a_long_chain(spark):
    """A chain of 10,000 records in no order settles on its least, in few rounds."""
    import random

    n = 10_000
    order = list(range(n))
    random.Random(7).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)]
    found = ed.resolve(spark.createDataFrame([*links, (n + 5, n + 5)], "id long, other long"))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(n)} | {(n + 5, n + 5)}


def test_run_of_a_library(spark):
    """New, changed, gone, moved and unchanged files, and the books that a run leaves empty."""
    known = spark.createDataFrame([("a", 1, 10, 1), ("b", 1, 10, 1), ("c", 2, 10, 1), ("d", 3, 10, 1)], "source_path string, book_id long, file_size long, mtime long")
    found = spark.createDataFrame([("a", 10, 1), ("b", 11, 1), ("d", 12, 1), ("e", 5, 1)], "source_path string, file_size long, mtime long")
    grouped = spark.createDataFrame([("b", 1), ("d", 9), ("e", 9)], "source_path string, book_id long")
    run = rc.run(known, found, grouped)
    assert sorted(r.source_path for r in run.parse.collect()) == ["b", "d", "e"]
    assert sorted(map(tuple, run.files.collect())) == [("a", 1), ("b", 1), ("d", 9), ("e", 9)]
    assert sorted(r.book_id for r in run.emptied.collect()) == [2, 3] and tuple(run.counts.first()) == (1, 1, 2, 1)
    assert sorted(map(tuple, rc.run(known, found).files.select("source_path", "book_id").collect())) == [("a", 1), ("b", 1), ("d", 3)]


def test_book_that_only_a_moved_file_keeps(spark):
    """A known book whose own files are gone isn't empty if the run files a moved one there; the book that file leaves is."""
    known = spark.createDataFrame([("a", 1, 10, 1), ("b", 2, 10, 1)], "source_path string, book_id long, file_size long, mtime long")
    found = spark.createDataFrame([("a", 11, 1)], "source_path string, file_size long, mtime long")
    run = rc.run(known, found, spark.createDataFrame([("a", 2)], "source_path string, book_id long"))
    assert [tuple(r) for r in run.files.collect()] == [("a", 2)] and [r.book_id for r in run.emptied.collect()] == [1]
