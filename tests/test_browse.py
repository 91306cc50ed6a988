from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bibspark.operators import browse, search, views
from bibspark.operators.browse import BookFilter, Facet


@pytest.fixture(scope="module")
def catalog(spark):
    def t(rows, spec):
        return spark.createDataFrame(rows, spec)

    books = t(
        [(1, 1, "Dune", 1, 1.0, "en", "Ace", "ACE", 1965, 5, 100, 300), (2, 1, "Dune Messiah", 1, 2.0, "en", None, None, None, None, 200, 200), (3, 2, "Анна", None, None, "ru", "Эксмо", "ЭКСМО", 1877, 3, 300, 100), (4, 2, "1984", None, None, "en", "  ", None, 1949, 5, 400, 100)],
        "id long, library_id long, title string, series_id long, series_number double, language string, publisher string, publisher_fold string, year int, rating int, added_at long, imported_at long",
    ).withColumn("annotation", F.lit(None).cast("string"))
    out = {
        "books": books,
        "libraries": t([(1, "a"), (2, "b"), (3, "c")], "id long, name string"),
        "series": t([(1, "Dune Saga", "DUNE SAGA")], "id long, name string, name_fold string"),
        "authors": t([(1, "Frank Herbert", "FRANK HERBERT"), (2, "Лев Толстой", "ЛЕВ ТОЛСТОЙ"), (3, "=", "="), (4, "Nobody", "NOBODY")], "id long, name string, name_fold string"),
        "genres": t([(1, "Science Fiction", "SCIENCE FICTION")], "id long, name string, name_fold string"),
        "book_authors": t([(1, 1), (2, 1), (3, 2), (4, 3)], "book_id long, author_id long"),
        "book_genres": t([(1, 1)], "book_id long, genre_id long"),
        "book_files": t([(1, 1, "fb2", 10, "a", None), (2, 1, "epub", 20, "b", 99), (3, 1, "epub", 30, "c", 7), (4, 3, "pdf", 5, "d", None)], "id long, book_id long, file_format string, file_size long, source_path string, pages int"),
        "book_identifiers": t([(1, "isbn", "9780306406157"), (1, "doi", "x"), (2, "isbn", "9780306406157")], "book_id long, type string, value string"),
    }
    texts = books.select("id", "title", F.when(F.col("id") < 3, "Frank Herbert").otherwise("").alias("authors"), F.lit("").alias("series"), F.lit("").alias("annotation"))
    return out | {"terms": search.term_table(texts)}


def ids(df):
    return [r.id for r in df.collect()]


def test_sorts(catalog):
    assert ids(browse.listing(catalog, BookFilter())) == [1, 2, 4, 3]
    assert ids(browse.listing(catalog, BookFilter(sort="source"))) == [4, 3, 2, 1]
    assert ids(browse.listing(catalog, BookFilter(sort="rating"))) == [4, 1, 3, 2]
    assert ids(browse.listing(catalog, BookFilter(sort="nonsense", limit=2, offset=1))) == [2, 4]


def test_facets(catalog):
    assert ids(browse.listing(catalog, BookFilter(format="epub"))) == [1]
    assert ids(browse.listing(catalog, BookFilter(author=Facet("Frank Herbert", True)))) == [1, 2]
    assert ids(browse.listing(catalog, BookFilter(author=Facet("Frank", True)))) == []
    assert sorted(ids(browse.listing(catalog, BookFilter(author=Facet("herbert"))))) == [1, 2]
    assert ids(browse.listing(catalog, BookFilter(series=Facet("Dune Saga", True), title=Facet("Dune", True)))) == [1]
    assert ids(browse.listing(catalog, BookFilter(genre="Science Fiction"))) == [1]
    assert ids(browse.listing(catalog, BookFilter(language="ru", library_id=2, publisher="Эксмо"))) == [3]
    assert ids(browse.listing(catalog, BookFilter(query='messiah "', title=Facet("dune")))) == []
    assert ids(browse.listing(catalog, BookFilter(query="messiah", title=Facet("dune"), sort="rating"))) == [2]
    assert browse.listing_count(catalog, BookFilter(author=Facet("Frank Herbert", True), limit=1)).first()[0] == 2


def test_facet_parse():
    assert Facet.parse("=") == Facet("", True)
    assert Facet.parse("= x ") == Facet("x", True)
    assert Facet.parse("  ") is None
    assert Facet.parse(" a b ") == Facet("a b")


def test_exact_empty_author_has_no_books(catalog):
    assert ids(browse.listing(catalog, BookFilter(author=Facet.parse("=")))) == []


def test_pages():
    assert browse.page(None, None) == (24, 0)
    assert browse.page(3, 1000) == (100, 200)
    assert browse.page(-1, -5) == (24, 0)
    assert browse.has_next(24, 24) and not browse.has_next(23, 24)


def test_indexes_and_letters(catalog):
    assert {(r.name, r.book_count) for r in browse.index(catalog, "author").collect()} == {("Frank Herbert", 2), ("Лев Толстой", 1), ("=", 1)}
    assert [r.name for r in browse.by_letter(catalog, "author", "Л").collect()] == ["Лев Толстой"]
    assert [r.name for r in browse.by_letter(catalog, "author", "#").collect()] == ["="]
    assert browse.by_letter(catalog, "author", "??").count() == 0
    assert [r.name for r in browse.by_letter(catalog, "author", "F", 2).collect()] == []
    assert [r.letter for r in browse.entity_letters(catalog, "author").orderBy("place").collect()] == ["Л", "F", "#"]
    assert {(r.publisher, r.book_count) for r in browse.publishers(catalog).collect()} == {("Ace", 1), ("Эксмо", 1)}


def test_statistics(catalog):
    assert browse.totals(catalog).first().asDict() == {"books": 4, "series": 1, "total_size": 65, "authors": 3, "genres": 1}
    assert {(r.file_format, r.book_count) for r in browse.books_by_format(catalog).collect()} == {("epub", 1), ("fb2", 1), ("pdf", 1)}
    assert {(r.id, r.book_count) for r in browse.libraries_with_count(catalog).collect()} == {(1, 2), (2, 2), (3, 0)}
    assert sorted(ids(browse.empty_books(catalog))) == [2, 4]
    assert ids(browse.by_identifier(catalog, 1, "isbn", "9780306406157")) == [1]


def test_views(catalog):
    rows = {r.id: r for r in views.book_views(catalog, catalog["books"]).collect()}
    one = rows[1].asDict(recursive=True)
    assert one["authors"] == [{"id": 1, "name": "Frank Herbert"}] and one["tags"] == ["Science Fiction"] and one["series"] == "Dune Saga" and one["pages"] == 99
    assert [f["type"] for f in one["formats"]] == ["epub", "epub", "fb2"]
    assert one["identifiers"] == [{"type": "doi", "value": "x", "url": None}, {"type": "isbn", "value": "9780306406157", "url": "https://isbnsearch.org/isbn/9780306406157"}]
    assert rows[4].formats == [] and rows[4].identifiers == [] and rows[4].series is None


def test_feed(catalog):
    entries = views.feed_entries(views.book_views(catalog, catalog["books"])).orderBy("entry_id").collect()
    xml = views.atom(entries, "All & more", "/opds", "/opds?page=2").decode()
    assert "All &amp; more" in xml and 'type="application/epub+zip"' in xml and 'rel="next"' in xml


def test_cover_rank(spark):
    rows = [("amazon", "Dune", "u1", 10, 10), ("goodreads", "Dune", "u1", 1, 1), ("openlibrary", None, "u2", 0, 0), ("amazon", "Dune Box Set", "u3", 99, 99), ("elsewhere", "Dune", "u0", 5, 5), ("amazon", "Dune", "u9", 10, 10), ("amazon", "Dune", "u8", 10, 10)]
    c = spark.createDataFrame(rows, "source string, title string, full_url string, width int, height int")
    ranked = views.rank_covers(c, F.array(F.lit("dune"))).orderBy("rank").collect()
    assert [(r.full_url, r.source) for r in ranked] == [("u2", "openlibrary"), ("u1", "goodreads"), ("u8", "amazon"), ("u9", "amazon"), ("u0", "elsewhere")]


def test_libraries(spark):
    rows = spark.createDataFrame([(1, "active", None), (2, "pending_purge", 5), (3, "pending_purge", 50), (4, "pending_purge", None)], "id long, status string, purge_at long")
    assert ids(browse.expired(rows, 10)) == [2]
    shown = browse.live_status(rows, F.col("id") == 1, F.col("id") <= 2).orderBy("id").collect()
    assert [r.live_status for r in shown] == ["syncing", "queued", "pending_purge", "pending_purge"]
