"""Browsing a catalogue: filtered listings, letters, indexes, facets and statistics.

A catalogue is a dict of DataFrames with the columns of bibspark.schema.  Every function returns a lazy DataFrame; optional
scopes add a filter only when they are set, so Catalyst sees the plainest plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import UNDEFINED_LANGUAGE
from . import search

Catalog = dict[str, DataFrame]

#: Page sizes and the largest page number.
PAGE_SIZE, PAGE_MOST, FEED_PAGE, PAGE_LAST = 24, 100, 50, 1_000_000_000


@dataclass(frozen=True)
class Facet:
    """A facet's value: exact, or words to be found in the text."""

    value: str
    exact: bool = False

    @classmethod
    def parse(cls, raw: str) -> Facet | None:
        """'=x' is exact x, even if x is empty; other text is trimmed, and blank text is no facet."""
        text = raw.strip(tx.WHITE)
        if text.startswith("="):
            return cls(text[1:].strip(tx.WHITE), True)
        return cls(text) if text else None


def facet(raw: Column) -> Column:
    """Facet.parse() over a column: struct<value, exact>, null where there is no facet."""
    text = tx.trimmed(raw)
    exact = text.startswith("=")
    value = F.when(exact, tx.trimmed(F.substr(text, F.lit(2)))).otherwise(text)
    return F.when(exact | (text != ""), F.struct(value.alias("value"), exact.alias("exact")))


@dataclass(frozen=True)
class BookFilter:
    """What a listing asks for; None constrains nothing, and all that is set must hold."""

    query: str | None = None
    title: Facet | None = None
    author: Facet | None = None
    series: Facet | None = None
    genre: str | None = None
    format: str | None = None
    library_id: int | None = None
    language: str | None = None
    publisher: str | None = None
    sort: str | None = None
    limit: int = PAGE_SIZE
    offset: int = 0

    def match(self) -> list[search.Clause]:
        """The clauses of the full-text query."""
        out = search.clauses(self.query or "")
        for column, facet in (("title", self.title), ("authors", self.author), ("series", self.series)):
            if facet is not None and not facet.exact:
                out += search.clauses(facet.value, column)
        return out


def page(number: int | None, size: int | None, default: int = PAGE_SIZE) -> tuple[int, int]:
    """(limit, offset) of a page, within bounds."""
    limit = min(size, PAGE_MOST) if size and size > 0 else default
    return limit, (min(max(number or 1, 1), PAGE_LAST) - 1) * limit


def filtered(catalog: Catalog, want: BookFilter) -> DataFrame:
    """Books that a filter keeps, once each, with ``score`` if it has a full-text query."""
    books = catalog["books"]
    for column, value in (("library_id", want.library_id), ("language", want.language), ("publisher", want.publisher)):
        if value is not None:
            books = books.filter(F.col(column) == value)
    if want.title is not None and want.title.exact:
        books = books.filter(F.col("title") == want.title.value)
    if want.series is not None and want.series.exact:
        named = catalog["series"].filter(F.col("name") == want.series.value)
        books = books.join(named.select(F.col("id").alias("series_id")), "series_id", "left_semi")
    if want.author is not None and want.author.exact:
        books = _with_entity(books, catalog, "author", want.author.value)
    if want.genre is not None:
        books = _with_entity(books, catalog, "genre", want.genre)
    if want.format is not None:
        files = catalog["book_files"].filter(F.col("file_format") == want.format)
        books = books.join(files.select(F.col("book_id").alias("id")), "id", "left_semi")
    if match := want.match():
        scores = search.bm25(catalog["terms"], match, sizes=catalog.get("sizes")).withColumnRenamed("doc_id", "id")
        books = books.join(scores, "id")
    return books


def _with_entity(books: DataFrame, catalog: Catalog, kind: str, name: str) -> DataFrame:
    named = catalog[f"{kind}s"].filter(F.col("name") == name).select(F.col("id").alias(f"{kind}_id"))
    linked = catalog[f"book_{kind}s"].join(named, f"{kind}_id", "left_semi")
    return books.join(linked.select(F.col("book_id").alias("id")), "id", "left_semi")


def order(want: BookFilter) -> list[Column]:
    """A total order: by relevance for a full-text query, else by the sort asked for, else the latest import first."""
    if want.match():
        return [F.col("score").asc(), F.col("id").asc()]
    if want.sort == "rating":
        return [F.col("rating").desc_nulls_last(), F.col("added_at").desc(), F.col("id").desc()]
    if want.sort == "source":
        return [F.col("added_at").desc(), F.col("id").desc()]
    return [F.col("imported_at").desc(), F.col("added_at").desc(), F.col("id").desc()]


def listing(catalog: Catalog, want: BookFilter) -> DataFrame:
    """One page of a filtered listing; without an offset Spark keeps only the page's rows of each task."""
    rows = filtered(catalog, want).orderBy(*order(want))
    return (rows.offset(want.offset) if want.offset else rows).limit(want.limit)


def listing_count(catalog: Catalog, want: BookFilter) -> DataFrame:
    return filtered(catalog, want).agg(F.count("*").alias("books"))


def has_next(rows: int, limit: int) -> bool:
    """A full page may have another behind it."""
    return rows == limit


# ---- entities --------------------------------------------------------------------------------------------------------


def _scoped(books: DataFrame, library_id: int | None) -> DataFrame:
    return books if library_id is None else books.filter(F.col("library_id") == library_id)


def links(catalog: Catalog, kind: str, library_id: int | None = None) -> DataFrame:
    """(entity_id, book_id) of authors, genres or series, in a library if one is given."""
    if kind == "series":
        return _scoped(catalog["books"], library_id).filter("series_id is not null").select(F.col("series_id").alias("entity_id"), F.col("id").alias("book_id"))
    bridge = catalog[f"book_{kind}s"].select(F.col(f"{kind}_id").alias("entity_id"), "book_id")
    return bridge if library_id is None else bridge.join(_scoped(catalog["books"], library_id).select(F.col("id").alias("book_id")), "book_id", "left_semi")


def entities(catalog: Catalog, kind: str) -> DataFrame:
    return catalog["series" if kind == "series" else f"{kind}s"]


def index(catalog: Catalog, kind: str, library_id: int | None = None, where: Column | None = None) -> DataFrame:
    """(id, name, name_fold, book_count) of the entities with books, counted before they are joined to their names."""
    named = entities(catalog, kind)
    named = named if where is None else named.filter(where)
    counts = links(catalog, kind, library_id).groupBy("entity_id").agg(F.count("*").alias("book_count"))
    return named.join(counts, named.id == counts.entity_id).select("id", "name", "name_fold", "book_count")


def by_letter(catalog: Catalog, kind: str, letter: str, library_id: int | None = None) -> DataFrame:
    """The index under one letter; '#' is every name outside the alphabet; an unknown letter has no rows."""
    fold = F.col("name_fold")
    if letter == tx.OTHER:
        return index(catalog, kind, library_id, tx.in_no_letter(fold))
    known = tx.letter_bounds(letter) is not None
    return index(catalog, kind, library_id, tx.in_letter(fold, letter) if known else F.lit(False))


def letters(folds: DataFrame, column: str) -> DataFrame:
    """(letter, place): the buckets in use, by their place in the alphabet."""
    spark = folds.sparkSession
    used = folds.select(tx.bucket(F.col(column)).alias("letter")).distinct()
    alphabet = spark.createDataFrame([(c, i) for i, c in enumerate(tx.ALPHABET)], "letter string, place int")
    return used.join(F.broadcast(alphabet), "letter")


def entity_letters(catalog: Catalog, kind: str, library_id: int | None = None) -> DataFrame:
    linked = links(catalog, kind, library_id).select(F.col("entity_id").alias("id"))
    return letters(entities(catalog, kind).join(linked, "id", "left_semi"), "name_fold")


def publishers(catalog: Catalog, letter: str | None = None, library_id: int | None = None) -> DataFrame:
    """(publisher, publisher_fold, book_count) of books with a publisher."""
    fold = F.col("publisher_fold")
    books = _scoped(catalog["books"], library_id).filter(fold.isNotNull() & (fold != ""))
    if letter == tx.OTHER:
        books = books.filter(tx.in_no_letter(fold))
    elif letter is not None:
        books = books.filter(tx.in_letter(fold, letter) if tx.letter_bounds(letter) else F.lit(False))
    return books.groupBy("publisher", "publisher_fold").agg(F.count("*").alias("book_count"))


# ---- facets and statistics -------------------------------------------------------------------------------------------


def formats(catalog: Catalog, library_id: int | None = None) -> DataFrame:
    files = catalog["book_files"]
    if library_id is not None:
        files = files.join(_scoped(catalog["books"], library_id).select(F.col("id").alias("book_id")), "book_id", "left_semi")
    return files.select("file_format").distinct()


def languages(catalog: Catalog, library_id: int | None = None) -> DataFrame:
    return _scoped(catalog["books"], library_id).select("language").distinct()


def totals(catalog: Catalog) -> DataFrame:
    """One row: books, files' bytes, authors, series and genres in use.  Five one-row aggregates side by side."""
    books = catalog["books"].agg(F.count("*").alias("books"), F.count_distinct("series_id").alias("series"))
    size = catalog["book_files"].agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("total_size"))
    authors = catalog["book_authors"].agg(F.count_distinct("author_id").alias("authors"))
    genres = catalog["book_genres"].agg(F.count_distinct("genre_id").alias("genres"))
    return books.join(size, F.lit(True)).join(authors, F.lit(True)).join(genres, F.lit(True))


def books_by_format(catalog: Catalog) -> DataFrame:
    return catalog["book_files"].groupBy("file_format").agg(F.count_distinct("book_id").alias("book_count"))


def books_by_language(catalog: Catalog) -> DataFrame:
    return catalog["books"].groupBy("language").agg(F.count("*").alias("book_count"))


def shown_languages(counts: DataFrame, undefined: str = UNDEFINED_LANGUAGE) -> DataFrame:
    """books_by_language() with ``place``, the order of display: the unknown language first, others by their code."""
    order = Window.orderBy((F.col("language") != undefined).cast("int"), "language")  # a row a language
    return counts.withColumn("place", F.row_number().over(order))


def shown_formats(counts: DataFrame) -> DataFrame:
    """books_by_format() with ``place``, the order of display: the commonest first, equals by name."""
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("book_count"), "file_format")))  # a row a format


def other_groups(folds: DataFrame, column: str) -> DataFrame:
    """(first, names): how many names stand under each first character outside the alphabet, the groups below '#'."""
    outside = folds.filter(tx.bucket(F.col(column)) == tx.OTHER)
    return outside.groupBy(F.substring(column, 1, 1).alias("first")).agg(F.count("*").alias("names"))


def libraries_in_order(libraries: DataFrame) -> DataFrame:
    """libraries with ``place``: the oldest first, equals by id; a catalogue has a handful."""
    return libraries.withColumn("place", F.row_number().over(Window.orderBy("created_at", "id")))


def libraries_with_count(catalog: Catalog) -> DataFrame:
    """Every library with its number of books, 0 included."""
    counts = catalog["books"].groupBy("library_id").agg(F.count("*").alias("book_count"))
    libraries = catalog["libraries"]
    return libraries.join(counts, libraries.id == counts.library_id, "left").select(*libraries.columns, F.coalesce("book_count", F.lit(0)).alias("book_count"))


def empty_books(catalog: Catalog, library_id: int | None = None) -> DataFrame:
    """Books without files."""
    return _scoped(catalog["books"], library_id).join(catalog["book_files"].select(F.col("book_id").alias("id")), "id", "left_anti")


def by_identifier(catalog: Catalog, library_id: int, type_: str, value: str) -> DataFrame:
    """The book of a library with this identifier, the least id if there are several."""
    found = catalog["book_identifiers"].filter((F.col("type") == type_) & (F.col("value") == value)).select(F.col("book_id").alias("id"))
    return _scoped(catalog["books"], library_id).join(found, "id", "left_semi").orderBy("id").limit(1)


def expired(libraries: DataFrame, now: int) -> DataFrame:
    """Libraries whose purge is due."""
    return libraries.filter((F.col("status") == "pending_purge") & F.col("purge_at").isNotNull() & (F.col("purge_at") <= now))


def live_status(libraries: DataFrame, running: Column, queued: Column) -> DataFrame:
    """libraries with the status shown: syncing before queued before the stored one."""
    return libraries.withColumn("live_status", F.when(running, "syncing").when(queued, "queued").otherwise(F.col("status")))
