"""Books as they are shown: nested views, feed entries, and covers ranked for a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import web
from .browse import Catalog

#: Providers of covers, the best first.
PROVIDERS = {"openlibrary": 4, "googlebooks": 3, "goodreads": 2, "amazon": 1}


def _lists(catalog: Catalog, page: DataFrame) -> list[DataFrame]:
    """For a page's books: authors, tags, formats with the first page count, identifiers; each as one array in its order."""
    ids = page.select(F.col("id").alias("book_id"))
    near = lambda t: catalog[t].join(ids, "book_id", "left_semi")
    authors = near("book_authors").join(catalog["authors"].select(F.col("id").alias("author_id"), "name", "name_fold"), "author_id")
    authors = authors.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("name_fold", F.col("author_id").alias("id"), "name"))).alias("a"))
    authors = authors.select("book_id", F.transform("a", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("authors"))
    tags = near("book_genres").join(catalog["genres"].select(F.col("id").alias("genre_id"), "name", "name_fold"), "genre_id")
    tags = tags.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("name_fold", "name"))).alias("g"))
    tags = tags.select("book_id", F.transform("g", lambda x: x["name"]).alias("tags"))
    files = near("book_files").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("file_format", "id", "file_size", "pages"))).alias("f"))
    files = files.select(
        "book_id",
        F.transform("f", lambda x: F.struct(x["file_format"].alias("type"), x["file_size"].alias("size_bytes"), F.concat(F.lit("/api/books/"), F.col("book_id").cast("string"), F.lit("/files/"), x["id"].cast("string")).alias("download_url"))).alias("formats"),
        F.get(F.filter(F.transform("f", lambda x: x["pages"]), lambda p: p.isNotNull()), F.lit(0)).alias("pages"),
    )
    idents = near("book_identifiers").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("type", "value"))).alias("i"))
    idents = idents.select("book_id", F.transform("i", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), web.identifier_url(x["type"], x["value"]).alias("url"))).alias("identifiers"))
    return [authors, tags, files, idents]


def book_views(catalog: Catalog, page: DataFrame) -> DataFrame:
    """A page of books as nested rows; the page is small, so its ids reach each relation first."""
    out = page.join(catalog["series"].select(F.col("id").alias("series_id"), F.col("name").alias("series")), "series_id", "left")
    for part in _lists(catalog, page):
        out = out.join(part, out.id == part.book_id, "left").drop("book_id")
    empty = {"authors": "array<struct<id:bigint,name:string>>", "tags": "array<string>", "formats": "array<struct<type:string,size_bytes:bigint,download_url:string>>", "identifiers": "array<struct<type:string,value:string,url:string>>"}
    for column, kind in empty.items():
        out = out.withColumn(column, F.coalesce(F.col(column).cast(kind), F.array().cast(kind)))
    return out.select("id", "title", "authors", "series", F.col("series_number").alias("series_index"), "tags", "publisher", "year", "pages", "rating", "language", "annotation", "formats", "identifiers")


def feed_entries(views: DataFrame) -> DataFrame:
    """Entries of an acquisition feed: title, author line, updated, and a link with its type for each file."""
    return views.select(
        F.concat(F.lit("urn:book:"), F.col("id").cast("string")).alias("entry_id"),
        "title",
        F.array_join(F.transform("authors", lambda a: a["name"]), ", ").alias("author_line"),
        F.transform("formats", lambda f: F.struct(f["download_url"].alias("href"), web.mime(f["type"]).alias("type"))).alias("links"),
    )


def navigation(index: DataFrame, base: str) -> DataFrame:
    """Entries of a navigation feed from an index of names and counts."""
    return index.select(F.concat(F.lit(base), F.col("id").cast("string")).alias("href"), "name", web.plural(F.col("book_count"), "book").alias("content"))


def atom(rows: list, title: str, self_url: str, next_url: str | None = None) -> bytes:
    """Atom XML of one page of feed entries (collected rows of feed_entries)."""
    import xml.etree.ElementTree as ET

    feed = ET.Element("feed", xmlns="http://www.w3.org/2005/Atom")
    ET.SubElement(feed, "title").text = title
    ET.SubElement(feed, "link", rel="self", href=self_url)
    if next_url:
        ET.SubElement(feed, "link", rel="next", href=next_url)
    for r in rows:
        entry = ET.SubElement(feed, "entry")
        ET.SubElement(entry, "id").text = r["entry_id"]
        ET.SubElement(entry, "title").text = r["title"]
        if r["author_line"]:
            ET.SubElement(ET.SubElement(entry, "author"), "name").text = r["author_line"]
        for link in r["links"]:
            ET.SubElement(entry, "link", rel="http://opds-spec.org/acquisition", href=link["href"], type=link["type"])
    return ET.tostring(feed, encoding="utf-8", xml_declaration=True)


def rank_covers(candidates: DataFrame, query_tokens: Column | None = None) -> DataFrame:
    """Candidates (source, title, full_url, width, height) with ``rank``: acceptable titles, one for each address, the best first.

    Better is a better provider, then a larger area, then the smaller address.  With a column ``request`` each request is ranked
    by itself.
    """
    from pyspark.sql import Window

    priority = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in PROVIDERS.items() for x in pair)), F.col("source")), F.lit(0))
    rows = candidates if query_tokens is None else candidates.filter(tx.title_acceptable(query_tokens, F.coalesce("title", F.lit(""))))
    rows = rows.withColumns({"priority": priority, "area": F.col("width").cast("long") * F.col("height")})
    keys = [c for c in ("request",) if c in candidates.columns]
    best = Window.partitionBy(*keys, "full_url").orderBy(F.desc("priority"), F.desc("area"), *sorted(c for c in candidates.columns if c not in (*keys, "full_url")))
    rows = rows.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")
    place = Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.desc("priority"), F.desc("area"), "full_url")
    return rows.withColumn("rank", F.row_number().over(place).cast("long"))
