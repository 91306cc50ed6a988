"""More queries beside their DuckDB SQL: sources, runs, scalar functions and the order of display."""

from __future__ import annotations

import io
import os
import sqlite3
import struct
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .functions import identity as idt
from .functions import text as tx
from .functions import web
from .operators import browse
from .operators.browse import BookFilter, Facet
from .operators.driver_views import catalog, index, seconds, table
from .plans import editions as ed
from .plans import enrich as en
from .plans import reconcile as rc
from .queries import _SCORE, BOOK, QUERIES, TERMS, VIEWS, _hits, query  # noqa: F401
from .sources import calibre, ebooks, inpx, online
from .streaming import events as ev

_BOOK = ", ".join(BOOK)


# ---- full text with facets, pages, display -----------------------------------------------------------------------------


@query(
    f""", {_hits('x', "term = 'license'")}, {_hits('y', "term = 'en' AND col = 'title'")}, {VIEWS}
SELECT {', '.join('books.' + c for c in BOOK)}, round({_SCORE.format(k="(SELECT count(*) FROM x)", f="x.f")} + {_SCORE.format(k="(SELECT count(*) FROM y)", f="y.f")}, 9) AS score
FROM x JOIN y USING (doc_id) JOIN sizes USING (doc_id) JOIN books ON books.id = doc_id, whole WHERE language = 'O' ORDER BY score, books.id LIMIT 24""",
    prelude=TERMS,
)
def listing_search(spark, sf_dir):
    """Words and a word of the title beside a facet; relevance overrides the sort that is asked for."""
    i = index(spark, sf_dir)
    c = dict(catalog(spark, sf_dir)) | {"terms": i.terms, "sizes": i.sizes}
    found = browse.listing(c, BookFilter(query="license", title=Facet("en"), language="O", sort="rating"))
    return found.select(*BOOK, F.round("score", 9).alias("score"))


@query(" SELECT page, least(24, greatest(0, n - 24 * (page - 1)))::BIGINT AS shown, n - 24 * (page - 1) >= 24 AS more FROM (SELECT count(*) AS n FROM books WHERE publisher = 'BUILDING' AND language = 'P'), (SELECT unnest([1, 2, 3, 4, 1000]) AS page)", prelude=VIEWS)
def listing_pages(spark, sf_dir):
    """A full page has a next one."""
    out = None
    for number in (1, 2, 3, 4, 1000):
        limit, offset = browse.page(number, None)
        one = browse.listing(catalog(spark, sf_dir), BookFilter(publisher="BUILDING", language="P", limit=limit, offset=offset)).agg(F.count("*").alias("shown"))
        one = one.select(F.lit(number).alias("page"), "shown", browse.has_next(F.col("shown"), limit).alias("more"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN NULL ELSE p_name END AS value, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN NULL WHEN 2 THEN false ELSE true END AS exact FROM part")
def facet_values(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit(" ="), "p_name")).when(k == 1, F.lit(" \t ")).when(k == 2, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise(F.concat(F.lit("= "), "p_name", F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", browse.facet(raw).alias("f")).select("p_partkey", "f.value", "f.exact")


@query(" SELECT language, book_count, row_number() OVER (ORDER BY language <> 'O', language)::INTEGER AS place FROM (SELECT language, count(*) AS book_count FROM books GROUP BY 1)", prelude=VIEWS)
def languages_shown(spark, sf_dir):
    return browse.shown_languages(browse.books_by_language(catalog(spark, sf_dir)), "O")


@query(" SELECT file_format, book_count, row_number() OVER (ORDER BY book_count DESC, file_format)::INTEGER AS place FROM (SELECT file_format, count(DISTINCT book_id) AS book_count FROM book_files GROUP BY 1)", prelude=VIEWS)
def formats_shown(spark, sf_dir):
    return browse.shown_formats(browse.books_by_format(catalog(spark, sf_dir)))


@query("SELECT substr(p_partkey::VARCHAR, 1, 1) AS first, count(*) AS names FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
def other_letters(spark, sf_dir):
    numbered = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), "p_name")).otherwise(F.col("p_name"))
    return browse.other_groups(table(spark, sf_dir, "part").select(F.upper(numbered).alias("f")), "f")


@query("SELECT n_nationkey::BIGINT AS id, n_regionkey * 10 AS created_at, row_number() OVER (ORDER BY n_regionkey, n_nationkey)::INTEGER AS place FROM nation")
def libraries_in_order(spark, sf_dir):
    return browse.libraries_in_order(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") * 10).alias("created_at")))


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'E' || upper(p_name) || ' Е' END AS name_fold FROM part")
def fold_names(spark, sf_dir):
    spelled = F.when(F.col("p_partkey") % 5 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" é"), "p_name", F.lit(" ё ")))
    return table(spark, sf_dir, "part").select("p_partkey", tx.fold_or_null(spelled).alias("name_fold"))


@query("SELECT p_partkey, p_name || '|' || p_brand AS names FROM part")
def distinct_names(spark, sf_dir):
    names = F.array(F.concat(F.lit(" "), "p_name"), F.upper("p_name"), F.lit(" "), F.col("p_brand"), F.lower("p_brand"), F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", names.alias("names")).withColumn("folds", tx.fold_all(F.col("names")))
    return rows.select("p_partkey", F.array_join(idt.distinct_folds(F.col("names"), F.col("folds")), "|").alias("names"))


@query("SELECT p_partkey, p_name || ' ' || ' y ' AS title FROM part")
def qualifiers_stripped(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.strip_qualifiers(F.concat("p_name", F.lit(" (Study [x] Guide) y [z"))).alias("title"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' x y' ELSE p_name || ' a & b' END AS plain FROM part")
def markup_stripped(spark, sf_dir):
    formed = F.concat(F.lit("<p>"), "p_name", F.lit("</p><b>x</b>&nbsp;y"))
    broken = F.concat(F.lit("<p>"), "p_name", F.lit("<br>\n a &amp;  b"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.strip_markup(F.when(F.col("p_partkey") % 2 == 0, formed).otherwise(broken)).alias("plain"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'S - 2.5 - ' || p_name END AS title FROM part")
def series_prefixes(spark, sf_dir):
    title = F.concat(F.lit(" S - 2.5 - "), "p_name", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", tx.strip_series_prefix(title, F.when(F.col("p_partkey") % 2 == 0, "S").otherwise("T")).alias("title"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE p_size END::DOUBLE AS number FROM part")
def series_numbers(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit(" "), n, F.lit(".5 "))).when(k == 1, F.concat(n, F.lit("x"))).when(k == 2, "").otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", tx.series_index(text).alias("number"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN epoch(date_trunc('second', o_orderdate)) - 7200 WHEN 4 THEN 0 ELSE epoch(date_trunc('second', o_orderdate)) END::BIGINT AS added_at FROM orders")
def library_timestamps(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    shown = lambda pattern: F.date_format("o_orderdate", pattern)
    text = F.when(k == 0, F.concat(shown("yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))).when(k == 1, shown("yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.concat(shown("yyyy-MM-dd HH:mm:ss"), F.lit(".25Z")))
    text = text.when(k == 3, F.concat(shown("yyyy-MM-dd HH:mm:ss"), F.lit(".123456+02:00"))).otherwise(shown("yyyy/MM/dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.library_timestamp(text).alias("added_at"))


@query("SELECT p_partkey, ['application/epub+zip', 'application/x-fictionbook+xml', 'application/x-mobipocket-ebook', 'application/vnd.amazon.ebook', 'application/pdf', 'application/octet-stream'][p_partkey % 6 + 1] AS mime FROM part")
def mime_types(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("EPUB", "fb2", "mobi", "azw3", "Pdf", "txt"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", web.mime(kind).alias("mime"))


@query("""
SELECT p_partkey, p_partkey % 6 IN (1, 3) OR (p_partkey % 6 = 0 AND n % 10 = 0) AS strong FROM (
    SELECT p_partkey, list_sum(list_transform(range(1, 14), lambda k: substr('978' || lpad((p_partkey * 7919)::VARCHAR, 10, '0'), k, 1)::INTEGER * CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END)) AS n FROM part)""")
def strong_identifiers(spark, sf_dir):
    """ISBNs count if their sum is right; placeholders and types that aren't strong never do."""
    k = F.col("p_partkey") % 6
    type_ = F.when(k == 0, "isbn").when(k == 1, "amazon").when(k == 2, "google").when(k == 3, "goodreads").when(k == 4, "doi").otherwise("isbn")
    value = F.when(k == 0, F.format_string("978%010d", F.col("p_partkey") * 7919)).when(k == 2, "0000").when(k == 5, "9999999999999").otherwise(F.concat(F.lit("x"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", idt.is_strong(type_, value).alias("strong"))


@query("""
SELECT p_partkey, p_name AS title, 'Ann|Bob' AS authors, '<p>' || p_type || '</p>' AS annotation, p_brand AS publisher, 1990 + p_size AS year, 'Fantasy' AS genres, 'google=v' || p_partkey AS identifiers,
       'https://x.example/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '?zoom=1' ELSE '' END AS cover_url FROM part WHERE p_partkey % 3 <> 0""")
def volume_metadata(spark, sf_dir):
    """Answers of a book service as records; those without items, and broken ones, give none."""
    links = F.when(F.col("p_partkey") % 2 == 0, F.format_string('{"thumbnail": "t", "large": "http://x.example/%d?zoom=1&edge=curl"}', "p_partkey")).otherwise(F.format_string('{"small": "http://x.example/%d"}', "p_partkey"))
    text = F.format_string(
        '{"items": [{"id": "v%d", "volumeInfo": {"title": " %s ", "authors": ["Ann", "Bob"], "publisher": "%s", "publishedDate": "%d-05", "description": "<p>%s</p>", "categories": ["fantasy", "Nothing known"], "imageLinks": %s}}]}',
        "p_partkey", "p_name", "p_brand", F.col("p_size") + 1990, "p_type", links,
    )
    answers = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, '{"items": []}').when(F.col("p_partkey") % 3 == 0, "not json").otherwise(text).alias("json"))
    found = online.volumes(answers)
    pairs = F.array_join(F.transform("identifiers", lambda x: F.concat(x["type"], F.lit("="), x["value"])), "|")
    return found.select("p_partkey", "title", F.array_join("authors", "|").alias("authors"), "annotation", "publisher", "year", F.array_join("genres", "|").alias("genres"), pairs.alias("identifiers"), "cover_url")


# ---- sources ---------------------------------------------------------------------------------------------------------

_INP = r"""
l AS (SELECT o_orderkey AS k, 'a' || (o_orderkey % 10) || '.zip' AS archive, o_orderkey % 7 = 0 AS deleted, o_orderkey % 11 = 0 AS short, o_orderdate AS d, o_orderstatus AS s FROM orders)
SELECT k, CASE WHEN k % 4 = 0 THEN k::VARCHAR ELSE 'Title ' || k END AS title, 'First Last' || (k % 50) || '|Solo' AS authors, 'sf|humor' AS genres, 'Cycle' AS series, CASE WHEN k % 3 <> 0 THEN (k % 3)::DOUBLE END AS series_number,
       CASE WHEN k % 2 = 0 THEN 'en' ELSE '' END AS language, epoch(date_trunc('day', d)::TIMESTAMP)::BIGINT AS added_at, CASE WHEN k % 5 = 0 THEN 0 ELSE k END AS file_size, archive || '/' || k || '.fb2' AS source_path, row_number() OVER (PARTITION BY archive ORDER BY k) AS arrival
FROM l WHERE NOT deleted AND NOT short"""


def _inp_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    fields = [
        F.concat(F.lit("Last"), (k % 50).cast("string"), F.lit(",First,:Solo,,:")), F.lit("sf: humor :"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("Title "), text)), F.lit("Cycle"), (k % 3).cast("string"), text,
        F.when(k % 5 == 0, "x").otherwise(text), F.lit("9"), F.when(k % 7 == 0, "1 ").otherwise("0"), F.lit(" FB2"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 2 == 0, "EN-us").otherwise("?"),
    ]
    line = F.when(k % 11 == 0, F.concat_ws("\x04", *fields[:9])).otherwise(F.concat(F.concat_ws("\x04", *fields), F.lit("\x04\r")))
    lines = table(spark, sf_dir, "orders").select(F.lit("b.inpx").alias("bundle"), F.concat(F.lit("a"), (k % 10).cast("string"), F.lit(".zip")).alias("archive"), k.alias("line_no"), line.alias("line"))
    return inpx.editions(lines, 1)


@query(f"WITH {_INP}")
def inp_editions(spark, sf_dir):
    """Lines of index files: names, numbers, dates and languages; deleted and short lines are left out."""
    found = _inp_editions(spark, sf_dir).withColumn("k", F.regexp_extract("entry", "[0-9]+", 0).cast("long"))
    return found.select("k", "title", F.array_join("authors", "|").alias("authors"), F.array_join("genres", "|").alias("genres"), "series", "series_number", "language", "added_at", "file_size", "source_path", "arrival")


@query("SELECT 'a' || (o_orderkey % 10) || '.zip' AS archive, o_orderkey || '.fb2' AS entry FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 10 <> 3 AND o_orderkey % 4 <> 1")
def inp_available(spark, sf_dir):
    """Records whose archive is missing or doesn't hold their entry go."""
    k = F.col("o_orderkey")
    entries = table(spark, sf_dir, "orders").filter((k % 10 != 3) & (k % 4 != 1)).select(F.concat(F.lit("a"), (k % 10).cast("string"), F.lit(".zip")).alias("archive"), F.concat(k.cast("string"), F.lit(".fb2")).alias("entry"))
    return rc.present(_inp_editions(spark, sf_dir), entries).select("archive", "entry")


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """The rows of nation, of which there are 25 at any size of the tables."""
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").limit(25).collect()


@query("SELECT 'books.zip/' || n_nationkey || '.fb2' AS source_path, n_name AS title, 'Ann Lee' AS authors FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey % 5 <> 0")
def inpx_bundle(spark, sf_dir):
    """A bundle and its archives as files: one archive is missing, one is broken, one lacks entries."""
    folder, nations = shared.scratch(spark, "inpx"), _nations(spark, sf_dir)
    line = lambda n: "\x04".join(("Lee,Ann,:", "sf:", n.n_name, "", "", str(n.n_nationkey), "1", "9", "1" if n.n_nationkey % 5 == 0 else "0", "fb2"))
    bundle, archive = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(bundle, "w") as z:
        for name in ("books", "missing", "broken"):
            z.writestr(f"{name}.inp", "\n".join(map(line, nations)))
        z.writestr("version.info", "1")
    with zipfile.ZipFile(archive, "w") as z:
        for n in nations:
            if n.n_nationkey % 4:
                z.writestr(f"{n.n_nationkey}.fb2", "x")
    for name, data in (("lib.inpx", bundle.getvalue()), ("books.zip", archive.getvalue()), ("broken.zip", b"x")):
        shared.put(spark, f"{folder}/{name}", data)
    return inpx.read(spark, f"{folder}/lib.inpx", folder, 1).select("source_path", "title", F.array_join("authors", "|").alias("authors"))


def _library(nations: list) -> bytes:
    """A library of these rows as a SQLite file."""
    kinds = {"long": "INTEGER", "double": "REAL", "string": "TEXT"}
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "metadata.db")
        db = sqlite3.connect(path)
        for name, spec in calibre.TABLES.items():
            db.execute(f"CREATE TABLE {name} ({', '.join(f'{c.split()[0]} {kinds[c.split()[1]]}' for c in spec.split(', '))})")
        db.execute("CREATE TABLE custom_column_7 (id INTEGER, book INTEGER, value INTEGER)")
        put = lambda name, *rows: db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        put("authors", (1, "Zed"), (2, "Ann"))
        put("languages", (1, "eng"), (2, "fre"))
        put("ratings", (1, 9), (2, 1))
        put("series", (1, "Saga"))
        put("custom_columns", (7, "pages", "Pages", "int"))
        for n in nations:
            k = n.n_nationkey
            put("books", (k, n.n_name, f"p{k}", k + 0.5, 0, "0101-01-01" if k % 5 == 0 else f"{1990 + k}-02-03", "2021-05-06 00:00:00+00:00" if k % 2 else None))
            put("books_authors_link", (2 * k, k, 1), (2 * k + 1, k, 2))
            put("books_languages_link", (2 * k, k, 1, k % 2), (2 * k + 1, k, 2, 1 - k % 2))
            put("books_ratings_link", (k, k, 1 + k % 2))
            put("custom_column_7", (k, k, 100 * (k % 3)))
            put("data", (2 * k, k, "EPUB", 10 + k, "f"), *([(2 * k + 1, k, "AZW3", None, "f")] if k % 3 == 0 else []))
            if k % 4 == 0:
                put("books_series_link", (k, k, 1))
                put("identifiers", (k, k, "isbn", "9780306406157"))
        db.commit()
        db.close()
        with open(path, "rb") as f:
            return f.read()


@query("""
SELECT 'calibre:' || n_nationkey AS library_key, n_name AS title, 'Zed|Ann' AS authors, CASE WHEN n_nationkey % 4 = 0 THEN 'Saga' END AS series, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey + 0.5 END::DOUBLE AS series_number,
       CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'fr' END AS language, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 1990 + n_nationkey END AS year, 100 * (n_nationkey % 3) AS pages, CASE WHEN n_nationkey % 2 = 0 THEN 4 END AS rating,
       CASE WHEN n_nationkey % 2 = 1 THEN 1620259200 ELSE 0 END::BIGINT AS added_at, 'p' || n_nationkey || '/f.' || f AS source_path, CASE WHEN f = 'epub' THEN 10 + n_nationkey ELSE 0 END::BIGINT AS file_size,
       CASE WHEN f = 'epub' AND n_nationkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS arrival
FROM nation, (SELECT unnest(['epub', 'azw3']) AS f) WHERE f = 'epub' OR n_nationkey % 3 = 0""")
def sqlite_editions(spark, sf_dir):
    """A SQLite library: books with their first language, named custom column, ratings, dates and files."""
    uri = f"{shared.scratch(spark, 'library')}/metadata.db"
    shared.put(spark, uri, _library(_nations(spark, sf_dir)))
    found = calibre.read(spark, uri, 9)
    return found.select("library_key", "title", F.array_join("authors", "|").alias("authors"), "series", "series_number", "language", "year", "pages", "rating", "added_at", "source_path", "file_size", "arrival")


def _epub(title: str, year: int, cover: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("c.jpg", b"x" * cover)
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>')
        z.writestr("c.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Saga - 2 - {title}</dc:title><dc:creator>Ann Lee</dc:creator><dc:language>en</dc:language><dc:date>{year}</dc:date><dc:description>About {title}</dc:description><meta name="calibre:series" content="Saga"/><meta name="calibre:series_index" content="2"/><meta name="cover" content="c"/></metadata><manifest><item id="c" href="c.jpg" media-type="image/jpeg"/></manifest></package>')
    return out.getvalue()


def _fb2(title: str, year: int) -> bytes:
    return f'<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><genre>sf</genre><author><first-name>Ann</first-name><last-name>Lee</last-name></author><book-title>{title}</book-title><annotation><p>About <emphasis>{title}</emphasis> &amp; <odd>more</odd></p><empty-line/></annotation><lang>ru</lang><sequence name="Saga" number="2"/></title-info><publish-info><year>{year}</year></publish-info></description></FictionBook>'.encode()


def _mobi(title: str, year: int) -> bytes:
    extra = [(100, b"Ann Lee"), (103, f"About {title}".encode()), (106, str(year).encode()), (503, title.encode()), (524, b"en")]
    body = b"".join(struct.pack(">II", k, len(v) + 8) + v for k, v in extra)
    head = bytearray(248)
    head[16:20] = b"MOBI"
    for at, number in ((20, 232), (28, 65001), (128, 0x40)):
        struct.pack_into(">I", head, at, number)
    record = bytes(head) + b"EXTH" + struct.pack(">II", 12 + len(body), len(extra)) + body
    struct_title = struct.pack(">II", len(record), len(title))
    record = record[:84] + struct_title + record[92:] + title.encode()
    return bytes(76) + struct.pack(">H", 1) + struct.pack(">II", 86, 0) + record


def _zipped(name: str, data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, data)
    return out.getvalue()


@query("""
SELECT n_nationkey AS k, ['epub', 'fb2', 'fb2', 'pdf', 'mobi'][n_nationkey % 7 + 1] AS file_format, n_name AS title, 'Ann Lee' AS authors, CASE WHEN n_nationkey % 7 < 3 THEN 'Saga' ELSE '' END AS series, 1990 + n_nationkey AS year,
       CASE n_nationkey % 7 WHEN 0 THEN 'About ' || n_name WHEN 3 THEN '' WHEN 4 THEN 'About ' || n_name ELSE '<p>About <em>' || n_name || '</em> &amp; more</p><br/>' END AS annotation, CASE WHEN n_nationkey % 7 = 0 AND n_nationkey % 2 = 1 THEN 5 END AS cover_bytes
FROM nation WHERE n_nationkey % 7 < 5""")
def ebook_folder(spark, sf_dir):
    """Files of all formats in nested folders; a broken one and one of another kind give no record, and too large a cover isn't read."""
    folder = shared.scratch(spark, "ebooks")
    for n in _nations(spark, sf_dir):
        k, title, year = n.n_nationkey, n.n_name, 1990 + n.n_nationkey
        pdf = f"%PDF-1.4\n1 0 obj<</Type /Page>>endobj 3 0 obj<</Title ({title}) /Author (Ann Lee) /CreationDate (D:{year}0601)>>endobj".encode()
        files = [(".epub", _epub(title, year, 5 if k % 2 else ebooks.COVER_MOST + 1)), (".FB2", _fb2(title, year)), (".fb2.zip", _zipped("b.fb2", _fb2(title, year))), (".pdf", pdf), (".mobi", _mobi(title, year)), (".azw3", b"broken"), (".txt", b"other")]
        ending, data = files[k % 7]
        shared.put(spark, f"{folder}/d{k % 3}/e{k % 2}/{k}{ending}", data)
    found = ebooks.read_files(spark, folder)
    return found.select(
        F.regexp_extract("path", "([0-9]+)[.][A-Za-z0-9.]+$", 1).cast("int").alias("k"), ebooks.file_format(F.col("path")).alias("file_format"), "title", F.array_join("authors", "|").alias("authors"), "series", "year", "annotation", F.octet_length("cover").alias("cover_bytes")
    )


# ---- runs ------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, n_nationkey % 4 <> 0 OR n_nationkey % 3 = 0 AS must_run FROM nation")
def checkpoint_gate(spark, sf_dir):
    """A library is read if it has no fingerprint or another one, or the run is forced."""
    k = F.col("n_nationkey")
    now = F.when(k % 4 == 1, "").otherwise(F.concat(k.cast("string"), F.lit(":9")))
    stored = F.when(k % 4 == 2, F.lit(None)).when(k % 4 == 3, F.lit("old")).otherwise(F.concat(k.cast("string"), F.lit(":9")))
    return table(spark, sf_dir, "nation").select(k.alias("id"), rc.gate(stored, now, k % 3 == 0).alias("must_run"))


_PATHS = "p AS (SELECT DISTINCT l_orderkey AS book_id, l_orderkey || '/' || l_partkey || '/' || l_linenumber AS source_path, l_partkey AS part FROM lineitem)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), path.alias("source_path"), F.col("l_partkey").alias("part")).distinct()


def _library_run(spark: SparkSession, sf_dir: str, *, apart: bool = False) -> rc.Run:
    """A run that files the paths of every 11th part under another book: 1,000,000 further on, or apart from all keys, as (new, id)."""
    paths, book = _paths(spark, sf_dir), F.col("book_id")
    old, new = (F.struct(F.lit(x).alias("new"), book.alias("id")) for x in (False, True)) if apart else (book, book + 1_000_000)
    known = paths.filter("part % 7 <> 0").select("source_path", old.alias("book_id"), F.lit(10).cast("long").alias("file_size"), F.lit(1).cast("long").alias("mtime"))
    found = paths.filter("part % 5 <> 0").select("source_path", F.when(F.col("part") % 11 == 0, 11).otherwise(10).cast("long").alias("file_size"), F.lit(1).cast("long").alias("mtime"))
    grouped = paths.filter("part % 5 <> 0 and (part % 7 = 0 or part % 11 = 0)").select("source_path", F.when(F.col("part") % 11 == 0, new).otherwise(old).alias("book_id"))
    return rc.run(known, found, grouped)


@query(f"WITH {_PATHS} SELECT source_path, CASE WHEN part % 11 = 0 THEN book_id + 1000000 ELSE book_id END AS book_id FROM p WHERE part % 5 <> 0")
def run_files(spark, sf_dir):
    """The files after a run: those that are gone are dropped, new ones are in, and moved ones stand under their new book."""
    return _library_run(spark, sf_dir).files.select("source_path", "book_id")


@query(f"WITH {_PATHS} SELECT source_path FROM p WHERE part % 5 <> 0 AND (part % 7 = 0 OR part % 11 = 0)")
def run_to_parse(spark, sf_dir):
    return _library_run(spark, sf_dir).parse.select("source_path")


@query(f"WITH {_PATHS} SELECT DISTINCT book_id FROM p WHERE part % 7 <> 0 EXCEPT SELECT book_id FROM p WHERE part % 5 <> 0 AND part % 11 <> 0")
def run_emptied_books(spark, sf_dir):
    """Books that keep no file; those under which the run files moved ones are none of the known, however far the keys reach."""
    return _library_run(spark, sf_dir, apart=True).emptied.select(F.col("book_id.id").alias("book_id"))


@query(f"WITH {_PATHS} SELECT source_path, book_id FROM p WHERE part % 7 <> 0 AND part % 11 = 0 AND part % 5 <> 0")
def moved_files(spark, sf_dir):
    """Rows of files that the run files under another book."""
    paths = _paths(spark, sf_dir)
    grouped = paths.filter("part % 5 <> 0").select("source_path", F.when(F.col("part") % 11 == 0, F.col("book_id") + 1_000_000).otherwise(F.col("book_id")).alias("book_id"))
    return rc.moved(paths.filter("part % 7 <> 0").select("source_path", "book_id"), grouped)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 777 ELSE o_orderkey * 10 END::BIGINT AS added_at, 777::BIGINT AS imported_at FROM orders WHERE o_orderkey > 0")
def arrival_times(spark, sf_dir):
    """The source's date if it has one, else the run's time."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").filter("o_orderkey > 0").select(k.alias("id"), F.when(k % 3 == 0, 0).otherwise(k * 10).cast("long").alias("added_at"))
    return ed.arrived(rows, 777)


@query("SELECT DISTINCT l_orderkey AS book_id, l_suppkey AS author_id FROM lineitem")
def bridge_links(spark, sf_dir):
    """Names of a run to links with their entities, each pair once."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    authors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.upper("s_name").alias("name_fold"))
    return ed.linked(lines.select(F.col("l_orderkey").alias("book_id"), F.upper("s_name").alias("name_fold")), authors, "author")


def _books_with_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, null, empty = F.col("o_orderkey"), F.lit(None).cast("string"), F.array().cast("array<string>")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.lit("t").alias("title"), F.array(F.lit("Ann")).alias("authors"), empty.alias("genres"), F.when(k % 2 == 0, "own").alias("annotation"), null.alias("series"), F.lit(None).cast("double").alias("series_number"), F.lit("en").alias("language"), null.alias("publisher"),
        F.lit(None).cast("int").alias("year"), F.create_map(F.lit("isbn"), F.lit("1")).alias("identifiers"), F.lit("h").alias("content_hash"), (k % 4 == 0).cast("int").alias("metadata_checked"), F.lit(0).alias("enrichment_checked"), F.lit(0).alias("manually_matched"),
    )


def _pairs(column: str):
    return F.array_join(F.array_sort(F.transform(F.map_entries(column), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), "|").alias(column)


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'own' WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'found' END AS annotation,
       CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'amazon=B2|isbn=1' ELSE 'isbn=1' END AS identifiers, (o_orderkey % 3 = 0 OR o_orderkey % 4 = 0)::INTEGER AS checked FROM orders""")
def backfill_local(spark, sf_dir):
    """Books not checked yet take from their own file an annotation they lack and identifiers of new types, once."""
    books = _books_with_maps(spark, sf_dir)
    ids = F.array(F.struct(F.lit("isbn").alias("type"), F.lit("2").alias("value")), F.struct(F.lit("amazon").alias("type"), F.lit("b2").alias("value")))
    parsed = books.filter("id % 3 = 0").select("id", F.lit("found").alias("annotation"), ids.alias("identifiers"))
    return en.backfilled(books, parsed).select("id", "annotation", _pairs("identifiers"), F.col("metadata_checked").alias("checked"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'edited' ELSE 't' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'Bob' ELSE 'Ann' END AS author,
       CASE WHEN o_orderkey % 6 = 0 THEN 'goodreads=5' WHEN o_orderkey % 9 = 0 THEN '' ELSE 'isbn=1' END AS identifiers, (o_orderkey % 3 = 0)::INTEGER AS locked FROM orders""")
def manual_edits(spark, sf_dir):
    """An edit overwrites and locks; no list of identifiers keeps them, a list replaces them, an empty one removes them."""
    books, k, none = _books_with_maps(spark, sf_dir), F.col("id"), F.lit(None)
    kind = "array<struct<type:string,value:string>>"
    ids = F.when(k % 6 == 0, F.array(F.struct(F.lit("goodreads").alias("type"), F.lit("5").alias("value")))).when(k % 9 == 0, F.array().cast(kind)).otherwise(none.cast(kind))
    edits = books.filter("id % 3 = 0").select("id", F.lit("edited").alias("title"), F.array(F.lit("Bob")).alias("authors"), "genres", "annotation", "series", "series_number", F.lit("").alias("language"), "publisher", "year", ids.alias("identifiers"))
    return en.edited(books, edits).select("id", "title", F.array_join("authors", "|").alias("author"), _pairs("identifiers"), F.col("manually_matched").alias("locked"))


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' || n_name ELSE n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'error' ELSE 'active' END AS status FROM nation WHERE n_nationkey % 5 <> 0")
def snapshot_versions(spark, sf_dir):
    """Inserts, updates and deletes of libraries as versions; readers see the last."""
    store = rc.Store(spark, shared.scratch(spark, "store"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("active").alias("status"))
    kinds = {c.split()[0]: c.split()[1] for c in rc.TABLES["libraries"].split(", ")}
    whole = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    store.commit({"libraries": whole(rows.filter("id < 20"))})
    old = store.read()["libraries"]
    changed = rows.filter("id % 2 = 0").select("id", F.concat(F.lit("new "), "name").alias("name"), F.lit("error").alias("status"))
    merged = rc.insert_absent(rc.upsert(old, whole(changed), ["id"]), whole(rows), ["id"])
    store.commit({"libraries": rc.deleted(merged, rows.filter("id % 5 = 0").select("id"), "id")})
    return store.read()["libraries"].select("id", "name", "status")


# ---- events ----------------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE x AS (SELECT user_id AS k, epoch_us(ts) // 1000 AS ms, bool_or(event_id % 20 = 0) AS total FROM events GROUP BY 1, 2),
r AS (SELECT k, min(ms) AS ms FROM x GROUP BY k UNION ALL SELECT r.k, (SELECT min(x.ms) FROM x WHERE x.k = r.k AND x.ms > r.ms AND (x.total OR x.ms >= r.ms + 36000000)) FROM r WHERE EXISTS (SELECT 1 FROM x WHERE x.k = r.k AND x.ms > r.ms AND (x.total OR x.ms >= r.ms + 36000000)))
SELECT k AS user_id, ms FROM r UNION SELECT k, max(ms) FROM x GROUP BY k""")
def throttle_totals(spark, sf_dir):
    """New totals are reported at once, and the last event of each key in any case."""
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = table(spark, sf_dir, "events").groupBy("user_id", ms.alias("ms")).agg(F.bool_or(F.col("event_id") % 20 == 0).alias("total"))
    return ev.throttled(rows, "user_id", every=36_000_000, at_once="total", flush=True)


@query("SELECT DISTINCT 'd' || (n_nationkey % 3) || '/e' || (n_nationkey % 2) AS dir, n_nationkey || '.fb2' AS name, 5::BIGINT AS size FROM nation WHERE n_nationkey % 4 <> 0")
def watch_folder(spark, sf_dir):
    """Files found by the stream over a folder and its subfolders, those of other kinds left out."""
    folder = shared.scratch(spark, "watched")
    for n in _nations(spark, sf_dir):
        k = n.n_nationkey
        shared.put(spark, f"{folder}/d{k % 3}/e{k % 2}/{k}.{'txt' if k % 4 == 0 else 'fb2'}", b"12345")
    out = f"{folder}-seen"
    stream = ev.watched(spark, folder, glob="*.fb2", files_a_batch=7)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.regexp_extract("dir", "(d[0-9]/e[0-9])$", 1).alias("dir"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "size")


@query("SELECT user_id, min(event_id) AS place, (sum(count(*)) OVER (ORDER BY min(event_id)) - count(*))::BIGINT AS start, (sum(count(*)) OVER (ORDER BY min(event_id)))::BIGINT AS end FROM events GROUP BY user_id")
def serve_queue(spark, sf_dir):
    """Jobs run one at a time in order of their first request; each takes as many seconds as it was asked for."""
    queue = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("place"), F.count("*").alias("seconds"))
    return ev.served(queue).select("user_id", "place", "start", "end")
