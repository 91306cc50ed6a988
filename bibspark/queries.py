"""Queries over the driver's tables, each beside the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .functions import identity as idt
from .functions import text as tx
from .functions import web
from .operators import browse, search, views
from .operators.browse import BookFilter, Facet
from .operators.driver_views import catalog, index, seconds, table, terms
from .plans import editions as ed
from .plans import enrich as en
from .plans import reconcile as rc
from .ranks import ranked
from .streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The catalogue's views in SQL.
VIEWS = """
books AS (
    SELECT o_orderkey AS id, c_nationkey::BIGINT AS library_id, c_name || ' / ' || o_orderkey AS title, o_custkey AS series_id, o_orderstatus AS language, c_mktsegment AS publisher,
           upper(c_mktsegment) AS publisher_fold, year(o_orderdate)::INTEGER AS year, CASE WHEN o_orderpriority NOT LIKE '4%' THEN 6 - substr(o_orderpriority, 1, 1)::INTEGER END AS rating,
           epoch(date_trunc('second', o_orderdate))::BIGINT AS added_at, epoch(date_trunc('month', o_orderdate)::TIMESTAMP)::BIGINT AS imported_at
    FROM orders JOIN customer ON o_custkey = c_custkey),
libraries AS (SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation),
series AS (SELECT c_custkey AS id, c_name AS name, upper(c_name) AS name_fold FROM customer),
authors AS (SELECT s_suppkey AS id, s_name AS name, upper(s_name) AS name_fold FROM supplier),
genres AS (SELECT row_number() OVER (ORDER BY p_type) AS id, p_type AS name, upper(p_type) AS name_fold FROM (SELECT DISTINCT p_type FROM part)),
book_authors AS (SELECT DISTINCT l_orderkey AS book_id, l_suppkey AS author_id FROM lineitem),
book_genres AS (SELECT DISTINCT l_orderkey AS book_id, genres.id AS genre_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN genres ON genres.name = p_type),
book_files AS (SELECT l_orderkey AS book_id, l_partkey * 10 + l_linenumber AS id, l_returnflag AS file_format, l_quantity::BIGINT AS file_size, CASE WHEN l_linenumber > 1 THEN l_linenumber * 100 END AS pages FROM lineitem),
book_identifiers AS (SELECT o_orderkey AS book_id, 'isbn' AS type, '978' || lpad(o_custkey::VARCHAR, 10, '0') AS value FROM orders)
"""
#: Term rows of documents in SQL.
TERMS = r"""
terms AS (
    SELECT doc_id, col, term, pos FROM (
        SELECT doc_id, col, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (
            SELECT doc_id, 'annotation' AS col, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
            UNION ALL SELECT doc_id, 'title', list_filter(regexp_split_to_array(lower(lang), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM documents))),
sizes AS (SELECT doc_id, count(*) AS d FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS n, avg(d) AS avgdl FROM sizes)
"""


def query(sql: str | None = None, *, prelude: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {prelude}{sql}" if prelude else sql
        return f

    return add


BOOK = ("id", "library_id", "title", "series_id", "language", "publisher", "year", "rating", "added_at", "imported_at")
_BOOK = ", ".join(BOOK)

# ---- listings --------------------------------------------------------------------------------------------------------

_WANT = BookFilter(author=Facet("Supplier#000000003", True), format="R", language="F", sort="rating", limit=25)
_WANT_SQL = """
FROM books WHERE language = 'F' AND EXISTS (SELECT 1 FROM book_files f WHERE f.book_id = books.id AND f.file_format = 'R')
  AND EXISTS (SELECT 1 FROM book_authors a JOIN authors ON authors.id = a.author_id WHERE a.book_id = books.id AND authors.name = 'Supplier#000000003')
"""


@query(f" SELECT {_BOOK} {_WANT_SQL} ORDER BY rating DESC NULLS LAST, added_at DESC, id DESC LIMIT 25", prelude=VIEWS)
def listing_filtered(spark, sf_dir):
    return browse.listing(catalog(spark, sf_dir), _WANT).select(*BOOK)


@query(f" SELECT count(*) AS books {_WANT_SQL}", prelude=VIEWS)
def listing_count(spark, sf_dir):
    return browse.listing_count(catalog(spark, sf_dir), _WANT)


@query(f" SELECT {_BOOK} FROM books ORDER BY imported_at DESC, added_at DESC, id DESC LIMIT 24", prelude=VIEWS)
def listing_recent(spark, sf_dir):
    return browse.listing(catalog(spark, sf_dir), BookFilter()).select(*BOOK)


@query(f" SELECT {_BOOK} FROM books WHERE library_id = 3 ORDER BY added_at DESC, id DESC LIMIT 50", prelude=VIEWS)
def listing_source(spark, sf_dir):
    return browse.listing(catalog(spark, sf_dir), BookFilter(library_id=3, sort="source", limit=browse.FEED_PAGE)).select(*BOOK)


@query(f" SELECT {_BOOK} FROM books WHERE publisher = 'BUILDING' ORDER BY rating DESC NULLS LAST, added_at DESC, id DESC LIMIT 24 OFFSET 48", prelude=VIEWS)
def listing_paged(spark, sf_dir):
    limit, offset = browse.page(3, None)
    return browse.listing(catalog(spark, sf_dir), BookFilter(publisher="BUILDING", sort="rating", limit=limit, offset=offset)).select(*BOOK)


@query(f" SELECT {_BOOK} FROM books JOIN series ON series.id = books.series_id WHERE series.name = 'Customer#000000010' ORDER BY imported_at DESC, added_at DESC, books.id DESC LIMIT 100".replace("SELECT id", "SELECT books.id"), prelude=VIEWS)
def listing_series(spark, sf_dir):
    return browse.listing(catalog(spark, sf_dir), BookFilter(series=Facet("Customer#000000010", True), limit=100)).select(*BOOK)


@query(f" SELECT {_BOOK} FROM books WHERE id IN (SELECT book_id FROM book_genres JOIN genres ON genres.id = genre_id WHERE name = (SELECT min(p_type) FROM part)) ORDER BY added_at DESC, id DESC LIMIT 100", prelude=VIEWS)
def listing_genre(spark, sf_dir):
    c = catalog(spark, sf_dir)
    first = c["genres"].orderBy("name").first()["name"]
    return browse.listing(c, BookFilter(genre=first, sort="source", limit=100)).select(*BOOK)


@query(f" SELECT {_BOOK} FROM books WHERE id = 7", prelude=VIEWS)
def book_by_id(spark, sf_dir):
    return catalog(spark, sf_dir)["books"].filter("id = 7").select(*BOOK)


@query(" SELECT book_id, id, file_format, file_size FROM book_files WHERE book_id = 7", prelude=VIEWS)
def files_of_book(spark, sf_dir):
    return catalog(spark, sf_dir)["book_files"].filter("book_id = 7").select("book_id", "id", "file_format", "file_size")


@query(" SELECT b.id, b.title, s.name AS series FROM books b LEFT JOIN series s ON s.id = b.series_id WHERE library_id = 5", prelude=VIEWS)
def book_with_series(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c["books"].filter("library_id = 5").join(c["series"].select(F.col("id").alias("series_id"), F.col("name").alias("series")), "series_id", "left").select("id", "title", "series")


_PAGE_SQL = "page AS (SELECT * FROM books ORDER BY imported_at DESC, added_at DESC, id DESC LIMIT 24)"


@query(
    f""", {_PAGE_SQL},
a AS (SELECT book_id, string_agg(name, '|' ORDER BY name_fold) AS authors FROM book_authors JOIN authors ON authors.id = author_id GROUP BY book_id),
g AS (SELECT book_id, string_agg(name, '|' ORDER BY name_fold) AS tags FROM book_genres JOIN genres ON genres.id = genre_id GROUP BY book_id),
f AS (SELECT book_id, string_agg(file_format || ':' || file_size, '|' ORDER BY file_format, id, file_size) AS formats, first(pages ORDER BY file_format, id, file_size) FILTER (pages IS NOT NULL) AS pages FROM book_files GROUP BY book_id),
i AS (SELECT book_id, 'https://isbnsearch.org/isbn/' || value AS link FROM book_identifiers)
SELECT page.id, page.title, series.name AS series, coalesce(authors, '') AS authors, coalesce(tags, '') AS tags, coalesce(formats, '') AS formats, pages, link
FROM page JOIN series ON series.id = page.series_id LEFT JOIN a ON a.book_id = page.id LEFT JOIN g ON g.book_id = page.id LEFT JOIN f ON f.book_id = page.id LEFT JOIN i ON i.book_id = page.id""",
    prelude=VIEWS,
)
def page_views(spark, sf_dir):
    c = catalog(spark, sf_dir)
    v = views.book_views(c, browse.listing(c, BookFilter()))
    bar = lambda col, f: F.array_join(F.transform(col, f), "|").alias(col)
    return v.select("id", "title", "series", bar("authors", lambda x: x["name"]), F.array_join("tags", "|").alias("tags"), bar("formats", lambda x: F.concat(x["type"], F.lit(":"), x["size_bytes"].cast("string"))), "pages", F.get("identifiers", F.lit(0))["url"].alias("link"))


@query(
    f""", {_PAGE_SQL}, a AS (SELECT book_id, string_agg(name, ', ' ORDER BY name_fold) AS authors FROM book_authors JOIN authors ON authors.id = author_id GROUP BY book_id),
f AS (SELECT book_id, count(*) AS n FROM book_files GROUP BY book_id)
SELECT 'urn:book:' || page.id AS entry_id, title, coalesce(authors, '') AS author_line, coalesce(n, 0)::INTEGER AS n_links FROM page LEFT JOIN a ON a.book_id = page.id LEFT JOIN f ON f.book_id = page.id""",
    prelude=VIEWS,
)
def feed_rows(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return views.feed_entries(views.book_views(c, browse.listing(c, BookFilter()))).select("entry_id", "title", "author_line", F.size("links").alias("n_links"))


@query(" SELECT '/opds/authors/' || id AS href, name, n || CASE WHEN n = 1 THEN ' book' ELSE ' books' END AS content FROM authors JOIN (SELECT author_id, count(*) AS n FROM book_authors GROUP BY author_id) ON author_id = id", prelude=VIEWS)
def feed_navigation(spark, sf_dir):
    return views.navigation(browse.index(catalog(spark, sf_dir), "author"), "/opds/authors/")


# ---- letters, indexes, facets, statistics ----------------------------------------------------------------------------


@query(" SELECT DISTINCT CASE WHEN regexp_matches(upper(p_name[1]), '[A-Z]') THEN upper(p_name[1]) ELSE '#' END AS letter FROM part", prelude=VIEWS)
def letters_present(spark, sf_dir):
    return browse.letters(table(spark, sf_dir, "part").select(F.upper("p_name").alias("f")), "f").select("letter")


def _index_sql(kind: str, where: str = "true", scope: str = "") -> str:
    link = {"author": "book_authors", "genre": "book_genres", "series": "(SELECT id AS book_id, series_id FROM books)"}[kind]
    names = "series" if kind == "series" else f"{kind}s"
    return f" SELECT e.id, e.name, e.name_fold, count(*) AS book_count FROM {names} e JOIN {link} l ON l.{kind}_id = e.id JOIN books b ON b.id = l.book_id WHERE {where} {scope} GROUP BY ALL"


@query(_index_sql("author"), prelude=VIEWS)
def authors_index(spark, sf_dir):
    return browse.index(catalog(spark, sf_dir), "author")


@query(_index_sql("genre"), prelude=VIEWS)
def genres_index(spark, sf_dir):
    return browse.index(catalog(spark, sf_dir), "genre")


@query(_index_sql("series"), prelude=VIEWS)
def series_index(spark, sf_dir):
    return browse.index(catalog(spark, sf_dir), "series")


@query(_index_sql("author", "e.name_fold >= 'S' AND e.name_fold < 'T'", "AND b.library_id = 3"), prelude=VIEWS)
def author_by_letter(spark, sf_dir):
    return browse.by_letter(catalog(spark, sf_dir), "author", "S", 3)


@query(_index_sql("series", "e.name_fold >= 'C' AND e.name_fold < 'D'", "AND b.library_id = 4"), prelude=VIEWS)
def series_by_letter(spark, sf_dir):
    return browse.by_letter(catalog(spark, sf_dir), "series", "C", 4)


@query(_index_sql("genre", "e.name_fold >= 'S' AND e.name_fold < 'T'"), prelude=VIEWS)
def genre_by_letter(spark, sf_dir):
    return browse.by_letter(catalog(spark, sf_dir), "genre", "S")


@query(" SELECT e.id, e.id || ' ' || e.name AS name, e.id || ' ' || e.name_fold AS name_fold, count(*) AS book_count FROM authors e JOIN book_authors l ON l.author_id = e.id WHERE e.id % 3 = 0 GROUP BY ALL", prelude=VIEWS)
def author_nonletter(spark, sf_dir):
    """Every third author's name begins with a number and stands under '#'."""
    c = catalog(spark, sf_dir)
    numbered = lambda n: F.when(F.col("id") % 3 == 0, F.concat(F.col("id").cast("string"), F.lit(" "), F.col(n))).otherwise(F.col(n)).alias(n)
    return browse.by_letter(dict(c) | {"authors": c["authors"].select("id", numbered("name"), numbered("name_fold"))}, "author", "#")


@query(" SELECT publisher, publisher_fold, count(*) AS book_count FROM books WHERE publisher_fold >= 'B' AND publisher_fold < 'C' AND publisher_fold <> '' GROUP BY ALL", prelude=VIEWS)
def publisher_by_letter(spark, sf_dir):
    return browse.publishers(catalog(spark, sf_dir), "B")


@query(" SELECT publisher, publisher_fold, count(*) AS book_count FROM books WHERE library_id = 2 GROUP BY ALL", prelude=VIEWS)
def publishers_scoped(spark, sf_dir):
    return browse.publishers(catalog(spark, sf_dir), None, 2)


@query(" SELECT DISTINCT file_format FROM book_files JOIN books ON books.id = book_id WHERE library_id = 1", prelude=VIEWS)
def facet_formats_scoped(spark, sf_dir):
    return browse.formats(catalog(spark, sf_dir), 1)


@query(" SELECT DISTINCT language FROM books WHERE library_id = 1", prelude=VIEWS)
def facet_languages_scoped(spark, sf_dir):
    return browse.languages(catalog(spark, sf_dir), 1)


@query(
    " SELECT (SELECT count(*) FROM books) AS books, (SELECT count(DISTINCT series_id) FROM books) AS series, (SELECT coalesce(sum(file_size), 0)::BIGINT FROM book_files) AS total_size, (SELECT count(DISTINCT author_id) FROM book_authors) AS authors, (SELECT count(DISTINCT genre_id) FROM book_genres) AS genres",
    prelude=VIEWS,
)
def stats_global(spark, sf_dir):
    return browse.totals(catalog(spark, sf_dir))


@query(" SELECT file_format, count(DISTINCT book_id) AS book_count FROM book_files GROUP BY 1", prelude=VIEWS)
def stats_by_format(spark, sf_dir):
    return browse.books_by_format(catalog(spark, sf_dir))


@query(" SELECT language, count(*) AS book_count FROM books GROUP BY 1", prelude=VIEWS)
def stats_by_language(spark, sf_dir):
    return browse.books_by_language(catalog(spark, sf_dir))


@query(" SELECT libraries.id, libraries.name, count(b.id) AS book_count FROM libraries LEFT JOIN books b ON b.library_id = libraries.id GROUP BY ALL", prelude=VIEWS)
def libraries_with_count(spark, sf_dir):
    return browse.libraries_with_count(catalog(spark, sf_dir))


@query(" SELECT id FROM books WHERE NOT EXISTS (SELECT 1 FROM book_files f WHERE f.book_id = books.id)", prelude=VIEWS)
def empty_books(spark, sf_dir):
    return browse.empty_books(catalog(spark, sf_dir)).select("id")


@query(" SELECT b.id, b.library_id FROM books b JOIN book_identifiers i ON i.book_id = b.id WHERE i.type = 'isbn' AND i.value = '9780000000010' AND b.library_id = (SELECT c_nationkey FROM customer WHERE c_custkey = 10) ORDER BY b.id LIMIT 1", prelude=VIEWS)
def find_by_identifier(spark, sf_dir):
    c = catalog(spark, sf_dir)
    home = table(spark, sf_dir, "customer").filter("c_custkey = 10").select(F.col("c_nationkey").cast("long").alias("library_id"))
    scoped = dict(c) | {"books": c["books"].join(home, "library_id", "left_semi")}
    found = scoped["book_identifiers"].filter("type = 'isbn' and value = '9780000000010'").select(F.col("book_id").alias("id"))
    return scoped["books"].join(found, "id", "left_semi").orderBy("id").limit(1).select("id", "library_id")


# ---- full text -------------------------------------------------------------------------------------------------------


def _hits(alias: str, where: str) -> str:
    return f"{alias} AS (SELECT doc_id, count(*) AS f FROM terms WHERE {where} GROUP BY doc_id)"


_SCORE = "-(CASE WHEN ln((n - {k} + 0.5) / ({k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - {k} + 0.5) / ({k} + 0.5)) END) * ({f} * 2.2) / ({f} + 1.2 * (0.25 + 0.75 * d / avgdl))"


@query(f", {_hits('h', "term = 'the'")} SELECT doc_id, f FROM h", prelude=TERMS)
def fts_token(spark, sf_dir):
    return search.occurrences(terms(spark, sf_dir), search.clauses("The")[0])


@query(", p AS (SELECT a.doc_id, count(*) AS f FROM terms a JOIN terms b ON b.doc_id = a.doc_id AND b.col = a.col AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id) SELECT doc_id, f FROM p", prelude=TERMS)
def fts_phrase(spark, sf_dir):
    return search.occurrences(terms(spark, sf_dir), search.clauses("of-the")[0])


@query(f", {_hits('h', "term = 'de' AND col = 'title'")} SELECT doc_id, f FROM h", prelude=TERMS)
def fts_scoped(spark, sf_dir):
    return search.occurrences(terms(spark, sf_dir), search.clauses("de", "title")[0])


@query(" SELECT count(*) AS docs FROM (SELECT DISTINCT doc_id FROM terms WHERE term = 'license') JOIN (SELECT DISTINCT doc_id FROM terms WHERE term = 'fr' AND col = 'title') USING (doc_id)", prelude=TERMS)
def fts_count(spark, sf_dir):
    return search.match_count(terms(spark, sf_dir), [*search.clauses("license"), *search.clauses("fr", "title")])


@query(
    f""", {_hits('x', "term = 'license'")}, {_hits('y', "term = 'en' AND col = 'title'")}
SELECT doc_id, round({_SCORE.format(k="(SELECT count(*) FROM x)", f="x.f")} + {_SCORE.format(k="(SELECT count(*) FROM y)", f="y.f")}, 9) AS score
FROM x JOIN y USING (doc_id) JOIN sizes USING (doc_id), whole ORDER BY score, doc_id LIMIT 50""",
    prelude=TERMS,
)
def bm25_top(spark, sf_dir):
    i = index(spark, sf_dir)
    scored = search.bm25(i.terms, [*search.clauses("license"), *search.clauses("en", "title")], sizes=i.sizes)
    return scored.select("doc_id", F.round("score", 9).alias("score")).orderBy("score", "doc_id").limit(50)


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\x09-\x0D\x20]+', ' ', 'g')) AS plain FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("plain"))


@query("SELECT doc_id, CASE WHEN regexp_extract(text, '[0-9]{4}') >= '1000' THEN regexp_extract(text, '[0-9]{4}')::INTEGER ELSE 0 END AS year FROM documents")
def parse_year(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.parse_year(F.col("text")).alias("year"))


@query("""
WITH i AS (SELECT p_partkey, '978' || lpad((p_partkey * 7919)::VARCHAR, 10, '0') AS v FROM part),
s AS (SELECT p_partkey, v, list_sum(list_transform(range(1, 14), lambda k: substr(v, k, 1)::INTEGER * CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END)) AS n FROM i)
SELECT p_partkey, v AS isbn, n % 10 = 0 AS valid FROM s""")
def isbn_valid(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.format_string("978%010d", F.col("p_partkey") * 7919).alias("isbn"))
    return rows.select("p_partkey", "isbn", idt.is_isbn(F.col("isbn")).alias("valid"))


@query("SELECT p_partkey, CASE WHEN p_size % 11 >= 2 THEN ((p_size % 11) // 2)::INTEGER END AS rating FROM part")
def rating_map(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.rating_stars(F.col("p_size") % 11).alias("rating"))


@query("""
WITH d AS (SELECT doc_id, 'Vol ' || (doc_id % 7) || ': The ' || lang || ' of ' || source AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(string_split(lower(regexp_replace(t, '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains(['the', 'a', 'an', 'of', 'and', 'to'], w)), ' ') AS tokens FROM d""")
def title_tokens(spark, sf_dir):
    title = F.concat(F.lit("Vol "), (F.col("doc_id") % 7).cast("string"), F.lit(": The "), "lang", F.lit(" of "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.title_tokens(title), " ").alias("tokens"))


@query("""
WITH c AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' Collection' WHEN 1 THEN ' (Study Guide)' WHEN 2 THEN ' 3 Books' WHEN 3 THEN ' Book 3' ELSE '' END AS t, string_split(lower(p_name), ' ')[1] AS q FROM part)
SELECT p_partkey, t AS title, p_partkey % 5 >= 3 AND list_contains(string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' '), trim(regexp_replace(q, '[^a-z0-9]+', ' ', 'g'))) AS acceptable FROM c""")
def title_acceptable(spark, sf_dir):
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, " Collection").when(k == 1, " (Study Guide)").when(k == 2, " 3 Books").when(k == 3, " Book 3").otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", tail).alias("title"), tx.title_tokens(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("q"))
    return rows.select("p_partkey", "title", tx.title_acceptable(F.col("q"), F.col("title")).alias("acceptable"))


_KEY_SQL = """
SELECT l_orderkey AS book, chr(31) AS sep, lower(trim(any_value(o_orderpriority))) || chr(31) || string_agg(DISTINCT a, ',' ORDER BY a) || chr(31) || lower(any_value(o_orderstatus)) AS k
FROM (SELECT l_orderkey, array_to_string(list_sort(list_filter(string_split_regex(lower(s_name), '[, #]+'), lambda x: x <> '')), ' ') AS a FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey
"""


def _books_with_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    names = c["book_authors"].join(c["authors"].select(F.col("id").alias("author_id"), F.translate("name", "#", ",").alias("name")), "author_id")
    names = names.groupBy("book_id").agg(F.collect_set("name").alias("authors"))
    return table(spark, sf_dir, "orders").join(names, F.col("o_orderkey") == F.col("book_id"))


@query(f"SELECT book, sha256(k) AS group_key FROM ({_KEY_SQL})")
def group_key(spark, sf_dir):
    rows = _books_with_authors(spark, sf_dir)
    return rows.select(F.col("o_orderkey").alias("book"), F.sha2(idt.group_key(F.col("o_orderpriority"), F.col("authors"), F.col("o_orderstatus")), 256).alias("group_key"))


@query(
    """SELECT o_orderkey AS book, sha256(concat_ws(chr(31), o_orderpriority, a, c_name, (o_orderkey % 5)::VARCHAR, o_orderstatus, '', c_mktsegment, year(o_orderdate)::VARCHAR, coalesce((CASE WHEN o_orderpriority NOT LIKE '4%' THEN 6 - substr(o_orderpriority, 1, 1)::INTEGER END)::VARCHAR, ''), '', 'isbn=' || o_custkey)) AS content_hash
FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT l_orderkey, string_agg(DISTINCT replace(s_name, '#', ','), '|' ORDER BY replace(s_name, '#', ',')) AS a FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def content_hash(spark, sf_dir):
    rows = _books_with_authors(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rating = F.when(~F.col("o_orderpriority").startswith("4"), 6 - F.substring("o_orderpriority", 1, 1).cast("int"))
    ids = F.array(F.struct(F.lit("isbn").alias("type"), F.col("o_custkey").cast("string").alias("value")))
    made = idt.content_hash(F.col("o_orderpriority"), F.col("authors"), F.col("c_name"), (F.col("o_orderkey") % 5).cast("double"), F.col("o_orderstatus"), F.lit(None).cast("string"), F.col("c_mktsegment"), F.year("o_orderdate"), rating, F.array().cast("array<string>"), ids)
    return rows.select(F.col("o_orderkey").alias("book"), made.alias("content_hash"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'isbn' WHEN 1 THEN 'amazon' WHEN 2 THEN NULL ELSE 'goodreads' END AS type,
       CASE p_partkey % 4 WHEN 0 THEN '978' || lpad(p_partkey::VARCHAR, 10, '0') WHEN 1 THEN 'B' || lpad(p_partkey::VARCHAR, 9, '0') WHEN 2 THEN NULL ELSE p_partkey::VARCHAR END AS value FROM part""")
def identifiers_clean(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    type_ = F.when(k == 0, "ISBN-13").when(k == 1, "mobi-asin").when(k == 2, "uuid").otherwise(" Goodreads ")
    value = F.when(k == 0, F.concat(F.lit("urn:isbn:978-"), F.lpad(n, 10, "0"))).when(k == 1, F.concat(F.lit("b"), F.lpad(n, 9, "0"))).otherwise(n)
    ids = idt.clean_identifiers(F.array(F.struct(type_.alias("type"), value.alias("value"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(ids, F.lit(0)).alias("i"))
    return rows.select("p_partkey", "i.type", "i.value")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang WHEN 2 THEN '' ELSE CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' ELSE 'es' END END AS language FROM documents")
def language_normalise(spark, sf_dir):
    k = F.col("doc_id") % 4
    long_ = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fre").when(F.col("lang") == "de", "ger").otherwise("spa")
    code = F.when(k == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit("-Latn-XX"))).when(k == 1, F.concat("lang", F.lit("_XX"))).when(k == 2, "english").otherwise(long_)
    return table(spark, sf_dir, "documents").select("doc_id", idt.language(code).alias("language"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Science Fiction' WHEN 1 THEN 'Fantasy|Humor' WHEN 2 THEN '' ELSE 'War & Military|Science Fiction' END AS genres FROM part")
def genres_canonical(spark, sf_dir):
    k = F.col("p_size") % 4
    tags = F.when(k == 0, F.array(F.lit("sf"), F.lit("Fiction / science fiction / Space Opera"))).when(k == 1, F.array(F.lit("dragon_fantasy"), F.lit(" HUMOR "))).when(k == 2, F.array(F.lit("unknown"), F.lit(" "))).otherwise(F.array(F.lit("military_special"), F.lit("SF_SPACE")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(idt.genres(tags), "|").alias("genres"))


@query("SELECT s_suppkey, 'First ' || 'M' || s_nationkey || ' ' || s_name || '|Solo' AS authors FROM supplier")
def author_reorder(spark, sf_dir):
    field = F.concat("s_name", F.lit(", First ,M"), F.col("s_nationkey").cast("string"), F.lit(":Solo:: "))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(tx.inp_authors(field), "|").alias("authors"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN epoch(date_trunc('day', o_orderdate)::TIMESTAMP)::BIGINT ELSE epoch(make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0.0))::BIGINT END AS added_at FROM orders")
def inp_dates(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-dd-MM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.inp_date(text).alias("added_at"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'http://x.example/i/' || p_partkey || '.jpg' ELSE 'https://x.example/i/' || p_partkey || '?zoom=1' END AS url, CASE WHEN p_partkey % 3 = 0 THEN 'http://x.example/i/' || p_partkey || '._SY450_.jpg' ELSE 'http://x.example/i/' || p_partkey || '?zoom=1&edge=curl' END AS thumb FROM part")
def image_urls(spark, sf_dir):
    n = F.col("p_partkey").cast("string")
    sized = F.concat(F.lit("http://x.example/i/"), n, F.when(F.col("p_partkey") % 3 == 0, "._AC_UL320_.JPG").otherwise("?zoom=1&edge=curl"))
    third = F.col("p_partkey") % 3 == 0
    return table(spark, sf_dir, "part").select("p_partkey", F.when(third, web.resized_image(sized)).otherwise(web.secure(web.without_curl(sized))).alias("url"), web.thumbnail(sized, 450).alias("thumb"))


@query("SELECT p_partkey, CASE WHEN p_size >= 25 THEN 'a' ELSE 'b' END AS url FROM part")
def largest_image(spark, sf_dir):
    text = F.format_string('{"b": [50, 10], "a": [20, %d]}', F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", web.largest_image(text).alias("url"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated, (o_orderkey % 3) || CASE WHEN o_orderkey % 3 = 1 THEN ' book' ELSE ' books' END AS label FROM orders")
def display_forms(spark, sf_dir):
    shown = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("updated"), web.plural(F.col("o_orderkey") % 3, "book").alias("label"))


@query("""
WITH c AS (SELECT p_size AS request, p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'amazon' WHEN 1 THEN 'goodreads' WHEN 2 THEN 'googlebooks' ELSE 'openlibrary' END AS source, (p_partkey % 4) AS prio, 'u' || (p_partkey % 50) AS full_url, (p_partkey % 7)::INTEGER AS width, p_size AS height FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY request, full_url ORDER BY prio DESC, width * height DESC, p_partkey) AS n FROM c)
SELECT request, p_partkey, full_url, row_number() OVER (PARTITION BY request ORDER BY prio DESC, width * height DESC, full_url) AS rank FROM b WHERE n = 1""")
def candidate_rank(spark, sf_dir):
    k = F.col("p_partkey") % 4
    source = F.when(k == 0, "amazon").when(k == 1, "goodreads").when(k == 2, "googlebooks").otherwise("openlibrary")
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("request"), "p_partkey", source.alias("source"), F.concat(F.lit("u"), (F.col("p_partkey") % 50).cast("string")).alias("full_url"), (F.col("p_partkey") % 7).cast("int").alias("width"), F.col("p_size").alias("height"))
    return views.rank_covers(rows).select("request", "p_partkey", "full_url", "rank")


# ---- ingest, merge, upkeep -------------------------------------------------------------------------------------------

_FILES_SQL = "f AS (SELECT l_orderkey AS book, l_partkey AS part, l_linenumber AS line, max(l_quantity)::BIGINT AS file_size, max(epoch(date_trunc('second', l_shipdate)))::BIGINT AS mtime FROM lineitem GROUP BY 1, 2, 3)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("book"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"))
    return rows.agg(F.max("l_quantity").cast("long").alias("file_size"), F.max(F.expr(seconds("l_shipdate"))).alias("mtime"))


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, sf_dir)
    known = files.filter("part % 7 <> 0")
    found = files.filter("part % 5 <> 0").withColumn("file_size", F.col("file_size") + F.when(F.col("part") % 11 == 0, 1).otherwise(0))
    return known, found


@query(f"WITH {_FILES_SQL} SELECT book, part, line, CASE WHEN part % 7 = 0 THEN 'new' WHEN part % 5 = 0 THEN 'gone' WHEN part % 11 = 0 THEN 'changed' ELSE 'same' END AS change FROM f WHERE NOT (part % 7 = 0 AND part % 5 = 0)")
def file_diff(spark, sf_dir):
    return rc.file_diff(*_two_runs(spark, sf_dir), key=["book", "part", "line"])


@query(f"WITH {_FILES_SQL}, c AS (SELECT CASE WHEN part % 7 = 0 THEN 'new' WHEN part % 5 = 0 THEN 'gone' WHEN part % 11 = 0 THEN 'changed' ELSE 'same' END AS change FROM f WHERE NOT (part % 7 = 0 AND part % 5 = 0)) SELECT count(*) FILTER (change = 'new') AS added, count(*) FILTER (change = 'gone') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'same') AS kept FROM c")
def run_counters(spark, sf_dir):
    return rc.counters(rc.file_diff(*_two_runs(spark, sf_dir), key=["book", "part", "line"]))


@query(f"WITH {_FILES_SQL} SELECT book, part, line FROM f WHERE part % 7 <> 0 AND part % 5 <> 0")
def prune_files(spark, sf_dir):
    known, found = _two_runs(spark, sf_dir)
    return rc.pruned(known, found, key=["book", "part", "line"]).select("book", "part", "line")


@query(f"WITH {_FILES_SQL} SELECT DISTINCT book FROM f WHERE part % 7 <> 0 EXCEPT SELECT book FROM f WHERE part % 7 <> 0 AND part % 5 <> 0")
def prune_books(spark, sf_dir):
    known, found = _two_runs(spark, sf_dir)
    left = rc.pruned(known, found, key=["book", "part", "line"])
    return known.select("book").distinct().join(left.select("book"), "book", "left_anti")


@query("SELECT upper(p_name) AS name_fold, arg_min(n, p_partkey) AS name FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part) GROUP BY 1")
def first_writer_name(spark, sf_dir):
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return ed.first_names(table(spark, sf_dir, "part").select(spelled.alias("name"), F.upper("p_name").alias("name_fold"), F.col("p_partkey").alias("arrival")))


@query("""
WITH old AS (SELECT dense_rank() OVER (ORDER BY p_name) AS id, p_name AS name, upper(p_name) AS name_fold FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0 AND p_size < 10)),
new AS (SELECT upper(p_name) AS name_fold, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS a FROM part GROUP BY 1 HAVING upper(p_name) NOT IN (SELECT name_fold FROM old))
SELECT id, name, name_fold FROM old UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM old) + row_number() OVER (ORDER BY a), name, name_fold FROM new""")
def dimension_upsert(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 2 = 0 and p_size < 10").select(F.col("p_name").alias("name")).distinct()
    old = ranked(old, "name", lambda df: shared.kept(spark, df, "names")).select((F.col("place") + 1).alias("id"), "name", F.upper("name").alias("name_fold"))
    return ed.upserted(old, part.select(F.col("p_name").alias("name"), F.upper("p_name").alias("name_fold"), F.col("p_partkey").alias("arrival")))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS value FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def settings_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return rc.upsert(c.filter("key % 2 = 0").withColumn("value", F.lit("old")), c.filter("key % 3 = 0").withColumn("value", F.lit("new")), ["key"])


@query("SELECT c_custkey AS book_id, 'isbn' AS type, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS value FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def identifier_insert_absent(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.lit("isbn").alias("type"))
    return rc.insert_absent(c.filter("book_id % 2 = 0").withColumn("value", F.lit("old")), c.filter("book_id % 3 = 0").withColumn("value", F.lit("new")), ["book_id", "type"])


@query(" SELECT id, language, CASE WHEN id % 4 = 0 THEN 'changed' ELSE publisher END AS publisher FROM books", prelude=VIEWS)
def book_update(spark, sf_dir):
    books = catalog(spark, sf_dir)["books"].select("id", "language", "publisher")
    return rc.updated(books, books.filter("id % 4 = 0").select("id", F.lit("changed").alias("publisher")), "id", ["publisher"])


@query(" SELECT (SELECT count(*) FROM books WHERE library_id % 5 <> 0) AS books, (SELECT count(*) FROM libraries WHERE id % 5 <> 0) AS libraries, (SELECT count(*) FROM book_authors JOIN books ON books.id = book_id WHERE library_id % 5 <> 0) AS book_authors, (SELECT count(*) FROM book_files JOIN books ON books.id = book_id WHERE library_id % 5 <> 0) AS book_files", prelude=VIEWS)
def purge_libraries(spark, sf_dir):
    left = rc.purged(catalog(spark, sf_dir), F.col("id") % 5 == 0)
    out = None
    for name in ("books", "libraries", "book_authors", "book_files"):
        one = left[name].agg(F.count("*").alias(name))
        out = one if out is None else out.join(one, F.lit(True))
    return out


@query("SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey * 100 <= 1200")
def pending_purge(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    libraries = table(spark, sf_dir, "nation").select(k.alias("id"), F.when(k % 3 == 0, "pending_purge").otherwise("active").alias("status"), F.when(k % 2 <= 1, k * 100).alias("purge_at"))
    return browse.expired(libraries, 1200).select("id")


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'syncing' WHEN n_nationkey % 5 = 1 THEN 'queued' WHEN n_nationkey % 3 = 0 THEN 'pending_purge' ELSE 'active' END AS live_status, CASE WHEN n_nationkey % 3 = 0 THEN 'pending_purge' ELSE 'active' END AS after_run FROM nation")
def library_status(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    libraries = table(spark, sf_dir, "nation").select(k.alias("id"), F.when(k % 3 == 0, "pending_purge").otherwise("error").alias("stored"))
    shown = browse.live_status(libraries.withColumn("status", F.when(F.col("stored") == "error", "active").otherwise(F.col("stored"))), F.col("id") % 5 == 0, F.col("id") % 5 == 1)
    return shown.select("id", "live_status", rc.synced_status(F.col("stored")).alias("after_run"))


_EDITIONS = "e AS (SELECT l_orderkey AS book, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS arrival, CASE l_returnflag WHEN 'A' THEN 'epub' WHEN 'N' THEN 'fb2' ELSE 'pdf' END AS fmt, CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 3 ELSE 1 END AS prio, CASE WHEN l_partkey % 3 <> 0 THEN 'P' || l_suppkey END AS publisher, CASE WHEN l_partkey % 4 <> 0 THEN year(l_shipdate)::INTEGER END AS yr, 'T' || l_partkey AS title, l_linestatus AS lang FROM lineitem)"


def _lineitem_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    flag = F.col("l_returnflag")
    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book"),
        F.row_number().over(order).cast("long").alias("arrival"),
        F.when(flag == "A", "epub").when(flag == "N", "fb2").otherwise("pdf").alias("file_format"),
        F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("title"),
        F.lit("").alias("series"),
        F.lit(None).cast("double").alias("series_number"),
        F.lower("l_linestatus").alias("language"),
        F.lit(None).cast("string").alias("annotation"),
        F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("P"), F.col("l_suppkey").cast("string"))).otherwise("").alias("publisher"),
        F.when(F.col("l_partkey") % 4 != 0, F.year("l_shipdate")).otherwise(0).alias("year"),
        F.lit(None).cast("int").alias("rating"),
        empty.alias("authors"),
        empty.alias("genres"),
        F.array().cast("array<struct<type:string,value:string>>").alias("identifiers"),
        F.lit("same").alias("content_hash"),
    ).withColumn("source_path", F.concat(F.lit("p"), F.col("arrival").cast("string")))


@query(f"""WITH RECURSIVE {_EDITIONS},
m AS (SELECT book, arrival, fmt, prio, title, publisher, yr, lang FROM e WHERE arrival = 1
      UNION ALL
      SELECT m.book, e.arrival, CASE WHEN e.prio > m.prio THEN e.fmt ELSE m.fmt END, greatest(e.prio, m.prio), CASE WHEN e.prio > m.prio THEN e.title ELSE m.title END,
             CASE WHEN e.prio > m.prio THEN coalesce(e.publisher, m.publisher) ELSE coalesce(m.publisher, e.publisher) END,
             CASE WHEN e.prio > m.prio THEN coalesce(e.yr, m.yr) ELSE coalesce(m.yr, e.yr) END,
             CASE WHEN e.prio > m.prio THEN e.lang ELSE m.lang END
      FROM m JOIN e ON e.book = m.book AND e.arrival = m.arrival + 1)
SELECT book, title, publisher, yr AS year, lower(lang) AS language, fmt AS metadata_format FROM m QUALIFY row_number() OVER (PARTITION BY book ORDER BY arrival DESC) = 1""")
def merge_editions(spark, sf_dir):
    return ed.merged(_lineitem_editions(spark, sf_dir), ["book"]).select("book", "title", "publisher", "year", "language", "metadata_format")


@query(f"WITH {_EDITIONS}, r AS (SELECT book, arrival, prio, max(prio) OVER (PARTITION BY book ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) SELECT book AS book_id, arrival, prio FROM r WHERE prio >= 2 AND (before IS NULL OR prio > before)")
def cover_choice(spark, sf_dir):
    rows = _lineitem_editions(spark, sf_dir).select(F.col("book").alias("book_id"), "arrival", ed.cover_priority(F.col("file_format")).alias("prio"), F.lit(2).alias("stored_prio"))
    return ed.chosen_covers(rows).select("book_id", "arrival", "prio")


@query(f"WITH {_EDITIONS}, r AS (SELECT book, arrival, fmt, lag(fmt) OVER (PARTITION BY book ORDER BY arrival) AS p FROM e) SELECT book, arrival, fmt AS file_format FROM r WHERE p IS NULL OR p <> fmt")
def format_runs(spark, sf_dir):
    return ed.run_starts(_lineitem_editions(spark, sf_dir).select("book", "arrival", "file_format"), "file_format", ["arrival"], ["book"])


def _resolved_orders(orders: DataFrame) -> DataFrame:
    orders = orders.select(F.col("o_orderkey").alias("id"))
    two = F.array(F.struct(F.lit("amazon").alias("type"), F.concat(F.lit("a"), (F.col("id") % 997).cast("string")).alias("value")), F.struct(F.lit("google").alias("type"), F.concat(F.lit("b"), (F.col("id") % 991).cast("string")).alias("value")))
    rows = orders.select("id", F.lit(1).alias("library"), F.inline(two))
    return ed.resolve(ed.strong_pairs(rows, id_col="id", scope="library"))


# All orders: the least book of each identifier's orders is handed to them until none is lower; one row an order is kept.
@query("""
WITH RECURSIVE i AS (SELECT o_orderkey AS id, 'a' || (o_orderkey % 997) AS v FROM orders UNION ALL SELECT o_orderkey, 'b' || (o_orderkey % 991) FROM orders),
r(id, book) USING KEY (id) AS (SELECT DISTINCT id, id FROM i
      UNION SELECT x.id, min(n.book) FROM (SELECT y.v, min(r.book) AS book FROM recurring.r JOIN i AS y ON y.id = r.id GROUP BY y.v) AS n
            JOIN i AS x ON x.v = n.v JOIN recurring.r AS o ON o.id = x.id GROUP BY x.id, o.book HAVING min(n.book) < o.book)
SELECT id, book FROM r""")
def resolve_identifiers(spark, sf_dir):
    return _resolved_orders(table(spark, sf_dir, "orders"))


_ENRICH = """SELECT o_orderkey AS id, {title} AS title, CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 3 <> 0 OR {keep}) THEN 'own' WHEN o_orderkey % 3 = 0 THEN 'found' END AS publisher,
CASE WHEN o_orderkey % 3 = 0 THEN 2001 END AS year, (o_orderkey % 3 = 0)::INTEGER AS checked, CASE WHEN {changed} THEN sha256('h:enriched') ELSE 'h' END AS content_hash FROM orders"""


def _enriched(spark: SparkSession, sf_dir: str, overwrite: bool) -> DataFrame:
    key, empty = F.col("o_orderkey"), F.array().cast("array<string>")
    null = F.lit(None).cast("string")
    books = table(spark, sf_dir, "orders").select(key.alias("id"), F.lit("t").alias("title"), empty.alias("authors"), empty.alias("genres"), null.alias("annotation"), null.alias("series"), F.lit(None).cast("double").alias("series_number"), F.lit("en").alias("language"), F.when(key % 2 == 0, "own").alias("publisher"), F.lit(None).cast("int").alias("year"), F.create_map().cast("map<string,string>").alias("identifiers"), F.lit("h").alias("content_hash"), F.lit(0).alias("enrichment_checked"), F.lit(0).alias("manually_matched"))
    records = books.filter("id % 3 = 0").select("id", F.lit("new").alias("title"), "authors", "genres", F.lit("").alias("annotation"), F.lit("").alias("series"), F.lit(0.0).alias("series_number"), F.lit("").alias("language"), F.lit("found").alias("publisher"), F.lit(2001).alias("year"), F.array().cast("array<struct<type:string,value:string>>").alias("identifiers"))
    return en.enriched(books, records, overwrite=overwrite).select("id", "title", "publisher", "year", F.col("enrichment_checked").alias("checked"), "content_hash")


@query(_ENRICH.format(title="'t'", keep="true", changed="o_orderkey % 3 = 0"))
def enrich_gaps(spark, sf_dir):
    return _enriched(spark, sf_dir, False)


@query(_ENRICH.format(title="CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 't' END", keep="false", changed="o_orderkey % 3 = 0"))
def enrich_overwrite(spark, sf_dir):
    return _enriched(spark, sf_dir, True)


# ---- events ----------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM s)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY user_id, burst""")
def debounce_sessions(spark, sf_dir):
    return ev.debounced(table(spark, sf_dir, "events"), "user_id", quiet="12 hours")


@query("SELECT event_type || '/' || (user_id % 50) AS key, min(event_id) AS place, arg_max(value, event_id) AS data FROM events GROUP BY 1")
def coalesce_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 50).cast("string")).alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("data"))
    return ev.coalesced(rows, "key")


@query("SELECT user_id, min(event_id) AS place, bool_or(event_type = (SELECT min(event_type) FROM events)) AS force FROM events GROUP BY 1")
def queue_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    least = rows.agg(F.min("event_type").alias("least"))
    return ev.queued(rows.join(F.broadcast(least), F.lit(True)).select("user_id", F.col("event_id").alias("seq"), (F.col("event_type") == F.col("least")).alias("force")), "user_id")


@query("""
WITH RECURSIVE x AS (SELECT user_id AS k, epoch_us(ts) // 1000 AS ms FROM events),
r AS (SELECT k, min(ms) AS ms FROM x GROUP BY k UNION ALL SELECT r.k, (SELECT min(x.ms) FROM x WHERE x.k = r.k AND x.ms >= r.ms + 3600000) FROM r WHERE EXISTS (SELECT 1 FROM x WHERE x.k = r.k AND x.ms >= r.ms + 3600000))
SELECT k AS user_id, ms FROM r""")
def throttle_progress(spark, sf_dir):
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return ev.throttled(table(spark, sf_dir, "events").select("user_id", ms.alias("ms")), "user_id", every=3_600_000)


@query("SELECT n_nationkey::BIGINT AS library_id, CASE WHEN n_nationkey % 3 = 0 THEN 'add' WHEN n_nationkey % 5 = 0 THEN 'remove' ELSE 'replace' END AS change FROM nation WHERE (n_nationkey % 3 = 0) <> (n_nationkey % 5 = 0) OR (n_nationkey % 3 <> 0 AND n_nationkey % 2 = 0)")
def interval_changes(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    jobs = table(spark, sf_dir, "nation").select(k.alias("library_id"))
    have = jobs.filter("library_id % 3 <> 0").withColumn("every", F.lit(60))
    wanted = jobs.filter("library_id % 5 <> 0").withColumn("every", F.when(F.col("library_id") % 2 == 0, 120).otherwise(60))
    return ev.interval_changes(wanted, have)
