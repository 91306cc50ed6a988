"""A Calibre-style library: a SQLite file read by a Python data source.

Tables are read in ranges of row numbers, a partition each.  A path that this machine has is opened in place, read-only; any
other URI is fetched once a worker, so executors need no copy of their own.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import sqlite3
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import identity as idt
from ..functions import text as tx
from ..plans.editions import native_key

#: Tables and the columns read of each.
TABLES = {
    "books": "id long, title string, path string, series_index double, has_cover long, pubdate string, timestamp string",
    "authors": "id long, name string",
    "series": "id long, name string",
    "tags": "id long, name string",
    "publishers": "id long, name string",
    "languages": "id long, lang_code string",
    "ratings": "id long, rating long",
    "comments": "id long, book long, text string",
    "data": "id long, book long, format string, uncompressed_size long, name string",
    "identifiers": "id long, book long, type string, val string",
    "books_authors_link": "id long, book long, author long",
    "books_series_link": "id long, book long, series long",
    "books_tags_link": "id long, book long, tag long",
    "books_publishers_link": "id long, book long, publisher long",
    "books_ratings_link": "id long, book long, rating long",
    "books_languages_link": "id long, book long, lang_code long, item_order long",
    "custom_columns": "id long, label string, name string, datatype string",
}
_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _value(kind: str, x):
    if x is None or kind == "string":
        return x if x is None or isinstance(x, str) else str(x)
    return int(x) if kind == "long" else float(x)


_FETCHED: dict[str, str] = {}


def _local(path: str) -> str:
    """A path that sqlite3 can open: the file itself, or a copy that goes with the process."""
    plain = re.sub("^file:(//)?", "", path)
    if "://" not in plain:
        return plain
    if path not in _FETCHED:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_stream(at) as data, tempfile.NamedTemporaryFile(suffix=".db", delete=False) as copy:
            shutil.copyfileobj(data, copy)
        atexit.register(os.unlink, copy.name)
        _FETCHED[path] = copy.name
    return _FETCHED[path]


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{_local(path)}?mode=ro", uri=True)


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[tuple[str, str]], rows: int):
        self.path, self.table, self.columns, self.rows = path, table, columns, rows

    def partitions(self):
        with contextlib.closing(_open(self.path)) as db:
            low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {self.table}").fetchone()
        return [_Rows(at, min(high, at + self.rows - 1)) for at in range(low, high + 1, self.rows)] or [_Rows(0, -1)]

    def read(self, partition):
        with contextlib.closing(_open(self.path)) as db:
            rows = db.execute(f"SELECT {', '.join(n for n, _ in self.columns)} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
            while got := rows.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array([_value(k, r[i]) for r in got], _KINDS[k]) for i, (_, k) in enumerate(self.columns)], names=[n for n, _ in self.columns])


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("table", ...)``; ``columns`` as 'name type, ...' for other tables, ``rows`` of a partition."""

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        return self.options.get("columns") or TABLES[self.options["table"]]

    def reader(self, schema):
        spec = self.schema()
        return _Reader(self.options["path"], self.options["table"], [tuple(c.split()) for c in spec.split(", ")], int(self.options.get("rows", 100_000)))


def table(spark: SparkSession, path: str, name: str, columns: str | None = None) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", path).option("table", name)
    return (reader.option("columns", columns) if columns else reader).load()


def page_counts(spark: SparkSession, path: str) -> DataFrame:
    """(book, pages) of the custom column labelled 'pages'; none if the library has no such column."""
    found = table(spark, path, "custom_columns").filter("label = 'pages'").select("id").orderBy("id").first()
    if found is None:
        return spark.createDataFrame([], "book long, pages int")
    rows = table(spark, path, f"custom_column_{int(found[0])}", "book long, value long")
    return rows.filter("value > 0").select("book", F.col("value").cast("int").alias("pages"))


def _listed(links: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """Names linked to each book, in the order of the links."""
    rows = links.select("book", F.col("id").alias("o"), F.col(column).alias("k")).join(names.select(F.col("id").alias("k"), "name"), "k")
    return rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("o", "name"))).alias("x")).select("book", F.transform("x", lambda x: x["name"]).alias(out))


def editions(tables: dict[str, DataFrame], library_id: int, pages: DataFrame | None = None) -> DataFrame:
    """One edition for each file of each book, in the order of book and format."""
    t = tables
    books, data = t["books"].withColumnRenamed("id", "book"), t["data"].drop("id")
    rows = books.join(data.withColumnRenamed("name", "file_name"), "book")
    rows = rows.join(_listed(t["books_authors_link"], t["authors"], "author", "authors"), "book", "left")
    rows = rows.join(_listed(t["books_tags_link"], t["tags"], "tag", "genres"), "book", "left")
    rows = rows.join(_listed(t["books_publishers_link"], t["publishers"], "publisher", "publishers"), "book", "left")
    rows = rows.join(_listed(t["books_series_link"], t["series"], "series", "all_series"), "book", "left")
    rows = rows.join(t["comments"].groupBy("book").agg(F.min_by("text", "id").alias("annotation")), "book", "left")
    stars = t["books_ratings_link"].join(t["ratings"].select(F.col("id").alias("rating"), F.col("rating").alias("raw")), "rating")
    rows = rows.join(stars.filter("raw >= 2").groupBy("book").agg(F.max(tx.rating_stars(F.col("raw"))).alias("rating")), "book", "left")
    spoken = t["books_languages_link"].withColumnRenamed("lang_code", "k").join(t["languages"].select(F.col("id").alias("k"), "lang_code"), "k")
    first = Window.partitionBy("book").orderBy("item_order", "id")
    rows = rows.join(spoken.withColumn("n", F.row_number().over(first)).filter("n = 1").select("book", "lang_code"), "book", "left")
    ids = t["identifiers"].groupBy("book").agg(F.array_sort(F.collect_list(F.struct("id", "type", F.col("val").alias("value")))).alias("x"))
    rows = rows.join(ids.select("book", F.transform("x", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))).alias("identifiers")), "book", "left")
    rows = rows.join(pages, "book", "left") if pages is not None else rows.withColumn("pages", F.lit(None).cast("int"))
    ending = F.lower("format")
    return rows.select(
        F.lit(library_id).cast("long").alias("library_id"),
        native_key("calibre", F.col("book")).alias("library_key"),
        F.lit(False).alias("derive_identity"),
        "title",
        "authors",
        "genres",
        "annotation",
        F.get("all_series", F.lit(0)).alias("series"),
        F.when(F.size("all_series") > 0, F.col("series_index")).alias("series_number"),
        idt.language(F.col("lang_code")).alias("language"),
        F.get("publishers", F.lit(0)).alias("publisher"),
        tx.parse_year(F.col("pubdate")).alias("year"),
        F.coalesce("pages", F.lit(0)).alias("pages"),
        "rating",
        tx.library_timestamp(F.col("timestamp")).alias("added_at"),
        "identifiers",
        F.concat("path", F.lit("/"), "file_name", F.lit("."), ending).alias("source_path"),
        ending.alias("file_format"),
        F.coalesce("uncompressed_size", F.lit(0)).alias("file_size"),
        F.row_number().over(Window.partitionBy("book").orderBy("format")).cast("long").alias("arrival"),
    )


def read(spark: SparkSession, path: str, library_id: int) -> DataFrame:
    names = [n for n in TABLES if n != "custom_columns"]
    return editions({n: table(spark, path, n) for n in names}, library_id, page_counts(spark, path))
