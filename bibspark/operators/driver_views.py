"""A catalogue over star-schema tables: orders as books, customers as series, suppliers as authors, part types as genres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared
from . import search
from .browse import Catalog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> str:
    """Seconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    return f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "supplier", "part", "lineitem", "nation")}
    customers = t["customer"].select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    books = t["orders"].join(customers, F.col("o_custkey") == F.col("c_custkey"))
    books = books.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_nationkey").cast("long").alias("library_id"),
        F.concat("c_name", F.lit(" / "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_custkey").alias("series_id"),
        F.lit(None).cast("double").alias("series_number"),
        F.col("o_orderstatus").alias("language"),
        F.lit(None).cast("string").alias("annotation"),
        F.col("c_mktsegment").alias("publisher"),
        F.upper("c_mktsegment").alias("publisher_fold"),
        F.year("o_orderdate").alias("year"),
        F.when(~F.col("o_orderpriority").startswith("4"), 6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("rating"),
        F.expr(seconds("o_orderdate")).alias("added_at"),
        F.expr(seconds("cast(trunc(o_orderdate, 'MONTH') as timestamp_ntz)")).alias("imported_at"),
    )
    named = lambda df, key, name: df.select(F.col(key).cast("long").alias("id"), F.col(name).alias("name"), F.upper(name).alias("name_fold"))
    kinds = t["part"].select("p_type").distinct()
    genres = kinds.select(F.row_number().over(Window.orderBy("p_type")).cast("long").alias("id"), F.col("p_type").alias("name"), F.upper("p_type").alias("name_fold"))
    lines = t["lineitem"]
    typed = lines.select("l_orderkey", "l_partkey").join(t["part"].select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return {
        "books": books,
        "libraries": named(t["nation"], "n_nationkey", "n_name").drop("name_fold"),
        "series": named(t["customer"], "c_custkey", "c_name"),
        "authors": named(t["supplier"], "s_suppkey", "s_name"),
        "genres": genres,
        "book_authors": lines.select(F.col("l_orderkey").alias("book_id"), F.col("l_suppkey").alias("author_id")).distinct(),
        "book_genres": typed.join(genres, typed.p_type == genres.name).select(F.col("l_orderkey").alias("book_id"), F.col("id").alias("genre_id")).distinct(),
        "book_files": lines.select(F.col("l_orderkey").alias("book_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("file_format"), F.col("l_quantity").cast("long").alias("file_size"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") * 100).alias("pages")),
        "book_identifiers": t["orders"].select(F.col("o_orderkey").alias("book_id"), F.lit("isbn").alias("type"), F.format_string("978%010d", "o_custkey").alias("value")),
    }


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The stored index of documents, their language as title; the words asked for are plain, so no folding UDF is needed."""
    path = f"{sf_dir}/documents.parquet"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("title"), F.col("text").alias("annotation"))
    terms = search.term_table(docs, ("title", "annotation"), id_col="doc_id", ascii_only=True)
    return search.stored(spark, terms, f"{shared.shared_dir(spark)}/index/documents-{shared.state_of(spark, path)}")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).terms
