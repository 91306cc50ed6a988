"""Metadata from elsewhere: gaps filled from a book's own file or an online record, and records that a user chose or wrote.

Books here carry their lists: authors and genres as arrays, identifiers as a map from type to value.  A record has the
columns of bibspark.schema.METADATA without the cover, keyed by book id; a book without a record stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as idt
from ..functions import text as tx


def _present(column: Column) -> Column:
    return F.when(tx.trimmed(column) != "", column)


def enriched(books: DataFrame, records: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """books after their records; ``overwrite`` is for a record that a user chose, which owns the book from then on.

    Filling gaps: annotation, publisher, year, genres if there are none, and identifiers of new types.  Overwriting replaces
    these and title, language, authors and series by what the record has; what it leaves out stays.  A change gives a new
    hash; every book with a record counts as checked, changed or not.
    """
    r = records.select(*(F.col(c).alias(f"r_{c}") for c in ("id", "title", "authors", "genres", "annotation", "series", "series_number", "language", "publisher", "year", "identifiers")))
    rows = books.join(r, books.id == F.col("r_id"), "left")
    found = F.col("r_id").isNotNull()
    empty = F.array().cast("array<string>")
    new_genres = F.when(F.size(idt.genres(F.coalesce("r_genres", empty))) > 0, idt.genres(F.coalesce("r_genres", empty)))
    new_ids = F.map_from_entries(F.transform(F.coalesce(idt.clean_identifiers(F.col("r_identifiers")), F.array().cast("array<struct<type:string,value:string>>")), lambda x: F.struct(x["type"], x["value"])))
    old_ids = F.coalesce("identifiers", F.create_map().cast("map<string,string>"))
    keep = lambda base, extra: F.map_concat(base, F.map_filter(extra, lambda k, _: ~F.map_contains_key(base, k)))
    year = F.when(F.col("r_year") != 0, F.col("r_year"))
    number = F.when(F.col("r_series_number") != 0, F.col("r_series_number"))
    pick = (lambda new, old: F.coalesce(new, old)) if overwrite else (lambda new, old: F.coalesce(old, new))
    out = {
        "annotation": pick(_present(F.col("r_annotation")), F.col("annotation")),
        "publisher": pick(F.when(F.col("r_publisher") != "", F.col("r_publisher")), F.col("publisher")),
        "year": pick(year, F.col("year")),
        "genres": F.coalesce(pick(new_genres, F.when(F.size("genres") > 0, F.col("genres"))), F.col("genres")),
        "identifiers": keep(new_ids, old_ids) if overwrite else keep(old_ids, new_ids),
    }
    if overwrite:
        series = _present(F.col("r_series"))
        out |= {
            "title": F.coalesce(_present(F.col("r_title")), F.col("title")),
            "language": F.coalesce(_present(F.col("r_language")), F.col("language")),
            "authors": F.coalesce(F.when(F.size("r_authors") > 0, F.col("r_authors")), F.col("authors")),
            "series": F.coalesce(series, F.col("series")),
            "series_number": F.when(series.isNotNull(), F.coalesce(number, F.col("series_number"))).otherwise(F.col("series_number")),
        }
    changed = F.lit(False)
    for name, value in out.items():
        if name != "identifiers":
            changed = changed | ~value.eqNullSafe(F.col(name))
    flags = {
        "content_hash": F.when(found & changed, F.sha2(F.concat(F.coalesce("content_hash", F.lit("")), F.lit(":enriched")), 256)).otherwise(F.col("content_hash")),
        "enrichment_checked": F.when(found, 1).otherwise(F.col("enrichment_checked")),
        "manually_matched": F.when(found & F.lit(overwrite), 1).otherwise(F.col("manually_matched")),
    }
    values = {k: F.when(found, v).otherwise(F.col(k)) for k, v in out.items()} | flags
    return rows.select(*(values.get(c, F.col(c)).alias(c) for c in books.columns))


def edited(books: DataFrame, edits: DataFrame) -> DataFrame:
    """books after a user's edits: an overwriting record that replaces all identifiers if it has a list, even an empty one."""
    lists = edits.filter("identifiers is not null").select(F.col("id").alias("e_id"), idt.clean_identifiers(F.col("identifiers")).alias("e_ids"))
    out = enriched(books, edits, overwrite=True)
    out = out.join(lists, out.id == F.col("e_id"), "left")
    exact = F.map_from_entries(F.transform("e_ids", lambda x: F.struct(x["type"], x["value"])))
    return out.withColumn("identifiers", F.when(F.col("e_id").isNotNull(), exact).otherwise(F.col("identifiers"))).select(*books.columns)


def backfilled(books: DataFrame, parsed: DataFrame) -> DataFrame:
    """books not yet checked after their own file's metadata: the annotation if there is none, and identifiers of new types."""
    r = parsed.select(F.col("id").alias("r_id"), F.col("annotation").alias("r_annotation"), F.col("identifiers").alias("r_identifiers"))
    rows = books.join(r, (books.id == F.col("r_id")) & (books.metadata_checked == 0), "left")
    found = F.col("r_id").isNotNull()
    new = F.map_from_entries(F.transform(F.coalesce(idt.clean_identifiers(F.col("r_identifiers")), F.array().cast("array<struct<type:string,value:string>>")), lambda x: F.struct(x["type"], x["value"])))
    old = F.coalesce("identifiers", F.create_map().cast("map<string,string>"))
    values = {
        "annotation": F.coalesce("annotation", _present(F.col("r_annotation"))),
        "identifiers": F.when(found, F.map_concat(old, F.map_filter(new, lambda k, _: ~F.map_contains_key(old, k)))).otherwise(F.col("identifiers")),
        "metadata_checked": F.when(found, 1).otherwise(F.col("metadata_checked")),
    }
    return rows.select(*(values.get(c, F.col(c)).alias(c) for c in books.columns))
