"""From the editions of a run to books: who belongs together, and what a book says when its editions disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import graph, shared
from ..functions import identity as idt
from ..functions import text as tx
from ..ranks import ranked
from ..schema import MANUAL_COVER, UNDEFINED_LANGUAGE

#: How much a format's metadata is trusted.
FORMAT_PRIORITY = {"epub": 4, "fb2": 3, "mobi": 2, "azw3": 2, "azw": 2, "pdf": 1}


def format_priority(file_format: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FORMAT_PRIORITY.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(file_format)), F.lit(0))


def with_identity(editions: DataFrame) -> DataFrame:
    """editions with cleaned language, genres and identifiers, their key and their hash."""
    named = editions.withColumn("authors", F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: a.isNotNull()))
    named = named.withColumn("__folds", tx.fold_all(F.col("authors")))  # a column of its own: lambdas can't hold a UDF
    out = named.withColumns({
        "language": idt.language(F.col("language")),
        "genres": idt.genres(F.coalesce("genres", F.array().cast("array<string>"))),
        "identifiers": idt.clean_identifiers(F.coalesce("identifiers", F.array().cast("array<struct<type:string,value:string>>"))),
        "authors": idt.distinct_folds(F.col("authors"), F.col("__folds")),
    })
    out = out.drop("__folds")
    out = out.withColumn("library_key", F.when(F.col("derive_identity"), idt.group_key(F.col("title"), F.col("authors"), F.col("language"))).otherwise(F.col("library_key")))
    return out.withColumn("content_hash", idt.content_hash(*(F.col(c) for c in ("title", "authors", "series", "series_number", "language", "annotation", "publisher", "year", "rating", "genres", "identifiers"))))


# ---- entity resolution -----------------------------------------------------------------------------------------------


def strong_pairs(records: DataFrame, *, id_col: str, scope: str, type_col: str = "type", value_col: str = "value") -> DataFrame:
    """(id, other): each record and the least record that shares a strong identifier with it in its scope."""
    strong = records.filter(idt.is_strong(F.col(type_col), F.col(value_col))).select(F.col(id_col).alias("id"), F.col(scope).alias("scope"), F.col(type_col).alias("t"), F.col(value_col).alias("v"))
    least = strong.groupBy("scope", "t", "v").agg(F.min("id").alias("other"))
    return strong.join(least, ["scope", "t", "v"]).select("id", "other").distinct()


def resolve(pairs: DataFrame) -> DataFrame:
    """(id, book): the state that repeated runs settle on, every record with the least one it is joined to by any chain.

    Large and small stars alternate until nothing changes, in a number of rounds that grows with the logarithm of the largest
    component in any order of its records.  Each round is checkpointed; the driver sees two numbers.
    """
    shared.shared_dir(pairs.sparkSession)  # where checkpoints go
    pairs = pairs.select("id", "other").checkpoint()
    roots = graph.components(pairs.select(F.col("id").alias("u"), F.col("other").alias("v")), lambda now: now.checkpoint())
    every = pairs.select("id").unionAll(pairs.select("other")).distinct()
    return every.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("book"))


# ---- ordered merge ---------------------------------------------------------------------------------------------------

_BOOK = (
    "title string, series string, series_number double, language string, annotation string, publisher string, year int, rating int, authors array<string>, genres array<string>, identifiers map<string,string>,"
    " metadata_format string, content_hash string, formats map<string,string>"
)


def merged(editions: DataFrame, key: list[str], *, locked: Column | None = None) -> DataFrame:
    """One row for each key: its editions folded in order of arrival.

    An edition of a strictly better format than the one that owns the book's metadata overwrites; so does a changed edition
    of the owning format, unless another file of that format is there; any other only fills gaps.  Overwriting replaces what the
    edition supplies and never erases.  Filling gaps never touches title, authors and genres, and adds identifiers of new types.
    Because an edition may leave fields out, order matters, and the fold is a higher-order aggregate over the sorted editions of
    a book (bounded by a book's files), with no Python.
    """
    rows = editions.withColumn("locked", F.lit(False) if locked is None else F.coalesce(locked, F.lit(False)))
    fields = ["arrival", "source_path", "file_format", "title", "series", "series_number", "language", "annotation", "publisher", "year", "rating", "authors", "genres", "identifiers", "content_hash", "locked"]
    grouped = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))
    start = F.from_json(F.lit("{}"), _BOOK)
    folded = F.aggregate("e", F.struct(F.lit(0).alias("n"), start.alias("b")), lambda acc, e: F.struct((acc["n"] + 1).alias("n"), _step(acc["n"] == 0, acc["b"], e).alias("b")))
    out = grouped.select(*key, folded["b"].alias("b")).select(*key, "b.*")
    idents = F.array_sort(F.transform(F.map_entries("identifiers"), lambda x: F.struct(x["key"].alias("type"), x["value"].alias("value"))))
    return out.withColumns({"identifiers": idents, "language": F.when(F.coalesce("language", F.lit("")) == "", UNDEFINED_LANGUAGE).otherwise(F.col("language"))}).drop("formats")


def _step(first: Column, book: Column, e: Column) -> Column:
    text = lambda c: F.when(tx.trimmed(c) != "", c)
    known = lambda c: F.when(c != "", c)
    language = F.when((e["language"] != "") & (e["language"] != UNDEFINED_LANGUAGE), e["language"])
    number = F.when(e["year"] != 0, e["year"])
    own = F.lower(e["file_format"])
    better = format_priority(e["file_format"]) > format_priority(F.coalesce(book["metadata_format"], F.lit("")))
    path = F.try_element_at(book["formats"], own)
    sibling = path.isNotNull() & (path != e["source_path"])
    edited = (own == book["metadata_format"]) & (e["content_hash"] != book["content_hash"]) & ~sibling
    over = first | (~e["locked"] & F.coalesce(better | edited, F.lit(False)))
    pick = lambda new, old: F.when(over, F.coalesce(new, old)).otherwise(F.coalesce(old, new))
    owned = lambda new, old: F.when(over, F.coalesce(new, old)).otherwise(old)
    nonempty = lambda c: F.when(F.size(c) > 0, c)
    series = known(e["series"])
    take_series = series.isNotNull() & (over | book["series"].isNull())
    new_ids = F.map_from_entries(F.transform(e["identifiers"], lambda x: F.struct(x["type"], x["value"])))
    old_ids = F.coalesce(book["identifiers"], F.create_map().cast("map<string,string>"))
    keep = lambda base, extra: F.map_concat(base, F.map_filter(extra, lambda k, _: ~F.map_contains_key(base, k)))
    formats = F.coalesce(book["formats"], F.create_map().cast("map<string,string>"))
    lang_old = F.when(book["language"] != UNDEFINED_LANGUAGE, book["language"])
    made = F.struct(
        owned(known(e["title"]), book["title"]).alias("title"),
        F.when(take_series, e["series"]).otherwise(book["series"]).alias("series"),
        F.when(take_series, e["series_number"]).otherwise(book["series_number"]).alias("series_number"),
        F.coalesce(pick(language, lang_old), F.lit(UNDEFINED_LANGUAGE)).alias("language"),
        pick(text(e["annotation"]), book["annotation"]).alias("annotation"),
        pick(known(e["publisher"]), book["publisher"]).alias("publisher"),
        pick(number, book["year"]).alias("year"),
        pick(e["rating"], book["rating"]).alias("rating"),
        owned(nonempty(e["authors"]), book["authors"]).alias("authors"),
        owned(nonempty(e["genres"]), book["genres"]).alias("genres"),
        F.when(over, keep(new_ids, old_ids)).otherwise(keep(old_ids, new_ids)).alias("identifiers"),
        F.when(over, own).otherwise(book["metadata_format"]).alias("metadata_format"),
        F.when(over, e["content_hash"]).otherwise(book["content_hash"]).alias("content_hash"),
        F.when(F.map_contains_key(formats, own), formats).otherwise(F.map_concat(formats, F.create_map(own, e["source_path"]))).alias("formats"),
    )
    return made.cast(f"struct<{_BOOK.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int').replace(' array', ':array').replace(' map', ':map')}>")


# ---- dimensions ------------------------------------------------------------------------------------------------------


def first_names(names: DataFrame, *, fold: str = "name_fold", name: str = "name", arrival: str = "arrival") -> DataFrame:
    """(name_fold, name): the spelling that came first for each fold."""
    return names.groupBy(fold).agg(F.min_by(name, F.struct(arrival, name)).alias(name))


def upserted(existing: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, name_fold): existing rows as they are, and new folds with new ids in order of arrival.

    ``names`` has name, name_fold and arrival.  New ids follow the largest one; they are places of the new folds alone, dealt in ranges.
    """
    new = names.groupBy("name_fold").agg(F.min_by("name", F.struct("arrival", "name")).alias("name"), F.min("arrival").alias("arrival"))
    new = new.join(existing.select("name_fold"), "name_fold", "left_anti")
    spark = existing.sparkSession
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = ranked(new, [F.asc("arrival"), F.asc("name_fold")], lambda df: shared.kept(spark, df, "names"))
    return existing.select("id", "name", "name_fold").unionByName(numbered.select((F.col("place") + 1 + top).alias("id"), "name", "name_fold"))


def arrived(editions: DataFrame, now: int) -> DataFrame:
    """editions with added_at, the source's date or else the run's time, and imported_at, the run's time; a merge keeps a book's first."""
    return editions.withColumns({"added_at": F.when(F.col("added_at") > 0, F.col("added_at")).otherwise(now), "imported_at": F.lit(now).cast("long")})


def native_key(kind: str, native_id: Column) -> Column:
    """The key of a book that its source names itself; such books are never matched by identifiers."""
    return F.concat(F.lit(f"{kind}:"), native_id.cast("string"))


def linked(book_names: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """(book_id, <kind>_id) of (book_id, name_fold), each pair once."""
    return book_names.join(entities.select("id", "name_fold"), "name_fold").select("book_id", F.col("id").alias(f"{kind}_id")).dropDuplicates()


# ---- covers ----------------------------------------------------------------------------------------------------------


def cover_priority(file_format: Column, manual: Column | None = None) -> Column:
    own = format_priority(file_format)
    return own if manual is None else F.when(manual, MANUAL_COVER).otherwise(own)


def chosen_covers(covers: DataFrame) -> DataFrame:
    """Of (book_id, arrival, prio, cover, stored_prio): the covers saved in turn, each better than all before it in the run and no worse than the stored one."""
    before = F.max("prio").over(Window.partitionBy("book_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    return covers.withColumn("before", before).filter((F.col("prio") >= F.col("stored_prio")) & (F.col("before").isNull() | (F.col("prio") > F.col("before")))).drop("before")


def run_starts(rows: DataFrame, key: str, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """The rows at which a key begins a run of equal keys."""
    previous = F.lag(key).over(Window.partitionBy(*(partition or [])).orderBy(*order))
    return rows.withColumn("__p", previous).filter(F.col("__p").isNull() | (F.col("__p") != F.col(key))).drop("__p")
