"""Answers of online book services, already fetched: JSON text into metadata and cover candidates.  Malformed answers give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as idt
from ..functions import text as tx
from ..functions import web

_VOLUME = "id string, volumeInfo struct<title:string,authors:array<string>,publisher:string,publishedDate:string,description:string,categories:array<string>,industryIdentifiers:array<struct<type:string,identifier:string>>,imageLinks:map<string,string>>"
_DOCS = "docs array<struct<title:string,cover_i:bigint>>"
_ITEMS = "array<struct<imageUrl:string,title:string,bookTitleBare:string>>"
#: Where covers are, and the height of a thumbnail.
COVERS, THUMB_HEIGHT = "https://covers.openlibrary.org/b/id", 450


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def volumes(answers: DataFrame, *, json: str = "json") -> DataFrame:
    """The columns of answers, and metadata of each volume of a list answer {"items": [...]}."""
    rows = answers.withColumn("__v", F.explode(F.from_json(json, f"items array<struct<{_VOLUME.replace('id string, volumeInfo struct', 'id:string,volumeInfo:struct')}>>")["items"]))
    info = F.col("__v.volumeInfo")
    raw = F.transform(F.coalesce(info["industryIdentifiers"], _none("array<struct<type:string,identifier:string>>")), lambda x: F.struct(x["type"].alias("type"), x["identifier"].alias("value")))
    own = F.when(F.coalesce(F.col("__v.id"), F.lit("")) != "", F.array(F.struct(F.lit("google").alias("type"), F.col("__v.id").alias("value")))).otherwise(_none("array<struct<type:string,value:string>>"))
    clean = lambda name: tx.trimmed(F.coalesce(info[name], F.lit("")))
    return rows.select(
        *(c for c in answers.columns if c != json),
        clean("title").alias("title"),
        F.coalesce(info["authors"], _none("array<string>")).alias("authors"),
        clean("description").alias("annotation"),
        clean("publisher").alias("publisher"),
        tx.parse_year(info["publishedDate"]).alias("year"),
        idt.genres(F.coalesce(info["categories"], _none("array<string>"))).alias("genres"),
        idt.clean_identifiers(F.concat(raw, own)).alias("identifiers"),
        web.secure(web.without_curl(F.coalesce(*(F.try_element_at(info["imageLinks"], F.lit(k)) for k in ("extraLarge", "large", "medium", "small", "thumbnail"))))).alias("cover_url"),
    )


def library_covers(answers: DataFrame, *, json: str = "json", by_isbn: bool = False) -> DataFrame:
    """Cover candidates of a search answer {"docs": [...]}; a search by ISBN needs no title."""
    rows = answers.withColumn("__d", F.explode(F.from_json(json, _DOCS)["docs"])).filter("coalesce(__d.cover_i, 0) <> 0")
    at = F.concat(F.lit(f"{COVERS}/"), F.col("__d.cover_i").cast("string"))
    title = F.lit("") if by_isbn else F.coalesce(F.col("__d.title"), F.lit(""))
    return rows.select(*(c for c in answers.columns if c != json), F.lit("openlibrary").alias("source"), title.alias("title"), F.concat(at, F.lit("-M.jpg")).alias("thumb_url"), F.concat(at, F.lit("-L.jpg")).alias("full_url"), F.lit(0).alias("width"), F.lit(0).alias("height"))


def completion_covers(answers: DataFrame, *, json: str = "json") -> DataFrame:
    """Cover candidates of an autocomplete answer, a list of items."""
    rows = answers.withColumn("__i", F.explode(F.from_json(json, _ITEMS))).filter("coalesce(__i.imageUrl, '') <> ''")
    title = F.when(F.coalesce(F.col("__i.title"), F.lit("")) != "", F.col("__i.title")).otherwise(F.coalesce("__i.bookTitleBare", F.lit("")))
    url = F.col("__i.imageUrl")
    return rows.select(*(c for c in answers.columns if c != json), F.lit("goodreads").alias("source"), title.alias("title"), web.thumbnail(url, THUMB_HEIGHT).alias("thumb_url"), web.resized_image(url).alias("full_url"), F.lit(0).alias("width"), F.lit(0).alias("height"))
