"""Full-text search over a term table, ranked by BM25.

The index is derived from the catalogue: one row for each document, column and term with its places.  It is stored once for each
state of what it indexes, in order of terms, so that Parquet statistics skip what a query doesn't ask for.  Phrases never leave a
column; clauses are joined by AND over the whole document.  Figures of the collection are those of the whole index, so
facets are applied to scores, not before them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("title", "authors", "series", "annotation")


def plain_text(text: str) -> str:
    """Lower case, without marks of decomposed letters and of Latin letters with a single mark."""
    out = []
    for ch in text:
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) == 2 and unicodedata.category(parts[1]) == "Mn" and unicodedata.name(ch, "").startswith("LATIN "):
            ch = parts[0]
        if unicodedata.category(ch) != "Mn":
            out.append(ch.lower() if len(ch.lower()) == 1 else ch)
    return "".join(out)


@F.pandas_udf(T.StringType())
def plain(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else plain_text(x))


def is_term_char(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co"


def terms_of(text: str) -> list[str]:
    return [t for t in "".join(c if is_term_char(c) else " " for c in plain_text(text)).split(" ") if t]


def term_array(text: Column, *, ascii_only: bool = False) -> Column:
    """A text's terms in order; texts known to need no folding skip the UDF."""
    low = F.lower(text) if ascii_only else plain(text)
    return F.filter(F.split(low, "[^\\p{L}\\p{N}\\p{Co}]+"), lambda t: t != "")


@dataclass(frozen=True)
class Clause:
    """A phrase of one or more terms, in one column or in any."""

    terms: tuple[str, ...]
    column: str | None = None


def clauses(query: str, column: str | None = None) -> list[Clause]:
    """A clause for each blank-separated word of user text, none of which is an operator; one without terms matches nothing."""
    return [Clause(tuple(terms_of(w)), column) for w in re.split(r"\s+", query) if w]


def term_table(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, *, id_col: str = "id", ascii_only: bool = False) -> DataFrame:
    """(doc_id, col, term, places): partially aggregated where the text is read."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), term_array(F.coalesce(F.col(c), F.lit("")), ascii_only=ascii_only).alias("terms")) for c in columns)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), each.alias("t")).select("doc_id", "t.col", F.posexplode("t.terms").alias("pos", "term"))
    return rows.groupBy("doc_id", "col", "term").agg(F.array_sort(F.collect_list("pos")).alias("places"))


def _back(by: int) -> Callable[[Column], Column]:
    return lambda place: place - by


def occurrences(terms: DataFrame, clause: Clause) -> DataFrame:
    """(doc_id, f): how often a phrase stands in each document that has it."""
    if not clause.terms:
        return terms.filter(F.lit(False)).select("doc_id", F.lit(0).cast("long").alias("f"))
    rows = terms if clause.column is None else terms.filter(F.col("col") == clause.column)
    first, *rest = clause.terms
    found = rows.filter(F.col("term") == first).select("doc_id", "col", "places")
    for i, term in enumerate(rest, 1):
        after = rows.filter(F.col("term") == term).select("doc_id", "col", F.transform("places", _back(i)).alias("next"))
        found = found.join(after, ["doc_id", "col"]).select("doc_id", "col", F.array_intersect("places", "next").alias("places"))
    return found.filter(F.size("places") > 0).groupBy("doc_id").agg(F.sum(F.size("places")).cast("long").alias("f"))


@dataclass(frozen=True)
class Index:
    """A stored index: its term table, and (doc_id, d), the number of terms of each document."""

    terms: DataFrame
    sizes: DataFrame


def sizes_of(terms: DataFrame) -> DataFrame:
    return terms.groupBy("doc_id").agg(F.sum(F.size("places")).alias("d"))


def stored(spark: SparkSession, terms: DataFrame, uri: str) -> Index:
    """The index at ``uri``, written there first unless it is there; name it by the state of what it indexes (shared.state_of)."""
    table = shared.kept_as(spark, terms.repartitionByRange("term").sortWithinPartitions("term", "doc_id"), f"{uri}/terms")
    return Index(table, shared.kept_as(spark, sizes_of(table), f"{uri}/sizes"))


def bm25(terms: DataFrame, match: list[Clause], docs: DataFrame | None = None, *, sizes: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of the documents that match every clause; the best score is the least.

    ``docs`` (doc_id) names all documents of the index where some may have no terms; ``sizes`` are stored ones.  Every clause's
    hits are found once and meet by document, where both the scores and each clause's number of documents come from.
    """
    if not match:
        return terms.filter(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))
    sizes = sizes_of(terms) if sizes is None else sizes
    if docs is not None:
        sizes = docs.join(sizes, "doc_id", "left").select("doc_id", F.coalesce("d", F.lit(0)).alias("d"))
    whole = sizes.agg(F.count("*").alias("n_docs"), F.avg("d").alias("avgdl"))
    every = [occurrences(terms, clause).select("doc_id", F.lit(i).alias("i"), "f") for i, clause in enumerate(match)]
    hits = reduce(DataFrame.unionAll, every).groupBy("doc_id").agg(*(F.sum(F.when(F.col("i") == i, F.col("f"))).alias(f"f{i}") for i in range(len(match))))
    numbers = hits.agg(*(F.count(f"f{i}").alias(f"n{i}") for i in range(len(match))))
    both = [F.col(f"f{i}").isNotNull() for i in range(len(match))]
    found = hits.filter(reduce(Column.__and__, both)).join(sizes, "doc_id")
    found = found.join(F.broadcast(whole), F.lit(True)).join(F.broadcast(numbers), F.lit(True))  # one row each
    score = F.lit(0.0)
    for i in range(len(match)):
        n = F.col(f"n{i}")
        idf = F.log((F.col("n_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        score = score - idf * (F.col(f"f{i}") * (K1 + 1)) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("d") / F.col("avgdl")))
    return found.select("doc_id", score.alias("score"))


def match_count(terms: DataFrame, match: list[Clause]) -> DataFrame:
    found = None
    for clause in match:
        hits = occurrences(terms, clause).select("doc_id")
        found = hits if found is None else found.join(hits, "doc_id", "left_semi")
    return found.agg(F.count("*").alias("docs"))
