"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and share ``growth`` times all words; a target
stops at ``most`` times its source's words and the excess is shared out again by weight until none is above.

Inclusion: a document of a source is expected e = min(most, level * 2 ** (tilt * class)) times, class being the floor of its size's
binary logarithm: longer documents, which fill a sequence with one text, are likelier.  It counts in steps of 2 ** -20.  A source's level is the one at which its
documents' expected words sum to its target; a source has at most 64 classes, so it is found from as many sums.

Copies: every document gets floor(e) whole copies for certain, and one more with the inclusion probability p = e - floor(e).  These
documents are ranked by Q = odds(U) / odds(p), U a hash of the document, and taken in this order while their words fit what the
certain copies leave of the target: a sample of fixed size in words with unequal probabilities.  The first that doesn't fit
ends the main part; of the ``reach`` that follow in order, at least, those that still fit are taken as well.

A source's order is cut by a histogram of ``BINS`` bins over Q / (1 + Q), summed with partial aggregation, by groups of bins first; only
the documents from the bin of the cut to the end of the reach are sorted, so that a source with a third of all rows lands in no single task.  U
depends on the document alone: reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ranks import ranked
from . import files

BINS, GROUP = 1 << 16, 1 << 8


def targets(sources: DataFrame, *, weights: Sequence[float] = (5, 2, 1), growth: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, source, source_size, target) of (source, source_size); src is the source's place."""
    spark = sources.sparkSession
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = ranked(sources, "source", lambda df: files.written(spark, df, "ranked")).withColumns({"w": weight, "cap": F.col("source_size") * float(most)})
    table = files.written(spark, table, "sources")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * float(growth)
    level, capped = 0.0, None
    while True:  # every round caps at least one more source
        above = F.col("cap") < F.col("w") * level
        n, caps, rest = table.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - (caps or 0.0)) / rest
    return table.select(F.col("place").alias("src"), "source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def _steps(e: str) -> str:
    """Expected copies in steps of 2 ** -20: the smallest inclusion probability that counts, so that ranks never crowd in one bin."""
    return f"(floor(({e}) * 1048576D + 0.5D) / 1048576D)"


def levels(classes: DataFrame, table: DataFrame, *, most: float, tilt: float) -> DataFrame:
    """table and ``level`` and ``room``: words that certain copies leave; classes are the sums (source, class, words) of sources."""
    weight = f"pow(2D, {float(tilt)}D * x.class)"
    # The longest classes reach ``most`` first, so i of them at the front are capped; the first i that holds is right.
    whole = f"aggregate(slice(c, 1, i), 0D, (a, x) -> a + {float(most)}D * x.words)"
    free = f"aggregate(slice(c, i + 1, size(c) - i), 0D, (a, x) -> a + {weight} * x.words)"
    tried = f"transform(sequence(0, size(c)), i -> named_struct('i', i, 'level', if(i = size(c), cast('infinity' as double), (target - {whole}) / {free})))"
    fits = f"y -> y.i = size(c) or y.level * pow(2D, {float(tilt)}D * c[y.i].class) <= {float(most)}D"
    sums = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "words")), asc=False).alias("c"))
    sums = sums.withColumnRenamed("source", "of")
    out = table.join(sums, F.col("source").eqNullSafe(F.col("of"))).withColumn("c", F.expr("filter(c, x -> x.words > 0)"))
    out = out.withColumn("level", F.expr(f"if(size(c) = 0 or target <= 0, 0D, filter({tried}, {fits})[0].level)"))
    sure = f"aggregate(c, 0D, (a, x) -> a + x.words * floor({_steps(f'least({float(most)}D, level * {weight})')}))"
    return out.withColumn("room", F.expr(f"target - {sure}")).drop("c", "of")


def _cuts(units: DataFrame, reach: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(src, low, left, high) of sources whose room is filled: the bin where that happens, the words left before it, and the bin where
    the reach ends, null if no more documents are there.

    Bins stand in groups of ``GROUP``: running sums go over a source's groups, and then over the bins of the one group that
    matters, so that a task sees BINS / GROUP or GROUP rows of a source.
    """
    upto = lambda what, key, order: F.sum(what).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    bins = units.filter("bin is not null").groupBy("src", "bin", "room").agg(F.sum("words").alias("s"), F.count("*").alias("n"))
    bins = keep(bins.withColumn("group", F.expr(f"bin div {GROUP}")), "bins")
    groups = bins.groupBy("src", "group", "room").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    groups = groups.withColumns({"s_upto": upto("s", ["src"], "group"), "n_upto": upto("n", ["src"], "group")})

    def inside(found: DataFrame) -> DataFrame:
        """The bins of the group found in each source, with running sums of the whole source."""
        own = bins.join(found.select("src", "group", (F.col("s_upto") - F.col("s")).alias("s_before"), (F.col("n_upto") - F.col("n")).alias("n_before")), ["src", "group"])
        return own.withColumns({"s_upto": F.col("s_before") + upto("s", ["src"], "bin"), "n_upto": F.col("n_before") + upto("n", ["src"], "bin")})

    def first(rows: DataFrame, by: str) -> DataFrame:
        """The row of the least ``by`` in each source."""
        return rows.groupBy("src").agg(F.min_by(F.struct(*rows.columns), by).alias("x")).select("x.*")

    cut = first(inside(first(groups.filter("s_upto > room"), "group")).filter("s_upto > room"), "bin")
    cut = keep(cut.select("src", F.col("bin").alias("low"), (F.col("room") - F.col("s_upto") + F.col("s")).alias("left"), (F.col("n_upto") + reach).alias("ends")), "cut")
    ends = first(groups.join(cut.select("src", "ends"), "src").filter("n_upto >= ends"), "group")
    ends = first(inside(ends).join(cut.select("src", "ends"), "src").filter("n_upto >= ends"), "bin")
    return cut.select("src", "low", "left").join(ends.select("src", F.col("bin").alias("high")), "src", "left")


def _filled(reach: pd.DataFrame) -> pd.DataFrame:
    """Of one source's documents around the cut, those taken in their order while they fit."""
    reach = reach.assign(null=reach["doc_id"].notna()).sort_values(["v", "null", "doc_id", "digest"], kind="stable")
    left, taken = float(reach["left"].iloc[0]) if len(reach) else 0.0, []
    for words in reach["words"]:
        taken.append(words <= left)
        left -= words if taken[-1] else 0
    return reach[["doc_id", "source", "digest", "rows", "size", "source_size", "target", "sure"]].assign(extra=[int(t) for t in taken])


def allocate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), growth: float = 1.5, most: float = 2.0, tilt: float = 0.25, reach: int = 2048, seed: int = 17) -> DataFrame:
    """(doc_id, source, digest, rows, size, source_size, target, copies): a row for each different document.

    Defined cases: a null text is empty and has size 0; the null source is a source; very long texts are documents like others, and are
    passed over where they don't fit; ties in the order are broken by id (null first) and text hash; rows with equal id, source and
    text (``rows`` of them) are taken or left together; documents of size 0 take no words (their certain copies count); an
    empty table gives no rows; other columns are never read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    units = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("digest"), F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long").alias("size"))
    units = units.groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("rows"))
    # Exact for any size below 2 ** 53, unlike a rounded logarithm.
    units = files.written(spark, units.withColumns({"words": F.col("size") * F.col("rows"), "class": F.greatest(F.length(F.bin("size")) - 1, F.lit(0))}), "units")
    classes = files.written(spark, units.groupBy("source", "class").agg(F.sum("words").alias("words")), "classes")
    table = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights=weights, growth=growth, most=most)
    table = files.written(spark, levels(classes, table, most=most, tilt=tilt), "targets")

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "digest", "source"), 11) + 0.5) / float(1 << 53)
    e = F.expr(_steps(f"least({float(most)}D, level * pow(2D, {float(tilt)}D * class))"))
    units = units.join(table.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    units = units.withColumns({"sure": F.floor(e).cast("long"), "p": e - F.floor(e)})
    # Null where nothing more is to be taken.
    units = units.withColumn("q", F.when((F.col("p") > 0) & (F.col("words") > 0), (u / (1 - u)) * (1 - F.col("p")) / F.col("p")))
    units = units.withColumn("v", F.col("q") / (1 + F.col("q"))).withColumn("bin", F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)).cast("int"))
    units = files.written(spark, units.select("doc_id", "source", "digest", "rows", "size", "words", "source_size", "target", "sure", "src", "room", "v", "bin"), "ranks")

    cuts = files.written(spark, _cuts(units, reach, lambda df, name: files.written(spark, df, name)), "cuts")
    marked = units.join(cuts.withColumnRenamed("src", "cut_src"), F.col("src") == F.col("cut_src"), "left")
    near = F.coalesce((F.col("bin") >= F.col("low")) & (F.col("bin") <= F.coalesce("high", F.lit(BINS))), F.lit(False))
    below = F.col("bin").isNotNull() & (F.col("low").isNull() | (F.col("bin") < F.col("low")))
    names = ["doc_id", "source", "digest", "rows", "size", "source_size", "target", "sure"]
    plain = marked.filter(~near).select(*names, F.when(below, 1).otherwise(0).cast("long").alias("extra"))
    kinds = dict(units.dtypes)
    around = marked.filter(near).select(*names, "src", "words", "v", "left").groupBy("src").applyInPandas(_filled, ", ".join(f"{c} {kinds[c]}" for c in names) + ", extra long")
    out = plain.unionByName(around)
    return out.select(*names[:-1], (F.col("sure") + F.col("extra")).alias("copies"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs, each as often as the mix takes it; all columns stay as they are.  For nulls and other cases see allocate()."""
    own = files.inner(docs)
    taken = allocate(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).filter("copies > 0")
    taken = taken.select(*(F.col(c).alias(own + c) for c in ("doc_id", "source", "digest", "copies")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = F.col(f"{own}id").eqNullSafe(F.col(f"{own}doc_id")) & F.col(f"{own}from").eqNullSafe(F.col(f"{own}source")) & (F.col(f"{own}text") == F.col(f"{own}digest"))
    keyed = docs.withColumns({f"{own}id": F.col(id_col).cast("long"), f"{own}from": F.col(source_col).cast("string"), f"{own}text": F.xxhash64(text)})
    out = keyed.join(taken.hint("shuffle_hash"), same).withColumn(f"{own}n", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{own}copies"))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
