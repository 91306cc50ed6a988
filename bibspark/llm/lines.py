"""Quality rules and deduplication by lines, in DataFrame functions alone.

Lines are what ``\\n`` separates; a blank line has no word.  Words are runs of other than U+0020 and U+0009 to U+000D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files

SPACE = "[ \\t-\\r]+"
def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def normalised(line: Column) -> Column:
    """A line in lower case with single blanks between its words."""
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def repeat_words(hashes: str, bits: str) -> Column:
    """Words that stand in 3-word windows found twice or more, from the window hashes in their order.

    Window hashes are sorted with their places in the low bits, so that equal ones meet in n log n steps; neighbours count
    as equal only if their whole hashes agree.  The arguments name columns: the hashes, and the bits of their number.
    """
    k = bits
    packed = f"sort_array(transform({hashes}, (x, i) -> shiftleft(x, {k}) | cast(i as bigint)))"
    of = lambda x: f"{hashes}[cast({x} & (shiftleft(1L, {k}) - 1) as int)]"
    same = lambda a, b: f"(shiftright({a}, {k}) = shiftright({b}, {k}) and {of(a)} = {of(b)})"
    found = f"filter(p, (x, i) -> (i > 0 and {same('x', 'p[i - 1]')}) or (i + 1 < size(p) and {same('x', 'p[i + 1]')}))"
    places = f"sort_array(transform({found}, x -> cast(x & (shiftleft(1L, {k}) - 1) as int)))"
    total = "aggregate(transform(q, (x, i) -> if(i + 1 < size(q), least(3, q[i + 1] - x), 3)), 0L, (a, x) -> a + x)"
    # A lambda over an array of one binds a value once.
    return F.expr(f"transform(array({packed}), p -> transform(array({places}), q -> {total})[0])[0]")


def base_features(docs: DataFrame, text: str, own: str) -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, each behind the prefix ``own``."""
    c = lambda name: F.col(own + name)
    out = docs.withColumn(f"{own}t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn(f"{own}w", split_words(c("t")))
    out = out.withColumn(f"{own}l", F.filter(F.split(c("t"), "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    w, h = f"{own}w", f"{own}h"
    out = out.withColumns({
        f"{own}n_words": F.size(c("w")).cast("long"),
        f"{own}word_chars": F.length(F.array_join(c("w"), "")).cast("long"),
        f"{own}n_symbols": F.regexp_count(c("t"), F.lit("[#*$%&|<>]")).cast("long"),
        f"{own}n_dup_lines": (F.size(c("l")) - F.size(F.array_distinct(c("l")))).cast("long"),
        h: F.expr(f"if(size({w}) >= 3, transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])), cast(array() as array<bigint>))"),
    })
    out = out.withColumns({f"{own}some": F.size(F.array_distinct(c("h"))) < F.size(c("h")), f"{own}k": F.length(F.bin(F.size(c("h"))))})
    out = out.withColumn(f"{own}n_repeat_words", F.when(c("some"), repeat_words(h, f"{own}k")).otherwise(F.lit(0)).cast("long"))
    # A column that isn't deterministic keeps Catalyst from pushing a later filter below, which would copy the
    # definitions of words and windows into lambdas and evaluate them for every element.
    return out.withColumn(f"{own}fence", F.monotonically_increasing_id()).drop(*(f"{own}{x}" for x in ("t", "w", "l", "h", "some", "k")))


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_removed", "base_failed", "kept", "text")


def quality_rules(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", min_docs: int = 5, max_share: float = 0.02, max_docs: int = 100, min_left: float = 0.5) -> DataFrame:
    """docs and the columns ``rule_*``: base features, base_failed, words_removed, kept, and text (without removed lines).

    A line is removed from a host's documents if it stands in more of them than the host's limit: the share ``max_share`` of
    them, but ``min_docs`` at least and ``max_docs`` at most, so that the rule works in small hosts and goes on working in large
    ones.  Lines are compared in normalised form by hash.  Distinct documents are those of different texts: a group of
    exact copies is one document, else it would make all of its own lines common and be rejected as a whole.  A document is
    rejected if the base rules fail, or if it keeps less than ``min_left`` of its words.

    One plan at all sizes: distinct (host, text, line, place) rows are written once, counted by (host, line) with partial
    counts, and joined with the lines above their limit; the places to remove come back to their documents, which move at
    most once, by (host, text).  All joins leave large partitions to be split.

    Defined cases: a null or empty text has no words and fails; a null host is a host of its own; very long texts are read
    whole, and their lines are removed by place, in linear time; a line exactly at its limit stays; repeated rows get the same
    result each; an empty table gives no rows.  Columns of docs stay as they are, and a result column whose name docs has
    gets underscores at its end (files.free).
    """
    spark, own = docs.sparkSession, files.inner(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host, d = f"{own}host", f"{own}d"
    keys = {host: F.xxhash64(F.col(host_col).isNull(), F.col(host_col).cast("string")), d: F.xxhash64(text)}
    norms = F.transform(F.split(text, "\n"), normalised)
    found = F.filter(F.transform(norms, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("at"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("n"))), lambda x: x["n"] > 0)
    # In order of (hash, place), the first place of each line of a text is the one that counts for the limit.
    marked = F.transform(F.array(F.array_sort(found)), lambda s: F.transform(s, lambda x, i: F.struct(x["h"].alias("h"), x["at"].alias("at"), x["n"].alias("n"), ((i == 0) | (F.get(s, i - 1)["h"] != x["h"])).alias("first"))))[0]
    # Place -1 stands for the text itself.
    itself = F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(-1).alias("at"), F.lit(0).alias("n"), F.lit(False).alias("first")))
    lines = docs.select(*(v.alias(k) for k, v in keys.items()), F.inline(F.concat(itself, marked)))
    lines = files.written(spark, lines.distinct(), "lines")
    share = F.count("*") * float(max_share)
    limits = lines.filter("at < 0").groupBy(host).agg(F.greatest(F.lit(float(min_docs)), F.least(F.lit(float(max_docs)), share)).alias("most"))
    counts = lines.filter("first").groupBy(host, "h").agg(F.count("*").alias("docs")).filter(F.col("docs") > min_docs)
    common = counts.join(limits, host).filter("docs > most").select(host, "h")
    hit = lines.filter("at >= 0").join(files.written(spark, common, "common_lines"), [host, "h"])
    hit = hit.groupBy(host, d).agg(F.sum("n").alias(f"{own}removed"), F.collect_list("at").alias(f"{own}gone"))
    out = base_features(docs.withColumns(keys), text_col, own).join(hit.hint("shuffle_hash"), [host, d], "left")
    removed, words = F.coalesce(F.col(f"{own}removed"), F.lit(0)), F.col(f"{own}n_words")
    failed = (words < 50) | (100 * F.col(f"{own}n_repeat_words") > 50 * words)
    every = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(f"{own}gone"))
    values = {c: F.col(f"{own}{c}") for c in RULES[:5]} | {
        "words_removed": removed,
        "base_failed": failed,
        "kept": (F.col(f"{own}fence") >= 0) & ~failed & (words - removed >= min_left * words),
        "text": F.when(F.col(f"{own}gone").isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(F.transform(F.array(every), lambda s: F.transform(left, lambda i: F.get(s, i)))[0], "\n")),
    }
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(values[c].alias(files.free(docs, f"rule_{c}")) for c in RULES))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``text_col`` replaced and the columns dedup_lines (lines with a word) and dedup_removed (of these, removed).

    Every three consecutive lines with a word make a window, compared by two hashes of their trimmed lines.  Of equal windows in
    the whole table all but the first, by (id, place), are removed: the lines that such windows cover, merged, leave their
    document, and blank lines stay.  Documents with fewer than three lines have no window.

    One plan at all sizes: windows are counted with partial aggregation before they move; those found twice come back to the
    windows by a join whose large partitions Spark can split, and the covered places to the texts, which move once, by
    (id, text).

    Defined cases: null texts stay null and have no line; a null id sorts first; very long texts are read whole; of equal windows
    at the same id (ties) that of the smaller text hash is first; rows with equal id and text count as one document and get the
    same result; an empty table gives no rows.  Other columns stay as they are, and a result column whose name docs has
    gets underscores at its end (files.free).
    """
    spark, own = docs.sparkSession, files.inner(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    numbered = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(" \t\x0b\x0c\r")).alias("s"), i.alias("i"))), lambda x: x.s != "")
    lined = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("d"), numbered.alias("l"))
    windows = lined.filter("size(l) >= 3").select("id", "d", F.expr("posexplode(transform(sequence(0, size(l) - 3), i -> struct(xxhash64(l[i].s, l[i + 1].s, l[i + 2].s) as h, hash(l[i].s, l[i + 1].s, l[i + 2].s) as g)))").alias("p", "w"))
    windows = windows.select("id", "d", "p", "w.h", "w.g")
    firsts = windows.groupBy("h", "g").agg(F.min(F.struct("id", "d", "p")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "g", "first")
    later = windows.join(files.written(spark, firsts, "windows"), ["h", "g"]).filter(~F.struct("id", "d", "p").eqNullSafe(F.col("first")))
    gone = later.groupBy("id", "d").agg(F.collect_set("p").alias("p"))
    gone = files.written(spark, gone.select(F.col("id").alias(f"{own}id"), F.col("d").alias(f"{own}d"), F.col("p").alias(f"{own}p")), "covered")
    same = F.col(id_col).eqNullSafe(F.col(f"{own}id")) & (F.col(f"{own}digest") == F.col(f"{own}d"))
    out = docs.withColumn(f"{own}digest", F.xxhash64(text)).join(gone.hint("shuffle_hash"), same, "left")
    out = out.withColumn(f"{own}all", F.split(text, "\n")).withColumn(f"{own}l", numbered.getField("i"))
    out = out.withColumn(f"{own}c", F.expr(f"array_distinct(flatten(transform({own}p, x -> array(x, x + 1, x + 2))))"))
    kept = f"array_except(sequence(0, size({own}all) - 1), transform({own}c, x -> {own}l[x]))"
    new = F.when(F.col(f"{own}c").isNull(), F.col(text_col)).otherwise(F.expr(f"array_join(transform({kept}, i -> {own}all[i]), '\\n')"))
    counts = {"dedup_lines": F.size(f"{own}l").cast("long"), "dedup_removed": F.coalesce(F.size(f"{own}c"), F.lit(0)).cast("long")}
    return out.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *(v.alias(files.free(docs, c)) for c, v in counts.items()))
