"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Only vectors of one label are compared.  Equal vectors form a class and are settled by one aggregation; all below
works on one representative of each class.  A table's hash rotates the unit vector by three rounds of random
signs and a Hadamard transform and takes the nearest signed axis, in ``cuts`` independent rotations.  The hash is the same
for any number of vectors: a vector makes tables * probes rows.  With three rotations a label has (2 * d) ** 3 buckets a table, d being
the dimension's next power of two: 2 million for 64 dimensions, 2 billion for 512, so buckets of unrelated vectors stay small up
to some tens of millions of vectors a label at 64 dimensions; for more, name more rotations and tables.  A vector is
stored in its own bucket of every table and looks into the buckets of the next best axes as well (multiprobe).
Buckets hold ids; a large one is dealt into chunks, and each pair of chunks is compared by its own task.  Pairs are
verified by their cosine in double precision, the lower side's table first to find a pair reporting it alone.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .graph import components

#: Signed axes tried in each rotation.
AXES = 4
#: Rotations of a hash, tables, and buckets that a vector looks into in each.
CUTS, TABLES, PROBES = 3, 12, 6


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of the rows, in log steps."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(units: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform, padded to a power of two."""
    d = 1 << max(0, units.shape[1] - 1).bit_length()
    x = np.zeros((len(units), d))
    x[:, : units.shape[1]] = units
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size=d))
    return x


def buckets(units: np.ndarray, table: int, probes: int, cuts: int) -> np.ndarray:
    """(vectors, probes) bucket numbers of one table: each vector's own first, then the next best by their axes' margins."""
    best, loss = [], []
    k = min(AXES, probes, 2 * (1 << max(0, units.shape[1] - 1).bit_length()))
    for cut in range(cuts):
        x = rotate(units, 1009 * table + cut)
        both = np.concatenate([x, -x], axis=1)
        top = np.argsort(-both, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(both, top, axis=1)
        best.append(top)
        loss.append((value[:, :1] - value) ** 2)
    combos = list(product(range(k), repeat=cuts))
    cost = np.stack([sum(loss[c][:, i] for c, i in enumerate(combo)) for combo in combos], axis=1)
    width = 2 * (1 << max(0, units.shape[1] - 1).bit_length())
    names = np.stack([sum(best[c][:, i].astype(np.int64) * width**c for c, i in enumerate(combo)) for combo in combos], axis=1)
    order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(names, order, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def near_pairs(classes: DataFrame, *, least: float = 0.93, tables: int = TABLES, probes: int = PROBES, cuts: int = CUTS, chunk: int = 1024) -> DataFrame:
    """(u, v, cos) with u < v: classes (id, label, vec) of equal label with a cosine of ``least`` or more."""
    spark = classes.sparkSession

    def hashed(batches):
        for batch in batches:
            ids, labels, sizes = batch.column(0), batch.column(1), np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                units = unit(_matrix(batch.column(2).take(pa.array(at))))
                for t in range(tables):
                    found = buckets(units, t, probes, cuts)
                    n = found.shape[1]
                    where = pa.array(np.repeat(at, n))
                    yield pa.RecordBatch.from_arrays([ids.take(where), labels.take(where), pa.array(np.full(len(at) * n, size, np.int32)), pa.array(np.full(len(at) * n, t, np.int32)), pa.array(found.ravel()), pa.array(np.tile(np.arange(n) == 0, len(at)))], names=["id", "label", "size", "t", "bucket", "own"])

    rows = files.written(spark, classes.select("id", "label", "vec").mapInArrow(hashed, "id long, label string, size int, t int, bucket long, own boolean"), "buckets")
    key = ["label", "size", "t", "bucket"]
    # A bucket's chunks, from its counted rows.
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("own").alias("owned")).filter("n > 1 and owned > 0").select(*key, F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    rows = rows.join(counts, key)
    mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.struct(F.least(i, mine).alias("a"), F.greatest(i, mine).alias("b")))
    rows = rows.select("id", "own", *key, F.inline(spread), mine.alias("mine"))
    group = [*key, "a", "b"]
    left, right = (rows.filter("own").select(*group, F.col("id").alias("u"), F.col("mine").alias("mu")), rows.select(*group, F.col("id").alias("v"), F.col("mine").alias("mv")))
    pairs = left.join(right, group).filter("u <> v and (a = b or mu <> mv)")
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    vectors = classes.select("id", "vec")
    pairs = pairs.join(vectors.withColumnsRenamed({"id": "u", "vec": "x"}), "u").join(vectors.withColumnsRenamed({"id": "v", "vec": "y"}), "v")

    def verified(batches):
        for batch in batches:
            u, v, x, y = (batch.column(i) for i in range(4))
            sizes = np.diff(x.offsets.to_numpy())
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                take = pa.array(at)
                cos = (unit(_matrix(x.take(take))) * unit(_matrix(y.take(take)))).sum(axis=1)
                good = pa.array(at[cos >= least])
                yield pa.RecordBatch.from_arrays([u.take(good), v.take(good), pa.array(cos[cos >= least])], names=["u", "v", "cos"])

    return files.written(spark, pairs.select("u", "v", "x", "y").mapInArrow(verified, "u long, v long, cos double"), "pairs")


def near_duplicates(table: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93, tables: int = TABLES, probes: int = PROBES, cuts: int = CUTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each vector.

    Defined cases: a null label or id, a null, empty or zero vector and one with a null or non-finite component link with
    nothing; vectors of different lengths have no cosine and don't link, however long; equal vectors (ties) are one class, and
    component_id is the least id among all of theirs; repeated ids are rows of their own; an empty table gives no rows; other
    columns are never read.
    """
    spark = table.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(vec, lambda x: x + 0.0).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("digest", F.when(usable, F.sha2(F.concat_ws("|", "label", F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")), 256)))
    rows = files.written(spark, rows, "vectors")
    good = rows.filter("digest is not null")
    # Vertices get numbers of their own: ids may repeat.
    classes = good.groupBy("digest").agg(F.min(F.struct("vec_id", "label", "vec")).alias("r"), F.count("*").alias("copies"))
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "digest", F.col("r.vec_id").alias("first"), F.col("r.label").alias("label"), F.col("r.vec").alias("vec"), "copies")
    classes = files.written(spark, classes, "classes")
    pairs = near_pairs(classes, least=least, tables=tables, probes=probes, cuts=cuts)
    both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(classes.select(F.col("id").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("others"))
    roots = components(spark, pairs.select("u", "v"))
    state = classes.select("digest", "id", "first", "copies").join(linked.withColumnRenamed("u", "id"), "id", "left").join(roots, "id", "left")
    state = state.select("digest", "first", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    least_ids = state.groupBy("root").agg(F.min("first").alias("component_id"))
    state = state.join(least_ids, "root").select("digest", "n_links", "component_id")
    out = rows.select("vec_id", "digest").join(state, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
