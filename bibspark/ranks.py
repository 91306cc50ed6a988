"""Places of rows in a global order, without a task that sees all of them: shared by the plans and by bibspark.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked(values: DataFrame, by: str | list[Column], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """values with ``place``, from 0 in ascending order of ``by`` (a column, null last, or a list of orders).

    Rows are dealt in ranges and sorted within them; ``keep`` stores them once, where all machines read them.  The driver sees one
    count a range, and these counts' prefix sums are the ranges' first places.
    """
    spark = values.sparkSession
    order = [F.col(by).asc_nulls_last()] if isinstance(by, str) else by
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = keep(values.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    bases, at = [], 0
    for p, count in sorted(tuple(r) for r in parted.groupBy(part).agg(F.count("*")).collect()):
        bases.append((p, at))
        at += count
    offsets = F.broadcast(spark.createDataFrame(bases, "__p long, __base long"))  # one row a range
    within = F.col("__m").bitwiseAND((1 << 33) - 1)
    return parted.join(offsets, part == F.col("__p")).withColumn("place", F.col("__base") + within).drop("__m", "__p", "__base")
