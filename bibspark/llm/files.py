"""Scratch tables in the folder that the driver and all executors share, and files that executors' Python reads and writes."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import shared
from ..shared import remove

#: Folders of scratch tables, by the innermost settled() that made them.
_MADE: list[list[str]] = [[]]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder; removed by settled(), or else when the driver's Python ends."""
    uri = shared.scratch(spark, name)
    _MADE[-1].append(uri)
    return uri


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a table of the shared folder: this cuts the lineage and survives lost executors."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s table, written; what it left in the scratch folder goes."""
    _MADE.append([])
    try:
        out = written(spark, make(), name)
    finally:
        made = _MADE.pop()
    for uri in made[:-1]:
        remove(spark, uri)
    _MADE[-1] += made[-1:]
    return out


def mark() -> int:
    """For drop_since(): where the scratch tables stand that are yet to be made."""
    return len(_MADE[-1])


def drop_since(spark: SparkSession, at: int) -> None:
    """Remove the scratch tables made since mark(), all but the last, which no longer needs them."""
    for uri in _MADE[-1][at:-1]:
        remove(spark, uri)
    del _MADE[-1][at:-1]


def rounds(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """written() for the rounds of an iteration: of earlier rounds only the last one stays, as the next is computed from it."""
    last: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        for uri in last:
            remove(spark, uri)
        last[:] = [path]
        return spark.read.schema(df.schema).parquet(path)

    return keep


def inner(*tables: DataFrame) -> str:
    """A prefix for columns of one's own: underscores, more of them than any column of these tables begins with."""
    lead = max((len(c) - len(c.lstrip("_")) for t in tables for c in t.columns), default=0)
    return "_" * (max(lead, 1) + 1)


def free(table: DataFrame, name: str) -> str:
    """``name`` for a new column, with underscores at its end until the table has none of that name."""
    have = {c.lower() for c in table.columns}
    while name.lower() in have:
        name += "_"
    return name


def open_fs(uri: str):
    """(file system, path in it) for executors' Python: local files, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


@contextlib.contextmanager
def new_file(uri: str):
    """An output stream; the file gets its name only when it is complete.  Names must be unique to an attempt."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{path}.part", compression=None) as out:
        yield out
    system.move(f"{path}.part", path)
