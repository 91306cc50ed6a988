"""Places that the driver and all executors share.

Scratch data lives below the folder that the cluster names in ``spark.checkpoint.dir``.  Only where no such
folder is set and Spark runs in one process (tests) is a temporary folder chosen.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; raises where a cluster names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="bibspark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, uri: str) -> bool:
    path, system = _path(spark, uri)
    return system.exists(path)


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder by the file system that Spark uses for it."""
    path, system = _path(spark, uri)
    system.delete(path, True)


def put(spark: SparkSession, uri: str, data: bytes) -> None:
    """Write a small file."""
    path, system = _path(spark, uri)
    out = system.create(path, True)
    out.write(bytearray(data))
    out.close()


_RUN = uuid.uuid4().hex[:12]
_TOPS: set[str] = set()


def _remove_quietly(spark: SparkSession, uri: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended first
        remove(spark, uri)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder; what is left of it goes when the driver's Python ends."""
    top = f"{shared_dir(spark)}/bibspark-{_RUN}"
    if top not in _TOPS:
        _TOPS.add(top)
        atexit.register(_remove_quietly, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a new table of the shared folder: this cuts the lineage and survives lost executors."""
    uri = scratch(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def kept_as(spark: SparkSession, df: DataFrame, uri: str) -> DataFrame:
    """df as the table at ``uri``, written there first unless it is there; readers never see a part of it."""
    if not exists(spark, uri):
        made = f"{uri}.{uuid.uuid4().hex[:12]}"
        df.write.parquet(made)
        path, system = _path(spark, made)
        if not system.rename(path, _path(spark, uri)[0]) and not exists(spark, uri):
            raise OSError(f"can't name the table {uri}")
    return spark.read.schema(df.schema).parquet(uri)


def state_of(spark: SparkSession, path: str) -> str:
    """A name for the present state of the files at ``path``, from their names, times and sizes; their content isn't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    n, size, mark = listed.selectExpr("count(*)", "coalesce(sum(length), 0)", "coalesce(bit_xor(xxhash64(path, modificationTime, length)), 0)").first()
    return f"{n}-{size}-{mark & (1 << 64) - 1:016x}"
