"""INPX inventories: a ZIP of index files whose lines name books in sibling archives."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity as idt
from ..functions import text as tx

#: The fields of a line in order, of which those up to ``ext`` must be there.
FIELDS = ("author", "genre", "title", "series", "serno", "file", "size", "libid", "deleted", "ext", "date", "lang")
NEEDED = FIELDS.index("ext") + 1


def index_lines(bundles: DataFrame) -> DataFrame:
    """(bundle, archive, line_no, line) of binaryFile rows of .inpx bundles."""

    def run(batches):
        for frame in batches:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for name in z.namelist():
                            if name.lower().endswith(".inp"):
                                archive = name.rpartition("/")[2][:-4] + ".zip"
                                rows += [(path, archive, i, x) for i, x in enumerate(z.read(name).decode("utf-8", "replace").split("\n"))]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["bundle", "archive", "line_no", "line"])

    return bundles.select("path", "content").mapInPandas(run, "bundle string, archive string, line_no long, line string")


def archive_entries(archives: DataFrame) -> DataFrame:
    """(archive, entry) of ZIP archives named in column path; a broken archive has none.

    Only an archive's directory is read, at its end, by seeking in the file; where rows carry the column content it is taken
    from there, for stores that nothing but Spark's readers reaches.
    """
    from pyarrow import fs

    whole = "content" in archives.columns

    def names(source) -> list[str]:
        with zipfile.ZipFile(source) as z:
            return z.namelist()

    def run(batches):
        for frame in batches:
            rows = []
            for i, path in enumerate(frame["path"]):
                try:
                    if whole:
                        found = names(io.BytesIO(frame["content"].iloc[i]))
                    else:
                        system, at = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
                        with system.open_input_file(at) as f:
                            found = names(f) if f.size() >= 22 else []  # less than the end of a directory
                except zipfile.BadZipFile:
                    continue
                rows += [(path.rpartition("/")[2], n) for n in found]
            yield pd.DataFrame(rows, columns=["archive", "entry"])

    return archives.select("path", *["content"] * whole).mapInPandas(run, "archive string, entry string")


#: Stores whose files can be sought in; of others Spark's reader hands over whole archives.
SOUGHT = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def _optional(fields: Column, name: str) -> Column:
    return tx.trimmed(F.coalesce(F.get(fields, F.lit(FIELDS.index(name))), F.lit("")))


def editions(lines: DataFrame, library_id: int) -> DataFrame:
    """Editions of index lines; lines that are blank, short, deleted or without a file name are left out."""
    rows = lines.withColumn("f", F.split(F.regexp_replace("line", "[\\r\\x04]+$", ""), "\\x04"))
    rows = rows.filter(F.size("f") >= NEEDED)
    of = lambda name: tx.trimmed(F.get(F.col("f"), F.lit(FIELDS.index(name))))
    rows = rows.withColumns({"file": of("file"), "ext": F.lower(of("ext")), "deleted": of("deleted")}).filter("deleted <> '1' and file <> '' and ext <> ''")
    number = of("serno").try_cast("double")
    entry = F.concat("file", F.lit("."), "ext")
    return rows.select(
        F.lit(library_id).cast("long").alias("library_id"),
        F.lit(True).alias("derive_identity"),
        F.when(of("title") != "", of("title")).otherwise(F.col("file")).alias("title"),
        tx.inp_authors(F.get(F.col("f"), F.lit(0))).alias("authors"),
        tx.listed(F.get(F.col("f"), F.lit(1))).alias("genres"),
        of("series").alias("series"),
        F.when(number != 0, number).alias("series_number"),
        idt.language(_optional(F.col("f"), "lang")).alias("language"),
        tx.inp_date(_optional(F.col("f"), "date")).alias("added_at"),
        F.coalesce(of("size").try_cast("long"), F.lit(0)).alias("file_size"),
        F.col("ext").alias("file_format"),
        F.concat("archive", F.lit("/"), entry).alias("source_path"),
        "archive",
        entry.alias("entry"),
        F.row_number().over(Window.partitionBy("archive").orderBy("line_no")).cast("long").alias("arrival"),
    )


def read(spark: SparkSession, bundle: str, archives: str, library_id: int) -> DataFrame:
    """Editions of a bundle whose archive entry is there."""
    lines = index_lines(spark.read.format("binaryFile").load(bundle))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(archives)
    sought = ("://" not in archives and not archives.startswith("viewfs:")) or archives.split(":")[0] in SOUGHT
    there = archive_entries(found.select("path") if sought else found)
    return editions(lines, library_id).join(there, ["archive", "entry"], "left_semi")
