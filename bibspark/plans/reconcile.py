"""Incremental runs: what changed, what to read, what to drop, and snapshots that readers switch to as a whole.

Tables are never changed in place: a run writes ``<root>/v=<n>`` and then moves a pointer, so that readers see the old state or the
new one.  Row changes (insert, update, upsert, delete, cascade) are joins from the old tables to the new ones.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES

# ---- diffs -----------------------------------------------------------------------------------------------------------


def checkpoint(mtime: int, size: int) -> str:
    return f"{mtime}:{size}"


def must_run(stored: str | None, now: str | None, force: bool = False) -> bool:
    """Whether a library must be read: it has no fingerprint, a new one, or the run is forced."""
    return force or not now or stored != now


def gate(stored: Column, now: Column, force: Column) -> Column:
    """must_run() over columns: whether each library must be read."""
    return force | F.coalesce(now == "", F.lit(True)) | ~stored.eqNullSafe(now)


def file_diff(known: DataFrame, found: DataFrame, *, key: list[str]) -> DataFrame:
    """(key..., change): 'same' needs no parsing, 'changed' and 'new' do, 'gone' is to be dropped."""
    old = known.select(*key, F.col("file_size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("old"))
    new = found.select(*key, F.col("file_size").alias("new_size"), F.col("mtime").alias("new_mtime"), F.lit(True).alias("new"))
    same = F.col("old_size").eqNullSafe(F.col("new_size")) & F.col("old_mtime").eqNullSafe(F.col("new_mtime"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(same, "same").otherwise("changed")
    return old.join(new, key, "full").select(*key, change.alias("change"))


def counters(diff: DataFrame) -> DataFrame:
    """One row: added, removed, changed and kept files of a run."""
    of = lambda what: F.count_if(F.col("change") == what)
    return diff.agg(of("new").alias("added"), of("gone").alias("removed"), of("changed").alias("changed"), of("same").alias("kept"))


def pruned(files: DataFrame, seen: DataFrame, *, key: list[str]) -> DataFrame:
    """Files that the run saw; a known file that no longer parses isn't seen, and goes."""
    return files.join(seen.select(*key).distinct(), key, "left_semi")


def moved(known: DataFrame, grouped: DataFrame, *, path: str = "source_path", book: str = "book_id") -> DataFrame:
    """Known rows whose file the run now groups under another book: the old rows go, or else the file would stand twice."""
    now = grouped.groupBy(path).agg(F.max(book).alias("__now"))
    return known.join(now, path).filter(F.col("__now") != F.col(book)).drop("__now")


@dataclass(frozen=True)
class Run:
    """What a run over one library found: the files to parse, the rows that stay, the books left empty, and its counters."""

    diff: DataFrame
    parse: DataFrame
    files: DataFrame
    emptied: DataFrame
    counts: DataFrame


def run(known: DataFrame, found: DataFrame, grouped: DataFrame | None = None, *, path: str = "source_path", book: str = "book_id") -> Run:
    """One run of a library that the gate let through: diff, then prune, then count.

    known (path, book, file_size, mtime) are its stored files, found (path, file_size, mtime) those that are there, and grouped (path,
    book) the books under which the run files them, for files that it parsed.
    """
    diff = file_diff(known, found, key=[path])
    parse = found.join(diff.filter("change in ('new', 'changed')").select(path), path, "left_semi")
    files = pruned(known, found, key=[path])
    if grouped is not None:
        files = files.join(moved(known, grouped, path=path, book=book).select(path), path, "left_anti")
        files = files.select(path, book).unionByName(grouped.select(path, book).join(files.select(path), path, "left_anti"))
    emptied = known.select(book).distinct().join(files.select(book), book, "left_anti")
    return Run(diff, parse, files, emptied, counters(diff))


def present(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Records whose archive is there and holds their entry; entries are (archive, entry)."""
    return records.join(entries, ["archive", "entry"], "left_semi")


# ---- row changes -----------------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those rows of old whose key new doesn't have."""
    return new.select(*old.columns).unionByName(old.join(new.select(*key), key, "left_anti"))


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and those rows of new whose key old doesn't have."""
    return upsert(new.select(*old.columns), old, key).select(*old.columns)


def updated(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with these columns taken from changes where the key is there."""
    new = changes.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    out = table.join(new, F.col(key) == F.col("__k"), "left")
    return out.select(*(F.when(F.col("__k").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def deleted(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


#: Each child table's column that refers to a book.
CHILDREN = {"book_files": "book_id", "book_identifiers": "book_id", "book_authors": "book_id", "book_genres": "book_id", "terms": "doc_id"}


def cascaded(catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The catalogue without children of books that are gone, and with no series that is gone."""
    books = catalog["books"]
    out = dict(catalog)
    for table, column in CHILDREN.items():
        if table in catalog:
            out[table] = catalog[table].join(books.select(F.col("id").alias(column)), column, "left_semi").select(*catalog[table].columns)
    if "series" in catalog:
        there = catalog["series"].select(F.col("id").alias("__s"))
        out["books"] = books.join(there, F.col("series_id") == F.col("__s"), "left").withColumn("series_id", F.col("__s")).drop("__s")
    return out


def purged(catalog: dict[str, DataFrame], library: Column) -> dict[str, DataFrame]:
    """The catalogue without the libraries for which ``library`` (over their columns) holds, their books and all theirs."""
    gone = catalog["libraries"].filter(library).select(F.col("id").alias("library_id"))
    out = dict(catalog) | {"libraries": catalog["libraries"].filter(~F.coalesce(library, F.lit(False)))}
    out["books"] = catalog["books"].join(gone, "library_id", "left_anti").select(*catalog["books"].columns)
    return cascaded(out)


def synced_status(status: Column) -> Column:
    """A library's status after a run: a purge that is waiting stays so."""
    return F.when(status == "pending_purge", status).otherwise("active")


# ---- snapshots -------------------------------------------------------------------------------------------------------


class Store:
    """Versioned tables below a root that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The version that readers see; 0 before the first."""
        path, fs = self._path("current.json")
        if not fs.exists(path):
            return 0
        return json.loads(self.spark.read.text(f"{self.root}/current.json", wholetext=True).first()[0])["version"]

    def read(self) -> dict[str, DataFrame]:
        v = self.version()
        if not v:
            return {name: self.spark.createDataFrame([], spec) for name, spec in TABLES.items()}
        return {name: self.spark.read.schema(spec).parquet(f"{self.root}/v={v}/{name}") for name, spec in TABLES.items()}

    def commit(self, catalog: dict[str, DataFrame]) -> int:
        """Write a new version, dimensions sorted by their fold, and switch to it."""
        v = self.version() + 1
        before = self.read() if v > 1 else {}
        for name in TABLES:
            table = catalog.get(name, before.get(name))
            if table is None:
                table = self.spark.createDataFrame([], TABLES[name])
            if "name_fold" in table.columns:
                table = table.sortWithinPartitions("name_fold")
            table.select(*(c.split()[0] for c in TABLES[name].split(", "))).write.mode("overwrite").parquet(f"{self.root}/v={v}/{name}")
        path, fs = self._path("current.json.new")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps({"version": v}).encode()))
        out.close()
        target, _ = self._path("current.json")
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(path, target):
            raise OSError(f"can't switch {self.root} to version {v}")
        return v
