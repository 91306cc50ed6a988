"""Events of a running catalogue: debouncing, coalescing, queueing and throttling, for finished tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The quiet time before a change counts, and the least time between two progress reports.
QUIET, PROGRESS_MS = "10 seconds", 250


def debounced(events: DataFrame, key: str, *, ts: str = "ts", quiet: str = QUIET) -> DataFrame:
    """(key, first, last, n): bursts of a key's events, each ended by a quiet time.  For streams too, with a watermark on ts.

    A stream yields a burst once the watermark has passed its end.
    """
    # A cast would hide a watermark, so only other types get one.
    time = F.col(ts) if dict(events.dtypes)[ts] == "timestamp" else F.col(ts).cast("timestamp")
    burst = F.session_window(time, quiet)
    return events.groupBy(F.col(key), burst.alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("w")


def coalesced(events: DataFrame, key: str, *, seq: str = "seq", data: str = "data") -> DataFrame:
    """(key, place, data): the latest data of each key at the place of its first event; events without a key all stay."""
    named = events.filter(F.col(key) != "")
    kept = named.groupBy(key).agg(F.min(seq).alias("place"), F.max_by(data, seq).alias(data))
    return kept.select(key, "place", data).unionByName(events.filter(F.coalesce(F.col(key), F.lit("")) == "").select(key, F.col(seq).alias("place"), data))


def queued(requests: DataFrame, key: str, *, seq: str = "seq", force: str = "force") -> DataFrame:
    """(key, place, force): one entry for each key in order of its first request, forced if any of its requests is."""
    return requests.groupBy(key).agg(F.min(seq).alias("place"), F.bool_or(force).alias("force"))


def throttled(events: DataFrame, key: str, *, ms: str = "ms", every: int = PROGRESS_MS, at_once: str | None = None, flush: bool = False) -> DataFrame:
    """(key, ms): of each key's events those reported: the first, and each one at least ``every`` after the last reported.

    Events whose column ``at_once`` is true are reported whatever the time and count as the last reported; ``flush`` reports each
    key's last event as well, once.  A key's events pass a task in order of time, with one number kept between them, so a hot key costs time but no memory; from
    one report the next is found by bisection.
    """
    names = {key: dict(events.dtypes)[key], ms: "bigint"}
    urgent = F.lit(False) if at_once is None else F.coalesce(F.col(at_once), F.lit(False))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, seen, held = None, None, None, []  # key, time last reported, time last seen, rows to send

        def ended() -> list[tuple]:
            return [(now, seen)] if flush and seen is not None and seen != last else []

        for frame in frames:
            keys, times, forced = frame[key], frame[ms].to_numpy(), np.flatnonzero(frame["__now"].to_numpy())
            same = keys.eq(keys.shift()) | (keys.isna() & keys.shift().isna())
            starts = np.union1d([0], np.flatnonzero(~same.to_numpy())).astype(int)
            for low, high in zip(starts, [*starts[1:], len(times)], strict=True):
                if low == high:
                    continue
                of = None if pd.isna(keys.iloc[low]) else keys.iloc[low]
                if seen is None or of != now:
                    held += ended()
                    now, last = of, None
                at = low
                while at < high:
                    due = at if last is None else low + int(np.searchsorted(times[low:high], last + every))
                    soon = int(np.searchsorted(forced, at))
                    at = min(max(due, at), forced[soon] if soon < len(forced) else high, high)
                    if at < high:
                        held.append((now, times[at]))
                        last, at = times[at], at + 1
                seen = times[high - 1]
            yield pd.DataFrame(held, columns=[key, ms]).astype({ms: "int64"})
            held = []
        yield pd.DataFrame(ended(), columns=[key, ms]).astype({ms: "int64"})

    rows = events.select(F.col(key), F.col(ms).cast("bigint").alias(ms), urgent.alias("__now")).filter(F.col(ms).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, ms).mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in names.items()))


def throttled_stream(events: DataFrame, key: str, *, ms: str = "ms", every: int = PROGRESS_MS) -> DataFrame:
    """throttled() of a stream in order of arrival; the state of a key is the time last reported."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for b in batches for t in b[ms]):
            if last is None or t >= last + every:
                out.append(t)
                last = t
        if out:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), ms: out})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ms} bigint", "last bigint", "append", "NoTimeout")


def coalesced_stream(events: DataFrame, key: str, *, seq: str = "seq", data: str = "data") -> DataFrame:
    """coalesced() of a stream as running rows (update mode): each batch yields the new latest of the keys it has."""
    return events.filter(F.col(key) != "").groupBy(key).agg(F.min(seq).alias("place"), F.max_by(data, seq).alias(data))


def watched(spark: SparkSession, folder: str, *, glob: str = "*", files_a_batch: int | None = None) -> DataFrame:
    """A stream of (path, dir, mtime, size) of files as they appear in a folder and its subfolders, new ones too.

    Only names, times and sizes are read.  Give debounced() the stream with a watermark on mtime to start one run for a burst of
    changes; ``files_a_batch`` bounds a trigger.
    """
    kind = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    return reader.load(folder).select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def served(queue: DataFrame, *, place: str = "place", seconds: str = "seconds") -> DataFrame:
    """queue with ``start`` and ``end`` in seconds: one job at a time in order of place.  A queue has a row a library."""
    order = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(seconds).over(order)
    return queue.withColumns({"start": end - F.col(seconds), "end": end})


def interval_changes(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(library_id, change) between jobs (library_id, every) that should run and that do."""
    both = wanted.withColumnRenamed("every", "new").join(have.withColumnRenamed("every", "old"), "library_id", "full")
    change = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(F.col("new") != F.col("old"), "replace")
    return both.select("library_id", change.alias("change")).filter(F.col("change").isNotNull())
