"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a Gray-order hierarchical index.

Fingerprints that differ in at most d bits agree in one of d + 1 blocks of bits, so each distinct fingerprint goes
to d + 1 groups, rotated to have the group's block on top.  In a group the rotated fingerprints are sorted by Gray
rank and cut into nodes of ``FAN`` neighbours, those into upper nodes, up to one root.  A node factors out the
bits that all below it share (mask and pattern).  A search descends pairs of nodes: the differences in bits that both
fix, accumulated from above, prune whole pairs of nodes once they exceed d; and where even all open bits
leave no more than d differences the two nodes are linked as a whole.  No pairs are listed beyond a
bounded front, and a group passes on a spanning forest of its links, never all pairs.

A group beyond ``run_limit`` fingerprints is dealt into chunks and every pair of chunks is searched by its own task.
Exact copies share one fingerprint and are settled by one aggregation.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import files
from .graph import components

BITS, FAN, FRONT = 64, 8, 1 << 18

#: _SPREAD[b] has bit i of the byte b in its byte i.
_SPREAD = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None].repeat(8, 2) * np.array([1, 0, 0, 0, 0, 0, 0, 0], np.uint8), axis=2, bitorder="little").reshape(256, 8).copy().view("<u8").ravel()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included; of all words if they are fewer; none if none."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    grams = zip(*(words[i:] for i in range(size)), strict=False)
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, grams), repeat(42)), dtype=np.uint64, count=len(words) - size + 1)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each list: a bit is 1 if it is set in over half the hashes."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    sizes = sizes[some]
    flat = np.concatenate([hashes[i] for i in some])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    pieces = (sizes + 254) // 255  # sums of bytes that can't overflow
    at = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    lanes = _SPREAD[flat.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(len(at), BITS).astype(np.int64)
    counts = np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=0)
    out[some] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(key, doc_id, fp): each whole text's fingerprint as a signed long with the same bits; key is row_key()."""

    def run(batches):
        for batch in batches:
            keys, ids, texts = batch.columns
            fps, waiting, n = [], [], 0
            for t in texts:
                waiting.append(shingle_hashes(t.as_py(), size))
                n += len(waiting[-1])
                if n >= 1 << 15:
                    fps.append(majority(waiting))
                    waiting, n = [], 0
            fps.append(majority(waiting))
            yield pa.RecordBatch.from_arrays([keys, ids, pa.array(np.concatenate(fps).view(np.int64))], names=["key", "doc_id", "fp"])

    return docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key long, doc_id long, fp long")


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """A code's place in the Gray order: neighbours there differ in one bit."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Levels of nodes over codes that are sorted by (run, Gray rank); runs are never mixed in a node."""

    def __init__(self, codes: np.ndarray, runs: np.ndarray):
        full = ~np.uint64(0)
        self.masks, self.patterns, self.kids = [np.full(len(codes), full)], [codes], [None]
        self.first = [np.arange(len(codes))]
        at = runs
        while len(at) > len(np.unique(at)):
            heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
            starts = np.flatnonzero(place % FAN == 0)
            masks, patterns = self.masks[-1], self.patterns[-1]
            ones = np.bitwise_and.reduceat(patterns & masks, starts)
            zeros = np.bitwise_and.reduceat(~patterns & masks, starts)
            self.masks.append(ones | zeros)
            self.patterns.append(ones)
            self.kids.append((starts, np.diff(np.append(starts, len(at)))))
            self.first.append(self.first[-1][starts])
            at = at[starts]

    def links(self, most: int):
        """(a, b) in bounded batches: places of codes that are linked; at least a spanning set of all links with up to ``most`` differences."""
        top = len(self.masks) - 1
        stack = [(top, np.arange(len(self.masks[top])), np.arange(len(self.masks[top])))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONT:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            fixed = self.masks[level][a] & self.masks[level][b]
            apart = np.bitwise_count((self.patterns[level][a] ^ self.patterns[level][b]) & fixed)
            near = apart <= most
            whole = near & (apart + (BITS - np.bitwise_count(fixed)) <= most)
            if whole.any():
                yield from self._whole(level, a[whole], b[whole])
            a, b = a[near & ~whole], b[near & ~whole]
            if level == 0 or not len(a):
                continue
            starts, counts = self.kids[level]
            na, nb = counts[a], counts[b]
            pairs = na * nb
            which = np.repeat(np.arange(len(a)), pairs)
            k = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            ka, kb = starts[a][which] + k // nb[which], starts[b][which] + k % nb[which]
            once = ka <= kb  # a pair of equal nodes has each pair of children once
            stack.append((level - 1, ka[once], kb[once]))

    def _whole(self, level: int, a: np.ndarray, b: np.ndarray):
        """Every code below a and b is linked with every other: a star around the first."""
        last = np.append(self.first[level], len(self.masks[0]))
        hub = self.first[level][a]
        for node in (a, b):
            n = last[node + 1] - last[node]
            members = np.repeat(last[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(hub, n), members


def forest(links, n: int) -> np.ndarray:
    """Each vertex' least connected vertex."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (down := root[root] != root).any():
                root[down] = root[root[down]]
    return root


def _rotated(fp: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    return np.where(by == 0, fp, (fp << by) | (fp >> ((np.uint64(BITS) - by) % np.uint64(BITS))))


def links(fps: DataFrame, *, most: int = 3, run_limit: int = 1_000_000, buffer: int = 1 << 16) -> DataFrame:
    """(u, v): a spanning set of the links between distinct fingerprints (column fp) with ``most`` differing bits or fewer."""
    width = BITS // (most + 1)
    blocks = F.array(*(F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(F.shiftleft("fp", j * width) if j else F.col("fp"), BITS - width).alias("key")) for j in range(most + 1)))
    rows = fps.select("fp", F.inline(blocks))
    # At most (most + 1) * fingerprints / run_limit groups are so large; Spark joins them by the size it sees.
    large = rows.groupBy("j", "key").count().filter(F.col("count") > run_limit).select("j", "key", F.ceil(F.col("count") / run_limit).cast("int").alias("chunks"))
    rows = rows.join(large, ["j", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    chunks = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.struct(F.least(i, own).alias("a"), F.greatest(i, own).alias("b")))
    )
    rows = rows.select("fp", "j", "key", F.inline(chunks))
    rows = rows.repartition("j", "key", "a", "b").sortWithinPartitions("j", "key", "a", "b")

    def search(parts):
        held = [np.concatenate(x) for x in zip(*parts, strict=True)]
        fp, j, run = held[0].view(np.uint64), held[1], held[2]
        codes = _rotated(fp, j * width)
        order = np.lexsort((gray_rank(codes), run))
        fp, codes, run = fp[order], codes[order], run[order]
        root = forest(GrayIndex(codes, run).links(most), len(fp))
        out = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[out].view(np.int64)), pa.array(fp[root[out]].view(np.int64))], names=["u", "v"])

    def run(batches):
        parts, n, last, number = [], 0, None, 0
        for batch in batches:
            fp, j, key, a, b = (c.to_numpy() for c in batch.columns)
            if not len(fp):
                continue
            group = np.stack([j, key, a, b], axis=1)
            new = np.concatenate([[last is None or (group[0] != last).any()], (group[1:] != group[:-1]).any(axis=1)])
            runs = number + np.cumsum(new)
            number, last = int(runs[-1]), group[-1]
            if n >= buffer and new.any():  # only whole runs leave the buffer
                cut = int(np.flatnonzero(new)[-1])
                parts.append((fp[:cut], j[:cut], runs[:cut]))
                yield search(parts)
                parts, n = [], 0
                fp, j, runs = fp[cut:], j[cut:], runs[cut:]
            parts.append((fp, j, runs))
            n += len(fp)
        if n:
            yield search(parts)

    return rows.mapInArrow(run, "u long, v long")


def _rooted(docs: DataFrame, *, id_col: str, text_col: str, size: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, fp) of all rows, and (fp, first, root) of all fingerprints; root names a component."""
    spark = docs.sparkSession
    all_ = files.written(spark, fingerprints(docs, id_col=id_col, text_col=text_col, size=size), "fingerprints")
    classes = files.written(spark, all_.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.min("doc_id").alias("least")), "classes")
    joined = components(spark, links(classes.select("fp"), most=most))
    return all_, classes.join(joined, classes.fp == joined.id, "left").select("fp", "first", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable by links, the document's own included.

    Defined cases: null and empty texts have the fingerprint zero and link like others; repeated ids keep a row each; a null id
    takes part, and is the component's id only if no other is there; an empty table gives no rows; other columns are ignored.
    """
    all_, rooted = _rooted(docs, id_col=id_col, text_col=text_col, size=size, most=most)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("fp", "component_id")
    return all_.join(found, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 3) -> DataFrame:
    """docs with one row of each component: that with the smallest id (null first); of equal rows one stays, and of rows with equal id
    and text but other columns any.  All columns stay as they are; null and empty texts, ties and empty tables: near_duplicates()."""
    own = files.inner(docs)
    _, rooted = _rooted(docs, id_col=id_col, text_col=text_col, size=size, most=most)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(f"{own}kept")).distinct()
    kept = files.written(docs.sparkSession, kept, "kept")
    keyed = docs.withColumn(f"{own}key", row_key(id_col, text_col))
    # Rows that repeat a key are few wherever ids are ids; they meet after all others have gone.
    out = keyed.join(kept.hint("shuffle_hash"), F.col(f"{own}key") == F.col(f"{own}kept"))
    once = F.row_number().over(Window.partitionBy(f"{own}key").orderBy(F.lit(0)))
    return out.withColumn(f"{own}n", once).filter(F.col(f"{own}n") == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
