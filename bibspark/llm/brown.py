"""Scoring texts with a Brown class-based bigram model.

A token's probability is P(class | class before) * P(item | class) * P(word | item).  Items are what the exchange clustering
moves between classes: every word seen ``min_count`` times in training (so their number grows with the corpus) is an item of its
own, and every other word, known or not, belongs to one of ``SUFFIXES`` items by its last bytes.  Within such an item words have
discounted relative frequencies, and the discount is left to words never seen.  Class transitions are smoothed towards class
frequencies, so the model sums to one and never gives zero.

Texts are scanned once in blocks of about ``block_tokens`` tokens: a block's distinct words are listed once, joined with the counted
vocabulary by word, and come back as counts and item numbers, so no task and not the driver ever holds the vocabulary.  What
depends on the words alone is summed by document at once; the texts stay as item numbers for all turns and the score.

Exchange: each turn scans these, counts for each item the classes before and after it, and sends the counts to the task that
has the item, which moves it to the class that gains most likelihood.  The first turn moves all items, each later one every other
item, in turn; turns end when two in a row gain less than ``tolerance`` nats a training token, and the best classes stay.  The
driver holds the classes-by-classes counts and an item's class, a byte or two each, which is what tasks are sent.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files

SUFFIXES, DISCOUNT, PRIOR, FLOOR = 2048, 0.5, 8.0, 0.1
#: The token that ends every text; it stands before its first token too.
END = b""
#: Items whose counts one task adds up at a time.
_BUCKET = 16384
#: Items and classes beside them that a task sorts and sums at a time.
_KEYS = 1 << 23
#: Bytes of packed sums that a task gathers before it sends them.
_PACKED = 1 << 26


def tokens(text: str | None) -> list[bytes]:
    """Words in ASCII lower case, as UTF-8, then the end."""
    return [*(text or "").encode().lower().split(), END]


def suffix(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SUFFIXES


@dataclass
class Vocabulary:
    """Totals, the suffix items' sums, and the words that are items as a table (word, c, item), by falling count."""

    total: int
    distinct: int
    size: int
    table: DataFrame
    rare: np.ndarray  # tokens of each suffix item
    types: np.ndarray  # distinct training words of each suffix item

    @property
    def unit(self) -> float:
        return float(self.total + self.distinct + 1)

    @cached_property
    def words(self) -> list[bytes]:
        """All words that are items, on the driver: to look at small models."""
        return [bytes(r.word) for r in self.table.orderBy("item").select("word").collect()]

    @cached_property
    def counts(self) -> np.ndarray:
        """Of the words that are items, then of the suffix items."""
        return np.concatenate([np.array([r.c for r in self.table.orderBy("item").select("c").collect()], np.int64), self.rare])


class Items(dict):
    """word -> item of a small model; other words by their suffix, kept until ``limit`` of them."""

    def __init__(self, words: list[bytes], limit: int = 250_000):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.base, self.limit = words, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.limit + len(self.base):
            self.clear()
            self.update(zip(self.base, range(len(self.base)), strict=True))
        item = self[word] = len(self.base) + suffix(word)
        return item


def vocabulary(training: DataFrame, *, share: float = 0.0, min_count: int = 5, flush: int = 250_000) -> tuple[DataFrame, Vocabulary]:
    """The counted vocabulary (word, c, item) as a written table, item null for words of suffix items, and its summary."""
    spark, made = training.sparkSession, files.mark()

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) >= flush:
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    words = training.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    words = files.written(spark, words, "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = max(share * total, min_count)
    frequent = (F.col("c") >= least) | (F.length("word") == 0)
    order = [F.desc("c"), F.asc("word")]
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = words.filter(frequent).repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())
    top = files.written(spark, top, "frequent")
    part, size, bases = F.shiftright("m", 33), 0, []
    for p, n in sorted(tuple(r) for r in top.groupBy(part).agg(F.count("*")).collect()):  # a row a partition
        bases.append((p, size))
        size += n
    bases = F.broadcast(spark.createDataFrame(bases, "p long, base long"))
    top = top.join(bases, part == F.col("p")).select("word", "c", (F.col("base") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("item"))

    def by_suffix(batches):
        n, t = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
        for batch in batches:
            at = np.array([suffix(w) for w in batch.column(0).to_pylist()], np.int64)
            np.add.at(n, at, batch.column(1).to_numpy())
            np.add.at(t, at, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SUFFIXES)), pa.array(n), pa.array(t)], names=["s", "n", "t"])

    rest = words.filter(~frequent).select("word", "c").mapInArrow(by_suffix, "s long, n long, t long").groupBy("s").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    n, t = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    for r in rest:
        n[r.s], t[r.s] = r.n, r.t
    items = files.written(spark, top.unionByName(words.filter(~frequent).select("word", "c", F.lit(None).cast("long").alias("item"))), "items")
    files.drop_since(spark, made)
    return items, Vocabulary(int(total), int(distinct), int(size), items.filter("item is not null"), n, t)


def _numbers(table: dict, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.int32, count=len(words))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


class _Block(dict):
    """word -> its place among the block's words."""

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


def _blob(x: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, kind).data)


def _unblob(data: pa.Scalar | bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data if isinstance(data, bytes) else data.as_buffer()), kind)


def coded(docs: DataFrame, vocab: Vocabulary, words: DataFrame | None = None, *, block_tokens: int = 2_000_000) -> DataFrame:
    """Blocks of whole texts: by document what the words alone give, and all texts as item numbers back to back.

    Rows without doc_id or held_out are training texts.
    """
    spark, made = docs.sparkSession, files.mark()
    words = vocab.table if words is None else words
    kinds = {"doc_id": ("long", None), "text": ("string", None), "held_out": ("boolean", False)}
    docs = docs.select(*((F.col(c) if c in docs.columns else F.lit(none)).cast(kind).alias(c) for c, (kind, none) in kinds.items()))

    def scan(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting, n, table = [], 0, _Block()

        def block():
            waiting.sort(key=lambda w: bool(w[1]))  # training texts first
            code = _blob(np.concatenate([w[2] for w in waiting]), "<i4")
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number]), "doc_id": pa.array([[w[0] for w in waiting]], pa.list_(pa.int64())), "held_out": pa.array([[w[1] for w in waiting]], pa.list_(pa.bool_())),
                "n_tokens": pa.array([[len(w[2]) for w in waiting]], pa.list_(pa.int64())), "code": pa.array([code], pa.binary()), "words": pa.array([list(table)], pa.list_(pa.binary())),
            })

        for batch in batches:
            for doc, text, out in zip(*(batch.column(i) for i in range(3)), strict=True):
                waiting.append((doc.as_py(), out.as_py(), _numbers(table, tokens(text.as_py()))))
                n += len(waiting[-1][2])
                if n >= block_tokens:
                    yield block()
                    number, waiting, n, table = number + 1, [], 0, _Block()
        if waiting:
            yield block()

    blocks = files.written(spark, docs.mapInArrow(scan, "block long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, code binary, words array<binary>"), "blocks")
    size, rare, types, unit = vocab.size, vocab.rare.astype(float), vocab.types.astype(float), vocab.unit
    listed = blocks.select("block", F.posexplode("words").alias("at", "word")).join(words, "word", "left")
    other = F.lit(size) + F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(SUFFIXES))
    listed = listed.select("block", "at", F.coalesce("c", F.lit(0).cast("long")).alias("c"), F.coalesce("item", other).cast("long").alias("item"))

    def packed(batches):
        now, held = None, []
        for batch in batches:
            block, pairs = batch.column(0).to_numpy(), np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if now is not None and block[low] != now:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([_blob(np.concatenate(held, 1), "<i8")], pa.binary())], names=["block", "found"])
                    held = []
                now = int(block[low])
                held.append(pairs[:, low:high].copy())
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([_blob(np.concatenate(held, 1), "<i8")], pa.binary())], names=["block", "found"])

    # Sorted rather than collected: a task holds one block's words at a time.
    found = listed.repartition("block").sortWithinPartitions("block", "at").mapInArrow(packed, "block long, found binary")
    back = blocks.drop("words").join(found, "block").select("doc_id", "held_out", "n_tokens", "code", "found")

    def number(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda k: batch.column(k)[row].values  # noqa: B023, E731
                code = _unblob(batch.column("code")[row], "<i4")
                c, item = _unblob(batch.column("found")[row], "<i8").reshape(2, -1)
                own, of = item < size, np.maximum(item - size, 0)
                # The share of a word in its item, and the item's tokens: its class has the rest.
                mass = np.log10(np.where(own, c, rare[of]) + FLOOR)
                unknown = np.where(rare[of] > 0, DISCOUNT * types[of] / np.maximum(rare[of], 1), 1.0)
                within = np.where(own, 0.0, np.log10(np.where(own, 1.0, np.where(c > 0, (c - DISCOUNT) / np.maximum(rare[of], 1), unknown))))
                sizes = get("n_tokens").to_numpy()
                starts = np.cumsum(sizes) - sizes
                per = lambda x: np.add.reduceat(x[code], starts)  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({
                    **{k: pa.array([get(k)], t) for k, t in (("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())))},
                    "n_known": pa.array([per((c > 0).astype(np.int64))], pa.list_(pa.int64())), "base": pa.array([per(np.log10((c + 1) / unit))], pa.list_(pa.float64())),
                    "within": pa.array([per(within + mass)], pa.list_(pa.float64())), "items": pa.array([_blob(item[code], "<u4")], pa.binary()),
                    "n_train": pa.array([int(sizes[~get("held_out").to_numpy(zero_copy_only=False)].sum())], pa.int64()),
                })

    kinds = "doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, within array<double>, items binary, n_train long"
    out = files.written(spark, back.mapInArrow(number, kinds), "coded")
    files.drop_since(spark, made)
    return out


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 by bytes, the low ones of all first: the high ones are mostly zero and pack to nothing."""
    return _blob(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T, "u1")


def _unplanes(data: pa.Scalar | bytes) -> np.ndarray:
    return np.ascontiguousarray(_unblob(data, "u1").reshape(4, -1).T).view("<u4").ravel()


def _buckets(items: int) -> int:
    """A power of two, so that an item's bucket is its low bits."""
    return 1 << max(6, (-(-items // _BUCKET) - 1).bit_length())


def _training(batches):
    """Item numbers of each block's training texts, which stand first; the end of one text stands before the next."""
    for batch in batches:
        for row in range(batch.num_rows):
            n = batch.column("n_train")[row].as_py()
            if n:
                yield _unblob(batch.column("items")[row], "<u4")[:n]


_TEXTS = ("n_train", "items")


def pair_counts(texts: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """(class before, class) counts of coded() training texts."""
    shared = texts.sparkSession.sparkContext.broadcast(_small(classes, n_classes))

    def count(batches):
        of, out = shared.value, np.zeros(n_classes * n_classes, np.int64)
        for at in _training(batches):
            c = of[at]
            out += np.bincount(np.roll(c, 1) * np.uint32(n_classes) + c, minlength=len(out))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "n"])

    out = np.zeros(n_classes * n_classes, np.int64)
    for r in texts.select(*_TEXTS).mapInArrow(count, "i long, n long").filter("n > 0").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r.i] = r.n
    shared.unpersist()
    return out.reshape(n_classes, n_classes)


def _small(classes: np.ndarray, n_classes: int) -> np.ndarray:
    return classes.astype("<u1" if n_classes <= 1 << 8 else "<u2")


def _by_bucket(texts: DataFrame, classes: np.ndarray, n_classes: int, finish, schema: str) -> list:
    """Rows of finish(bucket, counts): how often each class stands before and after each item; items go round the buckets."""
    spark, n, width = texts.sparkSession, len(classes), 2 * n_classes
    n_buckets = _buckets(n)
    rows, bits = -(-n // n_buckets), n_buckets.bit_length() - 1
    shared = spark.sparkContext.broadcast(_small(classes, n_classes))
    kind = np.uint32 if n_buckets * rows * width < 1 << 32 else np.uint64

    bounds = (np.arange(n_buckets, dtype=np.uint64) * (rows * width)).astype(kind)

    def sums(held, parts):
        """Adds the sums of these keys to each bucket's parts, packed; returns their bytes."""
        keys = np.concatenate(held)
        held.clear()
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        seen, keys = np.diff(first, append=len(keys)).astype(np.uint32), keys[first]
        cuts, size = np.append(np.searchsorted(keys, bounds), len(keys)), 0
        for b in range(n_buckets):
            own = slice(cuts[b], cuts[b + 1])
            if cuts[b + 1] > cuts[b]:
                parts[b].append((_planes(np.diff(keys[own].astype(np.int64), prepend=b * rows * width)), _planes(seen[own])))
                size += sum(map(len, parts[b][-1]))
        return size

    def merged(parts):
        """A row for each bucket: a task's parts of it as one."""
        for b, own in parts.items():
            if len(own) > 1:
                keys = np.concatenate([np.cumsum(_unplanes(k), dtype=np.int64) for k, _ in own])
                order = np.argsort(keys, kind="stable")
                keys, seen = keys[order], np.concatenate([_unplanes(n) for _, n in own])[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                parts[b] = [(_planes(np.diff(keys[first], prepend=0)), _planes(np.add.reduceat(seen.astype(np.int64), first)))]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(list(parts), pa.int64()), "keys": pa.array([own[0][0] for own in parts.values()], pa.binary()), "seen": pa.array([own[0][1] for own in parts.values()], pa.binary())})

    def count(batches):
        of, held, size, parts, kept = shared.value, [], 0, defaultdict(list), 0
        for at in _training(batches):
            x, c = at.astype(kind), of[at].astype(kind)
            place = ((x & kind(n_buckets - 1)) * kind(rows) + (x >> kind(bits))) * kind(width)
            held += [place + np.roll(c, 1), np.roll(place, 1) + kind(n_classes) + c]
            size += 2 * len(at)
            if size >= _KEYS:
                kept, size = kept + sums(held, parts), 0
            if kept >= _PACKED:
                yield merged(parts)
                parts, kept = defaultdict(list), 0
        if held:
            sums(held, parts)
        if parts:
            yield merged(parts)

    def total(batches):
        now, held = None, None
        for batch in batches:
            for b, keys, seen in zip(*(batch.column(i) for i in range(3)), strict=True):
                if b.as_py() != now:
                    if now is not None:
                        yield finish(now, held.reshape(rows, width))
                    now, held = b.as_py(), np.zeros(rows * width, np.int64)
                held[np.cumsum(_unplanes(keys), dtype=np.int64)] += _unplanes(seen)
        if now is not None:
            yield finish(now, held.reshape(rows, width))

    parts = texts.select(*_TEXTS).mapInArrow(count, "bucket long, keys binary, seen binary").repartition("bucket").sortWithinPartitions("bucket")
    out = parts.mapInArrow(total, schema).collect()
    shared.unpersist()
    return out


def contexts(texts: DataFrame, vocab: Vocabulary, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """(items, 2 * n_classes): how often each class stands before and after each item, on the driver: to look at small models."""
    n_buckets = _buckets(len(classes))
    out = np.zeros((len(classes), 2 * n_classes), np.int64)
    for r in _by_bucket(texts, classes, n_classes, lambda b, seen: pa.RecordBatch.from_arrays([pa.array([b]), pa.array([_blob(seen, "<i8")], pa.binary())], names=["b", "seen"]), "b long, seen binary"):
        own = out[r.b :: n_buckets]
        own[:] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.seen), "<i8").reshape(-1, 2 * n_classes)[: len(own)]
    return out


def exchanged(texts: DataFrame, classes: np.ndarray, n_classes: int, pairs: np.ndarray, turn: int) -> np.ndarray:
    """Classes after one turn, each item moved by the task that has its counts; pairs are the class counts before it."""
    n_buckets, gain, small = _buckets(len(classes)), gains(pairs), _small(classes, n_classes)
    shared = texts.sparkSession.sparkContext.broadcast(small)

    def move(b, seen):
        own = shared.value[b::n_buckets].astype(np.int64)
        moving = (np.arange(len(own)) * n_buckets + b) % 2 == turn % 2 if turn else np.ones(len(own), bool)
        return pa.RecordBatch.from_arrays([pa.array([b]), pa.array([_small(best(seen[: len(own)], own, n_classes, gain, moving), n_classes).tobytes()], pa.binary())], names=["b", "classes"])

    out = classes.copy()
    for r in _by_bucket(texts, classes, n_classes, move, "b long, classes binary"):
        out[r.b :: n_buckets] = np.frombuffer(r.classes, small.dtype)
    shared.unpersist()
    return out


def transitions(seen: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """(class before, class) counts."""
    out = np.zeros((n_classes, n_classes), np.int64)
    np.add.at(out.T, classes, seen[:, :n_classes])
    return out


def gains(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs + 0.5
    return np.log(pairs * pairs.sum() / (pairs.sum(1)[:, None] * pairs.sum(0)[None, :]))


def best(seen: np.ndarray, classes: np.ndarray, n_classes: int, gain: np.ndarray, moving: np.ndarray) -> np.ndarray:
    score = seen[:, :n_classes] @ gain + seen[:, n_classes:] @ gain.T
    top = score.argmax(1)
    better = moving & (seen.sum(1) > 0) & (score[np.arange(len(classes)), top] > score[np.arange(len(classes)), classes])
    return np.where(better, top, classes)


def exchange(seen: np.ndarray, classes: np.ndarray, n_classes: int, moving: np.ndarray) -> np.ndarray:
    """Classes after each moving item went where the likelihood of class bigrams gains most."""
    return best(seen, classes, n_classes, gains(transitions(seen, classes, n_classes)), moving)


def likelihood(pairs: np.ndarray) -> float:
    """Nats a token that the classes of neighbours tell of each other: what exchange raises."""
    p = pairs / max(1, pairs.sum())
    free = p.sum(1)[:, None] * p.sum(0)[None, :]
    return float((p[p > 0] * np.log(p[p > 0] / free[p > 0])).sum())


def first_classes(vocab: Vocabulary, n_classes: int) -> np.ndarray:
    """The most frequent words in classes of their own, others by their last two bytes."""
    own, rows = n_classes // 4, vocab.table
    out = np.empty(vocab.size + SUFFIXES, np.int64)

    def start(batches):
        for batch in batches:
            item = batch.column(1).to_numpy()
            late = np.array([own + zlib.crc32(w[-2:]) % (n_classes - own) for w in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_blob(item, "<i8")], pa.binary()), pa.array([_blob(np.where(item < own, item, late), "<u2")], pa.binary())], names=["item", "class"])

    unpack = zstandard.ZstdDecompressor().decompress
    for r in rows.select("word", "item").mapInArrow(start, "item binary, class binary").toLocalIterator():
        out[np.frombuffer(unpack(r[0]), "<i8")] = np.frombuffer(unpack(r[1]), "<u2")
    out[vocab.size :] = own + np.arange(SUFFIXES) % (n_classes - own)
    return out


@dataclass
class Model:
    vocab: Vocabulary
    classes: np.ndarray
    step: np.ndarray  # log10 P(class | class before)
    mass: np.ndarray  # log10 of the tokens of each class
    gained: list[float]  # likelihood() before the first turn and after each

    @cached_property
    def item(self) -> np.ndarray:
        """log10 P(item | its class), on the driver: to look at small models."""
        return np.log10(self.vocab.counts + FLOOR) - self.mass[self.classes]


def train(training: DataFrame, *, share: float = 0.0, n_classes: int = 64, turns: int | None = None, tolerance: float = 0.002) -> tuple[DataFrame, Model]:
    """The counted vocabulary and the model of training texts; see fit()."""
    words, vocab = vocabulary(training, share=share)
    return words, fit(coded(training, vocab, words), vocab, n_classes=n_classes, turns=turns, tolerance=tolerance)


def fit(texts: DataFrame, vocab: Vocabulary, *, n_classes: int, turns: int | None, tolerance: float) -> Model:
    """The model of coded() training texts; as many turns as it takes, unless ``turns`` names a number."""
    classes = first_classes(vocab, n_classes)
    pairs = pair_counts(texts, classes, n_classes)
    gained, kept, idle = [likelihood(pairs)], (classes, pairs), 0
    while idle < 2 if turns is None else len(gained) <= turns:
        classes = exchanged(texts, classes, n_classes, pairs, len(gained) - 1)
        pairs = pair_counts(texts, classes, n_classes)
        now, top = likelihood(pairs), max(gained)
        idle = 0 if now >= top + tolerance else idle + 1
        if now > top:
            kept = classes, pairs
        gained.append(now)
    classes, pairs = kept[0], kept[1].astype(float)
    prior = (pairs.sum(0) + 1) / (pairs.sum() + n_classes)
    step = np.log10((pairs + PRIOR * prior) / (pairs.sum(1, keepdims=True) + PRIOR))
    # A class holds its items' tokens, which are its column's, and FLOOR for each item.
    mass = np.log10(np.maximum(pairs.sum(0) + FLOOR * np.bincount(classes, minlength=n_classes), FLOOR))
    return Model(vocab, classes, step, mass, gained)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None, share: float = 0.0, n_classes: int = 64, turns: int | None = None, tolerance: float = 0.002, block_tokens: int = 2_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; ``held_out`` marks rows not to learn from.

    Defined cases: a null text is empty and has the end alone; repeated ids are rows of their own; without training rows every word is
    unknown; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    words, vocab = vocabulary(docs.filter(~F.col("held_out")), share=share)
    texts = coded(docs, vocab, words, block_tokens=block_tokens)
    model = fit(texts, vocab, n_classes=n_classes, turns=turns, tolerance=tolerance)
    total, step, mass = vocab.total, model.step, model.mass
    shared = spark.sparkContext.broadcast(_small(model.classes, n_classes))
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def finish(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda k: batch.column(k)[row].values  # noqa: B023, E731
                of = shared.value[_unblob(batch.column("items")[row], "<u4")]
                sizes = get("n_tokens").to_numpy()
                starts = np.cumsum(sizes) - sizes
                before = np.concatenate([of[-1:], of[:-1]])  # every text ends with the end
                logs = np.add.reduceat(step[before, of] - mass[of], starts) + get("within").to_numpy()
                yield pa.RecordBatch.from_arrays([get("doc_id"), get("held_out"), get("n_tokens"), get("n_known"), pa.array(np.full(len(sizes), total)), get("base"), pa.array(logs)], names=list(names))

    return texts.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
