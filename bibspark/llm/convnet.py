"""A byte-level convolutional network in numpy that scores texts for quality.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Every byte has a learned vector; learned
filters of ``WIDTH`` bytes pass over a chunk at steps of ``STEP``; each filter keeps its largest response in the chunk, and the
text's features are the largest and the mean of its chunks' responses.  A logistic layer over them gives one
probability.  Empty texts are padded with zero bytes and scored like others.

Training reads at most ``max_rows`` labelled rows (those with the smallest hashes, so any size gives such a sample) whose
whole texts have at most ``max_bytes`` bytes together, and passes ``epochs`` times over them with a rate that falls to the
last; all three are parameters, and nothing else ends training or leaves a text out.  Scoring covers every byte of every text.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files

WIDTH, STEP, EMBED, FILTERS = 12, 4, 6, 48
#: Windows of a chunk; chunks overlap by WIDTH - STEP bytes, so windows run on from one to the next.
WINDOWS = 256


@dataclass
class Net:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    top: np.ndarray  # (2 * FILTERS,)
    offset: np.ndarray  # (1,)


def new_net(seed: int = 5) -> Net:
    rng = np.random.default_rng(seed)
    return Net(rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), np.zeros(1, np.float32))


def padded(text: bytes) -> np.ndarray:
    """The text's bytes with zeros up to the end of its last window."""
    n = max(WIDTH, len(text))
    n += -(n - WIDTH) % STEP
    return np.frombuffer(text.ljust(n, b"\0"), np.uint8)


def responses(net: Net, data: np.ndarray) -> np.ndarray:
    """(windows, FILTERS) over padded bytes."""
    x = net.embed[data].ravel()
    n = (len(data) - WIDTH) // STEP + 1
    rows = np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STEP * EMBED * x.itemsize, x.itemsize))
    return rows @ net.filters + net.bias


def features(net: Net, data: np.ndarray) -> np.ndarray:
    """The largest and the mean of the chunks' largest responses, chunk by chunk: memory doesn't grow with the text."""
    best, total, chunks = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.float32), 0
    n = (len(data) - WIDTH) // STEP + 1
    for at in range(0, n, 16 * WINDOWS):
        m = min(n - at, 16 * WINDOWS)
        r = responses(net, data[at * STEP : (at + m - 1) * STEP + WIDTH])
        pooled = np.maximum(np.maximum.reduceat(r, np.arange(0, m, WINDOWS), axis=0), 0)
        best, total, chunks = np.maximum(best, pooled.max(0)), total + pooled.sum(0), chunks + len(pooled)
    return np.concatenate([best, total / chunks])


def probability(net: Net, texts: list[bytes]) -> np.ndarray:
    z = np.array([features(net, padded(t)) @ net.top + net.offset[0] for t in texts], np.float64)
    return 1 / (1 + np.exp(-z))


def _gradients(net: Net, text: bytes, label: float, weight: float) -> tuple[Net, float]:
    """Of the weighted log loss; only the windows that a maximum picks carry any."""
    data = padded(text)
    r = responses(net, data)
    starts = np.arange(0, len(r), WINDOWS)
    pick = np.stack([r[s : s + WINDOWS].argmax(0) + s for s in starts])  # (chunks, FILTERS)
    pooled = np.maximum(r[pick, np.arange(FILTERS)], 0)
    top = pooled.argmax(0)
    feats = np.concatenate([pooled.max(0), pooled.mean(0)])
    z = float(feats @ net.top + net.offset[0])
    p = 1 / (1 + np.exp(-z))
    loss = -weight * np.log(max(1e-9, p if label else 1 - p))
    d = np.float32(weight * (p - label))
    g_pooled = np.repeat(d * net.top[None, FILTERS:] / len(starts), len(starts), 0)
    g_pooled[top, np.arange(FILTERS)] += d * net.top[:FILTERS]
    g_pooled *= pooled > 0
    bytes_at = data[pick[:, :, None] * STEP + np.arange(WIDTH)]  # (chunks, FILTERS, WIDTH)
    x = net.embed[bytes_at].reshape(len(starts), FILTERS, -1)
    g_filters = np.einsum("cfk,cf->kf", x, g_pooled)
    g_x = (g_pooled[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    g_embed = np.stack([np.bincount(bytes_at.ravel(), g_x[:, e], 256) for e in range(EMBED)], 1).astype(np.float32)
    return Net(g_embed, g_filters, g_pooled.sum(0), d * feats, np.array([d], np.float32)), loss


def train(texts: list[bytes], labels: list[int], *, epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 5) -> Net:
    """Adam over balanced log loss."""
    net, rng = new_net(seed), np.random.default_rng(seed)
    y = np.array(labels)
    share = y.mean() if len(y) else 0.5
    weights = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    names = [f.name for f in fields(Net)]
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sums = {k: np.zeros_like(getattr(net, k)) for k in names}
            for i in rows:
                g, _ = _gradients(net, texts[i], float(y[i]), float(weights[i]))
                for k in names:
                    sums[k] += getattr(g, k)
            t += 1
            step = rate * (1 - epoch / epochs)
            for k in names:
                g = sums[k] / len(rows)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                getattr(net, k)[...] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_rows: int, max_bytes: int) -> DataFrame:
    """(id, y, t): at most ``max_rows`` labelled rows, as many of each label as there are up to half, with whole texts of at most
    ``max_bytes`` in all.  The driver sees ids and sizes alone."""
    spark = docs.sparkSession
    clean = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    clean = clean.groupBy("id").agg(F.min("y").alias("y"))
    chosen = []
    for y in (0, 1):
        chosen += [(r[0], y) for r in clean.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows // 2).select("id").collect()]
    # At most max_rows short rows: a bound that doesn't grow with the data.
    few = F.broadcast(spark.createDataFrame(chosen, "id long, y int"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).join(few, "id")
    # One text for each id, however many rows repeat it: at most max_rows rows are written, and read twice.
    found = files.written(spark, found.groupBy("id", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), F.octet_length("t"))).alias("t")), "sample")
    total, keep = 0, []
    for _, i, n in sorted((zlib.crc32(str(r[0]).encode()), r[0], r[1]) for r in found.select("id", F.octet_length("t")).collect()):
        if total + n <= max_bytes:  # else the next that still fits
            total += n
            keep.append((i,))
    return found.join(F.broadcast(spark.createDataFrame(keep, "id long")), "id")


def learned(sample: DataFrame, epochs: int) -> Net:
    """The net of a labelled_sample(), trained by one task with one thread: the sample is bounded, and matrices this small lose by sharing."""

    def run(batches):
        rows = sorted((r["id"], r["y"], r["t"] or "") for b in batches for r in b.to_pylist())
        net = train([t.encode() for _, _, t in rows], [y for _, y, _ in rows], epochs=epochs)
        yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps([getattr(net, f.name) for f in fields(Net)])], pa.binary())})

    found = sample.select("id", "y", "t").coalesce(1).mapInArrow(run, "net binary").first()
    return Net(*pickle.loads(found[0])) if found else new_net()


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: Column | None = None, max_rows: int = 4000, max_bytes: int = 10_000_000, epochs: int = 6) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text; rows that ``held_out`` marks are never learned from.

    Defined cases: a null text is empty; a null label, and one other than 0 and 1, is left out; a document labelled twice counts once, as
    the lower; repeated ids are rows of their own, and teach once, by the text of the least hash; a very long text is scored whole, and
    learned from whole if it fits ``max_bytes``; ties at the end of the sample go by id; without labelled rows every score is 0.5;
    an empty table gives no rows; other columns are never read.
    """
    spark = docs.sparkSession
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    open_ = labels if held_out is None else labels.filter(~held)
    sample = labelled_sample(docs, open_, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows, max_bytes=max_bytes)
    shared = spark.sparkContext.broadcast(learned(sample, epochs))

    def run(batches):
        net = shared.value
        for batch in batches:
            p = probability(net, [(t.as_py() or "").encode() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
