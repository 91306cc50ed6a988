"""Token ids in flat files of unsigned integers with 64-bit document offsets.

A corpus is a folder of shards and a manifest.  Shard ``s`` has ``<name>.ids``, the ids of its documents back to
back as little-endian unsigned integers (16 bits where the vocabulary fits, else 32), and ``<name>.idx``: its
documents' ids, then n + 1 offsets into ``.ids``, all little-endian 64-bit integers.  Shards hold ranges of
ascending ids; a shard's base, the number of ids in all shards before it, is a prefix sum over the manifest, so
that ``base + offset`` is a document's place in the corpus.  Both files can be memory-mapped.

Writing: documents are encoded where they are read, dealt by ranges of (id, first token bytes), sorted within a shard and
streamed out.  There are as many shards as hold ``shard_bytes`` bytes of text each, and two for each task that can run at once at
the least; their bounds are quantiles of a sample of as many rows a shard at any size, so that an id that repeats often
is dealt over several.  An attempt writes files of its own names and only a finished attempt's names enter the manifest, so
that lost executors and second attempts leave nothing wrong behind.  Reading maps local files, and takes ranges of the
others, a batch of documents at a time.

Defined cases: a null text is empty and yields the end id alone; null ids sort first and read back as null; a very long text is
written whole; repeated ids are kept, in the order of their token bytes; an empty table has no shards; other columns are
never read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .tokens import vocabulary_size, word_ids

#: A null document id in an .idx file.
_NULL = np.iinfo(np.int64).min
#: Token bytes of a document that tell its place among rows of one id; sampled rows for each shard.
_HEAD, _SAMPLE = 32, 8


def selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encoded(batches: Iterable[pa.RecordBatch], tokenizer: str, end_id: int | None, dtype: str) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """For batches of selected(): their ids, and each whole text's token ids packed as ``dtype`` with ``end_id`` at the end."""
    words, end = word_ids(tokenizer, dtype), b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()
    for batch in batches:
        yield batch.column(0), [(words.text(t.as_py()) if t.is_valid else b"") + end for t in batch.column(1)]


def write(docs: DataFrame, uri: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shards: int | None = None, shard_bytes: int = 1 << 28) -> dict:
    """Write docs as a corpus below ``uri``, in ``shards`` shards if it is given; returns the manifest.

    The driver holds ``_SAMPLE`` small rows for each shard.
    """
    spark = docs.sparkSession
    dtype = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(text_col).cast("string")))).first()
    n = shards or max(2 * spark.sparkContext.defaultParallelism, -(-(size or 0) // shard_bytes))

    def place(doc: int | None, ids: bytes) -> tuple:
        return doc is not None, doc or 0, ids[:_HEAD]

    def heads(batches):
        for ids, packed in encoded(batches, tokenizer, end_id, dtype):
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[:_HEAD] for x in packed], pa.binary())], names=["doc_id", "head"])

    sample = selected(docs, id_col, text_col).sample(min(1.0, _SAMPLE * n / max(1, rows)), seed=1)
    seen = sorted(place(r[0], bytes(r[1])) for r in sample.mapInArrow(heads, "doc_id long, head binary").collect())
    cuts = sorted({seen[i * len(seen) // n] for i in range(1, n)}) if seen else []

    width = np.dtype(dtype).itemsize

    def deal(batches):
        for ids, packed in encoded(batches, tokenizer, end_id, dtype):
            shard = [bisect_right(cuts, place(d, x)) for d, x in zip(ids.to_pylist(), packed, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids, pa.array(packed, pa.binary())], names=["shard", "doc_id", "ids"])

    def save(batches):
        name, shard, first, total, docs_, offsets = uuid.uuid4().hex, 0, True, 0, [], [0]
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        head = next(rows, None)
        if head is None:
            return
        shard = head[0]
        with files.new_file(f"{uri}/{name}.ids") as out:
            while head is not None:
                out.write(head[2])
                total += len(head[2]) // width
                docs_.append(_NULL if head[1] is None else head[1])
                offsets.append(total)
                head = next(rows, None)
        with files.new_file(f"{uri}/{name}.idx") as out:
            out.write(np.array(docs_ + offsets, dtype="<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "docs": [len(docs_)], "tokens": [total]})

    dealt = selected(docs, id_col, text_col).mapInArrow(deal, "shard int, doc_id long, ids binary")
    dealt = dealt.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("doc_id", "ids")
    done = sorted(dealt.mapInArrow(save, "shard int, name string, docs long, tokens long").collect(), key=lambda r: r.shard)
    base, parts = 0, []
    for r in done:
        parts.append({"name": r.name, "docs": r.docs, "tokens": r.tokens, "base": base})
        base += r.tokens
    manifest = {"dtype": dtype, "tokens": base, "shards": parts}
    with files.new_file(f"{uri}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class _Ranges:
    """Values of a file by place: a local file is mapped, of any other only the asked range is read."""

    def __init__(self, system, path: str, dtype: str):
        self.kind, size = np.dtype(dtype), system.get_file_info(path).size
        self.n = size // self.kind.itemsize
        local = system.type_name == "local" and self.n
        self.map, self.file = (np.memmap(path, dtype=dtype, mode="r"), None) if local else (None, system.open_input_file(path))

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[at]
        low, high, _ = at.indices(self.n)
        return np.frombuffer(self.file.read_at((high - low) * self.kind.itemsize, low * self.kind.itemsize), self.kind)


def read(spark: SparkSession, uri: str, *, batch_tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids): documents of a corpus in its order within a shard; ids as 32-bit little-endian bytes."""
    system, path = files.open_fs(f"{uri}/manifest.json")
    with system.open_input_stream(path) as f:
        manifest = json.loads(f.read())
    dtype = manifest["dtype"]

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = files.open_fs(f"{uri}/{name}")
                ids, index = _Ranges(system, f"{at}.ids", dtype), _Ranges(system, f"{at}.idx", "<i8")
                n = (index.n - 1) // 2
                docs, offsets = index[:n], index[n:]
                i = 0
                while i < n:
                    j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + batch_tokens, "right")) - 1))
                    flat = np.ascontiguousarray(ids[offsets[i] : offsets[j]]).astype("<u4")
                    packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(((offsets[i : j + 1] - offsets[i]) * 4).astype("<i4")), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays([pa.array(docs[i:j], mask=docs[i:j] == _NULL), pa.array(offsets[i:j] + base), pa.array(np.diff(offsets[i : j + 1])), packed], names=["doc_id", "start", "n_tokens", "ids"])
                    i = j

    shards = spark.createDataFrame([(s["name"], s["base"]) for s in manifest["shards"]], "name string, base long")
    return shards.repartition(max(1, len(manifest["shards"]))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def checksum(ids: bytes) -> int:
    """What op1 and op10 return for packed ids; Spark's crc32() gives the same."""
    return zlib.crc32(ids)
