"""op1 and op10: token ids against encode() of whole texts, files against a round trip, packing against its rules."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bibspark.llm import files, packing, queries, token_files, tokens

from .helpers import documents, saved

FILE = path("word_bpe_49k.json")
TEXTS = ["The cat's sat, on\tthe MAT!!\n", "", None, "x", "é È ß ñandú <|endoftext|> a<|startoftext|>b", "Ünï—ćode 漢字 नमस्ते́ ﬁ İ", "don't we'll 3.14 $$$%%% a,b;c:d", "  \n\n ", "word " * 30000, "q" * 5000, "éa ́", "a b c\x1cd\x85e"]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_are_encoded_like_whole_texts(name):
    tokenizer, ids = Tokenizer.from_file(path(name)), tokens.WordIds(path(name))
    for text in TEXTS:
        assert np.frombuffer(ids.text(text or ""), "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aB é,.!'sTß \n\t#|<>")), max_size=60))
def test_any_text(text):
    ids = tokens.word_ids(FILE, "<u4")
    assert np.frombuffer(ids.text(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_table_is_bounded():
    ids = tokens.WordIds(FILE, limit=10)
    for i in range(100):
        ids.text(f"w{i} Word{i},")
    assert len(ids) <= 14


def expected(rows, whole):
    """(doc_id, start, n, crc) in ascending order of ids, null first."""
    out, at = [], 0
    coded = [(d, np.array([*whole(t), 1], "<u4")) for d, t in rows]
    for d, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, r[1].astype("<u2").tobytes())):
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_round_trip(spark, tmp_path, whole):
    ids = [7, 3, 11, 3, 0, 5, 2, 9, 8, 1, 4, 6]
    sf = saved(documents(spark, TEXTS, ids=ids).withColumnRenamed("lang", "ids").withColumnRenamed("source", "shard"), tmp_path)
    got = sorted(map(tuple, queries.op1_token_files(spark, sf).collect()), key=lambda r: r[1])
    assert got == expected(list(zip(ids, TEXTS, strict=True)), whole)


def test_an_id_that_repeats_fills_several_shards(spark, tmp_path, whole):
    rows = [(i, f"text {i}") for i in range(40)] + [(7, f"hot {i}") for i in range(400)] + [(None, "none")] * 3
    uri = files.scratch(spark, "hot")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "shard": F.lit(2), "n": F.lit(3)})
    made = token_files.write(docs, uri, FILE, shards=10)
    assert len(made["shards"]) >= 8 and max(s["docs"] for s in made["shards"]) < 150
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in sorted(token_files.read(spark, uri).collect(), key=lambda r: r.start)]
    assert [d for d, _, _ in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert sorted((d, x) for d, _, x in got if d) == sorted((d, np.array([*whole(t), 1], "<u4").tobytes()) for d, t in rows if d)
    assert [s for _, s, _ in got] == [sum(len(x) // 4 for _, _, x in got[:i]) for i in range(len(got))]


def test_shards_grow_with_the_texts(spark):
    docs = spark.createDataFrame([(i, "word " * 2000) for i in range(60)], "doc_id long, text string")
    few, many = (len(token_files.write(docs, files.scratch(spark, "grow"), FILE, shard_bytes=b)["shards"]) for b in (1 << 30, 20_000))
    assert few <= 2 * spark.sparkContext.defaultParallelism < 20 < many <= 31


def test_ranges_of_files_that_arent_local(tmp_path):
    from pyarrow import fs

    values = np.arange(1000, dtype="<u2")
    (tmp_path / "x").write_bytes(values.tobytes())
    away = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    got = token_files._Ranges(away, "x", "<u2")
    assert got.map is None and got.n == 1000 and got[10:20].tolist() == list(range(10, 20)) and got[:3].tolist() == [0, 1, 2] and got[998:].tolist() == [998, 999]


def test_null_ids_and_empty_table(spark, tmp_path, whole):
    rows = [(None, "null id"), (2, "b"), (1, "a"), (2, "a")]
    sf = saved(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    assert sorted(map(tuple, queries.op1_token_files(spark, sf).collect()), key=lambda r: r[1]) == expected(rows, whole)
    empty = spark.createDataFrame([], "doc_id long, text string")
    uri = files.scratch(spark, "empty")
    assert token_files.write(empty, uri, FILE) == {"dtype": "<u2", "tokens": 0, "shards": []}
    assert token_files.read(spark, uri).count() == 0


def check_pieces(rows, coded, size=2048):
    """Every id in one piece, pieces back to back in their sequences."""
    seen, at = {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(coded[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(coded[r.doc_id])
    for d, ids in coded.items():
        end = 0
        for start, n in sorted(seen[d]):
            assert start == end and n > 0
            end += n
        assert end == len(ids)
    total = padded = 0
    for pieces in at.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= size
        total += end
        padded += 0 if end.bit_count() == 1 else size - end
    return padded / total


def test_packing(spark, tmp_path, whole):
    texts = TEXTS + [f"text number {i} " * (i % 97) for i in range(600)]
    sf = saved(documents(spark, texts), tmp_path)
    coded = {i: np.array([*whole(t), 1], "<u4") for i, t in enumerate(texts)}
    assert check_pieces(queries.op10_packing(spark, sf).collect(), coded) < 0.01


def test_packing_never_reads_other_columns(spark, whole):
    docs = documents(spark, ["a b c", None], ids=[1, 2]).withColumns({c: F.lit(9) for c in ("ids", "start", "length", "doc_tokens", "sequence_id", "offset", "__id")})
    got = packing.pack_documents(docs, FILE).collect()
    assert sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in got) == [(1, 0, len(whole("a b c")) + 1, len(whole("a b c")) + 1), (2, 0, 1, 1)]


def test_packing_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, FILE).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = packing.pack_documents(rows, FILE).collect()
    assert sum(r.length for r in got if r.doc_id is None) == 1 and sum(r.length for r in got if r.doc_id == 1) == 6
    assert sorted({(r.doc_id or 0, r.doc_tokens) for r in got}) == [(0, 1), (1, 3)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(0, 8))
def test_pack_rules(lengths, slack):
    out = packing.pack(lengths, 32, slack)
    assert sorted((i, s + k) for seq in out for i, s, n in seq for k in range(n)) == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
    assert all(32 - (fill := sum(p[2] for p in seq)) <= slack or fill.bit_count() == 1 for seq in out)


def test_tightest_window_is_found():
    windows = packing.OpenWindows(64)
    rooms = {w: r for w, r in enumerate([5, 9, 9, 33, 64, 1])}
    for w, r in rooms.items():
        windows.add(w, r)
    for need in (6, 6, 6, 1, 60, 3, 64):
        fits = [r for r in rooms.values() if r >= need]
        found = windows.take(need)
        assert (found is None) == (not fits)
        if found:
            assert found[1] == min(fits) and rooms.pop(found[0]) == found[1]


def test_padding_figures(spark):
    rows = spark.createDataFrame([(0, 2048), (1, 1000), (1, 24), (2, 100)], "sequence_id long, length long")
    assert tuple(packing.padding(rows).first()) == (3, 3172, 1948)
