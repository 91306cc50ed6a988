"""op8 and op4: fingerprints, links and components against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibspark.llm import embeddings, graph, queries, simhash

from .helpers import documents, least_reachable, saved


def fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def near_texts():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(150)) for _ in range(25)]
    texts = ["", None, "one", "One Two", " \n", "ÉCOLE é", "x " * 20000]
    for b in base:
        texts += [b] * rng.randint(1, 3)
        for _ in range(rng.randint(0, 6)):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return texts


def test_simhash_query(spark, tmp_path):
    texts = near_texts()
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(1).shuffle(ids)
    sf = saved(documents(spark, texts, ids=ids).withColumnsRenamed({"lang": "fp", "source": "key", "n_chars": "root"}), tmp_path)
    f = [fingerprint(t) for t in texts]
    want = least_reachable(len(f), lambda i, j: (f[i] ^ f[j]).bit_count() <= 3, ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, sf).collect()}
    assert got == {d: (f"{x:016x}", c) for d, x, c in zip(ids, f, want, strict=True)}
    assert len(set(want)) < len(set(f))


def test_simhash_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (4, "other words stand here"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 4), (4, 4), (4, 4), (4, 4), (8, 8), (9, 8)]
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.deduplicated(docs).collect()), key=str)
    assert kept == [(0, "a b c d"), (4, "other words stand here"), (8, "")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.integers(0, 2**30))
def test_index_finds_every_component(seeds, salt):
    rng = random.Random(salt)
    codes = set()
    for s in seeds:
        for _ in range(12):
            x = s
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            codes.add(x)
    codes = np.array(sorted(codes), np.uint64)
    runs = np.array([int(c) & 1 for c in codes])
    order = np.lexsort((simhash.gray_rank(codes), runs))
    codes, runs = codes[order], runs[order]
    root = simhash.forest(simhash.GrayIndex(codes, runs).links(3), len(codes))
    want = least_reachable(len(codes), lambda i, j: runs[i] == runs[j] and int(codes[i] ^ codes[j]).bit_count() <= 3, range(len(codes)))
    assert root.tolist() == want


def test_gray_rank():
    rank = np.argsort(simhash.gray_rank(np.arange(256, dtype=np.uint64)))
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(rank, rank[1:], strict=False))


def test_majority():
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 2, 254, 255, 256, 511, 3000)]
    for h, got in zip(lists, simhash.majority(lists), strict=True):
        assert int(got) == sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in h) > len(h))


def test_large_groups_are_dealt(spark):
    rng = random.Random(5)
    codes = {0}
    while len(codes) < 400:
        x = rng.choice(sorted(codes))
        codes.add(x ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(12)))
    codes |= {c | 1 << 62 | 1 << 55 | 1 << 40 | 1 << 20 for c in list(codes)[:50]}
    signed = sorted(c - (1 << 64) if c >> 63 else c for c in codes)
    fps = spark.createDataFrame([(c,) for c in signed], "fp long")
    found = graph.components(spark, simhash.links(fps, run_limit=50))
    roots = {r.id: r.root for r in found.collect()}
    want = least_reachable(len(signed), lambda i, j: (signed[i] ^ signed[j]).bit_count() <= 3, signed)
    assert [roots.get(c, c) for c in signed] == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(-5, 0), (7, 7)]
    got = {r.id: r.root for r in graph.components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    names = sorted({x for e in edges for x in e if e[0] != e[1]})
    joined = {frozenset(e) for e in edges}
    want = least_reachable(len(names), lambda i, j: frozenset((names[i], names[j])) in joined, names)
    assert got == dict(zip(names, want, strict=True))
    assert graph.components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=24)
            for _ in range(rng.integers(1, 6)):
                rows.append((n, (base + rng.normal(size=24) * rng.choice([0, 0.1, 0.25, 0.4])).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n, [0.0] * 24, 0), (n + 1, [0.0] * 24, 0), (n + 2, None, 0), (n + 3, [1.0] * 23 + [None], 0), (n + 4, [1.0] * 23 + [math.inf], 0), (n + 5, [1.0] * 23 + [math.nan], 0), (n + 6, [], 0), (n + 7, [2.0] * 12, 0), (n + 8, [1.0] * 12, 0)]
    rows += [(n + 10 + i, [1.0, -0.0] * 12, 1) for i in range(9)] + [(n + 30, [1.0, 0.0] * 12, 1)]
    rng.shuffle(rows)
    sf = saved(spark.createDataFrame([(int(a), b, c) for a, b, c in rows], "vec_id long, embedding array<float>, label int"), tmp_path, "embeddings")
    good = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        a, b = rows[i], rows[j]
        if i == j or a[2] is None or a[2] != b[2] or not good(a[1]) or not good(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], float), np.array(b[1], float)
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    ids = [int(r[0]) for r in rows]
    links = {ids[i]: sum(linked(i, j) for j in range(len(rows))) for i in range(len(rows))}
    want = least_reachable(len(rows), linked, ids)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op4_embeddings(spark, sf).collect()}
    assert got == {i: (links[i], c, c == i) for i, c in zip(ids, want, strict=True)}


def test_embeddings_repeats_and_empty(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (2, [1.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embeddings.near_duplicates(t).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (2, 1, 1)]
    assert embeddings.near_duplicates(t.limit(0)).count() == 0


def at_the_threshold(dim, n, cosine=0.93):
    rng = np.random.default_rng(dim)
    a = embeddings.unit(rng.normal(size=(n, dim)))
    side = rng.normal(size=a.shape)
    side = embeddings.unit(side - (side * a).sum(1, keepdims=True) * a)
    return a, cosine * a + math.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize("dim", [24, 64, 128, 300, 384])
def test_recall_at_the_threshold(dim):
    a, b = at_the_threshold(dim, 400)
    hit = np.zeros(len(a), bool)
    for t in range(embeddings.TABLES):
        x, y = (embeddings.buckets(v, t, embeddings.PROBES, embeddings.CUTS) for v in (a, b))
        hit |= (x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)
    assert hit.mean() >= 0.99


@pytest.mark.parametrize(("dim", "cuts", "tables", "probes"), [(64, 3, 12, 6), (64, 2, 8, 4), (64, 4, 32, 16), (300, 3, 12, 6)])
def test_links_at_the_threshold(spark, dim, cuts, tables, probes):
    """Recall of the whole operator: pairs just above the threshold are linked, those just below never."""
    near, far = at_the_threshold(dim, 300, 0.9301), at_the_threshold(dim + 1, 100, 0.9299)
    rows = [(2 * i + k, v[i].tolist(), 1) for k, v in enumerate(near) for i in range(300)] + [(10_000 + 2 * i + k, v[i].tolist(), 1) for k, v in enumerate(far) for i in range(100)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(1), "u": F.lit(2), "own": F.lit(3), "digest": F.lit(4)})
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table, cuts=cuts, tables=tables, probes=probes).collect()}
    assert np.mean([got[i] == 1 for i in range(600)]) >= 0.98 and not any(n for i, n in got.items() if i >= 10_000) and max(got.values()) == 1


def test_rotation_keeps_lengths():
    x = embeddings.rotate(np.eye(6), 3)
    assert x.shape == (6, 8) and np.allclose(x @ x.T, np.eye(6))
