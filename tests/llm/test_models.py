"""op6, op7, op9 and the pipeline."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bibspark.llm import brown, convnet, files, mixing, packing, queries, simhash

from .helpers import documents, saved, words
from .test_lines import plain_dedup, plain_rules
from .test_near import fingerprint

# ---- op6 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    return docs, {r.doc_id: r for r in queries.op6_brown(spark, sf_dir).collect()}


def test_brown_counts_and_base(scored):
    docs, got = scored
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    seen = Counter()
    for d, t in docs.items():
        if not held[d]:
            seen.update(brown.tokens(t))
    n, v = sum(seen.values()), len(seen)
    for d, t in docs.items():
        own = brown.tokens(t)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(own), sum(seen[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)


def test_brown_beats_base_on_held_out(scored):
    held = [r for r in scored[1].values() if r.held_out]
    size = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / size > sum(r.base_score for r in held) / size + 0.3


def test_brown_sums_to_one(spark):
    """After any word, known words and one unseen word for each suffix share all probability."""
    texts = ["a b c a b d", "b c a", "a a a b", "the cat sat", "a cat", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    _, m = brown.train(rows, share=0.1, n_classes=8, turns=2)
    vocab = Counter(w for t in texts for w in brown.tokens(t))
    assert m.vocab.total == sum(vocab.values()) and m.vocab.distinct == len(vocab)
    items = brown.Items(m.vocab.words)
    n = len(m.vocab.words)
    within = defaultdict(float)
    for w, c in vocab.items():
        i = items[w]
        within[i] += 1 if i < n else (c - brown.DISCOUNT) / m.vocab.counts[i]
    for i in range(n, len(m.classes)):
        within[i] += brown.DISCOUNT * m.vocab.types[i - n] / m.vocab.counts[i] if m.vocab.counts[i] else 1
    assert all(math.isclose(within[i], 1) for i in range(len(m.classes)))
    for c in range(8):
        assert math.isclose(sum(10 ** m.step[c, k] for k in range(8)), 1)
        inside = [10 ** m.item[i] for i in range(len(m.classes)) if m.classes[i] == c]
        assert not inside or math.isclose(sum(inside), 1)


def test_brown_contexts(spark):
    texts = ["x y x", "y", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    _, vocab = brown.vocabulary(rows, share=0.01)
    classes = np.arange(len(vocab.counts)) % 4
    got = brown.contexts(brown.coded(rows, vocab), vocab, classes, 4)
    items, want = brown.Items(vocab.words), np.zeros_like(got)
    for t in texts:
        before = items[brown.END]
        for w in brown.tokens(t):
            want[items[w], classes[before]] += 1
            want[before, 4 + classes[items[w]]] += 1
            before = items[w]
    assert (got == want).all()


def test_exchange_parts_two_languages():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 10, 400) + 10 * k for k in (0, 1) for _ in range(20)]
    classes = rng.integers(0, 2, 20)
    for turn in range(8):
        seen = np.zeros((20, 4))
        for t in texts:
            for a, b in zip(t, t[1:], strict=False):
                seen[b, classes[a]] += 1
                seen[a, 2 + classes[b]] += 1
        classes = brown.exchange(seen, classes, 2, np.arange(20) % 2 == turn % 2)
    assert len(set(classes[:10])) == 1 and len(set(classes[10:])) == 1 and classes[0] != classes[10]


def test_brown_small_blocks_nulls_and_empty(spark):
    docs = documents(spark, ["a b c", None, "", "zz a", "a b c"], ids=[1, 2, None, 4, 1])
    one = sorted((r.doc_id or 0, r.n_tokens, round(r.score, 9), round(r.base_score, 9)) for r in brown.score(docs).collect())
    many = sorted((r.doc_id or 0, r.n_tokens, round(r.score, 9), round(r.base_score, 9)) for r in brown.score(docs, block_tokens=1).collect())
    assert one == many and [r[:2] for r in one] == [(0, 1), (1, 4), (1, 4), (2, 1), (4, 3)]
    assert brown.score(docs.limit(0)).count() == 0
    unseen = brown.score(docs, held_out=F.lit(True)).collect()
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in unseen)


def test_brown_clusters_every_repeated_word(spark):
    """The least count doesn't rise with the corpus: words seen six times in 700,000 tokens are items of their own."""
    texts = ["a " * 700_000, " ".join(f"six{i}" for i in range(300)) + " once"]
    rows = spark.createDataFrame([(texts[0],)] + [(texts[1],)] * 6 + [("rare",)], "text string")
    _, m = brown.train(rows, n_classes=8, turns=1)
    assert set(m.vocab.words) == {b"a", b"", b"once"} | {b"six%d" % i for i in range(300)}


def test_brown_sums_in_parts(spark, sf_dir, monkeypatch):
    """However often a task sums and sends, the counts are the same."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    words, vocab = brown.vocabulary(rows)
    texts, classes = brown.coded(rows, vocab, words, block_tokens=3000), brown.first_classes(vocab, 16)
    want = brown.contexts(texts, vocab, classes, 16)
    for keys, packed in ((1, 1 << 26), (9000, 1 << 26), (9000, 1)):
        monkeypatch.setattr(brown, "_KEYS", keys)
        monkeypatch.setattr(brown, "_PACKED", packed)
        assert (brown.contexts(texts, vocab, classes, 16) == want).all()


def test_brown_exchange_on_executors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    words, vocab = brown.vocabulary(rows)
    texts, classes = brown.coded(rows, vocab, words, block_tokens=5000), brown.first_classes(vocab, 16)
    seen = brown.contexts(texts, vocab, classes, 16)
    pairs = brown.pair_counts(texts, classes, 16)
    assert (pairs == brown.transitions(seen, classes, 16)).all() and pairs.sum() == vocab.total
    for turn in (0, 1, 2):
        moving = np.arange(len(classes)) % 2 == turn % 2 if turn else np.ones(len(classes), bool)
        got = brown.exchanged(texts, classes, 16, pairs, turn)
        assert (got == brown.exchange(seen, classes, 16, moving)).all() and (got != classes).any()


def test_brown_score_against_plain(spark):
    """Every document's score, summed token by token from counts and classes alone."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{int(rng.zipf(1.4)) % 60}" for _ in range(int(rng.integers(0, 40)))) for _ in range(60)] + [None, "never seen", "w1 " * 300]
    docs = documents(spark, texts).withColumns({c: F.lit(9) for c in ("c", "item", "block", "n_tokens", "words", "__id", "base")})
    held = F.col("doc_id") % 7 == 2
    got = {r.doc_id: r for r in brown.score(docs, held_out=held, n_classes=8).collect()}
    training = [brown.tokens(t) for i, t in enumerate(texts) if i % 7 != 2]
    _, m = brown.train(spark.createDataFrame([(t,) for i, t in enumerate(texts) if i % 7 != 2], "text string"), n_classes=8)
    counts = Counter(w for t in training for w in t)
    own = {w: i for i, w in enumerate(m.vocab.words)}
    assert set(own) == {w for w, n in counts.items() if n >= 5 or not w}
    item = lambda w: own.get(w, len(own) + brown.suffix(w))
    of = lambda w: m.classes[item(w)]
    item_count = Counter(item(w) for t in training for w in t)
    types, n_classes = Counter(item(w) for w in counts), 8
    pairs = np.zeros((n_classes, n_classes))
    for t in training:
        for a, b in zip([b"", *t[:-1]], t, strict=True):
            pairs[of(a), of(b)] += 1
    prior = (pairs.sum(0) + 1) / (pairs.sum() + n_classes)
    step = (pairs + brown.PRIOR * prior) / (pairs.sum(1, keepdims=True) + brown.PRIOR)
    sizes = [sum(item_count[i] + brown.FLOOR for i in range(len(m.classes)) if m.classes[i] == c) for c in range(n_classes)]
    for d, text in enumerate(texts):
        log = 0.0
        for a, b in zip([b"", *brown.tokens(text)[:-1]], brown.tokens(text), strict=True):
            i = item(b)
            within = 1.0
            if b not in own:
                n = item_count[i]
                within = (counts[b] - brown.DISCOUNT) / n if counts[b] else brown.DISCOUNT * types[i] / n if n else 1.0
            log += math.log10(step[of(a), of(b)] * (item_count[i] + brown.FLOOR) / sizes[of(b)] * within)
        assert math.isclose(got[d].score, log, rel_tol=1e-9) and got[d].held_out == (d % 7 == 2) and got[d].train_tokens == sum(map(len, training))


def test_brown_turns_until_nothing_is_gained(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    _, m = brown.train(rows, tolerance=0.002)
    assert len(m.gained) > 4 and max(m.gained) - max(m.gained[:-2]) < 2 * 0.002 and max(m.gained) > m.gained[3] + 0.02


# ---- op7 -------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in rest) if rest else 0
        above = {s for s in rest if weight[s] * level > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= above


def test_mixing(spark, tmp_path):
    rng = np.random.default_rng(8)
    texts, sources = [], []
    for s, n in (("hot", 400), ("b", 120), ("Z", 90), (None, 60), ("é", 80), ("zero", 3)):
        for _ in range(n):
            texts.append("" if s == "zero" else "w " * int(rng.integers(0, 60)))
            sources.append(s)
    texts[5] = None
    sf = saved(documents(spark, texts, sources), tmp_path)
    got = queries.op7_mixing(spark, sf).collect()
    again = queries.op7_mixing(spark, sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(texts)
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(words(t))
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len(words(texts[r.doc_id])) and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert all(0 <= want[s] - taken[s] + 1e-6 and want[s] - taken[s] <= 5 for s in sizes)


def plain_mix(rows, us, weights=(5, 2, 1), growth=1.5, most=2.0, tilt=0.25, reach=2048, bins=1 << 16):
    """{id: copies} of (id, text, source) with different ids, by ranking each source's documents; us are their U."""
    size = {d: len(words(t)) for d, t, _ in rows}
    sizes = Counter()
    for d, _, s in rows:
        sizes[s] += size[d]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped, level = growth * sum(sizes.values()), set(), 0
    while True:
        rest = [s for s in order if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / max(1e-300, sum(weight[s] for s in rest))
        above = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not above:
            break
        capped |= above
    out = {}
    for s in order:
        target = most * sizes[s] if s in capped else weight[s] * level
        own = [d for d, _, x in rows if x == s]
        e = lambda d, t: min(most, t * 2 ** (tilt * max(0, size[d].bit_length() - 1)))
        steps = lambda d, t: math.floor(e(d, t) * 2**20 + 0.5) / 2**20
        t, full = 0.0, set()
        while target and any(size[d] and d not in full for d in own):  # who goes beyond the most is capped, until nobody does
            t = (target - most * sum(size[d] for d in full)) / sum(size[d] * 2 ** (tilt * (size[d].bit_length() - 1)) for d in own if d not in full and size[d])
            above = {d for d in own if size[d] and d not in full and t * 2 ** (tilt * (size[d].bit_length() - 1)) > most}
            if not above:
                break
            full |= above
        sure = {d: int(steps(d, t)) for d in own}
        p = {d: steps(d, t) - sure[d] for d in own}
        left = target - sum(sure[d] * size[d] for d in own)
        q = {d: us[d] / (1 - us[d]) * (1 - p[d]) / p[d] for d in own if p[d] and size[d]}
        taken, over = set(), None
        ends = None
        for d in sorted(q, key=lambda d: (q[d] / (1 + q[d]), d)):
            b = min(bins - 1, int(q[d] / (1 + q[d]) * bins))
            if size[d] <= left and (ends is None or b <= ends):
                taken.add(d)
                left -= size[d]
            elif over is None:  # the reach counts from the end of this bin and goes to the end of a bin
                over, counts = b, Counter(min(bins - 1, int(x / (1 + x) * bins)) for x in q.values())
                upto = lambda k: sum(n for j, n in counts.items() if j <= k)  # noqa: B023, E731
                ends = next((k for k in sorted(counts) if k >= over and upto(k) >= upto(over) + reach), None)
        out |= {d: sure[d] + (d in taken) for d in own}
    return out


@pytest.mark.parametrize("reach", [0, 7, 2048])
def test_mixing_against_plain_ranking(spark, reach):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.lognormal(3, 1.4)) if i % 50 else None, s) for s, n in (("hot", 900), ("b", 300), ("Z", 200), (None, 150)) for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "source"), 11) + 0.5) / float(1 << 53)
    us = {r[0]: r[1] for r in docs.select("doc_id", u).collect()}
    got = {r.doc_id: r.copies for r in mixing.allocate(docs, reach=reach).collect()}
    want = plain_mix(rows, us, reach=reach)
    size = {d: len(words(t)) for d, t, _ in rows}
    assert {d: n for d, n in got.items() if size[d]} == {d: n for d, n in want.items() if size[d]}


def test_mixing_takes_by_unequal_odds(spark):
    """Long documents are likelier by the power tilt of their size class, and words come to the target for all tilts."""
    texts = [("a " * (4 if i % 2 else 64)) for i in range(4000)]
    sources = ["x" if i < 2000 else "y" for i in range(4000)]
    for tilt in (0.0, 0.25, 0.5):
        got = mixing.allocate(documents(spark, texts, sources), weights=(1, 1), growth=0.3, tilt=tilt).collect()
        rate = {size: np.mean([r.copies for r in got if r.size == size]) for size in (4, 64)}
        assert math.isclose(rate[64] / rate[4], 2 ** (tilt * 4), rel_tol=0.15)
        assert abs(sum(r.copies * r.size for r in got) - 0.3 * sum(r.size for r in got)) <= 8


def test_mixing_at_whole_and_nearly_whole_copies(spark):
    """Where the expected copies are a whole number, or differ from it by next to nothing, nothing is ranked and nothing crowds."""
    for growth in (1.0, 1.0 + 1e-9, 1.0 - 1e-9):
        got = mixing.allocate(documents(spark, ["a b c d"] * 500 + ["e " * 40] * 20, ["s"] * 520), growth=growth, tilt=0.0).collect()
        assert {r.copies for r in got} == {1}


def test_mixing_certain_copies_of_long_documents(spark):
    """Where the level takes long documents to the most, they are taken so for certain and the others share the rest."""
    texts = ["a " * 5000] * 3 + ["b " * 3] * 600
    got = mixing.allocate(documents(spark, texts, ["s"] * len(texts)), growth=1.9, tilt=1.0).collect()
    assert {r.copies for r in got if r.size == 5000} == {2} and abs(sum(r.copies * r.size for r in got) - 1.9 * sum(r.size for r in got)) <= 3


def test_mix_repeats_rows_and_keeps_columns(spark):
    mine = {"copies": 1, "extra": 2, "__id": 3, "__n": 4, "__source": 5, "___text": 6, "digest": 7}
    docs = documents(spark, ["a b", "a b", None, "c d e f"], ["s", "s", None, "t"], ids=[1, 1, None, 2]).withColumns({k: F.lit(v) for k, v in mine.items()})
    out = mixing.mix(docs, growth=2.0)
    rows = out.collect()
    assert out.columns == docs.columns and all(r[k] == v for r in rows for k, v in mine.items())
    assert Counter(r.doc_id for r in rows)[1] == 4 and Counter(r.doc_id for r in rows)[2] == 2
    assert mixing.mix(docs.limit(0)).count() == 0


# ---- op9 -------------------------------------------------------------------------------------------------------------


def test_quality_net(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_quality_net(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) >= 0.93


def test_chunks_cover_the_whole_text():
    net = convnet.new_net()
    for n in (0, 1, 11, 12, 13, 1039, 70_001):
        data = convnet.padded(bytes(np.random.default_rng(n).integers(32, 120, n).astype(np.uint8)))
        r = np.stack([net.embed[data[i : i + convnet.WIDTH]].ravel() @ net.filters + net.bias for i in range(0, len(data) - convnet.WIDTH + 1, convnet.STEP)])
        pooled = np.stack([np.maximum(r[i : i + convnet.WINDOWS].max(0), 0) for i in range(0, len(r), convnet.WINDOWS)])
        assert (len(data) - convnet.WIDTH) % convnet.STEP == 0 and len(data) >= n
        assert np.allclose(convnet.features(net, data), np.concatenate([pooled.max(0), pooled.mean(0)]), atol=1e-4)


def test_gradients():
    net = convnet.new_net()
    rng = np.random.default_rng(2)
    net.top[:] = rng.normal(size=net.top.shape)
    text = bytes(rng.integers(97, 122, 300).astype(np.uint8))
    g, _ = convnet._gradients(net, text, 1.0, 1.0)
    for name, at in (("filters", (3, 5)), ("filters", (20, 40)), ("bias", (7,)), ("top", (2,)), ("offset", (0,)), ("embed", (text[10], 1))):
        p, eps = getattr(net, name), 1e-2
        old = p[at]
        p[at] = old + eps
        _, up = convnet._gradients(net, text, 1.0, 1.0)
        p[at] = old - eps
        _, down = convnet._gradients(net, text, 1.0, 1.0)
        p[at] = old
        assert math.isclose(float(getattr(g, name)[at]), (up - down) / (2 * eps), rel_tol=0.1, abs_tol=5e-3)


def test_net_edge_cases(spark):
    docs = documents(spark, ["good text here", None, "", "bad### stuff### here###" * 50, "good text here"], ids=[1, 2, None, 4, 1]).withColumns({"score": F.lit(9), "quality": F.lit(0)})
    labels = spark.createDataFrame([(1, 1), (4, 0), (2, None), (None, 1), (9, 7), (1, 1)], "doc_id long, quality int")
    got = convnet.score(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and {r.score for r in got if r.doc_id == 1}.__len__() == 1
    assert {r.score for r in convnet.score(docs, labels.limit(0)).collect()} == {0.5}
    assert convnet.score(docs.limit(0), labels).count() == 0


def test_net_sample_is_bounded_in_rows_and_bytes(spark):
    """Repeated rows of a labelled id teach once; long texts are in while they fit; nothing else is left out."""
    texts = ["x" * 3000] * 500 + ["long " * 40_000] + [f"text {i}" for i in range(30)]
    ids = [7] * 500 + [8] + list(range(100, 130))
    docs = documents(spark, texts, ids=ids).withColumns({"id": F.lit(1), "y": F.lit(2), "t": F.lit("z"), "__id": F.lit(3)})
    labels = spark.createDataFrame([(i, i % 2) for i in sorted(set(ids))], "doc_id long, quality int")
    how = {"id_col": "doc_id", "text_col": "text", "label_col": "quality"}
    taken = lambda rows, size: [r.t for r in convnet.labelled_sample(docs, labels, **how, max_rows=rows, max_bytes=size).collect()]
    assert sorted(map(len, taken(100, 10**6)))[-2:] == [3000, 200_000] and len(taken(100, 10**6)) == 32
    assert sum(map(len, taken(100, 5000))) <= 5000 and len(taken(10, 10**6)) == 10 and not taken(0, 10**6)


def test_net_is_trained_to_the_end():
    """Every epoch counts: the rate falls to the last one whatever the sample's size, so more bytes are never fewer epochs."""
    rng = np.random.default_rng(1)
    good = [bytes(rng.integers(97, 110, 3000).astype(np.uint8)) for _ in range(12)]
    bad = [bytes(rng.integers(110, 123, 3000).astype(np.uint8)) for _ in range(12)]
    net = convnet.train(good + bad, [1] * 12 + [0] * 12, epochs=6)
    assert convnet.probability(net, good).min() > 0.5 > convnet.probability(net, bad).max()


# ---- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "simhash", "mixing", "packing"]

    first = stages["quality_rules"](spark, docs, sf_dir)
    got = {r.doc_id: r.text for r in first.collect()}
    assert first.columns == docs.columns and got.keys() == {d for d, v in plain_rules(rows).items() if v[6]}

    second = stages["line_dedup"](spark, first, sf_dir)
    plain = plain_dedup(list(got.items()))
    texts = {r.doc_id: r.text for r in second.collect()}
    assert second.columns == docs.columns and texts == {d: t for d, (t, n, gone) in plain.items() if gone == 0 or gone < n}

    third = stages["simhash"](spark, second, sf_dir)
    ids = sorted(texts)
    f = {d: fingerprint(texts[d]) for d in ids}
    root = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (f[a] ^ f[b]).bit_count() <= 3:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == set(root.values())

    fourth = stages["mixing"](spark, third, sf_dir)
    copies = Counter(r.doc_id for r in fourth.collect())
    sizes = Counter()
    for d in set(root.values()):
        sizes[source[d]] += len(words(texts[d]))
    taken = Counter()
    for d, n in copies.items():
        taken[source[d]] += n * len(words(texts[d]))
    want = plain_targets(sizes)
    assert fourth.columns == docs.columns and max(copies.values()) <= 2 and sum(abs(taken[s] - want[s]) for s in sizes) < 0.1 * sum(sizes.values())

    packed = stages["packing"](spark, fourth, sf_dir)
    per = Counter()
    for r in packed.collect():
        per[r.doc_id] += r.length
        assert len(r.ids) == 4 * r.length
    tokens = {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert per == {d: n * tokens[d] for d, n in copies.items()}
    figures = packing.padding(packed).first()
    assert figures.padding < 0.02 * figures.tokens


def test_pipeline_runs_and_takes_odd_tables(spark, tmp_path):
    body = " ".join(f"w{i}" for i in range(80))
    rows = [body, body, None, "", body.replace("w3 ", "v3 "), "short", body.upper() + "\n" + "z " * 70]
    docs = documents(spark, rows, ids=[5, 5, None, 6, 7, 8, None])
    out = corpus_pipeline.run(spark, saved(docs, tmp_path))
    assert out.count() > 0
    assert corpus_pipeline.run(spark, saved(docs.limit(0), tmp_path / "none")).count() == 0


def test_pipeline_keeps_other_columns_and_takes_long_texts_and_ties(spark):
    """Every stage but the last returns the documents' own columns with their values, whatever they are called."""
    mine = {"rule_kept": 77, "rule_text": 78, "dedup_lines": 3, "dedup_removed": 4, "__n": 5, "__id": 6, "__w": 7, "copies": 8, "extra": 9, "ids": 10, "component_id": 11}
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{int(i)}" for i in rng.integers(0, 10**6, n))
    long = "\n".join(text(50) for _ in range(1500))
    texts = [long, *[text(80) for _ in range(30)], *[text(80)] * 3, None, ""]
    docs = documents(spark, texts, sources=[None if i % 5 == 0 else "s" for i in range(len(texts))]).withColumns({k: F.lit(v) for k, v in mine.items()})
    clean, now = set(range(31)), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = files.written(spark, stage(spark, now, ""), name)
        rows = now.collect()
        assert now.columns == docs.columns and all(r[k] == v for r in rows for k, v in mine.items())
        ids = Counter(r.doc_id for r in rows)
        if name != "mixing":
            assert set(ids) >= clean and all(r.text == texts[r.doc_id] for r in rows) and set(ids.values()) == {1}
            assert len(set(ids) & {31, 32, 33}) == (1 if name == "simhash" else 3)
    packed = corpus_pipeline.pack(spark, now, "")
    assert packed.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in packed.filter("start = 0").collect())


def test_one_of_each_group_stays(spark):
    mine = {"__n": 5, "__key": 6, "___kept": 7, "root": 8, "fp": 9}
    docs = documents(spark, ["a b c d e"] * 40 + ["f g h i j"]).withColumns({k: F.lit(v) for k, v in mine.items()})
    got = simhash.deduplicated(docs)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == [0, 40] and got.columns == docs.columns and all(r[k] == v for r in rows for k, v in mine.items())
