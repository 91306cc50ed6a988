"""op2 and op3 against plain versions in Python and against their SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bibspark.llm import lines, queries, sql

from .helpers import documents, saved, words

SHARED = "one common line of a host\n"
TEXTS = ["", None, " \n\t ", "a b c a b c a b c", "x " * 60, "the cat sat on the mat the cat sat on a mat and so on", "l1 x\nl1 x\n\nl2\nl1 x", "#*$%&|<>", "É È x y", "one\ftwo\x0bthree\rfour", " ".join(f"w{i}" for i in range(3000))]


def plain_rules(rows, min_docs=5, max_share=0.02, max_docs=100, min_left=0.5):
    blank = lambda line: not line.encode().split()
    norm = lambda line: b" ".join(line.encode().split()).decode().lower()
    texts = {(s, t or "") for _, t, s in rows}
    docs, seen = Counter(s for s, _ in texts), Counter()
    for s, t in texts:
        seen.update({(s, norm(x)) for x in t.split("\n") if not blank(x)})
    common = {k for k, n in seen.items() if n > max(min_docs, min(max_docs, max_share * docs[k[0]]))}
    out = {}
    for d, t, s in rows:
        t = t or ""
        w, own = words(t), [x for x in t.split("\n") if not blank(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
        gone = sum(len(words(x)) for x in own if (s, norm(x)) in common)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = not failed and len(w) - gone >= min_left * len(w)
        out[d] = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(covered), failed, kept, gone)
    return out


def rule_rows():
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    rows += [(100 + i, SHARED + body(i), "hot") for i in range(30)] + [(200 + i, body(i), "hot") for i in range(20)]
    rows += [(300 + i, body(777) + "\n" + body(778), "copies") for i in range(60)] + [(400 + i, body(900 + i), "copies") for i in range(5)]
    rows += [(500 + i, (SHARED * 14 + body(i)[:40]).upper() if i % 2 else SHARED * 9, None) for i in range(24)]
    return rows


def test_rules_against_plain(spark, tmp_path):
    rows = rule_rows()
    sf = saved(spark.createDataFrame(rows, "doc_id long, text string, source string"), tmp_path)
    got = {r[0]: tuple(r)[1:] for r in queries.op2_quality_rules(spark, sf).collect()}
    want = plain_rules(rows)
    assert got == want
    assert all(want[i][6] for i in range(300, 360)) and not any(want[i][6] for i in range(500, 524))


def test_rules_filter_clean_text_and_names(spark):
    rows = rule_rows()
    mine = {"__w": 1, "h": 2, "__host": 3, "rule_kept": 77, "Rule_text": 78, "___d": 4, "gone": 5}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnsRenamed({"doc_id": "n"}).withColumns({k: F.lit(v) for k, v in mine.items()})
    found = lines.quality_rules(docs)
    assert found.columns[: len(docs.columns)] == docs.columns and found.columns[-2:] == ["rule_kept_", "rule_text_"]
    got = {r.n: r for r in found.filter("rule_kept_").collect()}
    assert got.keys() == {d for d, v in plain_rules(rows).items() if v[6]}
    assert got[100].rule_text_ == rows[len(TEXTS)][1][len(SHARED) :] and got[200].rule_text_ == dict((r[0], r[1]) for r in rows)[200]
    assert all(r[k] == v for r in got.values() for k, v in mine.items())
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.columns == docs.columns and {r.rule_kept for r in kept.collect()} == {77} and kept.count() == len(got)


def test_rules_reject_depleted_documents(spark):
    """Documents that fail no base rule go if common lines were most of them; those with enough of their own stay."""
    menu = "\n".join(f"menu {k} of the site leads to page {k * 7} and back {k}" for k in range(8))
    own = lambda i, n: " ".join(f"own{i}x{k}" for k in range(n))
    rows = [(i, f"{menu}\n{own(i, 20)}", "host") for i in range(12)] + [(50 + i, f"{menu}\n{own(i, 200)}", "host") for i in range(12)] + [(90 + i, own(100 + i, 60), "host") for i in range(30)]
    got = {r.doc_id: r for r in lines.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = plain_rules(rows)
    assert not any(r.rule_base_failed for r in got.values()) and {d: r.rule_kept for d, r in got.items()} == {d: v[6] for d, v in want.items()}
    assert {d for d, r in got.items() if not r.rule_kept} == set(range(12)) and got[50].rule_text == own(0, 200) and got[50].rule_words_removed == 96


def test_rules_limit_is_exclusive_and_copies_are_one(spark):
    body = lambda i: " ".join(f"b{i}x{k}" for k in range(60))
    rows = [(i, "five times\n" + body(i), "a") for i in range(5)] + [(10 + i, "six times\n" + body(10 + i), "a") for i in range(6)] + [(30 + i, "copied\n" + body(30), "a") for i in range(40)]
    got = {r.doc_id: r.rule_words_removed for r in lines.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {d: 2 if 10 <= d < 16 else 0 for d, _, _ in rows}


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 1000), ("sf0.1", 20_000)])
def test_rules_remove_known_lines(spark, sf, least):
    """The fixtures' commonest line stands in up to a fifth of a host's documents; it goes wherever it is over the limit."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    line = "the and attion to thanedble the, anea. eriner thanea."
    found = lines.quality_rules(docs).select("source", "text", "rule_text", "rule_words_removed").collect()
    has = lambda t: any(" ".join(x.split()).lower() == line for x in t.split("\n"))
    hosts, with_line = {}, {}
    for s, t in {(r.source, r.text) for r in found}:
        hosts[s] = hosts.get(s, 0) + 1
        with_line[s] = with_line.get(s, 0) + has(t)
    over = {s for s, n in with_line.items() if n > max(5, min(100, 0.02 * hosts[s]))}
    assert len(over) >= 10 and all(has(r.rule_text) == (has(r.text) and r.source not in over) for r in found)
    assert sum(r.rule_words_removed for r in found) >= least


def test_rules_repeated_rows_and_empty(spark):
    body = " ".join(f"w{k}" for k in range(70))
    docs = documents(spark, [body, body, None], ids=[1, 1, None])
    assert sorted((r.doc_id or 0, r.rule_kept) for r in lines.quality_rules(docs).collect()) == [(0, False), (1, True), (1, True)]
    assert lines.quality_rules(docs.limit(0)).count() == 0


def plain_dedup(rows):
    """{doc: (text, lines, removed)} of rows with different ids."""
    first, out = {}, {}
    for d, t in sorted(rows):
        every = (t or "").split("\n")
        own = [i for i, x in enumerate(every) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        for p in range(len(own) - 2):
            g = tuple(every[i].strip(" \t\x0b\x0c\r") for i in own[p : p + 3])
            if first.setdefault(g, (d, p)) != (d, p):
                gone |= {p, p + 1, p + 2}
        lost = {own[p] for p in gone}
        out[d] = (None if t is None else t if not gone else "\n".join(x for i, x in enumerate(every) if i not in lost), len(own), len(gone))
    return out


DEDUP = [
    (5, "a\nb\nc\nd\ne"), (1, "x\n a \nb\n\nc\t\ny"), (2, None), (3, ""), (4, "a\nb"), (6, "z\nz\nz\nz\nz\nz"), (7, "a\nb\nc"), (8, "\n\n"), (9, "b\nc\nd\ne\nq"),
    *[(20 + i, "h1\nh2\nh3\n" + f"own {i}\nmore {i}") for i in range(40)], (99, "\n".join(f"line {i}" for i in range(5000))), (100, "\n".join(f"line {i}" for i in range(2000, 4000))),
]


def test_dedup_against_plain(spark, tmp_path):
    sf = saved(spark.createDataFrame(DEDUP, "doc_id long, text string"), tmp_path)
    got = {r[0]: tuple(r)[1:] for r in queries.op3_line_dedup(spark, sf).collect()}
    assert got == plain_dedup(DEDUP)


def test_dedup_null_ids_repeated_rows_and_names(spark):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "p\nq\nr"), (2, "p\nq\nr")]
    mine = {"h": 1, "g": 2, "p": 3, "first": 4, "__id": 5, "___p": 6, "dedup_lines": 77, "id": 7, "d": 8}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in mine.items()})
    found = lines.line_dedup(docs)
    assert found.columns == [*docs.columns, "dedup_lines_", "dedup_removed"]
    got = found.collect()
    assert sorted((r.doc_id or 0, r.text, r.dedup_removed) for r in got) == [(0, "a\nb\nc", 0), (1, "d", 3), (1, "d", 3), (2, "p\nq\nr", 0), (2, "p\nq\nr", 0)]
    assert all(r[k] == v for r in got for k, v in mine.items()) and sorted(r.dedup_lines_ for r in got) == [3, 3, 3, 4, 4]
    assert corpus_pipeline.line_dedup(spark, docs, "").columns == docs.columns
    assert lines.line_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "oracle"), [("op2_quality_rules", sql.QUALITY_RULES), ("op3_line_dedup", sql.LINE_DEDUP)])
def test_against_sql(spark, sf_dir, name, oracle):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = con.execute(oracle)
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
