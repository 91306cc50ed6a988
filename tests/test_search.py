"""Held against SQLite's own full-text index."""

from __future__ import annotations

import math
import sqlite3

import pytest

from bibspark.operators import search

BOOKS = [
    (1, "Dune", "Frank Herbert", "Dune Saga", "spice and sand, the spice must flow"),
    (2, "Dune Messiah", "Frank Herbert", "Dune Saga", "after Dune the sand remains"),
    (3, "Foo-bar café", "Ann O_Neil", "", "naïve été in Việt and спайс йод ёж"),
    (4, "Foundation", "Isaac Asimov", "Foundation", "sand"),
    (5, "Empty", "", "", ""),
]
QUERIES = ["dune", "DUNE", "foo-bar", "bar-foo", "messiah frank", "messiah-frank", "o_neil", "naive ete", "viet", "việt", "йод", "иод", "!", "dune !", "sand", "spice-must-flow", "cafe", "herbert sand", "the"]


@pytest.fixture(scope="module")
def terms(spark):
    rows = spark.createDataFrame(BOOKS, "id long, title string, authors string, series string, annotation string")
    return search.term_table(rows).cache()


@pytest.fixture(scope="module")
def sqlite():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, authors, series, annotation, tokenize='unicode61 remove_diacritics 1')")
    db.executemany("INSERT INTO t(rowid, title, authors, series, annotation) VALUES (?, ?, ?, ?, ?)", BOOKS)
    return db


def expected(db, query: str, column: str | None = None) -> dict[int, float]:
    quoted = " AND ".join('"' + w.replace('"', '""') + '"' for w in query.split())
    match = f"{{{column}}} : ({quoted})" if column else quoted
    return dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("column", [None, "title", "annotation"])
def test_matches_and_scores(spark, terms, sqlite, query, column):
    docs = spark.createDataFrame([(b[0],) for b in BOOKS], "doc_id long")
    got = {r.doc_id: r.score for r in search.bm25(terms, search.clauses(query, column), docs).collect()}
    want = expected(sqlite, query, column)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9)


def test_no_clause_matches_nothing(terms):
    assert search.bm25(terms, []).count() == 0
    assert search.match_count(terms, search.clauses("dune sand")).first()[0] == 2
