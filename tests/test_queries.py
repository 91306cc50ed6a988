"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from bibspark import more_queries, queries  # more_queries registers its own with the others

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def cells(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(more_queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, str(DATA))
    want = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert cells(got.select(*names).collect()) == cells(want.fetchall())


def test_resolution_of_all_orders(spark, tmp_path):
    """Orders beyond key 2000 are resolved too: against union-find over the shared identifiers."""
    keys = [*range(0, 6000, 7), *range(150_000, 150_400)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k in keys:
        for v in (("a", k % 997), ("b", k % 991)):
            root[find(k)] = find(v)
    least = {}
    for k in keys:
        least.setdefault(find(k), k)  # keys ascend
    got = {r.id: r.book for r in queries.resolve_identifiers(spark, str(tmp_path)).collect()}
    assert got == {k: least[find(k)] for k in keys} and len(set(got.values())) > 1


@pytest.mark.parametrize("name", ["run_files", "run_to_parse", "run_emptied_books", "moved_files"])
def test_run_over_far_keys(spark, tmp_path, name):
    """Keys a million apart: a run's new book may have the number of a known one, which is empty all the same."""
    keys = [-1_000_001, -1_000_000, -1, 0, 1, 2, 1_000_000, 1_000_001, 1_000_002, 2_000_001]
    lines = [(k, part, n) for i, k in enumerate(keys) for n, part in enumerate([(11, 22), (5, 10), (11, 5), (1, 11), (7, 11), (35, 5), (7, 14)][i % 7])]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = cells(want.fetchall())
    assert got.columns == names and dict(got.dtypes).get("book_id", "bigint") == "bigint"
    assert want and cells(got.collect()) == want


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
