"""Every query with SQL against DuckDB; the others must run and keep their schema."""

import math

import duckdb
import pytest

from plumbline.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) and b is not None:
        return (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-6 * max(1, abs(a))
    return a == b


def key(row):
    return [(x is None, type(x).__name__ if isinstance(x, str) else "", round(x, 3) if isinstance(x, float) else x if x is not None else 0) for x in row]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted([tuple(r[c] for c in columns) for r in df.collect()], key=key)
    assert rows
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        want = sorted([tuple(r[names.index(c)] for c in columns) for r in found.fetchall()], key=key)
        assert len(rows) == len(want)
        wrong = [(a, b) for a, b in zip(rows, want) if not all(map(same, a, b))]
        assert not wrong, wrong[:3]
