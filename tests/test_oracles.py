"""Every query with DuckDB SQL gives the rows of its SQL."""

import math

import duckdb
import pytest

from tidemark.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) + 0.0 if isinstance(v, float) else v


def ordered(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert ordered(got.columns, [tuple(r) for r in got.collect()]) == ordered(columns, want.fetchall())
