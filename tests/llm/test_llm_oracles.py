"""Every query with DuckDB SQL gives the rows of its SQL."""

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck(sf_dir).execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(columns, want.fetchall())
    assert a[0] == b[0]
    assert a[1] == b[1]
