"""Hard negatives against plain loops, and the packed products against numpy's."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import negatives, queries


def brute(rows, positives=5, lacking=3, low=50, high=95):
    """Rows (vec_id, label, vector, anchor) as the contract states them."""
    last = lambda v: math.inf if v is None else v
    rows = [(i, c, [math.floor(256 * x) for x in v], a) for i, c, v, a in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, c, v, a in rows:
        if not a:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), last(j), d) for j, d, w, _ in rows)
        good = [(-s, j) for s, j, d in scored if d == c and j != i][:positives]
        for ps, p in good:
            bad = [(-s, j) for s, j, d in scored if d != c and low * ps <= -100 * s <= high * ps][:lacking]
            out += [(i, p, k + 1, j, ps, ns) for k, (ns, j) in enumerate(bad)]
    return sorted(out)


def plain(df):
    return sorted(tuple(math.inf if v is None else v for v in r) for r in df.collect())


@pytest.mark.parametrize("least,greatest,width", [(-132, 146, 64), (-3, 2, 5), (0, 1, 7), (-20_000, 30_000, 1024), (-9, -4, 3), (5, 9, 2), (0, 0, 1)])
def test_packed_products(least, greatest, width):
    rng = np.random.default_rng(width)
    packing = negatives.Packing(least, greatest, width)
    a, b = rng.integers(least, greatest + 1, (9, width)), rng.integers(least, greatest + 1, (31, width))
    a[0], b[0], a[1], b[1] = least, least, greatest, greatest
    assert (packing.scores(a, packing.pack(b), b) == a @ b.T).all()
    assert packing.fields == 64 // packing.bits >= 1


def test_packing_limits():
    with pytest.raises(ValueError, match="bits"):
        negatives.Packing(-(2**40), 2**40, 64)
    packing = negatives.Packing(-1, 5, 3)
    assert packing.matrix(pa.array([[1, 2], [], [3, 4, 5]])).tolist() == [[1, 2, 0], [0, 0, 0], [3, 4, 5]]


@pytest.mark.parametrize("block,rows", [(2048, 2048), (3, 5)])
def test_random_rows(spark, monkeypatch, block, rows):
    """Ties, nulls, repeated ids, short vectors; blocks and strips of any size give the same."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ROWS", rows)
    monkeypatch.setattr(negatives, "STRIP", rows)
    rng = np.random.default_rng(3)
    data = []
    for i in range(160):
        v = (rng.integers(0, 4, 6) / 8 + rng.choice([0.0, 0.001], 6)).tolist()
        data.append((int(i), int(rng.integers(0, 4)), v, i % 10 == 0))
    data += [(200, None, [1.0] * 6, True), (201, 1, None, True), (202, 1, [1.0, None], True), (203, 1, [math.inf], True), (204, 1, [math.nan], True)]
    data += [(None, 1, [0.5] * 6, False), (None, 2, [0.25] * 6, False), (7, 2, [0.3] * 6, False), (300, 2, [0.3, 0.4], True), (301, 1, [], True), (302, 3, [-1.0] * 6, True)]
    data += [(400, 1, [0.375] * 6, False)] * 3
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>, asks boolean").selectExpr("*", "'x' AS key", "1 AS anchor_id").repartition(4)
    assert plain(negatives.hard_negatives(df, df.asks)) == brute(data)
    named = df.withColumn("label", df.label.cast("string"))
    assert plain(negatives.hard_negatives(named, named.asks)) == brute(data)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding, r.vec_id % 50 == 0) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert plain(queries.op11_negatives(spark, sf_dir)) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(df, df.vec_id % 50 == 0).count() == 0
    df = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(df, df.vec_id % 50 == 0).count() == 0
