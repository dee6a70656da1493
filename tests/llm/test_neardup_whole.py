"""One bucket of stars, chains and single texts against all pairs."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
import test_neardup

from tidemark.llm import icws, minhash, neardup


def texts(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(5000)]
    new = lambda: [rng.choice(vocab) for _ in range(200)]

    def edited(words):
        words = list(words)
        for k in rng.sample(range(10, 190, 12), 4):
            words[k] = rng.choice(vocab)
        return words

    out = []
    for _ in range(4):  # an original near all its copies, which are not near each other
        out.append(new())
        out += [edited(out[-1]) for _ in range(12)]
    for _ in range(3):  # each a copy of the one before
        out.append(new())
        for _ in range(11):
            out.append(edited(out[-1]))
    out += [new()[: 200 - 9 * i] for i in range(20)]
    rng.shuffle(out)
    return [" ".join(words) for words in out]


@pytest.mark.parametrize("op", ["icws", "minhash"])
@pytest.mark.parametrize("size", [7, 500])
def test_one_bucket_against_all_pairs(spark, monkeypatch, op, size):
    monkeypatch.setattr(neardup, "GROUP", size)
    rows = list(enumerate(texts()))
    how = minhash.ShingleSets() if op == "minhash" else icws.WeightedShingles(SimpleNamespace(value=SimpleNamespace(of=lambda shingles: np.full(len(shingles), 1.25, np.float32))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = spark.createDataFrame([(i, how.node(t, how.vector(t)), [7, 8]) for i, t in rows], "doc_id long, node binary, bands array<bigint>")
    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in neardup.classes(docs, keys, how).collect()), key=repr)
    want = test_neardup.brute(rows, how)
    assert len({c for _, c, _ in want}) == 27
    assert got == want


@pytest.mark.parametrize("size", [7, 40])
def test_texts_of_many_sizes_in_one_bucket(spark, monkeypatch, size):
    monkeypatch.setattr(neardup, "GROUP", size)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(2000)]
    # each is a beginning of the longest, and near those of up to a quarter more words
    kept = [base[: int(2000 * 0.97**i)] for i in range(80)] + [base[: 40 + i] for i in range(0, 12, 3)]
    kept += [[rng.choice(vocab) for _ in range(rng.randrange(20, 1500))] for _ in range(60)]
    rows = list(enumerate(" ".join(words) for words in kept))
    how = minhash.ShingleSets()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = [(i, how.node(t, v), [7], float(len(v))) for i, t in rows for v in [how.vector(t)]]
    keys = spark.createDataFrame(keys, "doc_id long, node binary, bands array<bigint>, size double")
    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in neardup.classes(docs, keys, how).collect()), key=repr)
    assert got == test_neardup.brute(rows, how)


def test_levels_of_near_sizes(spark):
    rng = random.Random(9)
    for least in (0.5, 0.8, 0.999, 1.0):
        sizes = [rng.uniform(0.5, 3e6) for _ in range(3000)]
        df = spark.createDataFrame([(x, x * least, x * least * 0.7) for x in sizes], "a double, b double, c double")
        rows = df.select(*[neardup.level(c, least).alias(c) for c in "abc"]).collect()
        assert all(0 <= r.a - r.b <= 1 for r in rows)
        assert any(r.a - r.c > 1 for r in rows) or least == 0.5


def test_small_tables_are_few_files_however_many_partitions(spark):
    """A chain of 300 nodes in 30 partitions: the labels of a step are one file."""
    put = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in put}
    edges = spark.range(299).selectExpr("id AS a", "id + 1 AS b")
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        made = neardup.components(edges)
        assert len(made.inputFiles()) == 1
        assert {tuple(r) for r in made.collect()} == {(i, 0) for i in range(300)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
