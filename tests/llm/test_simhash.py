"""SimHash fingerprints and their components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import queries, simhash


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def reachable(values):
    """The least place that links reach, for each place; all pairs."""
    f = np.array(values, np.uint64)
    label = list(range(len(f)))
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= 2) for x in f]
    for start in range(len(f)):
        if label[start] != start:
            continue
        todo = [start]
        while todo:
            for j in near[todo.pop()]:
                if label[j] > start:
                    label[j] = start
                    todo.append(int(j))
    return label


@pytest.mark.parametrize("bite", [1 << 20, 16, 40])
def test_fingerprints(monkeypatch, bite):
    monkeypatch.setattr(simhash, "BITE", bite)
    rng = np.random.default_rng(bite)
    texts = ["".join(rng.choice(list("aBÉ \t\n\x0b\xa0xy"), size=rng.integers(0, 80))) for _ in range(200)]
    for t in [*texts, "", " ", "a", "a b", "x" * 100, "x" * 100 + " b", "A b c " * 50]:
        assert simhash.fingerprint(t.encode()) % (1 << 64) == brute(t)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs.sort()
    prints = [brute(t) for _, t in docs]
    label = reachable(prints)
    want = [(d, f"{p:016x}", docs[k][0]) for (d, _), p, k in zip(docs, prints, label, strict=True)]
    got = sorted(tuple(r) for r in queries.op13_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect())
    assert got == sorted(want)


@pytest.mark.parametrize("held", [simhash.HELD, 40, 3, 1])
def test_components_of_clusters_and_chains(spark, held):
    """Stars, chains and dense clusters; buckets of more than ``held`` fingerprints meet in Spark, with the same result."""
    rng = np.random.default_rng(5)
    values = set()
    for _ in range(4):  # dense clusters of up to four flips of one half
        base = int(rng.integers(0, 1 << 63))
        for _ in range(90):
            x = base
            for k in rng.choice(32, rng.integers(0, 5)):
                x ^= 1 << int(k)
            values.add(x)
    x = int(rng.integers(0, 1 << 63))
    for k in range(0, 60, 2):  # a chain of two flips a step, over all blocks
        values.add(x)
        x ^= 3 << k
    values |= {0, 1 << 63, (1 << 63) | 1, (1 << 64) - 1}
    values = sorted(values)
    label = reachable(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {r.fp: r.component for r in simhash.components(spark.createDataFrame([(v,) for v in signed], "fp long"), held).collect()}
    groups = {}
    for v, k in zip(signed, label, strict=True):
        groups.setdefault(k, []).append(v)
    want = {v: min(g) for g in groups.values() if len(g) > 1 for v in g}
    assert got == want


def test_edge_cases(spark):
    rows = [(3, None, "x"), (1, "", "y"), (None, " \n", "z"), (7, "One two three", "w"), (8, "one TWO three", "w"), (8, "one TWO three", "w"), (None, "alone is this text here", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumnRenamed("component_id", "fp")
    got = {(r.doc_id, r.fingerprint == "0" * 16, r.component_id) for r in simhash.near_components(df).collect()}
    assert got == {(3, True, 1), (1, True, 1), (None, True, 1), (7, False, 7), (8, False, 7), (None, False, None)}
    assert simhash.near_components(df).count() == len(rows)
    assert simhash.near_components(df.limit(0)).count() == 0
