import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from tidemark.llm import icws, minhash, neardup


def brute(rows, how, least=0.8):
    """class id, number of copies by row, from all pairs of different texts."""
    vectors = [how.vector(t or "") for _, t in rows]
    nodes = [how.node(t or "", v) for (_, t), v in zip(rows, vectors, strict=True)]
    distinct = {n: v for n, v in zip(nodes, vectors, strict=True)}
    names = list(distinct)
    parent = {n: n for n in names}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            if how.alike(distinct[a], distinct[b]) >= least:
                parent[top(a)] = top(b)
    heads = {}
    for (d, _), n in zip(rows, nodes, strict=True):
        if d is not None:
            heads[top(n)] = min(d, heads.get(top(n), d))
    copies = Counter(nodes)
    return sorted(((d, heads.get(top(n)), copies[n]) for (d, _), n in zip(rows, nodes, strict=True)), key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    hot = text(60)
    rows = []
    for i in range(60):  # originals, some with a passage that many share
        body = text(rng.randrange(3, 250))
        rows.append((i, " ".join(hot + body if i % 3 == 0 else body)))
    for i in range(60, 120):  # edited copies
        words = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(0, max(len(words) // 40, 1) + 1)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    base = text(300)  # one large group of near copies and one of exact copies
    for i in range(120, 220):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(300)] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(base)) for i in range(220, 260)]
    rows += [(300, None), (301, ""), (302, "..."), (303, "..."), (304, "Word"), (305, "word!"), (None, rows[5][1]), (7, rows[7][1]), (7, "other text of the same id"), (None, "alone here")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("op", ["icws", "minhash"])
def test_against_all_pairs(spark, op):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(5)
    if op == "icws":
        how = icws.WeightedShingles(SimpleNamespace(value=icws.idf(df)))
        got = icws.near_classes(df)
    else:
        how = minhash.ShingleSets()
        got = minhash.near_classes(df)
    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in got.collect()), key=repr)
    assert got == brute(rows, how)


def test_keep_one(spark):
    rows = corpus(6)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    how = icws.WeightedShingles(SimpleNamespace(value=icws.idf(df)))
    kept = [(r.doc_id, r.text) for r in icws.keep_one(df).collect()]
    # rows that differ in id or text get names of their own, so that a class is known by its row and not by its id alone
    named = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    heads = {c for _, c, _ in brute([(i, t) for i, (_, t) in enumerate(named)], how)}
    assert sorted(kept, key=repr) == sorted((named[i] for i in heads), key=repr)
    assert (7, "other text of the same id") in kept and any(r[0] == 7 and r[1] != "other text of the same id" for r in kept)
    assert icws.keep_one(df).columns == df.columns


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert icws.near_classes(df).count() == 0 and icws.keep_one(df).count() == 0 and minhash.near_classes(df).count() == 0


def test_idf_counts_documents(spark):
    texts = ["a b c d e"] * 6 + ["a b c d e a b c d e", "f g h i j", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = icws.idf(df)
    of = lambda t: got.of(icws.counted([t])[0][0])[0]
    want = lambda n: 1 + icws.IDF_SPAN * np.log(9 / n) / np.log(1 / icws.RAREST)
    assert got.documents == 9 and abs(of("a b c d e") - want(7)) < 1e-6 and abs(of("f g h i j") - want(1)) < 1e-6


def test_idf_of_a_full_sketch():
    rng = np.random.default_rng(1)
    documents, width = 1_000_000, 1 << icws.CELL_BITS
    some = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    times = np.geomspace(300, 900_000, 300).astype(np.int64)  # documents of each of these
    counts = np.stack([rng.poisson(400, width) for _ in range(icws.DEPTH)]).astype(np.int64)  # what all others put there
    for row in range(icws.DEPTH):
        np.add.at(counts[row], icws._cells(some, row), times)
    want = 1 + icws.IDF_SPAN * np.log(documents / times) / np.log(1 / icws.RAREST)
    assert np.abs(icws.Idf(counts, documents).of(some) - np.minimum(want, 1 + icws.IDF_SPAN)).max() < 0.02


def test_samples_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        hits, near = [], []
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
            y, w = x.copy(), (1 + rng.random(len(x))).astype(np.float32)
            v, k = w.copy(), int(len(x) * (1 - share))
            v[:k] *= 3
            s = icws.samples([(x, w), (y, v)])
            hits.append((s[0] == s[1]).mean())
            near.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
        assert abs(np.mean(hits) - np.mean(near)) < 0.04


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    key = lambda n: n.to_bytes(16, "big")
    df = spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.component, "big") for r in neardup.components(df).collect()}
    parent = {n: n for e in edges for n in e}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert got == {n: top(n) for e in edges if e[0] != e[1] for n in e}


def numbers():
    class Numbers:  # made here, so that it travels to the workers whole
        """Texts are numbers; those less than 10 apart are near."""

        def vector(self, text):
            return int(text)

        def node(self, text, vector):
            return vector.to_bytes(16, "big")

        def alike(self, a, b):
            return 1.0 if abs(a - b) < 10 else 0.0

    return Numbers()


@pytest.mark.parametrize("size", [3, 500])
def test_large_bucket_of_many_clusters(spark, monkeypatch, size):
    monkeypatch.setattr(neardup, "GROUP", size)
    values = [c * 1000 + i for c in range(12) for i in range(8)]
    random.Random(1).shuffle(values)
    rows = [(i, str(v), numbers().node("", v), [7]) for i, v in enumerate(values)]
    keys = spark.createDataFrame([(i, n, b) for i, _, n, b in rows], "doc_id long, node binary, bands array<bigint>")
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs, keys, numbers()).collect()}
    least = {}
    for i, v in enumerate(values):
        least.setdefault(v // 1000, i)
    assert got == {i: least[v // 1000] for i, v in enumerate(values)}
