import random
import re
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import decontam


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(docs, items, stretch=13, share=0.75, shortest=decontam.LEAST):
    """Every text against every item at every shift, without seeds."""
    classes, number = {}, {}
    for i, t in items:
        classes.setdefault(tuple(words(t)), []).append(i)
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.int32)
    out = {}
    for d, t in docs:
        w = code(words(t))
        for b, ids in classes.items():
            width = min(len(b), stretch)
            if not width or len(b) < shortest or len(w) < width:
                continue
            same = w[:, None] == code(b)[None]
            best = int(sum(same[x : len(w) - width + 1 + x, x : len(b) - width + 1 + x].astype(np.int16) for x in range(width)).max())
            if best >= (width if len(b) < decontam.SHORT else decontam.least(width, share)):
                key = (d, min(ids))
                out[key] = (len(ids), max(best, out.get(key, (0, 0))[1]))
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


def cases():
    rng = random.Random(3)
    vocab = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(60)]
    item = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, item(n)) for i, n in enumerate([8, 9, 12, 15, 30, 40, 60, 1, 3, 10, 11, 13])]
    items.append((20, items[4][1]))
    docs = []
    for d in range(60):
        body = item(rng.randrange(0, 60))
        it = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 1 + len(it) // 3)):
            it[rng.randrange(len(it))] = "zz"
        cut = rng.randrange(len(it)) if d % 3 == 0 else 0
        at = rng.randrange(len(body) + 1)
        docs.append((d, ", ".join(body[:at] + it[cut:] + body[at:]).upper()))
    docs += [(0, docs[0][1]), (0, "again"), (None, " ".join(items[5][1])), (99, None), (98, ""), (97, " ".join(items[6][1] * 40))]
    return docs, [(i, " ".join(x)) for i, x in items] + [(50, None), (51, "")]


@pytest.mark.parametrize("rows", [200_000, 5])
def test_against_brute_force(spark, rows):
    docs, items = cases()
    got = decontam.overlaps(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_items int"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, seed int"), broadcast_rows=rows)
    want = brute(docs, items)
    assert len(want) > 20
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_substitutions_and_clean_texts(spark):
    item = [f"q{i}" for i in range(40)]
    changed = [w if i % 5 else "other" for i, w in enumerate(item)]
    df = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(sorted(item, key=hash))), (3, "q1 q2 q3 q4 q5 q6 q7"), (4, "x " * 50 + " ".join(item[:14]) + " y" * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontam.overlaps(df, bench).collect()} == {1, 4}
    assert sorted(r.doc_id for r in decontam.decontaminate(df, bench).collect()) == [2, 3]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    bench = df.withColumnRenamed("doc_id", "item_id")
    assert decontam.overlaps(df, bench).count() == 1
    assert decontam.overlaps(df.limit(0), bench).count() == 0 and decontam.overlaps(df, bench.limit(0)).count() == 0
    assert decontam.decontaminate(df, bench.limit(0)).count() == 1


def test_no_pattern_is_lost():
    assert all(decontam.recall(width, 0.75) == 1 for width in range(9, 14))


@pytest.mark.parametrize("rows", [200_000, 5])
def test_every_pattern_of_exchanged_tokens(spark, rows):
    docs, items = [], []
    for width, misses in ((9, 2), (10, 2), (11, 2), (12, 3), (13, 3)):
        item = [f"i{width}w{i}" for i in range(width)]
        items.append((width, " ".join(item)))
        for n, bad in enumerate(combinations(range(width), misses)):
            docs.append((width * 1000 + n, "x y " + " ".join("z" if i in bad else w for i, w in enumerate(item)) + " x"))
        docs.append((-width, " ".join("z" if i <= misses else w for i, w in enumerate(item))))
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=rows)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted((d, d // 1000) for d, _ in docs if d > 0)


def test_short_items(spark):
    df = spark.createDataFrame([(1, "so: what is the capital of France?"), (2, "what is the capital"), (3, "Paris"), (4, ""), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is the capital of France"), (2, "paris"), (3, ""), (4, None), (5, "the capital"), (6, "is the CAPITAL of")], "item_id long, text string")
    assert sorted(tuple(r) for r in decontam.overlaps(df, bench).collect()) == [(1, 1, 1, 6), (1, 6, 1, 4)]
    assert sorted(tuple(r) for r in decontam.overlaps(df, bench, shortest=1).collect()) == [(1, 1, 1, 6), (1, 5, 1, 2), (1, 6, 1, 4), (2, 5, 1, 2), (3, 2, 1, 1)]


def test_everyday_words_empty_no_corpus(spark):
    """Items of a word or two are passed over, and told."""
    df = spark.createDataFrame([(1, "yes, that is the one"), (2, "the other day it was"), (3, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, "the"), (3, "is the one"), (4, ""), (5, "it was the other day")], "item_id long, text string")
    assert decontam.decontaminate(df, bench).count() == 3
    assert sorted(tuple(r) for r in decontam.passed_over(bench).collect()) == [(1, 1), (2, 1), (3, 3), (4, 0)]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_a_passage_that_most_texts_share(spark, rows):
    """One phrase of the benchmark in every text, and in several items: every pair is found, in either form of the join."""
    phrase = " ".join(f"p{i}" for i in range(14))
    docs = spark.range(600).selectExpr("id AS doc_id", f"concat('a', id, ' b ', '{phrase}', ' c', id % 7) AS text")
    items = spark.createDataFrame([(i, f"x{i} {phrase} y{i}") for i in range(3)], "item_id long, text string")
    got = decontam.overlaps(docs, items, broadcast_rows=rows)
    assert got.count() == 1800 and got.select("n_tokens").distinct().count() == 1


def test_long_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    df = spark.createDataFrame([(1, "a b " * 200_000 + item + " c d" * 100_000)], "doc_id long, text string")
    assert [tuple(r) for r in decontam.overlaps(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [(1, 5, 1, 13)]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_a_long_text_that_repeats_a_passage(spark, rows):
    """9,000 tokens, all of which are hits: they would not fit in memory if each took the whole text along."""
    item = [f"i{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(item * 225)), (2, " ".join(item[:12])), (3, "z " * 505 + " ".join(item) + " y" * 40)], "doc_id long, text string")
    got = decontam.overlaps(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), broadcast_rows=rows)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7, 1, 13), (3, 7, 1, 13)]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_pieces_of_any_size_give_the_same_rows(spark, rows, monkeypatch):
    docs, items = cases()
    for size in (1, 7):
        monkeypatch.setattr(decontam, "PIECE", size)
        got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=rows)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)
