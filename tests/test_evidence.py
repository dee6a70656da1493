import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence, stats
from tidemark.plans import jobs


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 8)))
    video = {v: unit(n) for v, n in (("a", 40), ("b", 25), ("c", 3))}
    asks = [(i, "abc"[i % 3], unit(1)[0], unit(4), i % 4) for i in range(7)]
    f = spark.createDataFrame([(v, i, 2.0 * i, x.tolist()) for v, m in video.items() for i, x in enumerate(m)], "video_id string, frame_idx int, t double, emb array<double>")
    q = spark.createDataFrame([(i, v, e.tolist(), o.tolist(), a) for i, v, e, o, a in asks], "question_id int, video_id string, q_emb array<double>, options array<array<double>>, answer_idx int")
    return video, asks, f, q


def scored(frames, q, options):
    r, s = frames @ q, frames @ options.T
    sc = s - s.mean(0)
    v = sc.var(1)
    z = lambda x: (x - x.mean()) / (x.std() + 1e-8)
    return r, sc, v, (z(r) + z(v)) / 2


def test_scores_selections_votes(spark, data):
    video, asks, f, q = data
    scores = evidence.frame_scores(q, f)
    by = {}
    for row in scores.collect():
        by.setdefault(row.question_id, {})[row.frame_idx] = row
    picked = {}
    for row in evidence.select_frames(scores, (4, 16)).collect():
        picked.setdefault((row.question_id, row.k, row.selector), []).append(row.frame_idx)
    votes = {(r.question_id, r.k, r.selector): r for r in evidence.vote(evidence.select_frames(scores, (4, 16)), q.select("question_id", "answer_idx"), ["question_id", "k", "selector"]).collect()}
    for i, v, e, o, a in asks:
        r, sc, var, b = scored(video[v], e, o)
        for k in range(len(r)):
            got = by[i][k]
            assert (got.r, got.v, got.b, *got.sc) == pytest.approx((r[k], var[k], b[k], *sc[k]), abs=1e-9)
        n = len(r)
        for k in (4, 16):
            take = min(k, n)
            want = {"Uniform": {int(round(x)) for x in np.linspace(0, n - 1, take)}, **{s: set(np.argsort(-x, kind="stable")[:take].tolist()) for s, x in (("Relevance", r), ("Variance", var), ("Blend", b))}}
            for s, idx in want.items():
                assert set(picked[i, k, s]) == idx
                sel = sc[sorted(idx)]
                counts = np.bincount(sel.argmax(1), minlength=4)
                best = max(range(4), key=lambda j: (counts[j], round(sel[:, j].sum(), 9), -j))
                got = votes[i, k, s]
                assert got.predicted == best and got.correct == (best == a)
                assert got.margin == pytest.approx(np.mean(sel[:, a] - np.delete(sel, a, 1).max(1)), abs=1e-9)


@pytest.mark.parametrize("block", [2, 256])
def test_null(spark, data, block):
    video, asks, f, q = data
    got = {r.question_id: r for r in evidence.swapped_null(q, f.repartition(5), 16, block).collect()}
    for i, v, e, o, _ in asks:
        top = {w: np.sort(scored(m, e, o)[2])[::-1][:16].mean() for w, m in video.items()}
        other = np.array([x for w, x in top.items() if w != v])
        assert got[i].z == pytest.approx((top[v] - other.mean()) / (other.std() + 1e-12), rel=1e-6)
        assert got[i].pct == pytest.approx((other < top[v]).mean())
    alone = evidence.swapped_null(q.filter("video_id = 'a'"), f.filter("video_id IN ('a', 'b')")).collect()
    assert all(r.z is None and r.pct is None for r in alone)


def test_spearman_and_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(x), float(y)) for g in range(3) for x, y in zip(rng.integers(0, 9, 50), rng.normal(size=50), strict=True)]
    df = spark.createDataFrame(rows, "g int, x int, y double")
    rank = lambda v: np.array([(np.sum(v < x) + 1 + np.sum(v <= x)) / 2 for x in v])
    for r in stats.spearman(df, "x", "y", ["g"]).collect():
        x, y = (np.array([row[k] for row in rows if row[0] == r.g]) for k in (1, 2))
        assert r.spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    for r in stats.bootstrap(df, "y", ["g"], 400).collect():
        y = np.array([row[2] for row in rows if row[0] == r.g])
        half = 1.96 * y.std() / np.sqrt(len(y))
        assert r.mean == pytest.approx(y.mean()) and abs(r.ci_lo - (y.mean() - half)) < half / 2 and abs(r.ci_hi - (y.mean() + half)) < half / 2
    constant = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0)], "g int, x int, y double")
    assert stats.spearman(constant, "x", "y", ["g"]).first().spearman is None
    assert stats.signal_summary(df.select(F.col("g").cast("string").alias("g"), F.col("y").alias("z")), "g", ["z"]).filter("group = 'All'").first().n == 150


def test_jobs_give_every_table_of_the_report(spark, data):
    _, _, f, q = data
    q = q.withColumn("task", F.col("video_id"))
    tables = jobs.selector_job(q, f, (2, 4), 4, "task")
    rows = tables["selector_eval"].collect()
    assert len(rows) == 2 * 4 * q.count()
    wide = {r.k: r for r in tables["summary"].collect()}
    for k in (2, 4):
        for s in evidence.SELECTORS:
            own = [r for r in rows if r.k == k and r.selector == s]
            for m in evidence.METRICS:
                assert wide[k][f"{s}_{m}"] == pytest.approx(np.mean([r[m] for r in own]))
    told = tables["intervals"].collect()
    assert {(r.selector, r.metric) for r in told} == {(s, m) for s in evidence.SELECTORS for m in evidence.METRICS[:3]}
    assert all(r.ci_lo <= r["mean"] + 1e-9 and r["mean"] <= r.ci_hi + 1e-9 for r in told)
    assert {r.task for r in tables["task_intervals"].collect()} == {r.task for r in q.select("task").collect()}
    assert tables["constants"].count() == 1


def test_null_of_two_variants_is_that_of_each(spark, data):
    _, _, f, q = data
    q = q.withColumns({"one": F.col("options"), "two": F.transform("options", lambda o: F.reverse(o)), "g": F.lit("x")})
    both = {r.question_id: r for r in evidence.variant_nulls(q, f, ["one", "two"], block=2).collect()}
    for v in ("one", "two"):
        for r in evidence.swapped_null(q, f, options=v).collect():
            assert (both[r.question_id][f"z_{v}"], both[r.question_id][f"pct_{v}"]) == (pytest.approx(r.z), r.pct)
    assert {(r.group, r.variant) for r in jobs.null_job(q, f, "g", variants=("one", "two"))["summary"].collect()} == {(g, v) for g in ("x", "All") for v in ("z_one", "z_two")}


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else [round(y, 9) + 0.0 for y in x] if isinstance(x, list) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("size", [(256, 131_072), (2, 7)])
def test_tasks_give_what_the_rows_of_all_scores_give(spark, data, monkeypatch, size):
    """Picks, whole votes and rank correlations, of blocks of questions and deals of frames, against frame_scores."""
    _, _, f, q = data
    scores = evidence.frame_scores(q, f).cache()
    answers = q.select("question_id", "answer_idx")
    want = [_rows(x) for x in (evidence.select_frames(scores, (4, 16)), evidence.vote(scores, answers, ["question_id"]), stats.spearman(scores, "r", "v", ["question_id"]), scores)]
    monkeypatch.setattr(evidence, "QUESTIONS", size[0])
    monkeypatch.setattr(evidence, "DEAL", size[1])
    of_select = ["question_id", "k", "selector", "frame_idx", "t", "sc"]
    got = [_rows(x) for x in (evidence.pick_frames(q, f, (4, 16)).select(of_select), evidence.whole_votes(q, f), evidence.rank_correlation(q, f), evidence.frame_scores(q, f))]
    assert got == want
    scores.unpersist()


def test_no_pair_of_question_and_frame_is_a_row_before_the_tasks(spark, data):
    """What meets in tasks is a row per question and per frame, of one block and deal each; the vectors are not joined in pairs."""
    _, _, f, q = data
    assert evidence._met(q, f).count() == q.count() + f.count()


def test_equal_frames_are_picked_in_order(spark):
    rng = np.random.default_rng(5)
    x, e, o = rng.normal(size=(3, 8)), rng.normal(size=8), rng.normal(size=(4, 8))
    f = spark.createDataFrame([("a", i, 2.0 * i, x[i % 3].tolist()) for i in range(333)] + [("b", i, 2.0 * i, x[0].tolist()) for i in range(77)], "video_id string, frame_idx int, t double, emb array<double>")
    q = spark.createDataFrame([(v, v, e.tolist(), o.tolist(), 0) for v in "ab"], "question_id string, video_id string, q_emb array<double>, options array<array<double>>, answer_idx int")
    got = {}
    for r in evidence.pick_frames(q, f, (8,)).collect():
        got.setdefault((r.question_id, r.selector), []).append(r.frame_idx)
    best = int(np.argmax(x @ e))
    assert sorted(got["a", "Relevance"]) == list(range(best, 24, 3))
    assert all(sorted(got["b", s]) == list(range(8)) for s in evidence.SELECTORS[1:])


def test_null_of_long_videos_in_parts(spark, data, monkeypatch):
    """A video in several deals, each with the video's mean, deals without frames, and a run of few products."""
    _, _, f, q = data
    want = {r.question_id: (pytest.approx(r.z), pytest.approx(r.pct), pytest.approx(r.real)) for r in evidence.swapped_null(q, f).collect()}
    monkeypatch.setattr(evidence, "DEAL", 6)
    monkeypatch.setattr(evidence, "DEALS", 40)
    assert {r.question_id: (r.z, r.pct, r.real) for r in evidence.swapped_null(q, f, block=2).collect()} == want


def test_a_key_is_drawn_once_for_all_its_groups(spark, monkeypatch):
    """Weights are those of the hash of seed, block and key, drawn once a key and task, whatever the groups, gaps and sizes of runs."""
    rng = np.random.default_rng(3)
    rows = [(g, m, i, None if rng.random() < 0.1 else float(rng.normal())) for i in range(30) for g in ("a", "b", None) for m in range(4)] + [("a", 0, None, 2.0)]
    df = spark.createDataFrame(rows, "g string, m int, id int, x double")

    def weight(block, i, key):
        u = int(hashlib.md5("|".join(["7", str(block), *([] if key is None else [str(key)])]).encode()).hexdigest()[8 * i : 8 * i + 8], 16) / 4294967296
        return sum(u >= c for c in stats.POISSON)

    want = {}
    for g, m in {(r[0], r[1]) for r in rows if r[0]}:
        own = [(k, x) for a, b, k, x in rows if (a, b) == (g, m) and x is not None]
        means = []
        for j in range(90):
            w = [weight(j // 4, j % 4, k) for k, _ in own]
            if sum(w):
                means.append(sum(a * x for a, (_, x) in zip(w, own, strict=True)) / sum(w))
        want[g, m] = (pytest.approx(np.mean([x for _, x in own])), pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))
    for size in ((1024, 1024), (3, 7)):
        monkeypatch.setattr(stats, "GROUPS", size[0])
        monkeypatch.setattr(stats, "DRAWN", size[1])
        got = stats.bootstrap(df, "x", ["g", "m"], 90, 7, "id")
        assert {(r.g, r.m): (r["mean"], r.ci_lo, r.ci_hi) for r in got.collect()} == want
    # no row is made per key and resample
    assert "Generate explode" not in got._jdf.queryExecution().executedPlan().toString() and not stats.bootstrap(df.filter("false"), "x", ["g"]).collect()
    assert stats.bootstrap(df.filter("false"), "x", []).first()["mean"] is None


def test_products_are_made_in_tiles_of_one_shape(spark, monkeypatch):
    """Frames over several tiles, many of them equal: each is there once, and equal frames have equal ranks and votes."""
    rng = np.random.default_rng(6)
    x, e, o = rng.normal(size=(5, 8)), rng.normal(size=(3, 8)), rng.normal(size=(3, 4, 8))
    f = spark.createDataFrame([("a", i, 2.0 * i, x[i * i % 5].tolist()) for i in range(333)], "video_id string, frame_idx int, t double, emb array<double>")
    q = spark.createDataFrame([(i, "a", e[i].tolist(), o[i].tolist(), i) for i in range(3)], "question_id int, video_id string, q_emb array<double>, options array<array<double>>, answer_idx int")
    scores = evidence.frame_scores(q, f).collect()
    monkeypatch.setattr(evidence, "TILE", 1 << 12)
    of = evidence.Asked(pa.table({"i": range(3)}), pa.table({"i": range(333)}), np.pad(x[np.arange(333) ** 2 % 5], ((0, 64), (0, 0))), np.concatenate([e[:, None], o], 1), np.zeros((3, 4)))
    assert [(at, p.shape) for at, p in of.tiles()] == [(at, (3, 5, min(64, 333 - at))) for at in range(0, 333, 64)]
    frames = x[np.arange(333) ** 2 % 5]
    rank = lambda v: np.array([(np.sum(v < y) + 1 + np.sum(v <= y)) / 2 for y in v])
    votes, ranks = ({r.question_id: r for r in df.collect()} for df in (evidence.whole_votes(q, f), evidence.rank_correlation(q, f)))
    for i in range(3):
        r, sc, v, _ = scored(frames, e[i], o[i])
        assert votes[i].predicted == np.bincount(sc.argmax(1), minlength=4).argmax() and votes[i].n_frames == 333
        assert votes[i].margin == pytest.approx(np.mean(sc[:, i] - np.delete(sc, i, 1).max(1)), abs=1e-9)
        assert ranks[i].spearman == pytest.approx(np.corrcoef(rank(np.round(r, 9)), rank(np.round(v, 9)))[0, 1], abs=1e-9)
    some = evidence.frame_scores(q, f, columns=("question_id", "frame_idx", "b"))
    assert some.columns == ["question_id", "frame_idx", "b"]
    assert {(r.question_id, r.frame_idx): r.b for r in some.collect()} == {(r.question_id, r.frame_idx): pytest.approx(r.b) for r in scores}


def test_frames_travel_once_for_a_thousand_questions(spark):
    f = spark.range(300).selectExpr("'a' AS video_id", "int(id) AS frame_idx", "double(id) AS t", "array(double(id), 1.0D) AS emb")
    q = spark.range(1000).selectExpr("id AS question_id", "'a' AS video_id", "array(1.0D, double(id)) AS q_emb", "array(array(1.0D, 2.0D), array(2.0D, 1.0D)) AS options", "0 AS answer_idx")
    assert evidence._met(q, f).count() == 1300
