import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events, intervals, matching

CUES = "video_id string, cue_idx long, start double, end double, text string"


def cues(spark, rows):
    return spark.createDataFrame([("v", i, float(a), float(b), t) for i, (a, b, t) in enumerate(rows)], CUES)


def test_windows(spark):
    df = cues(spark, [(2, 4, "hello"), (14, 17, "boundary"), (31, 32, "later")])
    d = spark.createDataFrame([("v", 45.0)], "video_id string, duration double")
    got = [(r.t, r.text) for r in intervals.cue_windows(df, 15.0, d).orderBy("t").collect()]
    assert got == [(7.5, "hello boundary"), (22.5, "boundary"), (37.5, "later")]


def test_window_edges(spark):
    # a cue that ends where a window starts is not in it; the last window is cut
    df = cues(spark, [(0, 15, "a"), (15, 30, "b"), (40, 50, "c"), (60, 70, "beyond")])
    d = spark.createDataFrame([("v", 50.0)], "video_id string, duration double")
    assert [(r.i, r.t, r.text) for r in intervals.cue_windows(df, 15.0, d).orderBy("i").collect()] == [(0, 7.5, "a"), (1, 22.5, "b"), (2, 37.5, "c"), (3, 47.5, "c")]


def test_context_is_closed_at_both_ends(spark):
    df = cues(spark, [(0, 5, "left"), (15, 20, "right"), (20.5, 30, "out")])
    p = spark.createDataFrame([("v", 10.0), ("v", 100.0), ("w", 1.0)], "video_id string, t double")
    assert {(r.video_id, r.t): r.subtitle_text for r in intervals.context_text(p, df, 5.0).collect()} == {("v", 10.0): "left right", ("v", 100.0): "", ("w", 1.0): ""}


@pytest.mark.parametrize("rows,duration,want", [([(0, 5, "a"), (3, 10, "b"), (20, 25, "c")], 25.0, 0.6), ([], 10.0, 0.0), ([(0, 5, "a"), (5, 9, "b"), (-3, 1, "c"), (8, 99, "d")], 10.0, 1.0), ([(0, 5, "a")], 0.0, 0.0)])
def test_coverage(spark, rows, duration, want):
    d = spark.createDataFrame([("v", duration)], "video_id string, duration double")
    assert abs(intervals.coverage(cues(spark, rows), d).first().coverage - want) < 1e-12


def test_grids(spark):
    v = spark.createDataFrame([("a", 5.0, 100, 29.97), ("b", 4.0, 3, 0.5), ("c", 0.0, 0, 25.0)], "video_id string, duration double, n_frames int, fps double")
    assert [(r.video_id, r.t) for r in intervals.time_grid(v, 2.0).orderBy("video_id", "t").collect()] == [("a", 0.0), ("a", 2.0), ("a", 4.0), ("b", 0.0), ("b", 2.0)]
    assert [r.frame_no for r in intervals.index_grid(v).filter("video_id = 'a'").orderBy("t").collect()] == [0, 29, 59, 89]
    with pytest.raises(Exception, match="no frame rate"):
        intervals.duration_of(v.withColumn("fps", F.lit(0.0))).collect()


def test_nearest_against_brute_force(spark):
    rng = random.Random(1)
    left = [(v, float(rng.randrange(100)), i) for i, v in enumerate("abc" * 20)]
    right = [(v, float(rng.randrange(100)), i) for i, v in enumerate("ab" * 15)]
    got = matching.nearest(spark.createDataFrame(left, "video_id string, t double, k int"), spark.createDataFrame(right, "video_id string, t double, s int"), ["s"])
    for r in got.collect():
        own = [(abs(t - r.t), t) for v, t, _ in right if v == r.video_id]
        assert (r.distance, r.near_t) == (min(own) if own else (float("inf"), None))
    assert got.count() == len(left)


def test_alignment_of_two_peak_lists(spark):
    rows = [("v", m, float(t), 1.0, True) for m, t in (("visual", 10), ("visual", 50), ("text", 12), ("text", 80))] + [("w", "visual", 3.0, 1.0, True)]
    e = events.event_table(spark.createDataFrame(rows, "video_id string, modality string, t double, norm double, is_peak boolean"), None, 10.0)
    d = {(r.modality, r.timestamp_seconds): (r.nearest_other_peak_seconds, r.event_type) for r in e.filter("video_id = 'v'").collect()}
    assert d == {("visual", 10.0): (2.0, "aligned"), ("visual", 50.0): (30.0, "visual-only"), ("text", 12.0): (2.0, "aligned"), ("text", 80.0): (30.0, "text-only")}
    a = {(r.video_id, r.tolerance_seconds): r for r in events.alignment(e, (5.0, 20.0)).collect()}
    assert (a["v", 5.0].visual_only, a["v", 5.0].text_only, a["v", 5.0].aligned_pairs, a["v", 5.0].visual_alignment_fraction) == (1, 1, 1, 0.5)
    # no peak of the other modality: infinite distance, in the denominator; no text peak: a null share
    assert a["w", 20.0].visual_alignment_fraction == 0.0 and a["w", 20.0].text_alignment_fraction is None
    assert e.filter("video_id = 'w'").first().nearest_other_peak_seconds == float("inf")


@pytest.mark.parametrize("span", [matching.SPAN, 7.0, 0.5])
def test_nearest_at_any_stretch(spark, span):
    rng = random.Random(2)
    left = [(v, rng.randrange(400) / 4, i) for i, v in enumerate("abc" * 40)]
    right = [(v, rng.randrange(400) / 4, i) for i, v in enumerate("ab" * 25)] + [("d", 1.0, 1)]
    got = matching.nearest(spark.createDataFrame(left, "video_id string, t double, near_s int"), spark.createDataFrame(right, "video_id string, t double, s int"), ["s"], span).toDF("video_id", "t", "k", "near_t", "s", "distance").collect()
    assert len(got) == len(left)
    for r in got:
        own = [(abs(t - r.t), t) for v, t, _ in right if v == r.video_id]
        assert (r.distance, r.near_t) == (min(own) if own else (float("inf"), None))
        assert not own or (r.video_id, r.near_t, r.s) in right


def test_nearest_of_one_long_video(spark):
    """200,000 rows of one video, in seconds: no row looks through those after it."""
    left = spark.range(100_000).selectExpr("'v' AS video_id", "id * 2.0D AS t")
    right = spark.range(100_000).selectExpr("'v' AS video_id", "id * 2.0D + 1 AS t")
    began = time.time()
    told = matching.nearest(left, right).selectExpr("sum(distance) AS d", "count(*) AS n", "count_if(near_t = greatest(t - 1, 1.0D)) AS earlier").first()
    assert (told.d, told.n, told.earlier) == (100_000.0, 100_000, 100_000)
    assert time.time() - began < 60


def test_event_table_looks_at_peaks_and_samples(spark):
    rng = random.Random(4)
    rows = [("v" if rng.random() < 0.8 else "w", rng.choice(["visual", "text"]), rng.randrange(2000) / 2 + k * 1e-4, rng.random(), rng.random() < 0.3) for k in range(150)]
    signal = spark.createDataFrame(rows, "video_id string, modality string, t double, norm double, is_peak boolean")
    got = events.event_table(signal, None, 5.0).collect()
    assert len(got) == sum(r[4] for r in rows)
    for r in got:
        own = [x for x in rows if x[0] == r.video_id and x[1] != r.modality]
        peak = min(((abs(x[2] - r.timestamp_seconds), x[2], x[3]) for x in own if x[4]), default=(float("inf"), 0, None))
        sample = min(((abs(x[2] - r.timestamp_seconds), x[2], x[3]) for x in own), default=(0, 0, None))
        assert r.nearest_other_peak_seconds == peak[0]
        assert (r.text_score if r.modality == "visual" else r.visual_score) == (peak[2] if peak[0] <= 5 else sample[2])


@pytest.mark.parametrize("span", [matching.SPAN, 10.0, 1.0])
def test_coverage_at_any_stretch(spark, span):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, s := rng.randrange(-20, 900) / 4, s + rng.choice([0.25, 1, 5, 60, -3]), "x") for i in range(120)]
    got = {r.video_id: r.coverage for r in intervals.coverage(spark.createDataFrame(rows, CUES), spark.createDataFrame([("a", 220.0), ("b", 150.0), ("c", 9.0)], "video_id string, duration double"), span).collect()}
    for v, d in (("a", 220.0), ("b", 150.0), ("c", 9.0)):
        quarters = {q for x, _, s, e, _ in rows if x == v for q in range(int(max(s, 0) * 4), int(min(e, d) * 4))}
        assert got[v] == pytest.approx(len(quarters) / 4 / d)


def test_context_of_cues_of_all_lengths(spark):
    """One cue over everything and cues of many lengths give the same as a plain loop, and few rows before the join."""
    rng = random.Random(6)
    rows = [("v", i, s := rng.randrange(0, 4000) / 4, s + rng.choice([0, 0.5, 3, 20, 150, 700]), f"c{i}") for i in range(150)]
    rows += [("v", 900, 0.0, 1e7, "day"), ("w", 1, 5.0, 5.0, "point"), ("v", 901, -50.0, 2.0, "early")]
    points = [("v", rng.randrange(0, 4400) / 4) for _ in range(80)] + [("w", 15.0), ("w", 15.25), ("x", 0.0), ("v", 9e6), ("v", -4.0)]
    got = intervals.context_text(spark.createDataFrame(points, "video_id string, t double"), spark.createDataFrame(rows, CUES), 10.0)
    for r in got.collect():
        own = sorted((s, i, x) for v, i, s, e, x in rows if v == r.video_id and s <= r.t + 10 and e >= r.t - 10)
        assert r.subtitle_text == " ".join(x for _, _, x in own)
    assert got.count() == len(points)
