import numpy as np
import pandas as pd
import pytest

from tidemark.config import BoundaryConfig
from tidemark.operators import signals


def brute_peaks(x):
    n, out = len(x), {}
    i = 1
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            p = (i + j) // 2
            lo = p
            while lo > 0 and x[lo - 1] <= x[p]:
                lo -= 1
            hi = p
            while hi < n - 1 and x[hi + 1] <= x[p]:
                hi += 1
            out[p] = x[p] - max(min(x[lo : p + 1]), min(x[p : hi + 1]))
        i = j + 1
    return out


def test_prominences_against_brute_force():
    rng = np.random.default_rng(0)
    for n in [0, 1, 2, 3, 5, 40, 200]:
        for top in (2, 4, 1000):
            x = rng.integers(0, top, n).astype(float)
            assert signals.prominences(x) == pytest.approx(brute_peaks(list(x)))


def test_spacing():
    t, s = np.array([0.0, 20.0, 30.0, 41.0]), np.array([1.0, 1.0, 5.0, 2.0])
    assert signals.spaced(t, s, 20.0) == [0, 2]
    assert signals.spaced(t[:2], s[:2], 20.0) == [0, 1]  # exactly the gap: both stay
    assert signals.spaced(np.array([0.0, 1.0]), np.array([1.0, 1.0]), 5.0) == [1]  # equal strength: the later
    assert signals.spaced(t, s, 0.0, 2) == [2, 3]


def test_smoothing():
    x = np.array([0.0, 0, 3, 0, 0])
    assert signals.smooth(x, 3.0, "moving_average").tolist() == [0, 1, 1, 1, 0]
    assert signals.smooth(x, 2.0, "moving_average").tolist() == [0, 0, 1.5, 1.5, 0]  # an even size reaches further left
    g = signals.smooth(np.ones(9), 1.5, "gaussian")
    assert np.allclose(g, 1)
    assert signals.smooth(x[:2], 3.0, "gaussian").tolist() == [0, 0]
    with pytest.raises(ValueError):
        signals.smooth(x, 1.0, "other")


def test_change_scores(spark):
    df = spark.createDataFrame([("v", 0.0, [1.0, 0.0]), ("v", 2.0, [1.0, 0.0]), ("v", 4.0, [0.0, 1.0]), ("one", 0.0, [1.0, 0.0])], "video_id string, t double, emb array<float>")
    assert [(r.video_id, r.t, round(r.raw, 9)) for r in signals.change_scores(df, ["video_id"]).orderBy("t").collect()] == [("v", 2.0, 0.0), ("v", 4.0, 1.0)]


def test_constant_series(spark):
    df = spark.createDataFrame([("v", float(i), 1.0) for i in range(5)], "video_id string, t double, value double")
    assert {r.norm for r in signals.zscore(df, ["video_id"]).collect()} == {0.0}
    assert {r.norm for r in signals.robust_scale(df, ["video_id"]).collect()} == {0.0}


def test_series_job(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for v in range(4):
        x = rng.random(60)
        t = np.cumsum(rng.integers(1, 4, 60)).astype(float)
        rows += [(v, float(a), float(b)) for a, b in zip(t, x, strict=True)]
        z = (x - x.mean()) / x.std()
        p = {i: q for i, q in brute_peaks(list(z)).items() if q >= 0.8}
        kept = []
        for i in sorted(p, key=lambda i: (-p[i], -i)):
            if all(abs(t[i] - t[k]) >= 10 for k in kept):
                kept.append(i)
        want[v] = sorted(kept)
    df = spark.createDataFrame(rows, "video_id int, t double, raw double").repartition(3)
    got = signals.signals(df, ["video_id"], BoundaryConfig(smoothing="none", peak_min_spacing=10.0)).filter("is_peak").collect()
    assert {v: sorted(r.i for r in got if r.video_id == v) for v in want} == want


def test_settings_are_checked():
    for bad in ({"frame_interval": 0.0}, {"smoothing": "x"}, {"normalization": "x"}):
        with pytest.raises(ValueError):
            BoundaryConfig(**bad)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000])
def test_chunks_know_the_prominences_of_the_whole(size):
    """Series cut anywhere, plateaus across seams included: shown runs and hidden peaks give what the whole series gives."""
    rng = np.random.default_rng(size)
    for n in (1, 2, 3, 10, 60, 300):
        for top in (1, 2, 3, 6, 10_000):
            x = rng.integers(0, top, n).astype(float)
            if n == 300 and top == 6:
                x = np.repeat(x[:30], 10)  # plateaus longer than a chunk
            told = [signals.chunk_summary(x[a : a + size], a) for a in range(0, n, size)]
            refs, peaks = signals.merged_summaries(pd.concat([t[0] for t in told], ignore_index=True))
            left, right = dict(zip(refs["of"], refs["left"], strict=True)), dict(zip(refs["of"], refs["right"], strict=True))
            got = dict(zip(peaks["i"], peaks["prominence"], strict=True))
            for _, some in told:
                for r in some.itertuples():
                    low = min(r.left, left[r.of_left]) if r.of_left >= 0 else r.left
                    high = min(r.right, right[r.of_right]) if r.of_right >= 0 else r.right
                    if max(low, high) < r.value:
                        got[r.i] = r.value - max(low, high)
            assert got == pytest.approx(signals.prominences(x))


def test_chunks_show_little():
    x = np.random.default_rng(1).random(20_000)
    items, _ = signals.chunk_summary(x, 0)
    assert len(items) < 100


@pytest.mark.parametrize("settings", [{}, {"smoothing": "moving_average", "normalization": "robust_percentile"}, {"smoothing": "none"}])
def test_long_series_in_pieces(spark, settings):
    """Chunks of 7, of 100 and whole series give the same signal."""
    rng = np.random.default_rng(8)
    rows = []
    for v, n in enumerate((230, 100, 8, 1)):
        x = np.round(rng.random(n), 1) if v % 2 else rng.random(n)
        t = np.cumsum(rng.integers(1, 4, n)).astype(float)
        rows += [(v, "m", float(a), float(b)) for a, b in zip(t, x, strict=True)]
    df = spark.createDataFrame(rows, "video_id int, modality string, t double, raw double").repartition(3)
    config = BoundaryConfig(peak_prominence=0.3, peak_min_spacing=9.0, smoothing_seconds=7.0, **settings)
    order = ["video_id", "i"]
    whole = signals.signals(df, ["video_id", "modality"], config).orderBy(*order).toPandas()
    assert whole["is_peak"].any()
    for size in (7, 100):
        got = signals.signals(df, ["video_id", "modality"], config, size).orderBy(*order).toPandas()[whole.columns]
        pd.testing.assert_frame_equal(got, whole, rtol=1e-9, atol=1e-9)


def test_apart_by_runs(spark):
    rng = np.random.default_rng(4)
    rows = [(int(v), float(t), float(s)) for v in range(3) for t, s in zip(np.unique(rng.integers(0, 900, 200)), rng.integers(0, 30, 200), strict=False)]
    df = spark.createDataFrame(rows, "k int, t double, s double").repartition(3)
    for most in (None, 1, 4):
        got = {(r.k, r.t) for r in signals.keep_apart(df, ["k"], "t", "s", 6.0, most).collect()}
        want = set()
        for v in range(3):
            own = sorted(r for r in rows if r[0] == v)
            t, s = np.array([r[1] for r in own]), np.array([r[2] for r in own])
            want |= {(v, float(t[i])) for i in signals.spaced(t, s, 6.0, most)}
        assert got == want


def test_quantiles_by_sketch(spark):
    """A sketch of accuracy 1000 gives a value whose rank is off by a thousandth at most; exact is the default."""
    df = spark.range(20_000).selectExpr("0 AS k", "id AS i", "pow((id * 7919) % 20000, 1.5) AS value").repartition(5)
    values = np.sort([r.value for r in df.collect()])
    got = df.groupBy("k").agg(signals.quantile("value", 0.05).alias("exact"), signals.quantile("value", 0.05, 1000).alias("near")).first()
    assert got.exact == pytest.approx(np.percentile(values, 5))
    assert abs(np.searchsorted(values, got.near) / len(values) - 0.05) <= 0.001
    a, b = (signals.robust_scale(df, ["k"], accuracy=x).orderBy("i").toPandas()["norm"].to_numpy() for x in (None, 1000))
    assert np.abs(a - b).max() < 0.005
