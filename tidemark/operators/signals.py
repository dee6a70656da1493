"""Change signals of a video: scores, smoothing, normalisation, peaks.

Smoothing with repeated edges, prominence and greedy spacing are sequential within one series, so they are numpy
helpers; everything else is built-in. Only scalars reach the helpers, never vectors. A helper sees one series at a time,
or, where a series has more than CHUNK samples, a piece of it: smoothing a chunk with the samples about it, prominence
a chunk and then the few samples that a chunk shows to the others, spacing a run of peaks that no other peak is near.
The results are the same.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import BoundaryConfig
from tidemark.functions import vectors
from tidemark.operators.matching import SPAN
from tidemark.sources.shared import written

#: Samples of a series that one call of a helper gets; a longer series is cut.
CHUNK = 65_536


def change_scores(frames: DataFrame, key: list[str], order: str = "t", emb: str = "emb") -> DataFrame:
    """key, t, raw: 1 - cosine of each vector with the one before it; the first of a series has none."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = frames.withColumn("_before", F.lag(emb).over(w)).filter(F.col("_before").isNotNull())
    return rows.select(*key, F.col(order).alias("t"), vectors.cosine_distance(F.col(emb), F.col("_before")).alias("raw"))


def width_in_samples(series: DataFrame, key: list[str], seconds: float) -> DataFrame:
    """key and width: seconds over the median time between samples, at least 1."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy(*key).orderBy("t"))
    medians = series.withColumn("_d", step).groupBy(*key).agg(F.expr("percentile(_d, 0.5)").alias("step"))
    return medians.withColumn("width", F.greatest(F.lit(seconds) / F.greatest("step", F.lit(1e-9)), F.lit(1.0)))


def zscore(series: DataFrame, key: list[str], value: str = "value", out: str = "norm", floor: float = 1e-12, add: float = 0.0) -> DataFrame:
    """Population z-scores within a series; all 0 where the deviation is at most ``floor``."""
    w = Window.partitionBy(*key)
    m, s = F.avg(value).over(w), F.stddev_pop(value).over(w)
    return series.withColumn(out, F.when(s <= floor, 0.0).otherwise((F.col(value) - m) / (s + add)))


def quantile(value: str, q: float, accuracy: int | None = None) -> Column:
    """The exact quantile, between two values in proportion; with ``accuracy`` a value whose rank is off by 1/accuracy at most.

    The exact one keeps all different values of a group, the other a mergeable sketch of bounded size.
    """
    return F.expr(f"percentile({value}, {q})") if accuracy is None else F.percentile_approx(value, q, accuracy).cast("double")


def robust_scale(series: DataFrame, key: list[str], value: str = "value", out: str = "norm", low: float = 5.0, high: float = 95.0, accuracy: int | None = None) -> DataFrame:
    """Scaled so that the low percentile is 0 and the high one 1, clipped; 0 where they are equal. See ``quantile``."""
    ends = series.groupBy(*key).agg(quantile(value, low / 100, accuracy).alias("_lo"), quantile(value, high / 100, accuracy).alias("_hi"))
    scaled = F.least(F.greatest((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0)), F.lit(1.0))
    return series.join(ends, key).withColumn(out, F.when(F.col("_hi") - F.col("_lo") <= 1e-12, 0.0).otherwise(scaled)).drop("_lo", "_hi")


def kernel_of(width: float, how: str) -> tuple[np.ndarray, int, int]:
    """Weights, and how many samples they reach to the left and to the right."""
    if how == "gaussian":
        radius = int(4 * width + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / width) ** 2)
        return kernel / kernel.sum(), radius, radius
    if how == "moving_average":
        n = max(1, round(width))
        return np.full(n, 1 / n), n // 2, n - 1 - n // 2
    raise ValueError(f"unknown smoothing {how!r}")


def smooth(x: np.ndarray, width: float, how: str) -> np.ndarray:
    """Gaussian (sigma = width) or moving average of round(width) samples, the end values repeated outwards."""
    if how == "none" or len(x) < 3:
        return x
    kernel, left, right = kernel_of(width, how)
    return np.convolve(np.pad(x, (left, right), mode="edge"), kernel, "valid")


def bases(y: np.ndarray) -> np.ndarray:
    """Least value between each sample and the last strictly higher one before it, by a falling stack."""
    out, stack = np.empty(len(y)), []
    for k, v in enumerate(y.tolist()):
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        stack.append((v, low))
        out[k] = low
    return out


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal values."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)
    return first, np.append(first[1:], len(x))[: len(first)] - 1


def prominences(x: np.ndarray) -> dict[int, float]:
    """Local maxima that are no ends (the middle of a plateau) and how far each stands out.

    The base on a side is the least value on the way to the next higher sample, or to the end.
    """
    first, last = runs_of(x)
    v = x[first]
    peaks = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    base = np.maximum(bases(v), bases(v[::-1])[::-1])
    return {int((first[p] + last[p]) // 2): float(v[p] - base[p]) for p in peaks}


def spaced(t: np.ndarray, strength: np.ndarray, gap: float, most: int | None = None) -> list[int]:
    """Indices kept by greedy choice: the strongest first (of equals the later), none nearer than ``gap`` to a kept one."""
    kept: list[int] = []
    times: list[float] = []  # of the kept, in order: only the two beside a place can be too near
    for i in sorted(range(len(t)), key=lambda i: (-strength[i], -i)):
        if most is not None and len(kept) == most:
            break
        at = bisect(times, t[i])
        if (at == 0 or t[i] - times[at - 1] >= gap) and (at == len(times) or times[at] - t[i] >= gap):
            times.insert(at, t[i])
            kept.append(i)
    return sorted(kept)


#: Rows of results that are put together before they leave a task.
ROWS = 20_000


def _each_series(df: DataFrame, key: list[str], order: str, one: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """``one`` of every series: rows are dealt by key and come in order, and many series share a call of the task.

    A series lies in one task, which holds one at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        made: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            fresh = np.zeros(len(pdf) - 1, bool)
            for c in key:
                x, none = pdf[c].to_numpy(), pdf[c].isna().to_numpy()
                fresh |= ((x[1:] != x[:-1]) & ~(none[1:] & none[:-1])).astype(bool)
            starts = np.append(0, np.flatnonzero(fresh) + 1)
            for a, b in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
                name = tuple(None if pd.isna(v) else v for v in (pdf[c].iat[a] for c in key))
                if held and name != last:
                    made.append(one(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)))
                    held = []
                held.append(pdf.iloc[a:b])
                last = name
            if sum(map(len, made)) >= ROWS:
                yield pd.concat(made, ignore_index=True)
                made = []
        if held:
            made.append(one(pd.concat(held, ignore_index=True)))
        if made:
            yield pd.concat(made, ignore_index=True)

    return df.repartition(*key).sortWithinPartitions(*key, order).mapInPandas(run, schema)


def signals(scores: DataFrame, key: list[str], config: BoundaryConfig, size: int = CHUNK) -> DataFrame:
    """key, i, t, raw, smooth, norm, is_peak, prominence of every series of change scores (key, t, raw).

    A series of up to ``size`` samples is one call of the helpers, a longer one goes through them in pieces.
    """
    kinds = ", ".join(f"{c} {scores.schema[c].dataType.simpleString()}" for c in key)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        t, raw = pdf["t"].to_numpy(), pdf["raw"].to_numpy(float)
        width = 1.0
        if len(t) > 1:
            width = max(config.smoothing_seconds / max(float(np.median(np.diff(t))), 1e-9), 1.0)
        s = smooth(raw, width, config.smoothing if config.smoothing_seconds > 0 else "none")
        if config.normalization == "zscore":
            d = s.std()
            norm = np.zeros_like(s) if d <= 1e-12 else (s - s.mean()) / d
        else:
            lo, hi = np.percentile(s, config.robust_percentiles)
            norm = np.zeros_like(s) if hi - lo <= 1e-12 else np.clip((s - lo) / (hi - lo), 0, 1)
        out = {i: p for i, p in prominences(norm).items() if p >= config.peak_prominence} if len(norm) >= 3 else {}
        at = np.array(sorted(out), int)
        kept = at[spaced(t[at], np.array([out[i] for i in at]), config.peak_min_spacing)] if len(at) else at
        peak, far = np.zeros(len(t), bool), np.full(len(t), None, object)
        peak[kept] = True
        far[kept] = [out[i] for i in kept]
        return pd.DataFrame({**{c: pdf[c] for c in key}, "i": np.arange(len(t), dtype=np.int32), "t": t, "raw": raw, "smooth": s, "norm": norm, "is_peak": peak, "prominence": far})

    rows = written(scores.select(*key, F.col("t").cast("double").alias("t"), F.col("raw").cast("double").alias("raw")), "scores")
    lengths = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    schema = f"{kinds}, i int, t double, raw double, smooth double, norm double, is_peak boolean, prominence double"
    if (lengths.agg(F.max("_n")).first()[0] or 0) <= size:
        return _each_series(rows, key, "t", one, schema)
    sized = rows.join(lengths, key)
    whole = _each_series(sized.filter(F.col("_n") <= size).drop("_n"), key, "t", one, schema)
    return whole.unionByName(_long_signals(sized.filter(F.col("_n") > size).drop("_n"), key, config, max(size, 3)))


def numbered(series: DataFrame, key: list[str], order: list[str], span: float = SPAN) -> DataFrame:
    """``series`` (key, t, ...) with i, the place of a row in its series, and n, the series' length.

    Rows are counted by stretches of ``span`` seconds and put in order within them.
    """
    rows = series.withColumn("_stretch", F.coalesce(F.floor(F.col("t") / span), F.lit(-(1 << 62))))
    counts = rows.groupBy(*key, "_stretch").agg(F.count("*").alias("_m"))
    along = Window.partitionBy(*key)
    counts = counts.select(*key, "_stretch", (F.sum("_m").over(along.orderBy("_stretch")) - F.col("_m")).alias("_before"), F.sum("_m").over(along).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*key, "_stretch").orderBy(*order)) - 1
    return rows.withColumn("_inside", inside).join(counts, [*key, "_stretch"]).withColumn("i", F.col("_before") + F.col("_inside")).drop("_stretch", "_before", "_inside")


def _long_signals(series: DataFrame, key: list[str], config: BoundaryConfig, size: int) -> DataFrame:
    """What ``signals`` gives, of series (key, t, raw) that are taken in pieces."""
    how = config.smoothing if config.smoothing_seconds > 0 else "none"
    rows = written(numbered(series, key, ["t", "raw"]), "series")
    rows = _smoothed(rows, key, how, config.smoothing_seconds, size) if how != "none" else rows.withColumn("smooth", F.col("raw"))
    rows = written(rows.select(*key, "i", "n", "t", "raw", "smooth"), "smooth")
    if config.normalization == "zscore":
        told = rows.groupBy(*key).agg(F.avg("smooth").alias("_m"), F.stddev_pop("smooth").alias("_s"))
        norm = F.when(F.col("_s") <= 1e-12, 0.0).otherwise((F.col("smooth") - F.col("_m")) / F.col("_s"))
    else:
        low, high = config.robust_percentiles
        told = rows.groupBy(*key).agg(quantile("smooth", low / 100).alias("_m"), quantile("smooth", high / 100).alias("_s"))
        norm = F.when(F.col("_s") - F.col("_m") <= 1e-12, 0.0).otherwise(F.least(F.greatest((F.col("smooth") - F.col("_m")) / (F.col("_s") - F.col("_m")), F.lit(0.0)), F.lit(1.0)))
    rows = written(rows.join(told, key).withColumn("norm", norm).drop("_m", "_s"), "norm")
    peaks = long_prominences(rows, key, "norm", size).filter(F.col("prominence") >= config.peak_prominence)
    peaks = peaks.join(rows.select(*key, "i", "t"), [*key, "i"])
    kept = keep_apart(peaks, key, "t", "prominence", config.peak_min_spacing).select(*key, "i", "prominence")
    out = rows.join(kept, [*key, "i"], "left")
    return out.select(*key, F.col("i").cast("int").alias("i"), "t", "raw", "smooth", "norm", F.col("prominence").isNotNull().alias("is_peak"), "prominence")


def _smoothed(rows: DataFrame, key: list[str], how: str, seconds: float, size: int) -> DataFrame:
    """``rows`` (key, i, n, t, raw) with ``smooth``, by chunks that also get the samples their kernel reaches beyond them."""
    chunk = F.floor(F.col("i") / size)
    ends = rows.filter((F.col("i") + 1) % size == 0).select(*key, (chunk + 1).alias("_c"), F.col("t").alias("_t0"))
    before = F.coalesce(F.lag("t").over(Window.partitionBy(*key, "_c").orderBy("i")), F.col("_t0"))
    steps = rows.withColumn("_c", chunk).join(ends, [*key, "_c"], "left").withColumn("_d", F.col("t") - before)
    widths = steps.groupBy(*key).agg(F.expr("percentile(_d, 0.5)").alias("_step"))
    widths = widths.select(*key, F.greatest(F.lit(seconds) / F.greatest("_step", F.lit(1e-9)), F.lit(1.0)).alias("width"))
    reach = F.floor(4 * F.col("width") + 0.5) if how == "gaussian" else F.floor(F.col("width") / 2) + 1
    # a chunk is at least as long as what it needs from beside it, so no sample is sent to more than three
    spread = rows.join(widths, key).withColumn("_reach", reach).withColumn("_size", F.greatest(F.lit(size), F.col("_reach")))
    least, most = F.greatest(F.floor((F.col("i") - F.col("_reach")) / F.col("_size")), F.lit(0)), F.least(F.floor((F.col("i") + F.col("_reach")) / F.col("_size")), F.floor((F.col("n") - 1) / F.col("_size")))
    spread = spread.select(*key, "i", "n", "t", "raw", "width", "_size", F.explode(F.sequence(least, most)).alias("_c"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        i, x, span, c = pdf["i"].to_numpy(), pdf["raw"].to_numpy(float), int(pdf["_size"].iloc[0]), int(pdf["_c"].iloc[0])
        own = (i >= c * span) & (i < (c + 1) * span)
        kernel, left, right = kernel_of(float(pdf["width"].iloc[0]), how)
        a, b = int(np.argmax(own)), int(len(own) - np.argmax(own[::-1]))
        # what lacks on a side lies beyond the series' end
        some = x[max(a - left, 0) : b + right]
        s = np.convolve(np.pad(some, (max(left - a, 0), max(right - (len(x) - b), 0)), mode="edge"), kernel, "valid")
        return pd.DataFrame({**{k: pdf[k][own] for k in [*key, "i", "n", "t", "raw"]}, "smooth": s})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*key, "i", "n", "t", "raw"])
    return _each_series(spread, [*key, "_c"], "i", one, f"{kinds}, smooth double")


def chunk_summary(x: np.ndarray, start: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What a chunk shows to others, and the peaks that it can tell itself; ``start`` is the place of its first sample.

    Shown are the runs of equal values that are higher than all before, or all after, within the chunk, and between two
    of those the least value of the runs there (``hidden``). To every sample of another chunk, and to every shown run, the
    next higher sample on a side is a shown one, and what is shown holds the least value on the way; it also has the same
    local maxima among the shown runs. A hidden run has one as high on both sides. Where none is higher on a side, its
    base there is that of the shown run of the same value: ``of_left``, ``of_right`` hold that run's first place.
    """
    first, last = runs_of(x)
    v = x[first]
    up, down = np.maximum.accumulate(v), np.maximum.accumulate(v[::-1])[::-1]
    rises, falls = np.append(True, v[1:] > up[:-1]), np.append(v[:-1] > down[1:], True)
    shown = rises | falls
    at = np.flatnonzero(shown)
    gap = np.flatnonzero(np.diff(at) > 1)
    lows = np.array([v[at[g] + 1 : at[g + 1]].min() for g in gap])
    items = pd.DataFrame({"first": np.append(first[at], first[at[gap] + 1]), "last": np.append(last[at], last[at[gap + 1] - 1]), "value": np.append(v[at], lows), "hidden": np.append(np.zeros(len(at), bool), np.ones(len(gap), bool))})

    k = np.flatnonzero(~shown)
    k = k[(v[k] > v[k - 1]) & (v[k] > v[k + 1])]  # a hidden run is neither the first nor the last
    left, right = bases(v), bases(v[::-1])[::-1]
    high, low_ = np.flatnonzero(rises), np.flatnonzero(falls)[::-1]  # of rising values
    place = lambda which, p: which[np.minimum(np.searchsorted(v[which], v[p]), len(which) - 1)]
    open_left, open_right = up[k] == v[k], down[k] == v[k]
    peaks = pd.DataFrame({"i": (first[k] + last[k]) // 2 + start, "value": v[k], "left": left[k], "right": right[k], "of_left": pd.array(np.where(open_left, first[place(high, k)] + start, -1), "Int64"), "of_right": pd.array(np.where(open_right, first[place(low_, k)] + start, -1), "Int64")})
    items["first"] += start
    items["last"] += start
    return items.sort_values("first"), peaks


def merged_summaries(items: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Bases of the shown runs of all chunks of a series (of: first place, left, right), and the peaks among them (i, prominence)."""
    value, first, last, hidden = (items[c].to_numpy() for c in ("value", "first", "last", "hidden"))
    # runs that go on in the next chunk are one
    fresh = np.append(True, (value[1:] != value[:-1]) | hidden[1:] | hidden[:-1])
    head, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    v, begin, stop, plain = value[head], first[head], last[np.append(head[1:], len(value)) - 1], ~hidden[head]
    left, right = bases(v), bases(v[::-1])[::-1]
    p = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & plain[1:-1]) + 1
    refs = pd.DataFrame({"of": first[~hidden], "left": left[of[~hidden]], "right": right[of[~hidden]]})
    return refs, pd.DataFrame({"i": (begin[p] + stop[p]) // 2, "prominence": v[p] - np.maximum(left[p], right[p])})


def long_prominences(rows: DataFrame, key: list[str], value: str, size: int) -> DataFrame:
    """key, i, prominence of all local maxima of series (key, i, value), by chunks of ``size`` samples.

    A chunk is summed up to the few runs that others can see (see ``chunk_summary``); a series' summaries meet in one
    task. Equal maxima take over the bases of the one that is shown, by a join.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in key}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        items, peaks = chunk_summary(pdf[value].to_numpy(float), int(pdf["i"].iloc[0]))
        made = pd.concat([items.assign(kind=0), peaks.assign(kind=1)], ignore_index=True)
        return made.assign(**{c: pdf[c].iloc[0] for c in key})[[*key, "kind", "first", "last", "value", "hidden", "i", "left", "right", "of_left", "of_right"]].astype({c: "Int64" for c in ("first", "last", "i")})

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", kind int, first long, last long, value double, hidden boolean, i long, left double, right double, of_left long, of_right long"
    chunks = rows.select(*key, "i", F.col(value).alias(value), F.floor(F.col("i") / size).alias("_c"))
    told = written(_each_series(chunks, [*key, "_c"], "i", one, schema), "summaries")

    def all_of(pdf: pd.DataFrame) -> pd.DataFrame:
        refs, peaks = merged_summaries(pdf)
        made = pd.concat([refs.rename(columns={"of": "i"}).assign(kind=0), peaks.assign(kind=1)], ignore_index=True)
        return made.assign(**{c: pdf[c].iloc[0] for c in key})[[*key, "kind", "i", "left", "right", "prominence"]]

    merged = _each_series(told.filter("kind = 0").select(*key, "first", "last", "value", "hidden"), key, "first", all_of, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", kind int, i long, left double, right double, prominence double")
    merged = written(merged, "bases")
    refs = merged.filter("kind = 0")
    hidden = told.filter("kind = 1").select(*key, "i", "value", "left", "right", "of_left", "of_right")
    hidden = hidden.join(refs.select(*key, F.col("i").alias("of_left"), F.col("left").alias("_l")), [*key, "of_left"], "left")
    hidden = hidden.join(refs.select(*key, F.col("i").alias("of_right"), F.col("right").alias("_r")), [*key, "of_right"], "left")
    base = F.greatest(F.least("left", "_l"), F.least("right", "_r"))  # least() leaves a null out
    return merged.filter("kind = 1").select(*key, "i", "prominence").union(hidden.select(*key, "i", (F.col("value") - base).alias("prominence")))


def keep_apart(df: DataFrame, key: list[str], t: str, strength: str, gap: float, most: int | None = None) -> DataFrame:
    """The rows of each series that greedy choice keeps (see ``spaced``); with ``most`` no more than so many of each.

    Rows are split into runs wherever neighbours lie ``gap`` apart; runs do not affect each other, so only a run must
    fit in a task. The ``most`` strongest of a series are among the ``most`` strongest of its runs.
    """
    along = Window.partitionBy(*key).orderBy(t, strength)
    fresh = F.coalesce((F.col(t) - F.lag(t).over(along) >= gap).cast("long"), F.lit(1))
    runs = df.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
    kept = _each_series(runs, [*key, "_run"], t, lambda pdf: pdf.iloc[spaced(pdf[t].to_numpy(), pdf[strength].to_numpy(), gap, most)], runs.schema).drop("_run")
    if most is None:
        return kept
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(strength), F.desc(t)))
    return kept.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def top_apart(df: DataFrame, key: list[str], t: str, score: str, n: int = 2, gap: float = 60.0) -> DataFrame:
    """The n rows of largest score of each key that lie at least ``gap`` apart, chosen greedily."""
    return keep_apart(df, key, t, score, gap, n)
