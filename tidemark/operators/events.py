"""Events (peaks of either modality), their alignment, and tables over videos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import context_text, coverage
from tidemark.operators.matching import closest
from tidemark.operators.signals import quantile

MODALITIES = ("visual", "text")


def event_table(signal: DataFrame, cues: DataFrame | None = None, tolerance: float = 10.0, reach: float = 10.0) -> DataFrame:
    """One row per peak of ``signal`` (video_id, modality, t, norm, is_peak): the columns of schemas.EVENTS.

    The other modality's score is that of the matched peak if it lies within the tolerance, else of its closest sample.
    Closest peaks and samples of both modalities come from one pass over the samples.
    """
    kinds = {f"{kind}_{m}": (F.col("modality") == m) & is_ for m in MODALITIES for kind, is_ in (("peak", F.col("is_peak")), ("sample", F.lit(True)))}
    rows = closest(signal.select("video_id", "modality", "t", "norm", "is_peak"), kinds, ["norm"]).filter("is_peak")
    visual = F.col("modality") == "visual"
    other = lambda kind, c: F.when(visual, F.col(f"{kind}_text.{c}")).otherwise(F.col(f"{kind}_visual.{c}"))
    rows = rows.withColumns({"gap": F.coalesce(F.abs(F.col("t") - other("peak", "t")), F.lit(float("inf"))), "peak_norm": other("peak", "norm"), "sample_norm": other("sample", "norm")})
    aligned = F.col("gap") <= tolerance
    across = F.when(aligned, F.col("peak_norm")).otherwise(F.col("sample_norm"))
    rows = rows.select("video_id", "modality", "t", F.when(visual, F.col("norm")).otherwise(across).alias("visual_score"), F.when(visual, across).otherwise(F.col("norm")).alias("text_score"), F.col("gap").alias("nearest_other_peak_seconds"), F.when(aligned, "aligned").otherwise(F.concat("modality", F.lit("-only"))).alias("event_type"))
    # texts come last, so that they do not travel through the joins
    rows = context_text(rows, cues, reach) if cues is not None else rows.withColumn("subtitle_text", F.lit(""))
    return rows.withColumnRenamed("t", "timestamp_seconds").select("video_id", "modality", "timestamp_seconds", "visual_score", "text_score", "nearest_other_peak_seconds", "event_type", "subtitle_text")


def alignment(events: DataFrame, tolerances: tuple[float, ...], by_video: bool = True) -> DataFrame:
    """Shares of visual and of text events within each tolerance, per video or pooled; null without events.

    A distance of infinity (no other peak) counts as not aligned.
    """
    rows = events.withColumn("tolerance_seconds", F.explode(F.array(*[F.lit(float(x)) for x in tolerances])))
    near = F.col("nearest_other_peak_seconds") <= F.col("tolerance_seconds")
    share = lambda m: F.avg(F.when(F.col("modality") == m, near.cast("double")))
    count = lambda m, what: F.count_if((F.col("modality") == m) & what)
    keys = ["video_id", "tolerance_seconds"] if by_video else ["tolerance_seconds"]
    out = rows.groupBy(*keys).agg(share("visual").alias("visual_alignment_fraction"), share("text").alias("text_alignment_fraction"), count("visual", ~near).alias("visual_only"), count("text", ~near).alias("text_only"), count("visual", near).alias("aligned_pairs"))
    return out if by_video else out.select("tolerance_seconds", "visual_alignment_fraction", "text_alignment_fraction")


def event_counts(events: DataFrame) -> DataFrame:
    """Per video: visual-only, text-only and shared (aligned visual) events."""
    return events.groupBy("video_id").agg(F.count_if(F.col("event_type") == "visual-only").alias("visual_only"), F.count_if(F.col("event_type") == "text-only").alias("text_only"), F.count_if((F.col("event_type") == "aligned") & (F.col("modality") == "visual")).alias("shared"))


def video_stats(signal: DataFrame, cues: DataFrame, durations: DataFrame) -> DataFrame:
    """Per video: duration, subtitle coverage, mean raw visual change, peaks of either modality."""
    of = lambda m, x: F.when(F.col("modality") == m, x)
    sums = signal.groupBy("video_id").agg(F.avg(of("visual", F.col("raw"))).alias("average_visual_change"), F.count_if((F.col("modality") == "visual") & F.col("is_peak")).alias("visual_peaks"), F.count_if((F.col("modality") == "text") & F.col("is_peak")).alias("text_peaks"))
    rows = durations.join(coverage(cues, durations), "video_id").join(sums, "video_id", "left")
    return rows.select("video_id", F.col("duration").alias("duration_seconds"), F.col("coverage").alias("subtitle_coverage"), "average_visual_change", F.coalesce("visual_peaks", F.lit(0)).alias("visual_peaks"), F.coalesce("text_peaks", F.lit(0)).alias("text_peaks"))


def grouped(stats: DataFrame, accuracy: int | None = None) -> DataFrame:
    """``stats`` with ``group``: whether coverage and visual change reach their medians over all videos.

    The medians are exact, or, for very many videos, from a sketch of the given accuracy (see ``signals.quantile``).
    """
    medians = stats.agg(quantile("subtitle_coverage", 0.5, accuracy).alias("_c"), quantile("average_visual_change", 0.5, accuracy).alias("_v"))
    level = lambda x, m: F.when(F.col(x) >= F.col(m), "high").otherwise("low")
    return stats.crossJoin(F.broadcast(medians)).withColumn("group", F.concat(level("subtitle_coverage", "_c"), F.lit(" speech / "), level("average_visual_change", "_v"), F.lit(" visual change"))).drop("_c", "_v")


def group_alignment(events: DataFrame, stats: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Per group of videos, over visual events: videos, mean finite distance, share within the tolerance."""
    d = F.col("nearest_other_peak_seconds")
    rows = events.filter("modality = 'visual'").join(stats.select("video_id", "group"), "video_id")
    return rows.groupBy("group").agg(F.countDistinct("video_id").alias("videos"), F.avg(F.when(d < float("inf"), d)).alias("mean_nearest_distance"), F.avg((d <= tolerance).cast("double")).alias("aligned"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """bin, low, n of equal bins over the finite values; the largest value is in the last bin."""
    rows = df.filter(F.col(value) < float("inf"))
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return rows.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.first(F.col("lo") + at * width).alias("low"), F.count("*").alias("n"))


def matched_strengths(events: DataFrame) -> DataFrame:
    """Scores of aligned visual events that have a text score."""
    return events.filter("modality = 'visual' AND event_type = 'aligned' AND text_score IS NOT NULL").select("video_id", "timestamp_seconds", "visual_score", "text_score")


def similarity_series(signal: DataFrame) -> DataFrame:
    """video_id, modality, t, similarity = 1 - raw, is_peak: the rows behind a stacked plot."""
    return signal.select("video_id", "modality", "t", (1 - F.col("raw")).alias("similarity"), "is_peak")
