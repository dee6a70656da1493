"""Cues (texts with a start and an end) against windows, points and each other; time grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.matching import SPAN


def in_order(text: str, *order: str):
    """Texts of a group joined by spaces in the given order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), " ")


def cue_windows(cues: DataFrame, width: float, durations: DataFrame | None = None) -> DataFrame:
    """video_id, i, t and text of the tumbling windows that hold a cue.

    Window i is [i * width, (i + 1) * width), cut at the video's duration (by default the last end of a cue); a cue is
    in every window it overlaps; t is the middle of the cut window. Each cue goes to the few windows around it, which
    are then checked, so no cue meets every window.
    """
    if durations is None:
        durations = cues.groupBy("video_id").agg(F.max("end").alias("duration"))
    rows = cues.join(durations.select("video_id", "duration"), "video_id")
    last = F.ceil(F.col("duration") / width) - 1
    low, high = F.greatest(F.floor(F.col("start") / width) - 1, F.lit(0)), F.least(F.ceil(F.col("end") / width), last)
    rows = rows.filter(high >= low).withColumn("i", F.explode(F.sequence(low, high)))
    begin, end = F.col("i") * width, F.least((F.col("i") + 1) * width, F.col("duration"))
    rows = rows.filter((F.col("start") < end) & (F.col("end") > begin) & (begin < F.col("duration")))
    return rows.groupBy("video_id", "i").agg(F.first((begin + end) / 2).alias("t"), in_order("text", "start", "cue_idx").alias("text"))


def context_text(points: DataFrame, cues: DataFrame, reach: float) -> DataFrame:
    """``points`` (video_id, t) with ``subtitle_text``: cues that touch [t - reach, t + reach], in order, '' if none.

    Buckets come in widths that double from 2 * reach on. A cue lies in those of the first width that it fits in, two of
    them at most; a point asks every width that its video has, two buckets of each. So a cue of a whole day costs as much as
    one of a second, and the rows before the join are bounded by the cues, and by the points times the widths.
    """
    least = max(2 * reach, 1e-3)
    begin, stop = F.least("start", "end"), F.greatest("start", "end")
    level = F.greatest(F.ceil(F.log2((stop - begin) / least)), F.lit(0)).cast("int")  # null for a length of 0
    width = least * F.pow(F.lit(2.0), F.col("level"))
    placed = cues.select("video_id", "cue_idx", "start", "end", "text", F.coalesce(level, F.lit(0)).alias("level"))
    placed = placed.withColumn("cue_first", F.floor(begin / width))
    spread = placed.withColumn("bucket", F.explode(F.sequence("cue_first", F.floor(stop / width))))
    asked = points.select("video_id", "t").distinct().join(placed.select("video_id", "level").distinct(), "video_id")
    asked = asked.withColumn("point_first", F.floor((F.col("t") - reach) / width))
    asked = asked.withColumn("bucket", F.explode(F.sequence("point_first", F.floor((F.col("t") + reach) / width))))
    met = asked.join(spread, ["video_id", "level", "bucket"]).filter((F.col("start") <= F.col("t") + reach) & (F.col("end") >= F.col("t") - reach))
    met = met.filter(F.col("bucket") == F.greatest("cue_first", "point_first"))  # the first bucket that both are in
    texts = met.groupBy("video_id", "t").agg(in_order("text", "start", "cue_idx").alias("subtitle_text"))
    return points.join(texts, ["video_id", "t"], "left").withColumn("subtitle_text", F.coalesce("subtitle_text", F.lit("")))


def coverage(cues: DataFrame, durations: DataFrame, span: float = SPAN) -> DataFrame:
    """video_id and the share of its duration under any cue, at most 1, 0 without cues.

    In order of start, a cue adds what of it lies beyond the furthest end before it. Cues are put in order by stretches of
    ``span`` seconds; the furthest end of all earlier stretches comes in as one row, so a long video is spread over tasks.
    """
    rows = cues.join(durations, "video_id").select("video_id", F.greatest("start", F.lit(0.0)).alias("s"), F.least("end", "duration").alias("e")).filter("e > s")
    rows = rows.withColumn("stretch", F.floor(F.col("s") / span))
    before, onward = (Window.unboundedPreceding, -1), Window.partitionBy("video_id").orderBy("stretch")
    ends = rows.groupBy("video_id", "stretch").agg(F.max("e").alias("e"))
    ends = ends.select("video_id", "stretch", F.lit(0).alias("cue"), F.lit(None).cast("double").alias("s"), F.max("e").over(onward.rowsBetween(*before)).alias("e"))
    both = rows.withColumn("cue", F.lit(1)).unionByName(ends)
    order = Window.partitionBy("video_id", "stretch").orderBy("cue", "s", "e")
    reached = F.max("e").over(order.rowsBetween(*before))
    both = both.withColumn("adds", F.greatest(F.col("e") - F.greatest("s", reached), F.lit(0.0)))
    total = both.filter("cue = 1").groupBy("video_id").agg(F.sum("adds").alias("covered"))
    share = F.when(F.col("duration") > 0, F.least(F.coalesce("covered", F.lit(0.0)) / F.col("duration"), F.lit(1.0))).otherwise(0.0)
    return durations.join(total, "video_id", "left").select("video_id", share.alias("coverage"))


def moving_mean(df: DataFrame, value: str, key: str, order: str, size: int = 15, out: str = "mean") -> DataFrame:
    """Centred mean over ``size`` rows, fewer at the ends."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(size // 2), size // 2)
    return df.withColumn(out, F.avg(value).over(w))


def time_grid(videos: DataFrame, step: float) -> DataFrame:
    """video_id, i, t: 0, step, 2 step ... below the duration."""
    n = F.ceil(F.col("duration") / step)
    return videos.filter(F.col("duration") > 0).select("video_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).withColumn("t", F.col("i") * F.lit(step))


def index_grid(videos: DataFrame, rate: float = 1.0) -> DataFrame:
    """video_id, frame_no, t: the frames of n_frames at fps that come nearest below every 1/rate seconds."""
    step = F.col("fps") / rate
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_frames") / step) - 1)).alias("k")
    rows = videos.filter("n_frames > 0 AND fps > 0").select("video_id", "fps", "n_frames", k)
    rows = rows.withColumn("frame_no", F.floor(F.col("k") * F.col("fps") / rate)).filter("frame_no < n_frames")
    return rows.select("video_id", "frame_no", (F.col("frame_no") / F.col("fps")).alias("t"))


def duration_of(videos: DataFrame) -> DataFrame:
    """``videos`` with duration = n_frames / fps; a rate that is not above 0 raises an error."""
    bad = F.raise_error(F.concat(F.lit("no frame rate: "), F.col("video_id").cast("string"))).cast("double")
    return videos.withColumn("duration", F.when(F.col("fps") > 0, F.col("n_frames") / F.col("fps")).otherwise(bad))


def batches(frames: DataFrame, size: int) -> DataFrame:
    """``frames`` with the number of the batch of ``size`` consecutive frames that each is in."""
    return frames.withColumn("batch", F.floor(F.col("frame_idx") / size))
