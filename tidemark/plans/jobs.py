"""Whole jobs over tables of frames, cues and questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import BoundaryConfig
from tidemark.operators import encode, events, evidence, intervals, signals, stats
from tidemark.sources import files
from tidemark.sources.shared import shared_folder


def boundary_job(frames: DataFrame, texts: DataFrame, cues: DataFrame, durations: DataFrame, config: BoundaryConfig) -> dict[str, DataFrame]:
    """Signal, events, stats and alignment tables.

    ``frames`` and ``texts`` have video_id, t and emb; ``cues`` as in schemas.CUES; ``durations`` video_id, duration.
    Vectors are shuffled once, by video and modality, for the change scores; all after that are scalars.
    """
    both = frames.select("video_id", F.lit("visual").alias("modality"), "t", "emb").unionByName(texts.select("video_id", F.lit("text").alias("modality"), "t", "emb"))
    signal = signals.signals(signals.change_scores(both, ["video_id", "modality"]), ["video_id", "modality"], config)
    table = events.event_table(signal, cues, config.event_tolerance, config.context_seconds)
    stats_table = events.grouped(events.video_stats(signal, cues, durations))
    return {
        "signal": signal,
        "events": table,
        "video_statistics": stats_table,
        "per_video_alignment": events.alignment(table, config.tolerances),
        "aggregate_alignment": events.alignment(table, config.tolerances, by_video=False),
        "group_alignment": events.group_alignment(table, stats_table, config.event_tolerance),
    }


def write_boundary(tables: dict[str, DataFrame], config: BoundaryConfig, path: str) -> None:
    """Reports as CSV, events by video, and the settings."""
    for name, df in tables.items():
        if name not in ("signal", "fresh"):
            files.write_report(df, f"{path}/{name}", "video_id" if name == "events" else None)
    files.write_config(tables["events"].sparkSession, asdict(config), f"{path}/run_config")


def text_windows(cues: DataFrame, durations: DataFrame, config: BoundaryConfig) -> DataFrame:
    """The texts to encode, by window."""
    return intervals.cue_windows(cues, config.subtitle_window, durations)


def video_errors(videos: DataFrame, probes: DataFrame, cues: DataFrame, frames: DataFrame) -> DataFrame:
    """video_id and error of the videos that a job must leave out; a video with several faults tells the first.

    ``videos`` has video_id, ``probes`` video_id, n_frames, fps. Of the cues and frames only the ids are read.
    """
    has = lambda df, c: df.select("video_id").distinct().withColumn(c, F.lit(True))
    probed = probes.groupBy("video_id").agg(F.first("n_frames").alias("n_frames"), F.first("fps").alias("fps"))
    rows = videos.select("video_id").distinct().join(probed, "video_id", "left").join(has(frames, "framed"), "video_id", "left").join(has(cues, "cued"), "video_id", "left")
    # coalesce keeps a null rate or count from counting as a sound one
    sound = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    error = F.when(~sound("fps"), "no frame rate").when(~sound("n_frames"), "no frames in the file").when(F.col("framed").isNull(), "no frame vectors").when(F.col("cued").isNull(), "no cues")
    return rows.select("video_id", error.alias("error")).filter("error IS NOT NULL")


def window_vectors(windows: DataFrame, cache: DataFrame, make: Callable, model: str) -> tuple[DataFrame, DataFrame]:
    """``windows`` (video_id, t, text) with emb, and the rows (key, emb) that the cache lacked.

    Every text is encoded once, whatever number of windows hold it, and only if no vector of this model is cached.
    """
    spark = windows.sparkSession
    keyed = windows.withColumn("key", encode.cache_key(F.col("text"), F.lit(model).alias("model")))
    fresh = encode.missing(keyed.groupBy("key").agg(F.first("text").alias("text")), cache, "key")
    # written, so that neither a second reader nor a lost executor encodes again
    path = shared_folder(spark, "window-vectors")
    encode.encode(fresh, "text", make).select("key", "emb").write.parquet(path)
    made = spark.read.parquet(path)
    known = cache.select("key", "emb").dropDuplicates(["key"]).unionByName(made)
    return keyed.join(known, "key").select("video_id", "t", "text", "emb"), made


def files_job(spark: SparkSession, root: str, probes: DataFrame, frames: DataFrame, cache: DataFrame, make: Callable, model: str, config: BoundaryConfig) -> dict[str, DataFrame]:
    """The boundary job from a folder of videos and subtitles on: the tables of boundary_job, and those of media_job."""
    path = shared_folder(spark, "media")
    files.catalogue_media(spark, root, config.max_videos).write.parquet(path)
    media = spark.read.parquet(path)
    if media.isEmpty():
        raise ValueError(f"no video with a subtitle under {root}")
    return media_job(media, files.read_subtitles(media), probes, frames, cache, make, model, config)


def media_job(media: DataFrame, cues: DataFrame, probes: DataFrame, frames: DataFrame, cache: DataFrame, make: Callable, model: str, config: BoundaryConfig) -> dict[str, DataFrame]:
    """The boundary job over catalogued videos, whose window texts are encoded where ``cache`` (key, emb) lacks them.

    A video that cannot be used is a row of ``errors`` (see video_errors) and of no other table; the others go on.
    ``fresh`` holds the vectors to add to the cache. Without any video there is an error, without a usable one empty tables.
    """
    spark = media.sparkSession
    if media.isEmpty():
        raise ValueError("no videos")
    path = shared_folder(spark, "cues")
    cues.write.parquet(path)
    cues = spark.read.parquet(path)
    errors = video_errors(media, probes, cues, frames)
    good = media.select("video_id").join(errors, "video_id", "left_anti").distinct()
    durations = intervals.duration_of(probes.dropDuplicates(["video_id"]).join(good, "video_id", "left_semi")).select("video_id", "duration")
    cues, frames = cues.join(good, "video_id", "left_semi"), frames.join(good, "video_id", "left_semi")
    texts, fresh = window_vectors(text_windows(cues, durations, config), cache, make, model)
    return boundary_job(frames, texts, cues, durations, config) | {"errors": errors, "fresh": fresh}


def null_job(questions: DataFrame, frames: DataFrame, group: str, top: int = 16, variants: tuple[str, ...] = ("options",)) -> dict[str, DataFrame]:
    """The video-swap null per question and variant of its option vectors, and its summary by ``group`` (a column of ``questions``)."""
    z = evidence.variant_nulls(questions, frames, list(variants), top).join(questions.select("question_id", group), "question_id")
    return {"signal_z": z, "summary": stats.signal_summary(z, group, [f"z_{v}" for v in variants])}


def selector_job(questions: DataFrame, frames: DataFrame, ks: tuple[int, ...] = (4, 8, 16, 32), k: int = 16, task: str | None = None) -> dict[str, DataFrame]:
    """Selections of the four frame selectors, their evaluation by question, and the tables of the report.

    ``summary`` has the five metrics by k and selector, ``intervals`` the bootstrap intervals at ``k`` by selector (and,
    with a column ``task`` of the questions, ``task_intervals`` by task), ``constants`` what does not hang on the selector.
    """
    picked = evidence.pick_frames(questions, frames, ks)
    path = shared_folder(questions.sparkSession, "selector-eval")
    evidence.evaluate(questions, evidence.whole_votes(questions, frames), picked).write.parquet(path)
    rows = questions.sparkSession.read.parquet(path)
    at_k = rows.filter(F.col("k") == k)
    tables = {
        "picked": picked,
        "selector_eval": rows,
        "overlap": evidence.jaccard(picked.filter(F.col("k") == k), "Relevance", "Variance", ["question_id"]).join(evidence.rank_correlation(questions, frames), "question_id"),
        "summary": stats.wide_means(rows, "k", "selector", evidence.SELECTORS, evidence.METRICS),
        "intervals": stats.intervals(at_k, ["selector"], evidence.METRICS[:3], "question_id"),
        "constants": at_k.filter(F.col("selector") == evidence.SELECTORS[0]).agg(F.avg("whole_video_acc").alias("whole_video_acc"), F.avg("odd_is_answer").alias("odd_is_answer")),
    }
    if task is not None:
        tables["task_intervals"] = stats.intervals(at_k.join(questions.select("question_id", task), "question_id"), [task, "selector"], evidence.METRICS[:1], "question_id")
    return tables
