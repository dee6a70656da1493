"""Readers and writers of annotations, media catalogues, subtitles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.encode import cache_key
from tidemark.sources import listing

#: File endings of videos and subtitles, the better subtitle first.
VIDEO_ENDINGS = ["mp4", "mkv", "webm", "avi", "mov", "m4v"]
SUBTITLE_ENDINGS = ["srt", "vtt"]


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUESTIONS).parquet(path)


def read_selection(spark: SparkSession, path: str, root: str | None = None, need: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header; all columns are strings. Missing columns are an error; relative paths get ``root``."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if lack := [c for c in need if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {lack}")
    for c in ("video_path", "subtitle_path"):
        if root is not None and c in df.columns:
            df = df.withColumn(c, F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(c))))
    return df


def catalogue_media(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """video_id, video_path, subtitle_path of every video under ``root`` that has a subtitle of its name beside it.

    Endings are taken in any case, .srt before .vtt. Equal names get _2, _3, ... in order of path. Files of zero bytes
    count as any other. ``pair_media`` takes another listing, such as ``listing.spark_listing``.
    """
    return pair_media(listing.list_files(spark, root), most)


def pair_media(files: DataFrame, most: int | None = None) -> DataFrame:
    """The same of a listing: rows with the path of each file."""
    files = files.select("path", F.regexp_extract("path", r"^(.*)\.[^./]+$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ending"))
    videos = files.filter(F.col("ending").isin(VIDEO_ENDINGS)).select("stem", F.col("path").alias("video_path"))
    rank = F.array_position(F.array(*map(F.lit, SUBTITLE_ENDINGS)), F.col("ending"))
    subtitles = files.filter(F.col("ending").isin(SUBTITLE_ENDINGS)).groupBy("stem").agg(F.min_by("path", rank).alias("subtitle_path"))
    rows = videos.join(subtitles, "stem").withColumn("raw_id", F.regexp_extract("stem", r"([^/]+)$", 1))
    rows = unique_ids(rows, "raw_id", "video_path").select("video_id", "video_path", "subtitle_path").orderBy("video_path")
    return rows.limit(most) if most is not None else rows


def unique_ids(df: DataFrame, raw: str, *order: str) -> DataFrame:
    """``df`` with video_id: the raw id, and _2, _3, ... from its second occurrence on."""
    n = F.row_number().over(Window.partitionBy(raw).orderBy(*order))
    return df.withColumn("video_id", F.when(n > 1, F.concat(F.col(raw), F.lit("_"), n.cast("string"))).otherwise(F.col(raw)))


def _clock(s: Column) -> Column:
    """Seconds of hh:mm:ss,mmm, mm:ss.mmm and the like."""
    p = F.transform(F.split(F.regexp_replace(s, ",", "."), ":"), lambda x: x.try_cast("double"))
    return F.aggregate(p, F.lit(0.0), lambda t, x: t * 60 + x)


def parse_subtitles(files: DataFrame) -> DataFrame:
    """Cues (schemas.CUES) of rows (video_id, content) of SRT or VTT text.

    Blocks lie between blank lines; tags and braces' contents go, white space becomes one space; cues without text or
    that do not end after they start are left out. cue_idx counts in order of start, then of place in the file.
    """
    clean = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^﻿", "")
    blocks = files.select("video_id", F.posexplode(F.split(clean, r"\n[ \t]*\n+")).alias("at", "block"))
    pattern = r"(?s)(?:^|\n)[ \t]*((?:\d+:)?\d+:\d+[.,]\d+)[ \t]*-->[ \t]*((?:\d+:)?\d+:\d+[.,]\d+)[^\n]*\n(.*)$"
    part = lambda i: F.regexp_extract("block", pattern, i)
    text = F.trim(F.regexp_replace(F.regexp_replace(part(3), r"<[^>]*>|\{[^}]*\}", ""), r"\s+", " "))
    rows = blocks.filter(F.col("block").rlike(pattern)).select("video_id", "at", _clock(part(1)).alias("start"), _clock(part(2)).alias("end"), text.alias("text"))
    rows = rows.filter("text <> '' AND end > start")
    idx = F.row_number().over(Window.partitionBy("video_id").orderBy("start", "at")) - 1
    return rows.select("video_id", idx.cast("long").alias("cue_idx"), "start", "end", "text")


def read_subtitles(manifest: DataFrame, partitions: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Cues of the files that ``manifest`` (video_id, subtitle_path) names, one row of text per file.

    Tasks open the named files and no others; a missing file has no cue. ``texts`` (path, content) takes the place of
    that for stores that only Spark opens, see ``read_texts``.
    """
    if texts is None:
        named = manifest.select("video_id", "subtitle_path")
        named = named.repartition(partitions, "video_id") if partitions else named
        rows = listing.contents(named, "subtitle_path").select("video_id", F.decode("content", "UTF-8").alias("content"))
        return parse_subtitles(rows.filter("content IS NOT NULL"))
    key = lambda c: F.regexp_replace(c, "^file:/*", "/")
    rows = manifest.join(texts, key(F.col("subtitle_path")) == key(F.col("path"))).select("video_id", "content")
    return parse_subtitles(rows.repartition(partitions, "video_id") if partitions else rows)


def media_keys(media: DataFrame, files: DataFrame, column: str, **settings) -> DataFrame:
    """``media`` with ``cache_key`` of the file in ``column``: of its path, size, time and the settings.

    ``files`` is a listing (path, size, modified_ns). A file changed or moved, or another setting, gives another key; a file
    that is not listed has none.
    """
    told = [F.lit(v).alias(k) for k, v in sorted(settings.items())]
    keys = files.select(F.col("path").alias(column), cache_key(F.col("modified_ns").alias("mtime"), F.col("path"), F.col("size"), *told).alias("cache_key"))
    return media.join(keys, column, "left")


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """path and content of every subtitle file under ``root``; executors list and read, the driver sees no path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{srt,SRT,Srt,vtt,VTT,Vtt}")
    return files.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def manifest(selection: DataFrame, catalogue: DataFrame, require_all: bool = True) -> DataFrame:
    """The media pair of every selected asset (schemas.MANIFEST); missing ones are an error that names eight, or left out."""
    media = catalogue.select(F.col("video_id").alias("asset_id"), "video_path", "subtitle_path")
    wanted = selection.withColumn("asset_id", F.col("videoID"))
    if require_all:
        lack = [r.asset_id for r in wanted.join(media, "asset_id", "left_anti").orderBy("asset_id").limit(8).collect()]
        if lack:
            raise ValueError(f"no media for {lack}")
    return wanted.join(media, "asset_id").select("video_id", "video_path", "subtitle_path", "asset_id", "domain", "sub_category")


def write_vectors(df: DataFrame, path: str) -> None:
    """Vector tables as Parquet, in order of video and time within each part."""
    df.sortWithinPartitions("video_id", "t").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, schema: str = schemas.FRAME_EMB) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_report(df: DataFrame, path: str, by: str | None = None) -> None:
    """A CSV report with a header, one folder per value of ``by``; infinity is written as inf."""
    for c, kind in df.dtypes:
        if kind == "double":
            df = df.withColumn(c, F.when(F.col(c) == float("inf"), "inf").otherwise(F.col(c).cast("string")))
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("positiveInf", "inf").schema(schema).csv(path)


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    """One JSON row."""
    spark.range(1).select(*[F.lit(str(v) if isinstance(v, tuple) else v).alias(k) for k, v in sorted(config.items()) if v is not None]).write.mode("overwrite").json(path)
