"""The boundary job from files on: errors by video, the cache, and the same result however rows are dealt."""

import pytest

from tidemark.config import BoundaryConfig
from tidemark.operators import encode
from tidemark.plans import jobs

CONFIG = BoundaryConfig(smoothing="none", peak_prominence=0.1, peak_min_spacing=0.0)
LINES = ["apples and pears", "a boat at sea", "apples and pears", "the court is open", "night falls"]


def subtitle(lines):
    return "\n".join(f"{i}\n00:00:{15 * i + 1:02d},000 --> 00:00:{15 * i + 4:02d},000\n{x}\n" for i, x in enumerate(lines) if 15 * i < 60)


@pytest.fixture
def folder(tmp_path):
    for name in ("good", "unrated", "unframed", "unprobed", "silent"):
        (tmp_path / f"{name}.mp4").write_bytes(b"x")
        (tmp_path / f"{name}.srt").write_text("\n" if name == "silent" else subtitle(LINES))
    (tmp_path / "alone.mp4").write_bytes(b"x")
    (tmp_path / "hollow.mp4").write_bytes(b"x")
    (tmp_path / "hollow.srt").write_bytes(b"")
    return f"file://{tmp_path}"


def tables(spark, turn=1):
    emb = [[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]]
    rows = [(v, i, 12.0 * i, e) for v in ("good", "unrated", "unprobed", "silent", "hollow") for i, e in enumerate(emb)]
    frames = spark.createDataFrame(rows[::turn], "video_id string, frame_idx long, t double, emb array<float>")
    probes = [("good", 1440, 24.0), ("unrated", 1440, None), ("unframed", 1440, 24.0), ("silent", 1440, 24.0), ("hollow", 1440, 24.0), ("elsewhere", 1, 0.0)]
    return spark.createDataFrame(probes[::turn], "video_id string, n_frames long, fps double"), frames


def no_cache(spark):
    return spark.createDataFrame([], "key string, emb array<float>")


def run(spark, folder, cache, make=encode.HashingEncoder, turn=1):
    probes, frames = tables(spark, turn)
    return jobs.files_job(spark, folder, probes, frames, cache, make, "hashing-32", CONFIG)


def test_a_bad_video_is_a_row_and_not_a_failure(spark, folder):
    got = run(spark, folder, no_cache(spark))
    assert {(r.video_id, r.error) for r in got["errors"].collect()} == {("unrated", "no frame rate"), ("unprobed", "no frame rate"), ("unframed", "no frame vectors"), ("silent", "no cues"), ("hollow", "no cues")}
    stats = got["video_statistics"].collect()
    assert [(r.video_id, r.duration_seconds) for r in stats] == [("good", 60.0)]
    assert stats[0].subtitle_coverage == pytest.approx(4 * 3 / 60)
    assert {r.video_id for r in got["signal"].collect()} == {"good"}


def refusing():
    """An encoder that fails if it is given a text; made here, since workers cannot import a test's module."""

    def make():
        def model(texts):
            raise AssertionError("a cached text was encoded")

        return model

    return make


def test_equal_texts_are_encoded_once_and_cached_ones_never(spark, folder):
    first = run(spark, folder, no_cache(spark))
    assert first["fresh"].count() == len(set(LINES[:4]))
    again = run(spark, folder, first["fresh"], refusing())
    assert again["fresh"].count() == 0
    order = lambda df: sorted(map(tuple, df.select("video_id", "modality", "t", "raw").collect()))
    assert order(again["signal"]) == order(first["signal"])


def test_a_cache_with_repeated_keys_doubles_no_window(spark, folder):
    first = run(spark, folder, no_cache(spark))
    cache = first["fresh"].unionByName(first["fresh"])
    assert run(spark, folder, cache)["signal"].count() == first["signal"].count()


def test_order_and_number_of_partitions_change_nothing(spark, folder):
    def told():
        got = run(spark, folder, no_cache(spark), turn=told.turn)
        return {k: sorted(str(tuple(r)) for r in got[k].collect()) for k in ("errors", "events", "video_statistics", "per_video_alignment", "aggregate_alignment", "group_alignment")}

    told.turn = 1
    one = told()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        told.turn = -1
        assert told() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_videos_is_an_error(spark, tmp_path):
    (tmp_path / "alone.mp4").write_bytes(b"x")
    with pytest.raises(ValueError, match="no video with a subtitle"):
        run(spark, f"file://{tmp_path}", no_cache(spark))
