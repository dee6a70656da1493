import os

import numpy as np
import pytest

from tidemark.config import BoundaryConfig
from tidemark.plans import jobs
from tidemark.sources import archives, files, listing

SRT = "1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hello</i>\r\n  there\r\n\r\n2\r\n00:00:00,000 --> 00:00:01,000\r\nfirst\r\n\r\n3\r\n00:00:05,000 --> 00:00:05,000\r\nno time\r\n\r\n4\r\n00:00:06,000 --> 00:00:07,000\r\n\r\n"
VTT = "WEBVTT\n\n00:01.500 --> 00:03.000 align:start\none {\\an8}two\n\nNOTE x\n\n01:00:00.000 --> 01:00:01.250\nlate\n"


@pytest.fixture
def media(tmp_path):
    for name, text in {"a/one.mp4": "x", "a/one.srt": SRT, "a/one.vtt": VTT, "b/one.MKV": "x", "b/one.VTT": VTT, "b/two.mov": "x", "c.srt": SRT}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(text.encode())
    return f"file://{tmp_path}"


def test_catalogue_and_subtitles(spark, media):
    rows = files.catalogue_media(spark, media).collect()
    assert [(r.video_id, r.subtitle_path.rsplit("/", 2)[-2:]) for r in rows] == [("one", ["a", "one.srt"]), ("one_2", ["b", "one.VTT"])]
    assert files.catalogue_media(spark, media, 1).count() == 1
    cues = files.read_subtitles(files.catalogue_media(spark, media)).orderBy("video_id", "cue_idx").collect()
    assert [(r.video_id, r.cue_idx, r.start, r.end, r.text) for r in cues] == [("one", 0, 0.0, 1.0, "first"), ("one", 1, 1.0, 2.5, "Hello there"), ("one_2", 0, 1.5, 3.0, "one two"), ("one_2", 1, 3600.0, 3601.25, "late")]


def test_selection_and_manifest(spark, media, tmp_path):
    (tmp_path / "sel.csv").write_text("video_id,videoID,duration,domain,sub_category,url\n007,one,long,d,s,u\n008,gone,long,d,s,u\n")
    sel = files.read_selection(spark, f"file://{tmp_path}/sel.csv", need=("videoID",))
    got = files.manifest(sel, files.catalogue_media(spark, media), require_all=False).collect()
    assert [(r.video_id, r.asset_id) for r in got] == [("007", "one")]
    with pytest.raises(ValueError, match="gone"):
        files.manifest(sel, files.catalogue_media(spark, media))
    with pytest.raises(ValueError, match="nothing"):
        files.read_selection(spark, f"file://{tmp_path}/sel.csv", need=("nothing",))


def test_boundary_job_end_to_end(spark, tmp_path):
    emb = [[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]]
    frames = spark.createDataFrame([("v", 2.0 * i, e) for i, e in enumerate(emb)], "video_id string, t double, emb array<float>")
    texts = spark.createDataFrame([("v", 7.5 * i, e) for i, e in enumerate(emb)], "video_id string, t double, emb array<float>")
    cues = spark.createDataFrame([("v", 0, 0.0, 8.0, "words")], "video_id string, cue_idx long, start double, end double, text string")
    d = spark.createDataFrame([("v", 10.0)], "video_id string, duration double")
    config = BoundaryConfig(smoothing="none", peak_prominence=0.1, peak_min_spacing=0.0)
    tables = jobs.boundary_job(frames, texts, cues, d, config)
    s = tables["video_statistics"].collect()
    assert len(s) == 1 and s[0].subtitle_coverage == 0.8 and s[0].visual_peaks == 1 and s[0].average_visual_change == 1.0
    jobs.write_boundary(tables, config, f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == ["aggregate_alignment", "events", "group_alignment", "per_video_alignment", "run_config", "video_statistics"]
    back = files.read_report(spark, f"file://{tmp_path}/out/video_statistics", "video_id string, duration_seconds double").first()
    assert back.duration_seconds == 10.0
    assert jobs.text_windows(cues, d, config).first().text == "words"


@pytest.mark.parametrize("folders", [1, 3, 256])
def test_listing_has_size_and_time_and_empty_files(spark, tmp_path, folders):
    want = {}
    for k, name in enumerate(("a.srt", "x/b.srt", "x/y/c.MP4", "x/y/z/d.vtt", "w/e", "w/v/f.mkv")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"." * k)
        want[f"file://{p}"] = (k, os.stat(p).st_mtime_ns)
    (tmp_path / "empty").mkdir()
    rows = listing.list_files(spark, f"file://{tmp_path}", folders)
    assert {r.path: (r.size, r.modified_ns) for r in rows.collect()} == want
    assert rows.count() == len(want)
    assert {r.path for r in listing.list_files(spark, str(tmp_path), folders).collect()} == {p.removeprefix("file://") for p in want}
    assert {r.size for r in listing.spark_listing(spark, f"file://{tmp_path}").collect()} == {1, 2, 3, 4, 5}
    with pytest.raises(Exception, match="nowhere"):
        listing.list_files(spark, f"file://{tmp_path}/nowhere").collect()


def test_subtitles_of_named_files(spark, media, tmp_path):
    """Only what the manifest names is opened; a store of Spark's own gives the same; a missing file has no cue."""
    rows = files.catalogue_media(spark, media)
    one = sorted(files.read_subtitles(rows).collect())
    assert one == sorted(files.read_subtitles(rows, 3).collect()) == sorted(files.read_subtitles(rows, texts=files.read_texts(spark, media)).collect())
    gone = rows.selectExpr("video_id", "concat(subtitle_path, 'x') AS subtitle_path").limit(1)
    assert files.read_subtitles(gone).count() == 0


def test_keys_of_files_follow_the_file(spark, media, tmp_path):
    def keys(**settings):
        rows = files.media_keys(files.catalogue_media(spark, media), listing.list_files(spark, media), "video_path", **settings)
        return {r.video_id: r.cache_key for r in rows.collect()}

    one = keys(interval=2.0, model="m")
    assert len(set(one.values())) == 2 and all(len(k) == 16 for k in one.values())
    assert keys(model="m", interval=2.0) == one
    assert not set(keys(interval=1.0, model="m").values()) & set(one.values())
    (tmp_path / "b/one.MKV").write_bytes(b"longer")
    again = keys(interval=2.0, model="m")
    assert again["one"] == one["one"] and again["one_2"] != one["one_2"]


def test_archives_give_the_rows_of_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "ROWS", 7)
    rng = np.random.default_rng(0)
    rows = [(f"v{v}", i, 2.0 * i, (rng.integers(-8, 9, 5) / 8).tolist()) for v in range(3) for i in range(20 + v)]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx long, t double, emb array<float>").repartition(4)
    written = archives.write_archives(frames, f"file://{tmp_path}/npz")
    told = written.collect()
    assert {(r.video_id, r.n_frames) for r in told} == {("v0", 20), ("v1", 21), ("v2", 22)}
    (tmp_path / "npz/bad.npz").write_bytes(b"nothing of the kind")
    (tmp_path / "npz/empty.npz").write_bytes(b"")
    np.savez(tmp_path / "npz/odd.npz", emb=np.zeros((2, 3)), t=np.zeros(3))
    np.savez_compressed(tmp_path / "npz/other.npz", embeddings=np.ones((2, 3), np.float32), timestamps=np.array([0.0, 7.5]))
    files_ = spark.createDataFrame([(r.video_id, r.path) for r in told] + [(n, f"file://{tmp_path}/npz/{n}.npz") for n in ("bad", "empty", "odd", "other", "gone")], "video_id string, path string")
    vectors, errors = archives.read_archives(files_)
    assert sorted(tuple(r) for r in vectors.filter("video_id LIKE 'v%'").collect()) == sorted(rows)
    assert [tuple(r) for r in vectors.filter("video_id = 'other'").orderBy("t").collect()] == [("other", 0, 0.0, [1.0] * 3), ("other", 1, 7.5, [1.0] * 3)]
    assert {r.video_id for r in errors.collect()} == {"bad", "empty", "odd", "gone"}
