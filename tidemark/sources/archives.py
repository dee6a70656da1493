"""Vectors in numpy archives (.npz), one file per video: a matrix, at half precision or more, and the times of its rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.listing import contents, opened

#: Names of the vectors and of their times in the archives of either study.
VECTORS, TIMES = ("emb", "embeddings"), ("t", "timestamps")
#: Rows that are put together at a time.
ROWS = 4096


def rows_of(raw: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First frame number, times and vectors (float32) of an archive, ``ROWS`` rows at a time."""
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        emb, t = (next((z[n] for n in names if n in z.files), None) for names in (VECTORS, TIMES))
    if emb is None or t is None or emb.ndim != 2 or len(t) != len(emb):
        raise ValueError("no matrix of vectors with their times")
    for at in range(0, len(t), ROWS):
        yield at, t[at : at + ROWS].astype(np.float64), emb[at : at + ROWS].astype(np.float32)


def read_archives(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors (schemas.FRAME_EMB) of the archives that ``files`` (video_id, path) names, and errors (video_id, error).

    A file that is missing or is no such archive is a row of the errors, and the others go on. Each task reads its own
    files; a file is read whole, its rows leave the task in blocks.
    """
    names = ["video_id", "frame_idx", "t", "emb", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(video: str, at: int, t: np.ndarray, emb: np.ndarray, error: str | None) -> pa.RecordBatch:
            n = max(len(t), 1 if error else 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * emb.shape[1], pa.int32()), pa.array(emb.ravel(), pa.float32())) if error is None else pa.nulls(1, pa.list_(pa.float32()))
            return pa.RecordBatch.from_arrays([pa.array([video] * n, pa.string()), pa.array(np.arange(at, at + n)), pa.array(t, pa.float64()) if error is None else pa.nulls(1, pa.float64()), lists, pa.array([error] * n, pa.string())], names=names)

        for batch in batches:
            for video, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    if not raw.is_valid:
                        raise ValueError("no such file")
                    for at, t, emb in rows_of(raw.as_py()):
                        yield block(video, at, t, emb, None)
                except (ValueError, EOFError, zipfile.BadZipFile, OSError) as e:
                    yield block(video, 0, np.zeros(0), np.zeros((0, 0)), str(e))

    raw = contents(files.select(F.col("video_id").cast("string").alias("video_id"), "path"), "path").select("video_id", "content")
    made = raw.mapInArrow(run, "video_id string, frame_idx long, t double, emb array<float>, error string")
    return made.filter("error IS NULL").drop("error"), made.filter("error IS NOT NULL").select("video_id", "error")


def write_archives(frames: DataFrame, root: str, dtype: str = "float16") -> DataFrame:
    """Writes <root>/<video_id>.npz of every video of ``frames`` (video_id, t, emb), and returns video_id, path, n_frames.

    A video's rows meet in one task, which writes its file; a second attempt of the task writes the same file again.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        video = str(pdf["video_id"].iloc[0])
        store, path, before = opened(root)
        store.create_dir(path, recursive=True)
        held = io.BytesIO()
        np.savez(held, emb=np.stack(pdf["emb"].to_list()).astype(dtype), t=pdf["t"].to_numpy(float))
        with store.open_output_stream(f"{path}/{video}.npz") as f:
            f.write(held.getvalue())
        return pd.DataFrame({"video_id": [video], "path": [f"{before}{path}/{video}.npz"], "n_frames": [len(pdf)]})

    rows = frames.filter("emb IS NOT NULL").select(F.col("video_id").cast("string").alias("video_id"), "t", "emb")
    return rows.groupBy("video_id").applyInPandas(run, "video_id string, path string, n_frames long")
