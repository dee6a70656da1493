"""Near-duplicate documents by improved consistent weighted sampling.

Each text is a weighted set of word shingles: (1 + ln of the count) times an inverse document frequency, which is 1 for a
shingle of every document and 1 + IDF_SPAN for one of a share of RAREST or less, and follows the logarithm of the share
between. Document frequencies are counted over all documents in a sketch of DEPTH rows of hashed cells; a shingle's
count is the median of its cells less what is in a middling cell. The sketch's size and error are fixed shares of
the corpus, so the weights mean the same at every size. A sample picks one shingle and one level of its
weight such that two texts pick the same with the probability of their weighted Jaccard similarity. Samples are
banded, and candidates are verified by the weighted Jaccard similarity of the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import neardup
from tidemark.llm.shared import sent_if_small
from tidemark.llm.shingles import CELLS, bites, mix, shingle_hashes

#: A pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9994 at 0.8, 0.11 at 0.3, 0.0014 at 0.1.
BANDS, ROWS = 14, 4
#: Document frequencies are kept in DEPTH rows of 2 ** CELL_BITS cells, sent between tasks in pieces of CHUNK cells.
CELL_BITS, DEPTH, CHUNK = 18, 3, 4096
#: The share of documents below which shingles count as equally rare, and how much more such a shingle weighs than one
#: of every document. With 1 it weighs twice as much: more, and a few edits would part the members of a group of near
#: copies that makes up a third of the corpus, whose common shingles are then frequent ones.
RAREST, IDF_SPAN = 1 / 4096, 1.0
_LEVELS = 4096


def _gamma2_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of n equal shares."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_R = _gamma2_quantiles(_LEVELS).astype(np.float32)
_INV_R = (1 / _R).astype(np.float32)
_LN_C = np.log(_gamma2_quantiles(_LEVELS)).astype(np.float32)
_rng = np.random.default_rng(41)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def counted(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's different shingles, in order, and how often each occurs."""
    values, first = shingle_hashes(texts)
    return [np.unique(values[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]


_ROW = np.random.default_rng(43).integers(0, 1 << 63, DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _cells(shingles: np.ndarray, row: int) -> np.ndarray:
    return ((shingles * _ROW[row]) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Idf:
    """Inverse document frequencies from the sketch: counts by row and cell, and the number of documents."""

    def __init__(self, counts: np.ndarray, documents: int, span: float = IDF_SPAN):
        self.span = span
        # half of all cells hold no more than the median, which a few frequent shingles do not move
        self.counts, self.documents = (counts - np.median(counts, axis=1, keepdims=True)).astype(np.float32), max(documents, 1)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        a, b, c = (self.counts[r][_cells(shingles, r)] for r in range(DEPTH))
        n = np.rint(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)))  # the median of three
        share = np.clip(n, 1, self.documents) / self.documents
        return (1 + self.span * np.log(np.maximum(share, RAREST)) / np.log(RAREST)).astype(np.float32)


def idf(docs: DataFrame) -> Idf:
    """From the texts of all rows of ``docs``. Tasks sum their own counts; the sums are added piece by piece in Spark."""
    width = 1 << CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((DEPTH, width), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in bites((t.as_py() for t in batch.column(0)), lambda t: len(t or "")):
                shingles = np.concatenate([s for s, _ in counted(part)])
                for row in range(DEPTH):
                    seen[row] += np.bincount(_cells(shingles, row), minlength=width)
        pieces = seen.reshape(-1, CHUNK)
        some = np.flatnonzero(pieces.any(1))
        # four bytes a cell: a task has fewer than 2 ** 31 rows
        packed = [pieces[i].astype(np.int32).tobytes() for i in some]
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1], pa.int32()), pa.array([*packed, np.int32(rows).tobytes()], pa.binary())], names=["piece", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(n.as_py(), np.int32).astype(np.int64)
                sums[i] = sums[i] + got if i in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "n"])

    # DEPTH x 2 ** CELL_BITS numbers reach the driver, whatever the corpus
    got = docs.select("text").mapInArrow(count, "piece int, n binary").repartition("piece").mapInArrow(add, "piece int, n binary").toArrow()
    table, documents = np.zeros((DEPTH * width // CHUNK, CHUNK), np.int64), 0
    for i, n in zip(got.column("piece").to_pylist(), got.column("n").to_pylist(), strict=True):
        if i < 0:
            documents = int(np.frombuffer(n, np.int64)[0])
        else:
            table[i] = np.frombuffer(n, np.int64)
    return Idf(table.reshape(DEPTH, width), documents)


class WeightedShingles:
    """The likeness that verification uses; carries the idf to the executors."""

    def __init__(self, idf):
        self.idf = idf  # a broadcast variable of an Idf

    def weights(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)).astype(np.float32) * self.idf.value.of(shingles)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shingles, counts = counted([text])[0]
        return shingles, counts, self.weights(shingles, counts)

    def node(self, text: str, vector) -> bytes:
        """Texts of equal shingles and counts are equal; texts without shingles are if they are the same."""
        shingles, counts = vector[:2]
        return hashlib.md5(shingles.tobytes() + counts.astype(np.int64).tobytes() if len(shingles) else b"plain:" + text.encode()).digest()

    def sketch(self, vector) -> np.ndarray:
        return np.bincount((vector[0] & np.uint64(CELLS - 1)).astype(np.int64), vector[2], CELLS).astype(np.float32)

    def alike(self, a, b) -> float:
        """Weighted Jaccard similarity."""
        if not len(a[0]) or not len(b[0]):
            return 0.0
        at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
        same = a[0][at] == b[0]
        x, y = a[2][at[same]].astype(np.float64), b[2][same].astype(np.float64)
        least = np.minimum(x, y).sum()
        return float(least / (a[2].sum(dtype=np.float64) + b[2].sum(dtype=np.float64) - least))


def samples(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """uint64[sets, BANDS * ROWS] of weighted sets (shingles, weights) that are not empty."""
    shingles = np.concatenate([s for s, _ in sets])
    ln_s = np.log(np.concatenate([w for _, w in sets])).astype(np.float32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in sets])[:-1]])
    index = np.arange(len(shingles), dtype=np.int64)
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        h = shingles * _A[k] + _B[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        i = (h >> np.uint64(52)).astype(np.int32)
        j = ((h >> np.uint64(40)) & np.uint64(_LEVELS - 1)).astype(np.int32)
        beta = ((h >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(1 / (1 << 24))
        t = np.floor(ln_s * _INV_R[i] + beta)
        ln_a = _LN_C[j] - _R[i] * (t - beta + np.float32(1))
        bits = ln_a.view(np.int32).astype(np.int64)
        bits ^= (bits >> 63) & 0x7FFFFFFF  # so that integers sort as the floats do
        at = np.minimum.reduceat((bits << 32) | index, starts) & 0xFFFFFFFF
        out[:, k] = mix(shingles[at] ^ mix(t[at].astype(np.int64).view(np.uint64) + np.uint64(k + 1)))
    return out


def band_keys(samples_: np.ndarray) -> np.ndarray:
    """int64[sets, BANDS]"""
    key = np.zeros((len(samples_), BANDS), np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + samples_[:, r::ROWS])
    return key.view(np.int64)


def keys(docs: DataFrame, how: WeightedShingles) -> DataFrame:
    """doc_id, node, bands and size (the sum of its weights) of every row; a text without shingles has no band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in bites(batch.column(1).to_pylist(), lambda t: len(t or "")):
                sets = [(s, c, how.weights(s, c)) for s, c in counted(part)]
                nodes = [how.node(t or "", v) for t, v in zip(part, sets, strict=True)]
                bands: list = [[] for _ in part]
                some = [i for i, v in enumerate(sets) if len(v[0])]
                if some:
                    for i, row in zip(some, band_keys(samples([(sets[i][0], sets[i][2]) for i in some])), strict=True):
                        bands[i] = row
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array([v[2].sum(dtype=np.float64) for v in sets], pa.float64())], names=["doc_id", "node", "bands", "size"])
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("node", "binary").add("bands", T.ArrayType(T.LongType())).add("size", "double"))


def _by_row(df: DataFrame, doc_id: str, text: str, least: float) -> DataFrame:
    """neardup.classes of the rows, each named by its id and text (see neardup.row_key): ids need not differ."""
    docs = df.select(neardup.row_key(df[doc_id], df[text]).alias("doc_id"), df[text].alias("text"))
    how = WeightedShingles(df.sparkSession.sparkContext.broadcast(idf(docs)))
    return neardup.classes(docs, keys(docs, how), how, least)


def near_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row per row; see neardup.classes.

    Equal texts are in one class; a null text counts as empty, and texts without words are near only their equals.
    """
    return _by_row(df, doc_id, text, least).select("doc_id.doc_id", F.col("class_id.doc_id").alias("class_id"), "n_links", "n_copies")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """``df`` with one row of each class: that with the smallest doc_id (null last), then the smallest hash of its text.

    Rows are told apart by id and text, so different texts that share an id, or have none, each stay.
    """
    n = df.count()
    rows = neardup.filed(_by_row(df, doc_id, text, least).select("doc_id", "class_id"), "rows", n)
    gone = sent_if_small(neardup.few(rows.filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct(), n), "gone")
    kept = df.withColumn("_row", neardup.row_key(df[doc_id], df[text]))
    kept = kept.join(gone, kept["_row"] == gone["_gone"], "left_anti")
    if rows.filter("doc_id = class_id").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_row"])  # the same text under the same id
    return kept.drop("_row")
