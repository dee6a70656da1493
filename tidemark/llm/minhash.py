"""MinHash fingerprints of documents.

A fingerprint is the least value of each of PERMUTATIONS universal hashes over a text's word shingles, worked out in
numpy for a run of texts at once; the share of equal places of two fingerprints estimates the Jaccard similarity of
their shingle sets. ``near_classes`` joins bands of the fingerprints in Spark and verifies candidates by the Jaccard
similarity of the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import neardup
from tidemark.llm.shingles import CELLS, bites, mix, shingle_hashes

PERMUTATIONS = 128
#: Bands of near_classes: a pair of similarity 0.8 shares one with probability 0.99995.
BANDS, ROWS = 25, 5
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_LOWEST = -(1 << 63)
#: Bytes of a text by which the rows of one id are dealt to ranges.
LEAD = 7


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """uint16[texts, PERMUTATIONS], and whether each text has a shingle at all (else its row is 0)."""
    values, first = shingle_hashes(texts)
    some = first[1:] > first[:-1]
    out = np.zeros((len(texts), PERMUTATIONS), np.uint16)
    if len(values):
        starts, work = first[:-1][some], np.empty_like(values)
        for k in range(PERMUTATIONS):
            np.multiply(values, _A[k], out=work)
            np.add(work, _B[k], out=work)
            out[some, k] = (np.minimum.reduceat(work, starts) >> np.uint64(20)).astype(np.uint16)
    return out, some


def written(signature: np.ndarray, some: bool) -> str:
    """Four hex digits a permutation; empty for a text without shingles."""
    return signature.astype(">u2").tobytes().hex() if some else ""


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``fingerprint`` of every row's whole text; null counts as empty; equal texts have equal ones."""
    schema = df.select(F.col(doc_id).alias("doc_id")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in bites(batch.column(1).to_pylist(), lambda t: len(t or "")):
                sig, some = signatures(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([written(s, x) for s, x in zip(sig, some, strict=True)], pa.string())], names=["doc_id", "fingerprint"])
                at += len(part)

    return df.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, schema.add("fingerprint", "string"))


def _alike(a: np.ndarray, some_a: bool, b: np.ndarray, some_b: bool) -> float:
    return float((a == b).mean()) if some_a and some_b else float(some_a == some_b)


def compare_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, in which the last half is taken from the next row.

    Rows are in order of doc_id (null first), then text; after the last comes the first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, one row per row; a null text counts as
    empty, and two texts without words are alike (1).

    The texts are dealt to ranges of doc_id, whose bounds (at most ``ranges`` numbers, from approximate quantiles)
    are all that the driver sees. An id that fills several ranges, such as a null one, is dealt to as many by how its
    texts begin (LEAD bytes; texts that agree in these stay together). Each range also gets the first row of the next one,
    so a task reads its rows in order and needs no other.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[doc_id].dataType, T.IntegralType):
        raise ValueError(f"{doc_id} must be of a whole-number type, by which rows are put in order")
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST)).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lead = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, LEAD)), 2 * LEAD, "0"), 16, 10).cast("long")
    docs = docs.withColumns({"lead": lead, "h": F.xxhash64("text")})
    bounds = docs.agg(F.percentile_approx("at", [i / ranges for i in range(ranges)], 4 * ranges)).first()[0]
    cuts, many = np.unique(np.array(bounds or [], np.int64), return_counts=True)
    inner: dict[int, np.ndarray] = {}  # of ids that are the bound of several ranges, the bounds within
    if (many > 1).any():
        held = docs.filter(F.col("at").isin(cuts[many > 1].tolist())).groupBy("at").agg(F.percentile_approx("lead", [i / ranges for i in range(1, ranges)], 4 * ranges).alias("b"))
        n_of = dict(zip(cuts.tolist(), many.tolist(), strict=True))
        inner = {r["at"]: np.unique(np.array(r["b"], np.int64)[np.linspace(0, ranges - 2, n_of[r["at"]] - 1).round().astype(int)]) for r in held.collect()}
    starts = np.append(0, np.cumsum([1 + len(inner.get(c, ())) for c in cuts.tolist()])).astype(np.int64)

    def range_number(at: np.ndarray, lead: np.ndarray) -> np.ndarray:
        place = np.searchsorted(cuts, at, side="left")
        out = starts[place]
        for c, own in inner.items():
            hot = at == c
            out[hot] += np.searchsorted(own, lead[hot], side="right")
        return out

    @F.pandas_udf("int")
    def range_of(at: pd.Series, lead: pd.Series) -> pd.Series:
        return pd.Series(range_number(at.to_numpy(np.int64), lead.to_numpy(np.int64)).astype(np.int32))

    first = F.min_by(F.struct("at", "h"), F.struct("at", "text"))
    firsts = sorted((r["r"], r["k"]["at"], r["k"]["h"]) for r in docs.withColumn("r", range_of("at", "lead")).groupBy("r").agg(first.alias("k")).collect())
    guest_of = {(at, h): firsts[i - 1][0] for i, (_, at, h) in enumerate(firsts)}  # [-1] is the last range

    @F.pandas_udf("array<int>")
    def places(at: pd.Series, lead: pd.Series, h: pd.Series) -> pd.Series:
        own = range_number(at.to_numpy(np.int64), lead.to_numpy(np.int64)).tolist()
        return pd.Series([[2 * r, 2 * guest_of[k] + 1] if k in guest_of else [2 * r] for k, r in zip(zip(at.tolist(), h.tolist(), strict=True), own, strict=True)])

    dealt = docs.select("doc_id", "at", "text", F.explode(places("at", "lead", "h")).alias("place"))
    dealt = dealt.select("doc_id", "at", "text", F.shiftright("place", 1).alias("range"), (F.col("place") % 2 == 1).alias("guest"))
    ordered = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range", "guest", "at", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []

        def told() -> pa.RecordBatch:
            """Rows of all that is held but the last, which is only the one after them."""
            texts = [t for _, t in held]
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:], strict=False)]
            sig, some = signatures(texts)
            esig, esome = signatures(edited)
            out: dict[str, list] = {c: [] for c in names}
            for i, (doc, t) in enumerate(held[:-1]):
                row = (doc, len(t), hashlib.sha256(edited[i].encode()).hexdigest(), written(sig[i], some[i]), written(esig[i], esome[i]), _alike(sig[i], some[i], esig[i], esome[i]), _alike(sig[i], some[i], sig[i + 1], some[i + 1]))
                for c, v in zip(names, row, strict=True):
                    out[c].append(v)
            types = [pa.int64() if kind == "bigint" else None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=names)

        current, size, ended = None, 0, False
        for batch in batches:
            for doc, text, part, guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != current:
                    held, size, current, ended = [], 0, part, False
                if ended:
                    continue
                held.append((doc, text))
                size += len(text)
                if guest or (size > 1 << 20 and len(held) > 1):
                    yield told()
                    held, size, ended = held[-1:], len(text), guest

    return ordered.select("doc_id", "text", "range", "guest").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


class ShingleSets:
    """The likeness that verification uses: the Jaccard similarity of the sets of word shingles."""

    def vector(self, text: str) -> np.ndarray:
        return np.unique(shingle_hashes([text])[0])

    def node(self, text: str, vector: np.ndarray) -> bytes:
        """Texts of equal shingles are equal; texts without shingles are if they are the same."""
        return hashlib.md5(vector.tobytes() if len(vector) else b"plain:" + text.encode()).digest()

    def sketch(self, vector: np.ndarray) -> np.ndarray:
        return np.bincount((vector & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.float32)

    def alike(self, a: np.ndarray, b: np.ndarray) -> float:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common / max(len(a) + len(b) - common, 1)


def near_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row per row, by banded fingerprints; see neardup.classes.

    Bands of ROWS values are joined in Spark, candidates verified by the Jaccard similarity of the whole texts. A null
    text counts as empty, and texts without words are near only their equals.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    how = ShingleSets()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in bites(batch.column(1).to_pylist(), lambda t: len(t or "")):
                sig, some = signatures(part)
                key = np.zeros((len(part), BANDS), np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r * BANDS : (r + 1) * BANDS].astype(np.uint64))
                values, first = shingle_hashes(part)
                sets = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                nodes = [how.node(t or "", s) for t, s in zip(part, sets, strict=True)]
                bands = [k if x else [] for k, x in zip(key.view(np.int64), some, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(map(len, sets), pa.float64())], names=["doc_id", "node", "bands", "size"])
                at += len(part)

    keys = docs.mapInArrow(run, docs.select("doc_id").schema.add("node", "binary").add("bands", T.ArrayType(T.LongType())).add("size", "double"))
    return neardup.classes(docs, keys, how, least)
