"""Hard negatives of embeddings: rows of another label that come near an anchor's positives without passing them.

Scores are integer inner products, worked out by Kronecker substitution: components are biased so that none is negative,
and those of several candidates are put in separate fields of one 64-bit word, each wide enough for a whole inner
product. An anchor's component is multiplied once with the word of several candidates; when the words are summed over
the components, every field holds one candidate's product, from which the bias is taken off again. All is exact.

Anchors are dealt to blocks, rows to deals, and every deal meets every block in a task (a stated query set against all
rows): the block is held, the rows stream past. A task keeps only the best few rows of each anchor, so neither vectors
nor scores are ever gathered. There are two passes, since which negatives count depends on the positives' scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import written

#: Anchors of a block, rows that are multiplied at once with STRIP anchors, and rows of a deal.
BLOCK, ROWS, STRIP, DEAL = 2048, 2048, 256, 16_384
#: Bits of a field beyond which scores would not be safe in 64-bit arithmetic.
WIDEST = 56
_NONE = np.iinfo(np.int64).min
#: Stands for a missing id within tasks, where ids are put in order.
_NO_ID = np.iinfo(np.int64).max


class Packing:
    """How components (between ``least`` and ``greatest``, ``width`` of them at most) go into fields of a word."""

    def __init__(self, least: int, greatest: int, width: int):
        self.bias, self.width = -min(least, 0), max(width, 1)
        span = max(greatest, 0) + self.bias
        self.bits = max(1, int(self.width * span * span).bit_length())
        if self.bits > WIDEST:
            raise ValueError(f"components from {least} to {greatest} in {width} places give scores of more than {WIDEST} bits")
        self.fields = 64 // self.bits

    def matrix(self, components: pa.ListArray) -> np.ndarray:
        """One row per vector; a shorter one has zeros in its last places."""
        flat, sizes = components.flatten().to_numpy(zero_copy_only=False), components.value_lengths().to_numpy(zero_copy_only=False)
        if len(sizes) and (sizes == self.width).all():
            return flat.reshape(-1, self.width).astype(np.int64)
        out = np.zeros((len(sizes), self.width), np.int64)
        out[np.arange(self.width)[None, :] < sizes[:, None]] = flat
        return out

    def pack(self, candidates: np.ndarray) -> np.ndarray:
        """uint64[width, words]: the biased components of ``fields`` candidates in each word, one row per component."""
        words = -(-len(candidates) // self.fields)
        out = np.zeros((self.width, words), np.uint64)
        biased = (candidates + self.bias).astype(np.uint64).T
        for k in range(self.fields):
            some = biased[:, k * words : (k + 1) * words]
            out[:, : some.shape[1]] |= some << np.uint64(k * self.bits)
        return out

    def scores(self, anchors: np.ndarray, packed: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """int64[anchors, candidates] of inner products: a word is multiplied once per anchor and component."""
        sums = (anchors + self.bias).astype(np.uint64) @ packed
        mask = np.uint64((1 << self.bits) - 1)
        fields = np.concatenate([(sums >> np.uint64(k * self.bits)) & mask for k in range(self.fields)], axis=1)[:, : len(candidates)].astype(np.int64)
        return fields - self.bias * (anchors.sum(1)[:, None] + candidates.sum(1)[None, :]) - self.width * self.bias**2


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row of ``scores`` (changed; _NONE does not count) and their ids, which rise along a row."""
    best, of = np.full((len(scores), k), _NONE), np.full((len(scores), k), _NO_ID)
    at = np.arange(len(scores))
    for r in range(min(k, scores.shape[1])):
        j = scores.argmax(1)  # the first of equals
        best[:, r] = scores[at, j]
        of[:, r] = np.where(best[:, r] > _NONE, ids[j], _NO_ID)
        scores[at, j] = _NONE
    return best, of


class _Block:
    """A block of anchors and the best rows of each so far."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, matrix: np.ndarray, bands: list | None, k: int, low: int, high: int):
        self.ids, self.keys, self.labels, self.matrix, self.k = ids, keys, labels, matrix, k
        self.low = self.high = None
        n = 1
        if bands is not None:
            n = max(map(len, bands), default=0)
            self.low, self.high = np.ones((len(ids), n), np.int64), np.zeros((len(ids), n), np.int64)  # empty
            for i, b in enumerate(bands):
                p = np.array(b, np.int64)
                self.low[i, : len(p)], self.high[i, : len(p)] = -((-low * p) // 100), high * p // 100
        self.best, self.of = np.full((n, len(ids), k), _NONE), np.full((n, len(ids), k), _NO_ID)

    def meet(self, packing: Packing, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        for at in range(0, len(order), ROWS):
            some = order[at : at + ROWS]
            rows, packed = matrix[some], packing.pack(matrix[some])
            for s in range(0, len(self.ids), STRIP):
                strip = slice(s, s + STRIP)
                scores = packing.scores(self.matrix[strip], packed, rows)
                same = self.labels[strip, None] == labels[None, some]
                for p in range(len(self.best)):
                    if self.low is None:
                        takes = same & (self.ids[strip, None] != ids[None, some])
                    else:
                        takes = ~same & (scores >= np.maximum(self.low[strip, p], self.best[p, strip, -1])[:, None]) & (scores <= self.high[strip, p, None])
                    hit = np.flatnonzero(takes.any(1))
                    if len(hit):
                        best, of = _top(np.where(takes[hit], scores[hit], _NONE), ids[some], self.k)
                        both, who = np.concatenate([self.best[p, s + hit], best], 1), np.concatenate([self.of[p, s + hit], of], 1)
                        order_ = np.lexsort((who, ~both), axis=-1)[:, : self.k]
                        self.best[p, s + hit], self.of[p, s + hit] = np.take_along_axis(both, order_, 1), np.take_along_axis(who, order_, 1)

    def told(self) -> pa.RecordBatch:
        """anchor, place (of the positive), best: the kept rows of each, as (less the score, id)."""
        p, a = np.nonzero(self.best[:, :, 0] > _NONE)
        best, of = self.best[p, a], self.of[p, a]
        there = best > _NONE
        pairs = pa.StructArray.from_arrays([pa.array(-best[there], pa.int64()), pa.array(of[there], pa.int64())], names=["less", "id"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(there.sum(1))), pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([pa.array(self.keys[a], pa.int64()), pa.array(p, pa.int32()), lists], names=["anchor", "place", "best"])


def _best(anchors: DataFrame, rows: DataFrame, packing: Packing, blocks: int, deals: int, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """anchor, place, best (k of them in order) of every anchor over all rows.

    Without a column ``scores`` in ``anchors`` these are the largest of the same label, else, for each of those scores,
    the largest of another label between the two percentages of it.
    """
    spark = rows.sparkSession
    banded = "scores" in anchors.columns
    scores = F.col("scores") if banded else F.lit(None).cast("array<long>")
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    fields = ["key", "vec_id", "label", "components"]
    one = anchors.select(own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.lit(0).cast("short").alias("side"), *fields, scores.alias("scores"))
    other = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("key"), F.lit(deals)).cast("int").alias("deal"), F.lit(1).cast("short").alias("side"), *fields, F.lit(None).cast("array<long>").alias("scores"))
    dealt = one.union(other).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "deal").sortWithinPartitions("block", "deal", "side", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Block | None = None
        block, deal, reading = None, None, False
        parts: list[pa.RecordBatch] = []

        def start() -> None:
            nonlocal held, parts
            if parts:
                t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                held = _Block(t.column("vec_id").to_numpy(), t.column("key").to_numpy(), t.column("label").to_numpy(), packing.matrix(t.column("components")), t.column("scores").to_pylist() if banded else None, k, low, high)
                parts = []

        for batch in batches:
            if not batch.num_rows:
                continue
            blocks_, deals_, sides = (batch.column(c).to_numpy() for c in range(3))
            edge = np.flatnonzero((blocks_[1:] != blocks_[:-1]) | (deals_[1:] != deals_[:-1]) | (sides[1:] != sides[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if blocks_[a] != block:
                    if held is not None:
                        yield held.told()
                    held, parts, block, deal, reading = None, [], blocks_[a], deals_[a], True
                if deals_[a] != deal:
                    # the same anchors come again in the same order; what they have is kept
                    start()
                    deal, reading = deals_[a], held is None
                if sides[a] == 0:
                    if reading:
                        parts.append(part)
                else:
                    start()
                    reading = False
                    if held is not None:  # else the block has no anchor
                        held.meet(packing, part.column("vec_id").to_numpy(), part.column("label").to_numpy(), packing.matrix(part.column("components")))
        if held is not None:
            yield held.told()

    made = dealt.mapInArrow(run, "anchor long, place int, best array<struct<less:long,id:long>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)  # of as many lists as there are tasks at most
    return made.groupBy("anchor", "place").agg(best.alias("best"))


def components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where the vector, or a component, is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def hard_negatives(df: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows of ``df`` where ``anchor`` holds.

    A row's score is the inner product of its components (floor of ``scale`` times each) with the anchor's; larger ones
    come first, of equal ones the smaller id (null last). The first ``positives`` rows of the anchor's label and another id
    are its positives; for each, the first ``negatives`` rows of another label are returned whose score lies between
    ``low`` and ``high`` per cent of the positive's (none, if that is negative). Fewer are returned where there are fewer.

    Rows with a null label, a null vector or a component that is null or not finite take no part; shorter vectors
    count as filled up with zeros; an id need not be unique, and each row that has it counts. Components so large that
    scores would not be exact (WIDEST bits) are an error. Labels are whole numbers or strings (told apart by a hash).
    """
    spark = df.sparkSession
    kind = df.schema[label].dataType
    name = F.col(label).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(label)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), name.alias("label"), F.col(label).isNotNull().alias("there"), components(F.col(vector), scale).alias("components"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter("there AND components IS NOT NULL").select(F.monotonically_increasing_id().alias("key"), F.coalesce("id", F.lit(_NO_ID)).alias("vec_id"), "label", "components", "anchor")
    rows = written(rows, "vectors")
    told = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.min(F.array_min("components")).alias("least"), F.max(F.array_max("components")).alias("greatest"), F.max(F.size("components")).alias("width")).first()
    packing = Packing(told.least or 0, told.greatest or 0, told.width or 0)
    blocks = max(1, -(-told.anchors // BLOCK))
    deals = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-told.n // DEAL))
    asking = rows.filter("anchor")

    near = _best(asking, rows, packing, blocks, deals, positives).select("anchor", "best")
    near = written(near, "positives")
    scores = near.select(F.col("anchor").alias("key"), F.transform("best", lambda b: -b["less"]).alias("scores"))
    far = _best(asking.join(scores, "key"), rows, packing, blocks, deals, negatives, low, high)
    each = near.select("anchor", F.posexplode("best").alias("place", "positive")).join(far, ["anchor", "place"])
    each = each.select("anchor", "positive", F.posexplode("best").alias("at", "negative"))
    out = each.join(asking.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select("anchor_id", known("positive.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), known("negative.id").alias("negative_id"), (-F.col("positive.less")).alias("positive_score"), (-F.col("negative.less")).alias("negative_score"))
