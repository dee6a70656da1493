"""Near-duplicate documents by SimHash: 64-bit fingerprints that differ in few bits, found by pigeonhole blocks.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles. Fingerprints are split into
FIELDS blocks; two that differ in MOST bits agree in at least FIELDS - MOST of them, so each goes to one bucket for
every choice of that many blocks, and close pairs meet in a bucket, where their Hamming distance is verified. Only
different fingerprints meet, so copies never do, and a bucket gives a spanning set of its links, not its pairs. A bucket
that is too large to be held has its fingerprints named, and these meet by the fingerprints one flip away, which is
exact and linear as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import neardup
from tidemark.llm.shared import written

BITS, WIDTH, SEED = 64, 3, 42
#: Fingerprints link at MOST differing bits or fewer; they are split into FIELDS blocks of SIZE bits, of which a bucket
#: fixes two (32 bits).
MOST, FIELDS = 2, 4
SIZE = BITS // FIELDS
CHOICES = list(combinations(range(FIELDS), FIELDS - MOST))
#: Up to SMALL fingerprints of a bucket are compared pair by pair, up to HELD by their flips within a task, more in Spark.
SMALL, HELD = 64, 65_536
#: Bytes of a text that are hashed in one go.
BITE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _votes(raw: bytes) -> tuple[np.ndarray, int]:
    """How many of the shingles of space-joined words have each bit set, and how many there are."""
    words = raw.split()
    if not words:
        return np.zeros(BITS, np.int64), 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    wide = min(WIDTH, len(words))
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts[: len(words) - wide + 1].tolist(), ends[wide - 1 :].tolist(), strict=True)], np.uint64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _OF_BYTE for k in range(8)]), len(hashes)


def _stretches(raw: bytes) -> Iterator[bytes]:
    """Parts of about BITE bytes that have every shingle once: each begins with the last words of the one before."""
    at, carry = 0, b""
    while len(raw) - at > BITE:
        gap = _SPACE.search(raw, at + BITE)
        end = gap.start() if gap else len(raw)
        part = carry + raw[at:end]
        if len(part.split(None, WIDTH)) > WIDTH or end == len(raw):
            yield part
            carry = b" ".join(part.rsplit(None, WIDTH - 1)[-(WIDTH - 1) :]) if len(part.split(None, WIDTH)) >= WIDTH else part
        else:  # too few words so far: they go on
            carry = part
        at = end
    yield carry + raw[at:]


def fingerprint(raw: bytes) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit number; 0 without words."""
    raw = raw.lower()  # of bytes: the letters A-Z only
    ones, n = np.zeros(BITS, np.int64), 0
    if len(raw) <= BITE:
        ones, n = _votes(raw)
    else:
        parts = list(_stretches(raw))
        for k, part in enumerate(parts):
            # a last part that only repeats the words carried over has no shingle of its own
            if k and len(part.split(None, WIDTH)) < WIDTH:
                continue
            some, m = _votes(part)
            ones, n = ones + some, n + m
    bits = np.flatnonzero(2 * ones > n)
    value = sum(1 << int(k) for k in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp`` (long) of every row's whole text; a null text counts as empty (0)."""
    schema = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(v.as_buffer().to_pybytes()) if v.is_valid else 0 for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.int64())], names=[*keep, "fp"])

    return df.select(*keep, df[text].cast("binary").alias("_text")).mapInArrow(run, schema.add("fp", "long"))


def written_out(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def _least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the edges a-b reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _close(f: np.ndarray, free: list[int]) -> np.ndarray:
    """For each of ``f`` (different fingerprints, equal but for the bits ``free``) the place of the least that links reach."""
    n = len(f)
    if n <= SMALL:
        a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= MOST)
        return _least_reachable(n, a, b)
    # two fingerprints are within two bits if and only if they, or one flip of each, or one and a flip of the other, are equal
    flips = np.array([0, *(1 << k for k in free)], np.uint64)
    keys, own = (f[None, :] ^ flips[:, None]).ravel(), np.tile(np.arange(n), len(flips))
    order = np.argsort(keys, kind="stable")
    keys, own = keys[order], own[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return _least_reachable(n, np.repeat(own[head], np.diff(np.append(head, len(keys)))), own)


def _met(spread: DataFrame, held: int) -> DataFrame:
    """Links (a, b) that span what each bucket links; of buckets of more than ``held``, rows of a alone (b null)."""
    ordered = spread.repartition("choice", "bucket").sortWithinPartitions("choice", "bucket", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        parts: list[np.ndarray] = []
        n = 0
        a: list[np.ndarray] = []
        b: list[np.ndarray | None] = []

        def done() -> None:
            nonlocal parts, n
            if 1 < n <= held:
                f = np.concatenate(parts)
                free = [SIZE * i + k for i in range(FIELDS) if i not in CHOICES[group[0]] for k in range(SIZE)]
                to = _close(f.view(np.uint64), free)
                moved = np.flatnonzero(to != np.arange(n))
                a.append(f[moved])
                b.append(f[to[moved]])
            parts, n = [], 0

        def out() -> pa.RecordBatch:
            left, right = [pa.array(x, pa.int64()) for x in a], [pa.array(y, pa.int64()) if y is not None else pa.nulls(len(x), pa.int64()) for x, y in zip(a, b, strict=True)]
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(left), pa.concat_arrays(right)], names=["a", "b"])

        for batch in batches:
            choice, bucket, fp = (batch.column(c).to_numpy() for c in range(3))
            edge = np.flatnonzero((choice[1:] != choice[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            starts, ends = np.append(0, edge), np.append(edge, len(fp))
            # groups of one row inside a batch meet nobody
            last = len(starts) - 1
            for i in np.flatnonzero((ends - starts > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)):
                s, e = starts[i], ends[i]
                if not len(fp):
                    continue
                key = (int(choice[s]), int(bucket[s]))
                if key != group:
                    done()
                    group = key
                n += e - s
                if n <= held:
                    parts.append(fp[s:e])
                else:  # named, not held
                    for p in [*parts, fp[s:e]]:
                        a.append(p)
                        b.append(None)
                    parts = []
            if sum(map(len, a)) > 10_000:
                yield out()
        done()
        if a:
            yield out()

    return ordered.mapInArrow(run, "a long, b long")


def components(fps: DataFrame, held: int = HELD) -> DataFrame:
    """fp and ``component`` (the least fp that links reach) of the different fingerprints ``fps`` (fp) that have a link."""
    block = lambda i: F.shiftrightunsigned("fp", SIZE * i).bitwiseAND(F.lit((1 << SIZE) - 1))

    def bucket(choice: tuple[int, ...]) -> Column:
        out = block(choice[0])
        for i in choice[1:]:
            out = F.shiftleft(out, SIZE).bitwiseOR(block(i))
        return out

    keys = F.array(*[F.struct(F.lit(c).cast("short").alias("choice"), bucket(blocks).alias("bucket")) for c, blocks in enumerate(CHOICES)])
    met = written(_met(fps.select("fp", F.inline(keys)).select("choice", "bucket", "fp"), held), "met")
    large = met.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(1 << k if k < BITS - 1 else -(1 << k)).cast("long")) for k in range(BITS)]
    spread = large.select("fp", F.explode(F.array("fp", *flips)).alias("key"))
    least = spread.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("greatest")).filter("least < greatest").select("key", "least")
    more = spread.join(least, "key").filter("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return neardup.components(met.filter("b IS NOT NULL").union(more)).withColumnRenamed("node", "fp")


def near_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """doc_id, ``fingerprint`` (hex) and ``component_id`` of every row, by its whole text.

    Letters A-Z are lower-cased, words lie between ASCII white space, and every three of them in a row, repeats
    included, make a shingle; fewer words make one. Texts without words (null counts as empty) have fingerprint zero and
    are linked as any other. component_id is the smallest doc_id of all rows that chains of links reach, the row's own
    included; null only if all their ids are. Repeated rows are each returned; rows may share an id; an empty table
    gives an empty result; other columns are not read. A long text is hashed by stretches of a megabyte.
    """
    made = written(fingerprints(df.select(df[doc_id].alias("doc_id"), df[text].alias("text"))), "fingerprints")
    each = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    of = components(each.select("fp"), held)
    named = written(each.join(of, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "named")
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(heads, "component").select("fp", "component_id")
    return made.join(told, "fp").select("doc_id", written_out(F.col("fp")).alias("fingerprint"), "component_id")
