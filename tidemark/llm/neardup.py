"""Classes of near-duplicate texts from band keys, in Spark joins.

Equal texts are one node from the start, so copies never meet in pairs. Nodes that share a band key form a bucket. Each
node of a bucket is compared with the bucket's first and last node; all others are compared with each other in parts of
bounded size, every two of which meet, unless they are of one component by then or a bound shows that they cannot be
near: the similarity of two texts is at most the share of their sizes, so a bucket falls into levels of size, and parts
meet those of their own and the next level only. Verified links make a graph, whose components come from least labels with pointer jumping. All that grows stays
in Spark; intermediate tables are written to the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


class Likeness(Protocol):
    """How two texts are compared; sent to the executors.

    It may also have ``sketch(vector)``: float32 sums of a vector's weights by cell. What two vectors have in common is
    at most the sum of the lesser cells, which bounds their similarity.
    """

    def vector(self, text: str) -> Any: ...

    def node(self, text: str, vector: Any) -> bytes:
        """The same for texts that count as equal."""

    def alike(self, a: Any, b: Any) -> float: ...


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its id and text; never null, in order of doc_id (null last)."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("of_text"))


#: Nodes of a part, a long text counting as one for each UNIT of its characters. A task compares one part within itself,
#: or two parts with each other.
GROUP, UNIT = 500, 20_000
#: Passes in which the parts of a large bucket are compared only within themselves, dealt anew each time, so that a
#: large group is mostly one component before parts meet each other.
DEALS = 2
#: Room for rounding in the bound by sketches.
_SLACK = 1e-3


class _Held:
    """Nodes that later ones are compared with, and which components turned out to be one."""

    def __init__(self, how: Likeness, least: float):
        self.how, self.least, self.sketch = how, least, getattr(how, "sketch", None)
        self.nodes: list[tuple[bytes, bytes, Any]] = []
        self.number: dict[bytes, int] = {}
        self.root, self.of = np.arange(8), np.zeros(8, np.int64)  # by component; component by node
        self.cells, self.sums = np.zeros((8, 0), np.float32), np.zeros(8)

    def component(self, name: bytes) -> int:
        got = self.number.setdefault(name, len(self.number))
        if got == len(self.root):
            self.root = np.concatenate([self.root, np.arange(got, 2 * got)])
        return got

    def links(self, name: bytes, vector: Any, cells: np.ndarray | None) -> list[tuple[bytes, bytes, float]]:
        """(node, component, similarity) of a held node of each other component that the node is near."""
        own, n, out = self.component(name), len(self.nodes), []
        open_ = np.flatnonzero(self.root[self.of[:n]] != self.root[own])
        if cells is not None and len(open_):
            common = np.concatenate([np.minimum(self.cells[at], cells).sum(axis=1, dtype=np.float64) for at in np.array_split(open_, len(open_) // 512 + 1)])
            bound = common / np.maximum(self.sums[open_] + cells.sum(dtype=np.float64) - common, 1e-9)
            order = np.argsort(-bound, kind="stable")
            open_ = open_[order][bound[order] >= self.least - _SLACK]
        for k in open_:
            if self.root[self.of[k]] != self.root[own] and (near := self.how.alike(self.nodes[k][2], vector)) >= self.least:
                out.append((self.nodes[k][0], self.nodes[k][1], near))
                self.root[self.root == self.root[self.of[k]]] = self.root[own]
        return out

    def hold(self, node: bytes, name: bytes, vector: Any, cells: np.ndarray | None) -> None:
        n = len(self.nodes)
        if n == len(self.of):
            self.of, self.sums = np.concatenate([self.of, self.of]), np.concatenate([self.sums, self.sums])
            self.cells = np.concatenate([self.cells, self.cells])
        if cells is not None:
            if not self.cells.shape[1]:
                self.cells = np.zeros((len(self.of), len(cells)), np.float32)
            self.cells[n], self.sums[n] = cells, cells.sum(dtype=np.float64)
        self.of[n] = self.component(name)
        self.nodes.append((node, name, vector))


#: Rows of ids that a partition of an intermediate table has, about, where there are as many.
ROWS = 50_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, at most ``rows`` rows of ids, in no more partitions than they fill.

    On a local file system Hadoop starts a process for each file that an executor writes, and a step writes a table or two.
    """
    return df.coalesce(max(1, -(-rows // ROWS)))


def filed(df: DataFrame, name: str, rows: int) -> DataFrame:
    return written(few(df, rows), name)


def _compared(rows: DataFrame, texts: DataFrame, how: Likeness, least: float) -> DataFrame:
    """Rows (bucket, i, j, second, node, component): all pairs within part i (i = j), or of part i with j (``second``).

    Vectors of one part are held at a time, those of the other stream past.

    A pair is left out only where its nodes are in one component, as given or by links of the same task, or where
    their sketches show that it cannot reach ``least``. Gives links: a, b, near, component_a, component_b.
    """
    spread = rows.join(texts.select("node", "text"), "node").select("bucket", "i", "j", "second", "node", "component", "text")
    ordered = spread.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "second", "node")
    names = ["a", "b", "near", "component_a", "component_b"]
    kinds = [pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for batch in batches:
            bucket, i, j, second, node, component = (batch.column(c).to_pylist() for c in range(6))
            out: list[tuple] = []
            for r in range(batch.num_rows):
                if (bucket[r], i[r], j[r]) != group:
                    group, held = (bucket[r], i[r], j[r]), _Held(how, least)
                vector = how.vector(batch.column(6)[r].as_py())
                cells = held.sketch(vector) if held.sketch else None
                if i[r] == j[r] or second[r]:
                    for other, of_other, near in held.links(component[r], vector, cells):
                        ends = sorted([(node[r], component[r]), (other, of_other)])
                        out.append((ends[0][0], ends[1][0], near, ends[0][1], ends[1][1]))
                if not second[r]:
                    held.hold(node[r], component[r], vector, cells)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kinds[c]) for c in range(5)], names=names)

    return ordered.mapInArrow(run, "a binary, b binary, near double, component_a binary, component_b binary")


def _ends(met: DataFrame) -> DataFrame:
    """Rows (bucket, n, first, last, node) as groups for _compared: the first and the last node of a bucket with all others.

    The others are dealt to parts, so an end's text is copied once a part; a pair that shares several buckets is
    compared once.
    """
    k = F.ceil(F.col("n") / GROUP)
    pairs = met.filter("node <> first").select(F.col("first").alias("hub"), "node", k.alias("k"))
    pairs = pairs.union(met.filter("node <> last AND node <> first").select(F.col("last").alias("hub"), "node", k.alias("k")))
    pairs = pairs.groupBy("hub", "node").agg(F.max("k").alias("k"))
    dealt = pairs.select("hub", "node", F.xxhash64("k", F.pmod(F.xxhash64("node"), F.col("k"))).alias("i"))
    rows = dealt.select("hub", "i", F.lit(True).alias("second"), "node").union(dealt.select("hub", "i", F.lit(False).alias("second"), F.col("hub").alias("node")).distinct())
    return rows.select(F.col("hub").alias("bucket"), "i", (F.col("i") + 1).alias("j"), "second", "node", F.col("node").alias("component"))


def _within(rows: DataFrame, turn: int) -> DataFrame:
    """Rows (bucket, n, node, component) dealt to parts, each to be compared within itself."""
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / GROUP))
    return rows.select("bucket", part.alias("i"), part.alias("j"), F.lit(False).alias("second"), "node", "component")


def _across(rows: DataFrame) -> DataFrame:
    """Rows (bucket, node, component, level, units) dealt to parts of one level, and every two parts of the same or the next level that are not of one component put together."""
    of = rows.groupBy("bucket", "level", "component").agg(F.sum("units").alias("m"))
    # a large component has parts of its own, small ones share theirs
    whole = F.when(F.col("m") >= GROUP / 2, F.col("component"))
    of = of.withColumn("whole", whole).withColumn("shared", F.coalesce("whole", F.lit(b"")))
    sizes = of.groupBy("bucket", "level", "shared").agg(F.ceil(F.sum("m") / GROUP).alias("k"))
    of = of.join(sizes, ["bucket", "level", "shared"]).select("bucket", "level", "component", "whole", "shared", "k")
    part = F.xxhash64("level", "shared", F.pmod(F.xxhash64("node"), F.col("k")))
    n = rows.count()
    dealt = filed(rows.join(of, ["bucket", "level", "component"]).select("bucket", "level", "node", "component", "whole", part.alias("part")), "dealt", n)
    parts = filed(dealt.groupBy("bucket", "level", "part").agg(F.first("whole").alias("whole")), "parts", n)
    one, two = parts.toDF("bucket", "level", "i", "whole_i"), parts.toDF("bucket", "level", "j", "whole_j")
    two = two.withColumn("level", F.explode(F.array(*[F.col("level") + k for k in (-1, 0, 1)])))
    met = one.join(two, ["bucket", "level"]).filter("i <= j AND (whole_i IS NULL OR whole_j IS NULL OR whole_i <> whole_j)").select("bucket", "i", "j")
    sides = met.select("bucket", "i", "j", F.col("i").alias("part"), F.lit(False).alias("second"))
    sides = sides.union(met.filter("i < j").select("bucket", "i", "j", F.col("j").alias("part"), F.lit(True).alias("second")))
    return dealt.join(sides, ["bucket", "part"]).select("bucket", "i", "j", "second", "node", "component")


def level(size: str, least: float) -> Column:
    """Levels of sizes such that two sizes whose share is ``least`` or more are at most one level apart."""
    step = -math.log(min(max(least, 1e-3), 1 - 1e-6) * (1 - 1e-6))  # a little more, for rounding
    return F.floor(F.log(F.greatest(F.col(size), F.lit(1e-9))) / F.lit(step))


def _unsettled(inner: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, n, node, component, level, units) of the buckets whose nodes are of more than one component; equal buckets once."""
    rows = inner.join(labels, "node")
    total = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    buckets = rows.groupBy("bucket").agg(F.sum("units").alias("n"), total.alias("total"), F.min("component").alias("low"), F.max("component").alias("high"))
    buckets = buckets.filter("low <> high").groupBy("n", "total", "low", "high").agg(F.min("bucket").alias("bucket"))
    return filed(rows.join(buckets.select("bucket", "n"), "bucket").select("bucket", "n", "node", "component", "level", "units"), "unsettled", inner.count())


def _merged(labels: DataFrame, made: DataFrame) -> DataFrame:
    """Labels (node, component) after the links of ``made``."""
    merged = components(made.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")), made.count()).toDF("component", "into")
    return filed(labels.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "labels", labels.count())


def links(docs: DataFrame, keys: DataFrame, how: Likeness, least: float) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, near) between different nodes, and the component (node, component) of all that share a bucket.

    Of two nodes of a bucket that end in different components each was compared with the other, or could not be near.
    ``docs`` has doc_id and text, ``keys`` doc_id, node and bands (an array of band keys), and, where the likeness is
    at most the lesser size by the greater, size.
    """
    ids = F.struct(F.col("doc_id").isNull(), "doc_id")
    size = F.max("size") if "size" in keys.columns else F.lit(1.0)
    nodes = keys.groupBy("node").agg(F.min_by("bands", ids).alias("bands"), F.min_by("doc_id", ids).alias("doc_id"), size.alias("size"))
    spread = nodes.select("node", "doc_id", level("size", least).alias("level"), F.posexplode("bands").alias("band", "key"))
    spread = spread.select("node", "doc_id", "level", F.xxhash64("band", "key").alias("bucket"))
    ends = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last")).filter("n > 1")
    met = filed(spread.join(ends, "bucket"), "buckets", keys.agg(F.sum(F.size("bands"))).first()[0] or 0)

    # the texts of all nodes that meet any other
    asked = met.select("doc_id", "node").distinct()
    most, null = docs.groupBy("doc_id").count().agg(F.max("count"), F.max(F.col("doc_id").isNull())).first()
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(asked, F.col("_id").eqNullSafe(F.col("doc_id")) if null else F.col("_id") == F.col("doc_id")).select("node", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one id may stand for several texts; the node's own is kept
        for batch in batches:
            keep = [how.node(t, how.vector(t)) == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    if (most or 0) > 1:
        rows = rows.mapInArrow(own, rows.schema).groupBy("node").agg(F.min("text").alias("text"))
    texts = written(rows.withColumn("units", F.ceil((F.length("text") + 1) / UNIT)), "texts")

    # every node with the first and the last of its bucket
    found = written(_compared(_ends(met), texts, how, least).select("a", "b", "near"), "links")
    n = met.count()
    labels = met.select("node").distinct().join(components(found, found.count()), "node", "left")
    labels = filed(labels.select("node", F.coalesce("component", "node").alias("component")), "labels", n)

    # the first and the last met all others; those between meet each other unless they are of one component
    sizes = texts.select("node", "units")
    inner = filed(met.filter("node <> first AND node <> last").select("bucket", "node", "level").join(sizes, "node"), "inner", n)
    for turn in range(DEALS + 1):
        rows = _unsettled(inner, labels)
        largest = rows.agg(F.max("n")).first()[0]
        if not largest:
            break
        made = written(_compared(_across(rows) if turn == DEALS else _within(rows, turn), texts, how, least), "made")
        found, labels = found.union(made.select("a", "b", "near")), _merged(labels, made)
        if largest <= GROUP:
            break
        inner = rows.filter(F.col("n") > GROUP).select("bucket", "node", "level", "units")  # the others are done
    return found.groupBy("a", "b").agg(F.max("near").alias("near")), labels


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b): the least node that can be reached. ``rows``: how many edges, at most, if that is known.

    Each step takes the least label among neighbours, then the label of that label, so long paths halve.
    """
    pairs = edges.filter("a <> b").select("a", "b")
    e = pairs.union(pairs.select("b", "a")).toDF("u", "v").distinct()
    e = written(e, "edges") if rows is None else filed(e, "edges", 2 * rows)
    rows = e.count()
    labels = filed(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels", rows)
    state = None
    while True:
        now = labels.agg(F.count("*"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()
        if now == state:
            return labels.withColumnRenamed("label", "component")
        state = now
        near = e.join(labels, e["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        near = labels.join(near, labels["node"] == near["u"]).select("node", F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels = filed(near.join(jump, near["label"] == jump["at"]).select("node", F.least("label", "next").alias("label")), "labels", rows)


def classes(docs: DataFrame, keys: DataFrame, how: Likeness, least: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links and n_copies, one row per row of ``keys``.

    class_id is the smallest doc_id of all texts that links connect (null only if there is no other), n_links the
    number of different texts that the row's text is linked with in the comparisons made, n_copies the number of rows
    with an equal text.
    """
    keys = written(keys, "keys")
    linked, labels = links(docs, keys, how, least)
    linked = filed(linked, "links", linked.count())
    each = linked.select(F.col("a").alias("node")).union(linked.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    inside = labels.join(each, "node", "left")
    nodes = keys.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    nodes = nodes.join(inside, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = nodes.groupBy("component").agg(F.min("least").alias("class_id"))
    told = nodes.join(heads, "component").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return keys.select("doc_id", "node").join(told, "node").select("doc_id", "class_id", "n_links", "n_copies")
