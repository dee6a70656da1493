"""A trie of conversation prefixes, built by van Emde Boas recursion.

Conversations are sequences of turns. They are cut at half depth; a cut prefix is named by its content; below it hangs a
lower forest. As the names of all cuts of a round come from sums over the upper halves, all upper tries and lower
forests of a round are halved together, so there are as many rounds as halvings of the greatest depth, until pieces of
LEAF turns are left, which are named whole. Totals then go back the same way: first within the pieces, and then, round
by round, the total of each lower forest is grafted onto its cut node and that node's ancestors within the upper trie.

A node's name is the exclusive-or of hashes of its turns, each hashed with its depth: two 64-bit halves, from the MD5 of
role and text. It does not depend on where sequences were cut, and parts of a sequence can be summed apart. No
conversation is ever gathered in one row or one task: turns are numbered by ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

#: Turns of a piece that is named without another cut.
LEAF = 4
#: Conversation ids that agree but for this many bits are put in one string before they are hashed in order.
STRETCH_BITS = 12
NAME = ["name_a", "name_b"]


def turns(df: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_hash, words, n_turns of every row of a conversation table, in order of turn.

    Null turns come first; equal turns are in order of role and text, of which the first 32 and 64 characters count, then
    their hash. A null role or text counts as empty. Rows without a conv_id are left out. Rows are put in ranges of this
    order and numbered within them; a conversation that goes on in another range starts there after the rows it has
    before, so a long one is spread over tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = df.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.left(role, F.lit(32)).alias("role"), F.left(text, F.lit(64)).alias("head"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_hash"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("turn_hash")]
    # repeated rows are told apart, so that they can lie in several ranges
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order, "row")
    dealt = written(dealt.select("conv_id", "turn_hash", "words", F.monotonically_increasing_id().alias("at")), "turns").withColumn("range", F.shiftright("at", 33))
    runs = dealt.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of = Window.partitionBy("conv_id")  # a row for each range that a conversation lies in
    runs = runs.select("conv_id", "range", "first", (F.sum("n").over(of.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(of).alias("n_turns"))
    return dealt.join(runs, ["conv_id", "range"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "turn_hash", "words", "n_turns")


def regrown(rows: DataFrame, shared: int = 20, at_most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another one does: sequences (conv_id, depth, turn_hash, words) and lengths (conv_id, length).

    Conversation c takes the first h = crc32(c) mod ``at_most`` turns of conversation c - c % ``shared`` (as many as it
    has), and then its own turns after its first h. ``rows`` is what ``turns`` gives.
    """
    known = rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"))
    c = F.col("conv_id")
    known = known.select("conv_id", "n_turns", (F.crc32(c.cast("string")) % at_most).alias("h"), (c - c % shared).alias("base"))
    bases = known.filter("conv_id = base").select("base", F.col("n_turns").alias("n_base"))
    known = known.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    known = known.withColumn("length", F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0)))
    known = written(known.select("conv_id", "base", "h", "taken", "length"), "lengths")
    heads = rows.filter(F.col("place") < at_most).select(F.col("conv_id").alias("base"), "place", "turn_hash", "words").join(known.filter("taken > 0"), "base").filter("place <= taken")
    own = rows.join(known.select("conv_id", "h", "taken"), "conv_id").filter("place > h")
    both = heads.select("conv_id", F.col("place").alias("depth"), "turn_hash", "words").union(own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "turn_hash", "words"))
    return both, known.select("conv_id", "length")


def _xor(what: str) -> Column:
    return F.bit_xor(what).alias(what)


def _of(depth: str, size: int) -> Column:
    """The piece of ``size`` turns that a depth lies in."""
    return F.floor((F.col(depth) - 1) / size)


def named(rows: DataFrame, deepest: int, leaf: int = LEAF) -> DataFrame:
    """``rows`` (conv_id, depth, turn_hash, words) with the names of each prefix (name_a, name_b) and of the one before it (up_a, up_b).

    The rounds of cuts work on one row for each piece of a conversation, not on its turns.
    """
    placed = rows.withColumns({"a": F.xxhash64(F.lit(1), F.col("depth").cast("long"), "turn_hash"), "b": F.xxhash64(F.lit(2), F.col("depth").cast("long"), "turn_hash")}).drop("turn_hash")
    placed = written(placed.withColumn("piece", _of("depth", leaf)), "sequences")
    w = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumns({"in_a": F.bit_xor("a").over(w), "in_b": F.bit_xor("b").over(w)})
    n_pieces = (deepest - 1) // leaf + 1
    if n_pieces <= 1:
        roots = inside.withColumns({"root_a": F.lit(0).cast("long"), "root_b": F.lit(0).cast("long")})
    else:
        pieces = written(placed.groupBy("conv_id", "piece").agg(_xor("a"), _xor("b")), "pieces")
        # the name of the prefix above each piece: at every cut, a lower piece takes on the sum of the upper half beside it
        tops = pieces.select("conv_id", "piece", F.lit(0).cast("long").alias("root_a"), F.lit(0).cast("long").alias("root_b")).filter("piece > 0")
        for k in range((n_pieces - 1).bit_length()):
            half = F.shiftright("piece", k)
            upper = pieces.filter(half % 2 == 0).groupBy("conv_id", F.shiftright("piece", k + 1).alias("tree")).agg(_xor("a"), _xor("b"))
            lower = half % 2 == 1
            tops = tops.withColumn("tree", F.shiftright("piece", k + 1)).join(upper, ["conv_id", "tree"], "left")
            take = lambda x: F.col(f"root_{x}").bitwiseXOR(F.when(lower, F.coalesce(x, F.lit(0))).otherwise(F.lit(0)).cast("long")).alias(f"root_{x}")  # noqa: B023, E731
            tops = tops.select("conv_id", "piece", take("a"), take("b"))
        roots = inside.join(tops, ["conv_id", "piece"], "left").withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in ("root_a", "root_b")})
    full = {f"name_{x}": F.col(f"root_{x}").bitwiseXOR(F.col(f"in_{x}")) for x in "ab"}
    return roots.withColumns(full).select("conv_id", "depth", "words", *NAME, *[F.col(f"name_{x}").bitwiseXOR(F.col(x)).alias(f"up_{x}") for x in "ab"])


def _grafted(weights: DataFrame, paths: DataFrame, size: int) -> DataFrame:
    """name_a, name_b, leaves, saved: weights (conv_id, depth, leaves, saved) of nodes added up at all their ancestors in their piece.

    The path of the node's smallest member leads through all of them; the node itself counts as one.
    """
    side = weights.select("conv_id", F.col("depth").alias("at"), _of("depth", size).alias("piece"), "leaves", "saved")
    path = paths.select("conv_id", "depth", *NAME, _of("depth", size).alias("piece"))
    met = path.join(side, ["conv_id", "piece"]).filter("depth <= at")
    return met.groupBy(*NAME).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _ends(last: DataFrame) -> DataFrame:
    """name_a, name_b, ends_sha256 of the conversations (conv_id) that end at a node, in rising order of id.

    Ids are put together by stretches of the number line, so a task reads a row for many of them, and hashes them one
    stretch after the other.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = last.groupBy(*NAME, F.shiftright("conv_id", STRETCH_BITS).alias("stretch")).agg(ids.alias("ids"))
    ordered = pieces.repartition(*NAME).sortWithinPartitions(*NAME, "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, done = None, None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=[*NAME, "ends_sha256"])
        for batch in batches:
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (a, b) != name:
                    if name is not None:
                        done.append((*name, digest.hexdigest()))
                    name, digest = (a, b), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if len(done) >= 1000:
                yield out()
                done = []
        if name is not None:
            done.append((*name, digest.hexdigest()))
        yield out()

    return ordered.mapInArrow(run, "name_a long, name_b long, ends_sha256 string")


def nodes(sequences: DataFrame, lengths: DataFrame, leaf: int = LEAF) -> DataFrame:
    """One row per different prefix of the sequences (conv_id, depth, turn_hash, words), the empty one (depth 0) included.

    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves
    (nodes without children in the subtree), saved_tokens (over the subtree: members less one, times the words of the
    last turn) and ends_sha256 (of the ids of members that end there). ``lengths`` (conv_id, length) names every member,
    also those without turns. Without members there is no root either.
    """
    deepest = lengths.agg(F.max("length")).first()[0]
    if deepest is None:
        return sequences.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    paths = written(named(sequences, max(deepest, 1), leaf), "paths")
    every = paths.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("depth", "words", "up_a", "up_b")])
    every = written(every, "nodes")
    up = [F.col("up_a").alias("name_a"), F.col("up_b").alias("name_b")]
    children = every.filter("depth > 1").groupBy(*up).agg(F.count("*").alias("n_children"))
    every = written(every.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")

    # totals within pieces, then of each lower forest at its cut and above
    own = every.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = written(_grafted(own, paths, leaf), "totals")
    size = leaf
    while size < deepest:
        cut = F.col("depth") % (2 * size) == size
        tops = every.filter((F.col("depth") - 1) % (2 * size) == size).select(*NAME, "up_a", "up_b").join(totals, NAME)
        forest = tops.groupBy(*up).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        weights = every.filter(cut).select("conv_id", "depth", *NAME).join(forest, NAME)
        more = _grafted(weights, paths.filter(_of("depth", size) % 2 == 0), 2 * size)
        totals = written(totals.union(more).groupBy(*NAME).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "totals")
        size *= 2

    last = paths.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("conv_id", *NAME)
    zero = F.lit(0).cast("long")
    last = last.union(lengths.filter("length = 0").select("conv_id", zero, zero))
    ends = _ends(last)
    empty = F.lit(hashlib.sha256(b"").hexdigest())

    whole = every.join(totals, NAME)
    first = whole.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).crossJoin(first)  # one row each
    root = root.select(zero.alias("name_a"), zero.alias("name_b"), "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"))
    smallest = lengths.agg(F.min("conv_id")).first()[0]
    parents = every.select(F.col("name_a").alias("up_a"), F.col("name_b").alias("up_b"), F.col("conv_id").alias("parent"))
    below = whole.filter("depth > 1").join(parents, ["up_a", "up_b"]).unionByName(whole.filter("depth = 1").withColumn("parent", F.lit(smallest).cast("long")))
    below = below.select(*NAME, "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    out = root.unionByName(below).join(ends, NAME, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return out.drop(*NAME)


def prefix_trie(df: DataFrame, shared: int = 20, at_most: int = 4, leaf: int = LEAF) -> DataFrame:
    """The trie of all conversations of ``df`` (conv_id, turn, role, text), each begun as the first of its ``shared`` ids begins.

    See ``turns`` for order, ties, nulls and repeated rows (each is a turn), ``regrown`` for the beginnings, ``nodes`` for
    the columns. Texts and conversations may be of any length; columns other than the four are not read; a table
    without conversations gives no node.
    """
    sequences, lengths = regrown(turns(df), shared, at_most)
    return nodes(sequences, lengths, leaf)
