"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask is a window of tokens of which only some places count, so a seed still matches where ignored tokens were
exchanged. The masked hashes of all token positions of the texts are joined with those of the benchmark. Around each
hit the two texts are laid side by side, and the pair counts as an overlap if some stretch of ``stretch`` tokens (or
the whole item, if shorter) agrees in at least ``share`` of its places.

The masks are chosen so that, with the given stretch and share, every pattern of exchanged tokens that still counts
leaves some mask whole: nothing that the rule finds is lost (see ``recall``). Items of fewer than SHORT tokens have no
room for them; these are looked up whole, by a hash of all their tokens. Items of fewer than LEAST tokens ("yes", "the
same") are everyday words, which say nothing about where a text is from: they are passed over, and ``passed_over`` names
them.

Texts are cut into pieces of PIECE positions with the tokens about them, and a hit takes along only the tokens that it
is compared by, so the hits that a task holds at once are those of a piece, however long a text is and however often it
repeats a passage.

A benchmark whose seeds fit in every task is sent there, and the texts never move. A larger one is joined by seed, for
which only positions and hashes are shuffled, and the pieces that have a hit are then joined with their hits.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import let
from tidemark.llm.shared import sent_if_small

#: Places of a window that count. Found by a search for few masks that leave no pattern of at most 2 of 9, 10 or 11, or
#: 3 of 12 or 13 exchanged tokens without a hit.
MASKS = [(0, 1, 2, 4, 5), (0, 1, 3, 7, 8), (0, 1, 4, 6, 7), (0, 3, 4, 5, 6), (0, 3, 4, 6, 8)]
#: Places that several masks share, and those masks: looked up first, so that few positions are hashed under every mask.
STEMS = [((0, 1), (0, 1, 2)), ((0, 3, 4), (3, 4))]
#: Items of fewer tokens are looked up whole, or, of fewer than LEAST, not at all.
SHORT, LEAST = 9, 4
_LEAST_SPAN = min(m[-1] + 1 for m in MASKS)
_SPAN = max(m[-1] + 1 for m in MASKS)
#: Positions of a piece of a text.
PIECE = 512
WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD), "")


def least(width: int, share: float) -> int:
    """Agreeing places that a stretch of ``width`` needs."""
    return math.ceil(width * share - 1e-9)


def recall(width: int, share: float) -> float:
    """Share of the patterns of exchanged tokens, as many as the rule allows, that leave a mask whole."""
    patterns = list(combinations(range(width), width - least(width, share)))
    hit = sum(any(all(at + p not in bad for p in mask) for mask in MASKS for at in range(width - mask[-1])) for bad in map(set, patterns))
    return hit / len(patterns)


def _hashed(w: Column, k: Column, places: tuple[int, ...], salt: int) -> Column:
    """Hash of the tokens at k plus each place; null where the text ends before."""
    return F.when(k + places[-1] < F.size(w), F.xxhash64(F.lit(salt), *[F.get(w, k + p) for p in places]))


def _stems(w: Column, k: Column) -> Column:
    return F.array(*[_hashed(w, k, places, -1 - i) for i, (places, _) in enumerate(STEMS)])


def _seeds(w: Column, k: Column, stem: Column) -> Column:
    """Hashes under the masks of the stem of that number."""
    of = [F.array(*[_hashed(w, k, MASKS[m], m) for m in masks]) for _, masks in STEMS]
    out = of[-1]
    for i in reversed(range(len(of) - 1)):
        out = F.when(stem == i, of[i]).otherwise(out)
    return out


def _positions(w: Column) -> Column:
    return F.sequence(F.lit(0), F.size(w) - _LEAST_SPAN)


def _reach(stretch: int) -> int:
    """Tokens of an item about a hit, the first of which lies at most ``stretch`` before it."""
    return 2 * stretch + _SPAN


def _pieces(docs: DataFrame, stretch: int) -> DataFrame:
    """``docs`` with w a piece of the tokens; its ``n`` positions from ``first`` on are those that no other piece has."""
    w = F.col("w")
    cut = lambda i: F.struct(i.alias("piece"), F.least(i, F.lit(stretch)).alias("first"), F.least(F.size(w) - i, F.lit(PIECE)).alias("n"), F.slice(w, F.greatest(i - stretch, F.lit(0)) + 1, F.least(i, F.lit(stretch)) + PIECE + _reach(stretch)).alias("w"))
    pieces = F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(PIECE)), cut)
    return docs.select(*[c for c in docs.columns if c != "w"], F.inline(pieces))


def _piece_positions(w: Column) -> Column:
    """Positions of a piece that have room for a mask; none in a last piece that is shorter."""
    last = F.least(F.col("first") + F.col("n") - 1, F.size(w) - _LEAST_SPAN)
    return F.when(last >= F.col("first"), F.sequence("first", last))


def _about(w: Column, k: Column, stretch: int) -> tuple[Column, Column]:
    """The tokens that a hit at k is compared by, and its place among them."""
    left = F.least(k, F.lit(stretch))
    return F.slice(w, k - left + 1, left + _reach(stretch)), left


def _best(a: Column, b: Column, width: Column) -> Column:
    """The most agreeing places in any stretch of ``width`` of two equally long token arrays; null if they are shorter."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    sums = F.aggregate(same, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return let(sums, lambda s: F.when(F.size(s) > width, F.array_max(F.transform(F.sequence(F.lit(0), F.size(s) - 1 - width), lambda i: s[i + width] - s[i]))))


def _agreeing(w: Column, k: Column, near: Column, lead: Column, width: Column) -> Column:
    """The best stretch of a text and ``near``, laid so that position k of the one meets ``lead`` of the other."""
    left = F.least(lead, k)
    right = F.least(F.size(near) - lead, F.size(w) - k)
    return _best(F.slice(w, k - left + 1, left + right), F.slice(near, lead - left + 1, left + right), width).cast("long")


def overlaps(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", stretch: int = 13, share: float = 0.75, broadcast_rows: int = 200_000, shortest: int = LEAST) -> DataFrame:
    """One row per doc_id and overlapping benchmark text: doc_id, item_id, n_items, n_tokens.

    Benchmark items with the same tokens are one text, named by its smallest id (null only if none has one), with
    n_items copies. n_tokens is the number of agreeing places of the best stretch; items of fewer than SHORT tokens
    must occur whole, those of fewer than ``shortest`` have no row (see ``passed_over``). Null texts are empty; texts and items without tokens have no row; repeated rows give one row;
    other columns are not read.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("b")).filter(F.size("b") >= max(shortest, 1))
    items = items.groupBy("b").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    long = items.filter(F.size("b") >= SHORT)
    # a few numbers: how many seeds there are, and which lengths short items have
    m = F.size("b")
    seeds, lengths, short = items.agg(F.coalesce(F.sum(F.when(m >= SHORT, m - _LEAST_SPAN + 1)), F.lit(0)) * len(MASKS), F.collect_set(F.when(m < SHORT, m)), F.count_if(m < SHORT)).first()
    docs = df.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("w"))
    found = _sent(docs.filter(F.size("w") >= SHORT), long, stretch, share) if seeds <= broadcast_rows else _dealt(docs.filter(F.size("w") >= SHORT), long, stretch, share)
    if lengths:
        found = found.union(_whole(docs, items.filter(m < SHORT), sorted(lengths), short <= broadcast_rows))
    return found


def passed_over(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", shortest: int = LEAST) -> DataFrame:
    """item_id and n_tokens of the benchmark items that are too short to be looked for."""
    return benchmark.select(F.col(item_id).alias("item_id"), F.size(tokens(F.col(item_text))).alias("n_tokens")).filter(F.col("n_tokens") < shortest)


def _passed(hits: DataFrame, agreeing: Column, width: Column, share: float) -> DataFrame:
    # the check comes after the sum: as a filter below it, it would move into the join and take the whole texts along
    found = hits.groupBy("doc_id", "item_id", "b_key", width.alias("width")).agg(F.max("n_items").alias("n_items"), F.max(agreeing).alias("n_tokens"))
    return found.filter(F.col("n_tokens") >= F.ceil(F.col("width") * F.lit(share) - 1e-9)).select("doc_id", "item_id", "n_items", "n_tokens")


def _placed(items: DataFrame) -> DataFrame:
    """Items by position and stem; items without an id are told apart by ``b_key``."""
    at = items.withColumn("b_key", F.xxhash64("b")).select("b", "b_key", "item_id", "n_items", F.explode(_positions(F.col("b"))).alias("p"))
    return at.select("*", F.posexplode(_stems(F.col("b"), F.col("p"))).alias("stem", "stem_hash")).filter("stem_hash IS NOT NULL")


def _sent(docs: DataFrame, items: DataFrame, stretch: int, share: float) -> DataFrame:
    """Overlaps with a benchmark whose seeds fit in every task."""
    placed = _placed(items)
    # what lies within reach of a hit, and where in it the hit begins
    start = F.greatest(F.col("p") - stretch, F.lit(0))
    seeds = placed.select("item_id", "b_key", "n_items", F.size("b").alias("m"), F.slice("b", start + 1, F.lit(_reach(stretch))).alias("near"), (F.col("p") - start).alias("lead"), F.explode(_seeds(F.col("b"), F.col("p"), F.col("stem"))).alias("seed")).filter("seed IS NOT NULL")
    stems = placed.select("stem_hash").distinct()

    w, k = F.col("w"), F.col("k")
    places = _pieces(docs.select("doc_id", "w"), stretch).select("doc_id", "w", F.explode(_piece_positions(w)).alias("k"))
    likely = places.select("doc_id", "w", "k", F.posexplode(_stems(w, k)).alias("stem", "stem_hash")).join(F.broadcast(stems), "stem_hash", "left_semi")
    hits = likely.select("doc_id", "w", "k", F.explode(_seeds(w, k, F.col("stem"))).alias("seed")).join(F.broadcast(seeds), "seed")
    near, place = _about(w, k, stretch)
    hits = hits.select("doc_id", "item_id", "b_key", "n_items", "m", "near", "lead", near.alias("w"), place.alias("k"))
    width = F.least(F.col("m"), F.lit(stretch))
    return _passed(hits, _agreeing(w, k, F.col("near"), F.col("lead"), width), width, share)


def _dealt(docs: DataFrame, items: DataFrame, stretch: int, share: float) -> DataFrame:
    """The same for a benchmark of any size: positions are shuffled by seed, then hits by text."""
    placed = _placed(items)
    seeds = placed.select("b_key", "p", F.explode(_seeds(F.col("b"), F.col("p"), F.col("stem"))).alias("seed")).filter("seed IS NOT NULL")
    w, k = F.col("w"), F.col("k")
    key = F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), w)))
    named = _pieces(docs.select("doc_id", key.alias("key"), "w"), stretch)
    places = named.select("key", "piece", "w", F.explode(_piece_positions(w)).alias("k"))
    stemmed = places.select("key", "piece", "w", "k", F.explode(F.sequence(F.lit(0), F.lit(len(STEMS) - 1))).alias("stem"))
    asked = stemmed.select("key", "piece", "k", F.explode(_seeds(w, k, F.col("stem"))).alias("seed")).filter("seed IS NOT NULL")
    hits = asked.join(seeds, "seed").select("key", "piece", "b_key", "k", "p").distinct()
    tokens_about, place = _about(w, k, stretch)
    cut = named.join(hits, ["key", "piece"]).select("doc_id", "b_key", "p", tokens_about.alias("w"), place.alias("k"))
    full = cut.join(items.withColumn("b_key", F.xxhash64("b")), "b_key")
    start = F.greatest(F.col("p") - stretch, F.lit(0))
    near, lead = F.slice("b", start + 1, F.lit(_reach(stretch))), F.col("p") - start
    full = full.select("doc_id", "item_id", "b_key", "n_items", F.size("b").alias("m"), near.alias("near"), lead.alias("lead"), "w", "k")
    width = F.least(F.col("m"), F.lit(stretch))
    return _passed(full, _agreeing(w, k, F.col("near"), F.col("lead"), width), width, share)


def _whole(docs: DataFrame, items: DataFrame, lengths: list[int], send: bool) -> DataFrame:
    """Texts that hold all tokens of a short item in a row; ``lengths`` are those of the items."""
    run = lambda a, k, n: F.when(k + n <= F.size(a), F.xxhash64(F.lit(n), F.slice(a, k + 1, F.lit(n))))
    w, k = F.col("w"), F.col("k")
    asked = items.select("item_id", "n_items", "b", F.xxhash64(F.size("b"), "b").alias("seed"))
    places = docs.filter(F.size(w) > 0).select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size(w) - 1)).alias("k"))
    # of the text, a row takes along no more than an item may have
    hashed = places.select("doc_id", F.slice(w, k + 1, F.lit(max(lengths))).alias("w"), F.explode(F.array(*[run(w, k, n) for n in lengths])).alias("seed"))
    hits = hashed.join(F.broadcast(asked) if send else asked, "seed")
    same = F.slice(w, 1, F.size("b")) == F.col("b")
    found = hits.groupBy("doc_id", "item_id", "b", "n_items").agg(F.max(same).alias("same")).filter("same")
    return found.select("doc_id", "item_id", "n_items", F.size("b").cast("long").alias("n_tokens"))


def decontaminate(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``df`` without the rows whose text overlaps a benchmark text; see overlaps(). Rows may share an id or have none."""
    # a text is known by its hash; few overlap: the hashes are counted, and the texts stay where they lie if they can be sent
    keyed = df.withColumn("_of_text", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    bad = sent_if_small(overlaps(keyed, benchmark, doc_id="_of_text", text=text, **how).select(F.col("doc_id").alias("_bad")).distinct(), "overlaps")
    return keyed.join(bad, keyed["_of_text"] == bad["_bad"], "left_anti").drop("_of_text")
