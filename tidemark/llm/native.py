"""Column expressions that several native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a running sum adds up in one go; arrays are summed by blocks, so the work stays near linear.
BLOCK = 512


def let(value: Column, body) -> Column:
    """``body`` of a column that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, more) -> Column:
    zero = F.struct(F.lit(None).cast("long").alias("total"), F.array().cast("array<bigint>").alias("all"))
    # ``more`` skips the null that it starts from
    step = lambda acc, x: let(more(acc["total"], x), lambda t: F.struct(t.alias("total"), F.concat(acc["all"], F.array(t)).alias("all")))
    return F.aggregate(values, zero, step, lambda acc: acc["all"])


def _by_blocks(values: Column, more) -> Column:
    starts = lambda v: F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = lambda v: F.transform(starts(v), lambda b: _running(F.slice(v, b + 1, F.lit(BLOCK)), more))
    before = lambda bs: _running(F.transform(bs, lambda x: F.element_at(x, -1)), more)
    # what comes before a block is looked up once for the block
    joined = lambda bs: let(before(bs), lambda p: F.flatten(F.transform(bs, lambda x, i: let(F.get(p, i - 1), lambda c: F.transform(x, lambda y: more(c, y))))))
    return let(values, lambda v: let(blocks(v), joined))


def running_sum(values: Column) -> Column:
    """array<bigint> -> sums of the first 1, 2, ... elements; an empty array stays empty."""
    return _by_blocks(values, lambda total, x: F.coalesce(total, F.lit(0).cast("long")) + x)


def running_max(values: Column) -> Column:
    """array<bigint> -> the largest of the first 1, 2, ... elements; an empty array stays empty."""
    return _by_blocks(values, lambda total, x: F.greatest(total, x))


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of a pattern's leftmost matches that don't overlap, in code points.

    The text between matches and the matches alternate, so their lengths give the places. The pattern must not match
    the empty string.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))

    def places(matches: Column) -> Column:
        sizes = F.transform(matches, lambda m: F.length(m).cast("long"))
        ends = running_sum(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), sizes, lambda g, n: g + n))
        return F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>"))


#: Characters of the pieces that a text is cut into before parts of it are taken.
PIECE = 1024


def cut_out(text: Column, begins: Column, ends: Column) -> Column:
    """Parts of a text from begins to ends (code points), in time that grows with the text and not with its square."""

    def parts(pieces: Column) -> Column:
        def part(b: Column, e: Column) -> Column:
            first, last = F.floor(b / PIECE).cast("int"), F.floor(e / PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            return F.when(e > b, F.substring(some, (b - first * PIECE + 1).cast("int"), (e - b).cast("int"))).otherwise(F.lit(""))

        return F.zip_with(begins, ends, part)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), parts)
