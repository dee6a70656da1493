"""Summaries: rank correlation, bootstrap intervals, pivots and group tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """Rank in rising order, equal values sharing the mean of their ranks."""
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def _correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation; null where a side is constant."""
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def spearman(df: DataFrame, a: str, b: str, by: list[str], out: str = "spearman") -> DataFrame:
    """Rank correlation of two columns within each group; null where one is constant."""
    ranked = df.withColumns({"_a": average_rank(a, *by), "_b": average_rank(b, *by)})
    return ranked.groupBy(*by).agg(_correlation("_a", "_b").alias(out))


def _ranked(df: DataFrame, value: str) -> DataFrame:
    """value and its average rank, one row per different value of a table, nulls left out.

    Values are counted, put in ranges in order, and summed within each; a range's rows begin after those of the ranges
    before, whose sums (one row a range) are all that one task sees.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).repartitionByRange(value)
    counts = counts.withColumn("part", F.spark_partition_id())
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(value)) - F.col("n")
    sums = counts.groupBy("part").agg(F.sum("n").alias("m"))
    before = sums.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
    return counts.withColumn("inside", inside).join(F.broadcast(before), "part").select(value, (F.col("before") + F.col("inside") + (F.col("n") + 1) / 2).alias("rank"))


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, spearman over the whole table: ranks are looked up by value and correlated in wide rows, pair by pair.

    A row takes part in a pair where both its values are there; ranks are those among all values of a column.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    wide = rows
    for c in columns:
        ranks = _ranked(rows, c)
        wide = wide.join(ranks.select(F.col(c).alias("_v"), F.col("rank").alias(f"{c}_rank")), wide[c] == F.col("_v"), "left").drop("_v")
    pairs = [(a, b) for a in columns for b in columns]
    both = lambda a, b, x: F.when(F.col(f"{a}_rank").isNotNull() & F.col(f"{b}_rank").isNotNull(), F.col(f"{x}_rank"))
    one = wide.agg(*[_correlation(both(a, b, a), both(a, b, b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    told = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("spearman")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*told)))


#: Shares of a Poisson(1) variable that are at most 0, 1, 2, ...
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


#: Groups whose sums a task holds at once, and rows whose weights are drawn at once.
GROUPS, DRAWN = 1024, 1024


def _weights(keys: list[str | None], resamples: int, seed: int) -> np.ndarray:
    """Weights [key, resample] from Poisson(1), after a first column of ones: four share the md5 of seed, their number and the key."""
    hashes = b"".join(hashlib.md5("|".join([str(seed), str(b), *([] if k is None else [k])]).encode()).digest() for k in keys for b in range((resamples + 3) // 4))
    drawn = np.frombuffer(hashes, ">u4").astype(np.uint32).reshape(len(keys), -1)[:, :resamples]
    out = np.ones((len(keys), resamples + 1))
    # a share of 2^32 is exact in double precision
    out[:, 1:] = sum((drawn >= np.uint32(np.ceil(c * 2.0**32)) for c in POISSON), np.zeros(drawn.shape, np.uint8))
    return out


def bootstrap(df: DataFrame, value: str, by: list[str], resamples: int = 2000, seed: int = 0, key: str | None = None) -> DataFrame:
    """by, mean, ci_lo, ci_hi: percentiles 2.5 and 97.5 of the means of resamples.

    Each row gets a Poisson(1) weight per resample from a hash of the seed, its key and the resample, four of which
    share a hash; a key's weights are drawn once for all its rows, and only their sums leave a task. ``key`` names a
    row, or else all its columns do: rows that share them are drawn together. Rows without a value or a group are left
    out.
    """
    named = F.col(key).cast("string") if key else F.xxhash64(*df.columns).cast("string")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    rows = df.filter(F.col(value).isNotNull()).dropna(subset=by).select(named.alias("_key"), group.alias("_by"), F.to_json(group).alias("_g"), F.col(value).cast("double").alias("_x"))
    # each narrow row is drawn hundreds of times, so they are dealt evenly first
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key").sortWithinPartitions("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[pa.Array, np.ndarray]] = {}

        def told() -> pa.RecordBatch:
            groups, sums = zip(*held.values(), strict=True)
            held.clear()
            ends = np.arange(len(sums) + 1, dtype=np.int32) * (resamples + 1)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(groups), *(pa.ListArray.from_arrays(ends, np.concatenate([x[i] for x in sums])) for i in (0, 1))], names=["_by", "s", "n"])

        for whole in batches:
            for at in range(0, len(whole), DRAWN):
                part = whole.slice(at, DRAWN)
                keys, groups = (part.column(c).dictionary_encode() for c in ("_key", "_g"))
                drawn = _weights([*keys.dictionary.to_pylist(), *([None] if keys.null_count else [])], resamples, seed)
                place, code = keys.indices.fill_null(len(keys.dictionary)).to_numpy(), groups.indices.to_numpy()
                x = part.column("_x").to_numpy()
                for i, g in enumerate(groups.dictionary.to_pylist()):
                    of = np.flatnonzero(code == i)
                    w = drawn[place[of]]
                    first, sums = held.get(g) or (part.column("_by").slice(of[0], 1), 0.0)
                    held[g] = first, sums + np.stack([x[of] @ w, w.sum(0)])
                    if len(held) >= GROUPS:
                        yield told()
        if held:
            yield told()

    told = dealt.mapInArrow(run, f"_by {rows.schema['_by'].dataType.simpleString()}, s array<double>, n array<double>")
    sums = told.select("_by.*", F.posexplode(F.arrays_zip("s", "n")).alias("_k", "_z")).groupBy(*by, "_k").agg(F.sum("_z.s").alias("s"), F.sum("_z.n").alias("n")).filter("n > 0")
    end = lambda p: F.expr(f"percentile(CASE WHEN _k > 0 THEN s / n END, {p})")
    return sums.groupBy(*by).agg(F.max(F.expr("CASE WHEN _k = 0 THEN s / n END")).alias("mean"), end(0.025).alias("ci_lo"), end(0.975).alias("ci_hi"))


def wide_means(df: DataFrame, by: str, across: str, values: list[str], metrics: list[str]) -> DataFrame:
    """One row per value of ``by``, with the mean of each metric for each listed value of ``across`` in a column <value>_<metric>."""
    mean = lambda v, m: F.avg(F.when(F.col(across) == v, F.col(m).cast("double"))).alias(f"{v}_{m}")
    return df.groupBy(by).agg(*[mean(v, m) for v in values for m in metrics])


def intervals(df: DataFrame, by: list[str], metrics: list[str], key: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """by, metric, mean, ci_lo, ci_hi: the bootstrap interval of every metric in every group, in one pass."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    return bootstrap(df.select(*by, key, F.inline(each)), "x", [*by, "metric"], resamples, seed, key)


def signal_summary(df: DataFrame, group: str, variants: list[str], cut: float = 1.645) -> DataFrame:
    """Per group and over all: variant, n, median z, share of z above the cut. ``variants`` are columns of z."""
    long = df.select(group, F.explode(F.map_from_arrays(F.array(*map(F.lit, variants)), F.array(*[F.col(v).cast("double") for v in variants]))).alias("variant", "z"))
    both = long.select(F.explode(F.array(F.col(group).cast("string"), F.lit("All"))).alias("group"), "variant", "z")
    return both.groupBy("group", "variant").agg(F.count("z").alias("n"), F.expr("percentile(z, 0.5)").alias("median_z"), F.avg((F.col("z") > cut).cast("double")).alias("share"))


def crosstab_shares(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """One row per value of ``row`` with the share of each listed value of ``column``; missing ones are 0."""
    counts = df.groupBy(row).pivot(column, values).count().fillna(0)
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return counts.select(row, *[(F.col(f"`{v}`") / total).alias(v) for v in values])


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, sample deviation, least, quartiles and largest of a column."""
    p = lambda q: F.expr(f"percentile({value}, {q})")
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"), F.max(value).alias("largest"))


def spread_by_task(df: DataFrame, task: str, template: str, alone: str) -> DataFrame:
    """Per task: n, mean spread of either variant, and their ratio, in order of the first."""
    out = df.groupBy(task).agg(F.count("*").alias("n"), F.avg(template).alias("template"), F.avg(alone).alias("alone"))
    return out.withColumn("compression", F.col("template") / F.col("alone")).orderBy("template")
