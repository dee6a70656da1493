"""Stratified samples, splits and caps. Order is by a hash of a seed and the id, so every choice can be repeated.

Where at most n rows of a stratum are wanted, a row's rank is held against that number itself: for numbers up to
spark.sql.optimizer.windowGroupLimitThreshold (1000) Spark then keeps n rows of each stratum in every task before it shuffles,
so no stratum is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: str | Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def zero_pad(x: Column, width: int = 3) -> Column:
    """At least ``width`` characters; longer strings stay whole."""
    return F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def first_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def allocate(strata: DataFrame, n: int, least: int = 0, key: str = "stratum") -> DataFrame:
    """``strata`` (key, size) with ``quota``: ``least`` each, and the rest in proportion to what is left of each.

    Rests are given by largest remainder, of equal ones to the larger stratum, then by key. A stratum smaller than
    ``least``, or an n that does not fit, is an error.
    """
    total, smallest, count = strata.agg(F.coalesce(F.sum("size"), F.lit(0)), F.min("size"), F.count("*")).first()
    if count and smallest < least:
        raise ValueError(f"a stratum has {smallest} rows, fewer than {least}")
    if n < least * count or n > total:
        raise ValueError(f"{n} rows cannot be drawn from {count} strata of {total} rows with {least} at least")
    left, capacity = n - least * count, total - least * count
    if capacity == 0:
        return strata.withColumn("quota", F.lit(least).cast("long"))
    share = (F.col("size") - least) * left
    rows = strata.withColumns({"_base": F.floor(share / F.lit(capacity)) if left else F.lit(0), "_rest": share % F.lit(capacity)})
    given = rows.agg(F.sum("_base")).first()[0]
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), F.desc("size"), key))  # one row per stratum
    return rows.withColumn("quota", (F.lit(least) + F.col("_base") + (rank <= left - given).cast("long")).cast("long")).drop("_base", "_rest")


def smallest(df: DataFrame, by: list[str], id_: str, n: int, seed: int, rank: str = "_rn") -> DataFrame:
    """The first n rows of each group in seeded order, with their rank."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(seeded(id_, seed), id_))
    return df.withColumn(rank, place).filter(F.col(rank) <= n)


def take_quota(df: DataFrame, quotas: DataFrame, key: str, id_: str, seed: int) -> DataFrame:
    """``quota`` rows of each stratum, by the seeded order."""
    most = quotas.agg(F.max("quota")).first()[0] or 0
    rows = smallest(df, [key], id_, most, seed)
    return rows.join(quotas.select(key, "quota"), key).filter(F.col("_rn") <= F.col("quota")).drop("_rn", "quota")


def stratified(df: DataFrame, outer: str, inner: str, id_: str, n: int, least: int, seed: int) -> DataFrame:
    """Two-level sample: quotas by ``outer``; within it first one row of each ``inner`` (in seeded order, as many as
    fit), then the rest in proportion."""
    quotas = allocate(df.groupBy(outer).agg(F.count("*").alias("size")), n, least, outer)
    cells = df.groupBy(outer, inner).agg(F.count("*").alias("size")).join(quotas.select(outer, "quota"), outer)
    order = F.row_number().over(Window.partitionBy(outer).orderBy(seeded(inner, seed), inner))
    cells = cells.withColumn("_first", (order <= F.col("quota")).cast("long"))
    w = Window.partitionBy(outer)
    rest, room = F.col("quota") - F.sum("_first").over(w), F.sum(F.col("size") - F.col("_first")).over(w)
    cells = cells.withColumns({"_left": rest, "_room": room}).withColumn("_share", (F.col("size") - F.col("_first")) * F.col("_left"))
    cells = cells.withColumns({"_base": F.when(F.col("_room") > 0, F.floor(F.col("_share") / F.greatest("_room", F.lit(1)))).otherwise(0), "_rest": F.when(F.col("_room") > 0, F.col("_share") % F.greatest("_room", F.lit(1))).otherwise(0)})
    more = F.row_number().over(w.orderBy(F.desc("_rest"), F.desc(F.col("size") - F.col("_first")), inner)) <= F.col("_left") - F.sum("_base").over(w)
    cells = cells.withColumn("take", F.col("_first") + F.col("_base") + more.cast("long")).select(outer, inner, "take")
    # no cell takes more than n; the cells may be many, so Spark chooses how they are joined
    return smallest(df, [outer, inner], id_, n, seed).join(cells, [outer, inner]).filter(F.col("_rn") <= F.col("take")).drop("_rn", "take")


def split(df: DataFrame, stratum: str, id_: str, n: int, seed: int) -> DataFrame:
    """``df`` with ``split``: dev for the first n ids of each stratum in seeded order, test for the rest.

    Only the ids of dev are ranked; the others are those not among them.
    """
    dev = smallest(df.select(stratum, id_).distinct(), [stratum], id_, n, seed).select(F.col(stratum).alias("_s"), F.col(id_).alias("_i"), F.lit("dev").alias("split"))
    rows = df.join(dev, F.col(stratum).eqNullSafe(F.col("_s")) & F.col(id_).eqNullSafe(F.col("_i")), "left").drop("_s", "_i")
    return rows.withColumn("split", F.coalesce("split", F.lit("test")))


def at_most(df: DataFrame, stratum: str, id_: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each stratum, in seeded order."""
    return smallest(df, [stratum], id_, n, seed).drop("_rn")


def round_robin(df: DataFrame, stratum: str, n: int, *order: str) -> DataFrame:
    """The first n rows, one of each stratum in turn, in the given order within a stratum."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= n).orderBy("_rn", stratum).limit(n).drop("_rn")


def sized(df: DataFrame, sizes: DataFrame, key: str, size: str, most: float) -> DataFrame:
    """``df`` with the ``size`` that ``sizes`` has for its key; rows without one, or of ``most`` or more, are left out."""
    return df.join(sizes.select(key, size), key, "left").filter(F.col(size) < most)
