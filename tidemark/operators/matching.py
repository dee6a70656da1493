"""Nearest-in-time joins within a video, in time linear in the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a video (some twelve days) that one window sorts; what lies before and after is carried in as one row each.
SPAN = 1_000_000.0


def closest(rows: DataFrame, kinds: dict[str, Column], carry: list[str], span: float = SPAN) -> DataFrame:
    """``rows`` (video_id, t, ...) with a struct (t and the columns ``carry``) per kind: the closest other row of that kind.

    Of two equally close rows the earlier counts; where there is none the struct is null. A row is of a kind where its
    condition holds. All kinds come from one shuffle by stretches of ``span`` seconds: the last row of a kind up to here
    is a running value in order of time, the first after it the same in the reverse order. A stretch begins and ends with
    what the others of its video have last and first, so a long video is spread over tasks, and a row meets no group.
    """
    there = F.struct("t", *carry)
    rows = rows.withColumn("_stretch", F.floor(F.col("t") / span)).withColumns({f"_{k}": F.when(is_ & F.col("t").isNotNull(), there) for k, is_ in kinds.items()})
    ends = rows.groupBy("video_id", "_stretch").agg(*[F.min(f"_{k}").alias(f"first_{k}") for k in kinds], *[F.max(f"_{k}").alias(f"last_{k}") for k in kinds])
    up_to, video = (Window.unboundedPreceding, -1), Window.partitionBy("video_id")
    onward, back = video.orderBy("_stretch").rowsBetween(*up_to), video.orderBy(F.desc("_stretch")).rowsBetween(*up_to)
    begins = ends.select("video_id", "_stretch", F.lit(-1).alias("_side"), *[F.last(f"last_{k}", ignorenulls=True).over(onward).alias(f"_{k}") for k in kinds])
    stops = ends.select("video_id", "_stretch", F.lit(1).alias("_side"), *[F.last(f"first_{k}", ignorenulls=True).over(back).alias(f"_{k}") for k in kinds])
    both = rows.withColumn("_side", F.lit(0)).unionByName(begins.unionByName(stops), allowMissingColumns=True)

    order, stretch = ["_side", "t", *[f"_{k}" for k in kinds]], Window.partitionBy("video_id", "_stretch")
    onward, back = stretch.orderBy(*order).rowsBetween(*up_to), stretch.orderBy(*map(F.desc, order)).rowsBetween(*up_to)
    both = both.withColumns({f"before_{k}": F.last(f"_{k}", ignorenulls=True).over(onward) for k in kinds} | {f"after_{k}": F.last(f"_{k}", ignorenulls=True).over(back) for k in kinds})

    def nearer(k: str) -> Column:
        before, after = F.col(f"before_{k}"), F.col(f"after_{k}")
        return F.when(before.isNull(), after).when(after.isNull(), before).when(F.col("t") - before["t"] <= after["t"] - F.col("t"), before).otherwise(after)

    kept = [c for c in rows.columns if c != "_stretch" and c not in {f"_{k}" for k in kinds}]
    return both.filter("_side = 0").select(*kept, *[nearer(k).alias(k) for k in kinds])


def nearest(left: DataFrame, right: DataFrame, carry: list[str] | None = None, span: float = SPAN) -> DataFrame:
    """``left`` (video_id, t, ...) with the closest row of ``right`` in its video: near_t, near_<carry>, distance.

    Of two equally close rows the earlier counts; without any, distance is infinite and the rest null.
    """
    carry = carry or []
    rest = [c for c in left.columns if c not in ("video_id", "t")]
    a = left.select("video_id", "t", F.lit(True).alias("_asks"), F.struct(*rest, F.lit(0).alias("_")).alias("_own"))
    b = right.select("video_id", "t", F.lit(False).alias("_asks"), *[F.col(c).alias(f"near_{c}") for c in carry])
    rows = closest(a.unionByName(b, allowMissingColumns=True), {"near": ~F.col("_asks")}, [f"near_{c}" for c in carry], span).filter("_asks")
    return rows.select("video_id", "t", *[F.col(f"_own.{c}") for c in rest], F.col("near.t").alias("near_t"), *[F.col(f"near.near_{c}").alias(f"near_{c}") for c in carry], F.coalesce(F.abs(F.col("t") - F.col("near.t")), F.lit(float("inf"))).alias("distance"))
