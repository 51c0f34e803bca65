"""Joins of points and spans with intervals, as equi-joins on bins.

A ``between`` join would plan as a nested loop. Here an interval is listed
once for each bin of the axis that it touches, and the join is on the bin with
the exact condition on top, so both sides shuffle by bin and any size works.
Spark guesses the size of intervals by that of their file, which listing them by
bin and growing their names exceeds many times; so these joins say that they merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 256
ZONE = 1 << 16


def _bin(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width)).cast("long")


def in_bins(df: DataFrame, start: str, end: str, width: int = BIN) -> DataFrame:
    """One row per bin that [start, end] touches, in column ``_bin``."""
    return df.withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end), width))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, pos: str = "pos", start: str = "start_pos", end: str = "end_pos", on: list[str] | None = None, how: str = "inner", width: int = BIN) -> DataFrame:
    """All (point, interval) matches with start <= pos <= end; ``how`` may also be left, left_semi or left_anti."""
    keys = on or []
    p = points.withColumn("_bin", _bin(F.col(pos), width)).alias("_p")
    i = in_bins(intervals.where(F.col(start) <= F.col(end)), start, end, width).alias("_i").hint("merge")
    same = F.col("_p._bin") == F.col("_i._bin")
    for k in keys:
        same = same & (F.col(f"_p.{k}") == F.col(f"_i.{k}"))
    same = same & (F.col(f"_i.{start}") <= F.col(f"_p.{pos}")) & (F.col(f"_p.{pos}") <= F.col(f"_i.{end}"))
    joined = p.join(i, same, how)
    left = [F.col(f"_p.{c}") for c in points.columns]
    if how in ("left_semi", "left_anti"):
        return joined.select(*left)
    return joined.select(*left, *[F.col(f"_i.{c}") for c in intervals.columns if c not in points.columns])


def last_feature(points: DataFrame, features: DataFrame, rank: Column | None = None) -> DataFrame:
    """``(pos, name, start_pos)``: each distinct position with the covering feature that starts last (then highest rank)."""
    matched = points_in_intervals(points.select("pos").distinct(), features)
    order = F.struct("start_pos", rank if rank is not None else F.lit(0), "name")
    return matched.groupBy("pos").agg(F.max(order).alias("m")).select("pos", "m.name", "m.start_pos")


def spans_overlap(a: DataFrame, b: DataFrame, a_start: str, a_end: str, b_start: str, b_end: str, on: list[str] | None = None, how: str = "inner", width: int = BIN) -> DataFrame:
    """All pairs of overlapping spans; a pair is emitted in the one bin where the later of the two starts lies."""
    keys = on or []
    left, right = in_bins(a, a_start, a_end, width).alias("_a"), in_bins(b.where(F.col(b_start) <= F.col(b_end)), b_start, b_end, width).alias("_b").hint("merge")
    same = (F.col("_a._bin") == F.col("_b._bin")) & (F.col(f"_a.{a_start}") <= F.col(f"_b.{b_end}")) & (F.col(f"_b.{b_start}") <= F.col(f"_a.{a_end}"))
    for k in keys:
        same = same & (F.col(f"_a.{k}") == F.col(f"_b.{k}"))
    cols = [F.col(f"_a.{c}") for c in a.columns]
    if how == "inner":
        same = same & (F.col("_a._bin") == _bin(F.greatest(F.col(f"_a.{a_start}"), F.col(f"_b.{b_start}")), width))
        return left.join(right, same).select(*cols, *[F.col(f"_b.{c}") for c in b.columns if c not in a.columns])
    hit = left.join(right, same, "left_semi").select(*[F.col(c) for c in a.columns]).distinct()
    return hit if how == "left_semi" else a.join(hit, [a[c].eqNullSafe(hit[c]) for c in a.columns], "left_anti")


def nearest(points: DataFrame, features: DataFrame) -> DataFrame:
    """``(pos, left_name, right_name)``: for each distinct position the last feature that ends before it and the first that starts after it.

    Features and positions are put in one order and the nearest values carried
    along it, forwards for the one and backwards for the other: a frame that
    ends without bound would be gone through anew for every row. The axis is cut
    into ranges of positions; what crosses a range comes from one summary row
    per range, so no task holds the whole axis.
    """
    left, right = "struct<end_pos:bigint,start_pos:bigint,name:string>", "struct<start_pos:bigint,end_pos:bigint,name:string>"
    ends = features.select(F.col("end_pos").alias("p"), F.struct("end_pos", "start_pos", "name").cast(left).alias("l"), F.lit(None).cast(right).alias("r"), F.lit(False).alias("asks"))
    starts = features.select(F.col("start_pos").alias("p"), F.lit(None).cast(left).alias("l"), F.struct("start_pos", "end_pos", "name").cast(right).alias("r"), F.lit(False).alias("asks"))
    asks = points.select(F.col("pos").alias("p")).distinct().select("p", F.lit(None).cast(left).alias("l"), F.lit(None).cast(right).alias("r"), F.lit(True).alias("asks"))
    rows = ends.union(starts).union(asks).withColumn("z", _bin(F.col("p"), ZONE))
    strictly = lambda order: Window.partitionBy("z").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    carried = rows.withColumn("near_l", F.max("l").over(strictly(F.asc("p")))).withColumn("near_r", F.min("r").over(strictly(F.desc("p"))))
    zones = rows.groupBy("z").agg(F.max("l").alias("l"), F.min("r").alias("r"))
    beyond = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  (one row per ZONE positions of the axis)
    zones = zones.select("z", F.max("l").over(beyond(F.asc("z"))).alias("zone_l"), F.min("r").over(beyond(F.desc("z"))).alias("zone_r"))
    out = carried.where("asks").join(zones, "z")
    return out.select(F.col("p").alias("pos"), F.coalesce("near_l.name", "zone_l.name").alias("left_name"), F.coalesce("near_r.name", "zone_r.name").alias("right_name"))


def close_pairs(df: DataFrame, by: str, pos: str, gap: int, carry: list[str]) -> DataFrame:
    """Pairs of rows of the same ``by`` whose positions differ by 1 to ``gap``; columns of the later one end in _2."""
    a = df.select(by, F.col(pos), *carry).withColumn("_bin", F.explode(F.array(_bin(F.col(pos), gap), _bin(F.col(pos), gap) + 1)))
    b = df.select(F.col(by).alias("_by"), F.col(pos).alias(f"{pos}_2"), *[F.col(c).alias(f"{c}_2") for c in carry]).withColumn("_bin2", _bin(F.col(f"{pos}_2"), gap))
    joined = a.join(b, (F.col(by) == F.col("_by")) & (F.col("_bin") == F.col("_bin2")))
    return joined.where((F.col(f"{pos}_2") > F.col(pos)) & (F.col(f"{pos}_2") - F.col(pos) <= gap)).drop("_by", "_bin", "_bin2")
