"""Quality filters of calls and sites."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.operators.features import encode
from cladeworks.operators.intervals import points_in_intervals
from cladeworks.plans.lineage import discard, materialise


@dataclass(frozen=True)
class QualityParams:
    min_qual: int = 40
    min_cov: int = 10
    min_mqm: int = 30
    z: float = 3.0
    window: int = 400
    low_depth: float = 10.0
    covered: float = 0.9
    fraction: float = 0.75


def thresholds(calls: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    return calls.where((F.col("qual") >= params.min_qual) & (F.col("cov") >= params.min_cov) & (F.col("mqm") >= params.min_mqm))


def z_cut(df: DataFrame, by: list[str], columns: Iterable[str], z: float) -> DataFrame:
    """Rows whose values are all at least mean - z population standard deviations of their group."""
    columns = list(columns)
    stats = df.groupBy(*by).agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.col(c) >= F.col(f"_m_{c}") - z * F.col(f"_s_{c}"))
    return df.join(stats, by).where(keep).select(df.columns)


def not_overcovered(calls: DataFrame, depth: DataFrame, z: float = 3.0) -> DataFrame:
    """Calls with coverage at most mean + z standard deviations of their sample's depth."""
    stats = depth.groupBy("sample_id").agg((F.avg("depth") + z * F.stddev_pop("depth")).alias("_most"))
    return calls.join(stats, "sample_id").where("cov <= _most").drop("_most")


def tolerant(bounds: dict[str, tuple[str, float]], value: Column) -> Column:
    """All annotations of a map within bounds; one that is missing passes. ``bounds``: name -> (operator, limit)."""
    keep = F.lit(True)
    for name, (op, limit) in bounds.items():
        v = F.element_at(value, name)
        keep = keep & F.coalesce(v >= limit if op == ">=" else v <= limit, F.lit(True))
    return keep


def annotation_z(df: DataFrame, by: list[str], annotations: str, z: float) -> DataFrame:
    """Rows none of whose map values leaves mean +- z standard deviations of its group and name."""
    long = df.select("*", F.monotonically_increasing_id().alias("_row"))
    long = long.select(*by, *[c for c in df.columns if c not in by], F.explode_outer(annotations).alias("_k", "_v"))
    stats = long.where("_k is not null").groupBy(*by, "_k").agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"))
    table = stats.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_k", F.struct("_m", "_s")))).alias("_stats"))
    bad = F.exists(F.map_entries(annotations), lambda e: F.abs(e["value"] - F.element_at("_stats", e["key"])["_m"]) > z * F.element_at("_stats", e["key"])["_s"])
    return df.join(table, by, "left").where(~F.coalesce(bad, F.lit(False))).drop("_stats")


def exclusion_intervals(features: DataFrame, types: list[str], tags: list[str], genes: DataFrame | None, flank: int) -> DataFrame:
    """``(start_pos, end_pos)`` to leave out: features of the given types or tags, and named genes with their upstream flank by strand."""
    picked = features.where(F.col("ftype").isin(types) | F.exists(F.array(*[F.lit(t) for t in tags]), lambda t: F.contains(F.col("tag"), t)))
    out = picked.select("start_pos", "end_pos")
    if genes is not None:
        own = features.join(genes, "name", "left_semi")
        out = out.union(own.select(F.when(F.col("strand") == 1, F.col("start_pos") - flank).otherwise(F.col("start_pos")), F.when(F.col("strand") == 1, F.col("end_pos")).otherwise(F.col("end_pos") + flank)))
    return out.distinct()


def window_stats(depth: DataFrame, width: int) -> DataFrame:
    """Mean and standard deviation of the depth over positions pos - width/2 + 1 .. pos + width/2 of the same sample.

    Positions without a row do not count. The axis is cut into stretches and
    each stretch borrows its margins, so a sample never has to sit in one task.
    """
    half, stretch = width // 2, max(width * 64, 1 << 14)
    zone = lambda c: F.floor(c / F.lit(stretch)).cast("long")
    pos = F.col("pos")
    zones = F.array_distinct(F.array(zone(pos), zone(pos - half), zone(pos + half - 1)))
    rows = depth.select("sample_id", "pos", "depth", F.explode(zones).alias("_z"))
    frame = Window.partitionBy("sample_id", "_z").orderBy("pos").rangeBetween(-(half - 1), half)
    out = rows.select("sample_id", "pos", "depth", "_z", F.avg("depth").over(frame).alias("mean"), F.stddev_pop("depth").over(frame).alias("std"))
    return out.where(F.col("_z") == zone(pos)).drop("_z")


def window_flags(depth: DataFrame, params: QualityParams) -> DataFrame:
    """Window statistics with flags: low mean, high mean (over mu + z sigma) and wild (std over z sigma) against the sample's depth."""
    stats = depth.groupBy("sample_id").agg(F.avg("depth").alias("mu"), F.stddev_pop("depth").alias("sigma"))
    joined = window_stats(depth, params.window).join(stats, "sample_id")
    flag = lambda c: c.cast("int")
    return joined.select(
        "sample_id", "pos", "depth", "mean", "std", flag(F.col("mean") < params.low_depth).alias("low"),
        flag(F.col("mean") > F.col("mu") + params.z * F.col("sigma")).alias("high"), flag(F.col("std") > params.z * F.col("sigma")).alias("wild"),
        flag(F.col("depth") < params.min_cov).alias("under"), flag(F.col("depth") > F.col("mu") + params.z * F.col("sigma")).alias("over"),
    )


def flags_by_place(depth: DataFrame, genes: DataFrame, params: QualityParams, inside: int = 400, outside: int = 50, genes_only: bool = False) -> DataFrame:
    """``window_flags`` with ``inside`` as the width at positions in ``genes (start_pos, end_pos)`` and ``outside`` elsewhere, where the flags are 0 with ``genes_only``."""
    within = materialise(points_in_intervals(depth.select("pos").distinct(), genes, how="left_semi"))
    wide = window_flags(depth, replace(params, window=inside)).join(within, "pos", "left_semi")
    narrow = window_flags(depth, replace(params, window=outside)).join(within, "pos", "left_anti")
    if genes_only:
        narrow = narrow.withColumns({c: F.lit(0) for c in ("low", "high", "wild")})
    return wide.unionByName(narrow)


def site_coverage(depth: DataFrame, sites: DataFrame, least: int) -> DataFrame:
    """``(sample_id, pos, covered)`` for every sample with any depth and every site; an absent depth is 0.

    ``depth`` has one row per sample and position. Samples are numbered and stand in groups of 4096; a site has 64 longs of
    flags for a group, so what is shuffled is depths and a row for each site and group, and the pairs of sample and site are made inside the tasks.
    """
    sites, group = sites.select("pos").distinct(), F.shiftright("code", 12).alias("group")
    numbered = materialise(encode(depth.select(F.col("sample_id").alias("feature"))).select(F.col("feature").alias("sample_id"), "code"))
    members = F.sort_array(F.collect_list(F.struct((F.col("code") % 4096).cast("int").alias("k"), "sample_id")))
    groups = numbered.groupBy(group).agg(F.transform(members, lambda m: m["sample_id"]).alias("samples"))
    covered = depth.where(F.col("depth") >= least).join(sites, "pos", "left_semi").join(numbered, "sample_id")
    words = covered.groupBy("pos", group, F.shiftright((F.col("code") % 4096).cast("int"), 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(code % 64 as int))")).alias("bits"))
    flags = words.groupBy("pos", "group").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    flags = flags.select("pos", "group", F.expr("transform(sequence(0, 63), i -> coalesce(element_at(m, i), 0L))").alias("flags"))
    last = numbered.agg(F.max(F.shiftright("code", 12))).scalar()
    cells = sites.select("pos", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("group")).join(flags, ["pos", "group"], "left")
    cells = cells.join(groups.hint("broadcast") if numbered.count() <= 500_000 else groups, "group")
    pairs = cells.select("pos", "flags", F.posexplode("samples").alias("k", "sample_id"))
    bit = F.getbit(F.get("flags", F.shiftright("k", 6)), F.col("k") % 64)
    return pairs.select("sample_id", "pos", F.coalesce(bit.cast("int"), F.lit(0)).alias("covered"))


def covered_shares(depth: DataFrame, sites: DataFrame, least: int) -> DataFrame:
    """``(pos, n_covered, share)`` of every site, also of those that no sample covers; the share is of all samples with any depth."""
    found = depth.where(F.col("depth") >= least).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))
    rows = sites.select("pos").distinct().join(found, "pos", "left").withColumn("n_samples", depth.agg(F.countDistinct("sample_id")).scalar())
    return rows.select("pos", F.coalesce("n", F.lit(0)).alias("n_covered"), F.round(F.coalesce("n", F.lit(0)) / F.col("n_samples"), 6).alias("share"))


def prune_round(covered: DataFrame, n_sites: int, n_samples: int, share: float) -> tuple[DataFrame, DataFrame]:
    """Samples and sites that stay in one synchronous round; ``covered (sample_id, pos)`` lists the covered pairs.

    Only covered pairs are rows, so the dense grid is never built.
    """
    samples = covered.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= share * n_sites).select("sample_id")
    sites = covered.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= share * n_samples).select("pos")
    return samples, sites


def prune(depth: DataFrame, least: int, share: float, order: str = "samples") -> DataFrame:
    """The covered pairs left when alternately dropping thinly covered samples and sites changes nothing more.

    ``order``: which of the two a round drops first; the other is judged on
    what the first has left. Each round is written to the shared folder.
    """
    sites, samples = depth.select("pos").distinct().count(), depth.select("sample_id").distinct().count()
    live = materialise(depth.where(F.col("depth") >= least).select("sample_id", "pos").distinct())
    while True:
        size = (sites, samples)
        for side in (("sample_id", "pos") if order == "samples" else ("pos", "sample_id")):
            keep = prune_round(live, sites, samples, share)[0 if side == "sample_id" else 1]
            after = materialise(live.join(keep, side, "left_semi"))
            discard(live)
            live = after
            if side == "sample_id":
                samples = live.select("sample_id").distinct().count()
            else:
                sites = live.select("pos").distinct().count()
        if (sites, samples) == size or not sites:
            return live
