"""Read and read-pair operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.operators.intervals import points_in_intervals, spans_overlap
from cladeworks.operators.quality import z_cut
from cladeworks.plans.lineage import materialise


def well_mapped(reads: DataFrame, z: float = 2.0) -> DataFrame:
    """Reads with a mapping quality of at least mean - z standard deviations of their sample."""
    return z_cut(reads, ["sample_id"], ["mapq"], z)


def overlapping(reads: DataFrame, intervals: DataFrame) -> DataFrame:
    """Reads that overlap any of ``intervals (x_start, x_end)``, each once."""
    return spans_overlap(reads, intervals, "start_pos", "end_pos", "x_start", "x_end", how="left_semi")


def mates(reads: DataFrame) -> DataFrame:
    """``(sample_id, qname, insert)``: one row per proper pair with its outer length."""
    proper = reads.where("is_proper")
    a = proper.where("mate = 0").select("sample_id", "qname", F.col("start_pos").alias("s1"), F.col("end_pos").alias("e1"))
    b = proper.where("mate = 1").select("sample_id", "qname", F.col("start_pos").alias("s2"), F.col("end_pos").alias("e2"))
    return a.join(b, ["sample_id", "qname"]).select("sample_id", "qname", (F.greatest("e1", "e2") - F.least("s1", "s2") + 1).alias("insert"))


def variant_pairs(reads: DataFrame, variants: DataFrame, z: float = 2.0) -> DataFrame:
    """``(sample_id, pos, alt, vtype, cov, proper, n_pairs, mean_insert, long_inserts)`` of every variant of every sample, also without reads.

    ``cov`` reads of the sample cover the position, ``proper`` of them in proper pairs; a pair counts once for a variant, whichever of its mates
    covers it. A long insert is more than ``z`` standard deviations off the mean over all pairs and variants of the sample.
    """
    key = ["sample_id", "pos", "alt", "vtype"]
    points = variants.select(*key).distinct()
    hits = materialise(points_in_intervals(points, reads.select("sample_id", "qname", "start_pos", "end_pos", "is_proper"), on=["sample_id"]))
    counts = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("cov"), F.count(F.when(F.col("is_proper"), 1)).alias("proper"))
    pairs = hits.where("is_proper").select(*key, "qname").distinct().join(mates(reads), ["sample_id", "qname"])
    usual = pairs.groupBy("sample_id").agg(F.avg("insert").alias("mean"), F.stddev_pop("insert").alias("std"))
    far = F.abs(F.col("insert") - F.col("mean")) > z * F.col("std")
    inserts = pairs.join(usual, "sample_id").groupBy(*key).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("insert").alias("mean_insert"), F.count(F.when(far, 1)).alias("long_inserts"))
    return points.join(counts, key, "left").join(inserts, key, "left").fillna(0, ["cov", "proper", "n_pairs", "long_inserts"])


def pair_shares(stats: DataFrame) -> DataFrame:
    """``stats`` with ``bad_pairs``, the share of reads not in proper pairs, and ``long_pairs``, long inserts by proper reads; 0 of none is 0."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return stats.withColumns({"bad_pairs": share(F.col("cov") - F.col("proper"), F.col("cov")), "long_pairs": share(F.col("long_inserts"), F.col("proper"))})


def pairs_by_variant(stats: DataFrame, limit: float = 0.5) -> DataFrame:
    """``(pos, alt, vtype, n_samples, cov, proper, long_inserts, bad_share, long_share)``: sums, and the shares of samples above ``limit``."""
    over = lambda c: F.avg((F.col(c) > limit).cast("int"))
    sums = [F.sum(c).alias(c) for c in ("cov", "proper", "long_inserts")]
    return pair_shares(stats).groupBy("pos", "alt", "vtype").agg(F.count(F.lit(1)).alias("n_samples"), *sums, over("bad_pairs").alias("bad_share"), over("long_pairs").alias("long_share"))


def flagged_variants(stats: DataFrame, limit: float = 0.5) -> DataFrame:
    """Variants of a sample of whose pairs more than ``limit`` are bad or long, with the shares."""
    return pair_shares(stats).where((F.col("bad_pairs") > limit) | (F.col("long_pairs") > limit))


def pairs_by_gene(stats: DataFrame, located: DataFrame) -> DataFrame:
    """``(gene, n_variants, cov, proper, long_inserts, bad_pairs, long_pairs)`` of the genes whose variants have reads, from ``located (pos, gene)``."""
    rows = pairs_by_variant(stats).join(located.select("pos", "gene"), "pos")
    sums = [F.sum(c).alias(c) for c in ("cov", "proper", "long_inserts")]
    return pair_shares(rows.groupBy("gene").agg(F.count(F.lit(1)).alias("n_variants"), *sums).where("cov > 0"))


def pooled_t(rows: DataFrame, group: Column, value: str) -> DataFrame:
    """One row: the two-sample t statistic with pooled variance of a value between group true and false."""
    on = lambda f, g: f(F.when(group == g, F.col(value)))
    s = rows.agg(*[x for g, n in ((True, "a"), (False, "b")) for x in (on(F.count, g).alias(f"n{n}"), on(F.avg, g).alias(f"m{n}"), on(F.var_samp, g).alias(f"v{n}"))])
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2)
    t = (F.col("ma") - F.col("mb")) / F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb")))
    return s.select("na", "nb", F.round("ma", 6).alias("mean_a"), F.round("mb", 6).alias("mean_b"), F.round(t, 6).alias("t"))
