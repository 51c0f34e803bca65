"""Features of samples: counting, screening, encoding and selection.

Feature tables are long, ``(sample_id, feature)``; the dense matrix is never
built except where a sink needs its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(features: DataFrame, pheno: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``(drug, feature, n_r, n_s)``: samples with the feature by label; with ``listed (drug, feature)`` these and no others, zeros included."""
    rows = features.join(pheno.where("pheno is not null"), "sample_id")
    counts = rows.groupBy("drug", "feature").agg(F.sum("pheno").cast("long").alias("n_r"), F.sum(1 - F.col("pheno")).cast("long").alias("n_s"))
    return counts if listed is None else listed.select("drug", "feature").distinct().join(counts, ["drug", "feature"], "left").fillna(0, ["n_r", "n_s"])


def frequency_band(features: DataFrame, low: int, n_samples: int | None = None) -> DataFrame:
    """Rows of the features that more than ``low`` and fewer than n - ``low`` samples have."""
    n = n_samples if n_samples is not None else features.select("sample_id").distinct().count()
    counts = features.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > low) & (F.col("n") < n - low))
    return features.join(counts, "feature", "left_semi")


def joint_features(features: DataFrame, least: int) -> DataFrame:
    """``(sample_id, feature)``: the features of each sample, and as ``a&b`` the pairs that more than ``least`` samples have.

    Only features that so many samples have are paired; pairs are counted in blocks (``common``), and only those that stay have rows.
    """
    from cladeworks.operators import common as cm

    often = features.join(features.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least), "feature", "left_semi")
    lists, n = cm.blocks(often, "feature", "sample_id")

    def make(p: cm.Pairs) -> Iterator[pa.RecordBatch]:
        for first, last in p.stretches():
            kept = ((p.count(first, last)[0] > least) & p.later(first, last)).reshape(-1)
            for cell, owner in p.common(first, last) if kept.any() else ():
                mine = kept[cell]
                a, b = np.divmod(cell[mine], len(p.b.sizes))
                both = pc.binary_join_element_wise(p.a.items.take(pa.array(a + first)), p.b.items.take(pa.array(b)), "&")
                yield pa.RecordBatch.from_arrays([pa.array(owner[mine]), both], ["sample_id", "feature"])

    joint = cm.over_pairs(lists, n, lists, n, "sample_id long, feature string", make, True)
    return features.select("sample_id", "feature").union(joint.select(F.col("sample_id").cast(features.schema["sample_id"].dataType), "feature"))


def screen_pairs(features: DataFrame, pheno: DataFrame, low: int, exclusive: int, similar: float) -> DataFrame:
    """Feature pairs worth adding, with counts: enough joint samples, enough exclusive ones, not too alike, and informative together.

    ``(a, b, n_ab, r_ab)``. The last test is P(R|a,b) <> P(R|a) P(R|b), in whole numbers. Pairs are counted in blocks (``common``).
    """
    from cladeworks.operators import common as cm

    own = features.join(pheno.select("sample_id", "pheno"), "sample_id")
    total = pheno.count()
    # Both features of a pair that stays have more than low + exclusive samples. An odd owner is a sample with the label.
    often = own.join(own.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > low + exclusive), "feature", "left_semi")
    lists, n = cm.blocks(often.select("feature", (F.col("sample_id").cast("long") * 2 + F.col("pheno")).alias("owner")), "feature", "owner")

    def make(p: cm.Pairs) -> Iterator[pa.RecordBatch]:
        n_a, n_b = p.a.sizes[:, None], p.b.sizes[None, :]
        r_a, r_b = (np.add.reduceat(s.owners % 2, s.ends[:-1]) for s in (p.a, p.b))
        exact = np.int64 if max(n_a.max(), n_b.max()) < 1 << 21 else object  # products of three counts
        for first, last in p.stretches():
            n_ab, r_ab = p.count(first, last, odd=True)
            mine = n_a[first:last]
            keep = (n_ab > low) & (n_ab < total - low) & (mine - n_ab > exclusive) & (n_b - n_ab > exclusive) & (n_ab < similar * (mine + n_b - n_ab)) & p.later(first, last)
            a, b = np.nonzero(keep)
            n_, r_ = n_ab[a, b], r_ab[a, b]
            whole = [x.astype(exact) for x in (r_, p.a.sizes[a + first], p.b.sizes[b], r_a[a + first], r_b[b], n_)]
            told = whole[0] * whole[1] * whole[2] != whole[3] * whole[4] * whole[5]
            a, b = a[told] + first, b[told]
            yield pa.RecordBatch.from_arrays([p.a.items.take(pa.array(a)), p.b.items.take(pa.array(b)), pa.array(n_[told]), pa.array(r_[told])], ["a", "b", "n_ab", "r_ab"])

    return cm.over_pairs(lists, n, lists, n, "a string, b string, n_ab long, r_ab long", make, True)


def extended(calls: DataFrame) -> DataFrame:
    """``(sample_id, feature)`` from ``(sample_id, gene, pos, vtype)``: genes with an indel become one ``broken`` feature, others give ``changed`` and their positions."""
    broken = calls.groupBy("sample_id", "gene").agg(F.max((F.col("vtype") != "snp").cast("int")).alias("broken"))
    rows = calls.join(broken, ["sample_id", "gene"])
    feature = F.explode(F.when(F.col("broken") == 1, F.array(F.concat_ws("\t", "gene", F.lit("broken")))).otherwise(
        F.array(F.concat_ws("\t", "gene", F.lit("changed")), F.concat_ws("\t", "gene", F.col("pos").cast("string")))))
    return rows.select("sample_id", feature.alias("feature")).distinct()


def encode(features: DataFrame) -> DataFrame:
    """``(feature, code)``: dense codes from 0 in the order of the features.

    Ranges of the sorted vocabulary are numbered inside themselves and shifted
    by the sizes of the ranges before, so no task sorts the whole vocabulary.
    """
    from cladeworks.plans.lineage import materialise

    words = materialise(features.select("feature").distinct().repartitionByRange("feature").withColumn("_range", F.spark_partition_id()))
    inside = words.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy("feature")))
    sizes = words.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.join(sizes.select("_range", before.alias("_base")), "_range").select("feature", (F.col("_base") + F.col("_k") - 1).alias("code"))


def _xlogx(joint: Column, row: Column, column: Column, n: Column) -> Column:
    return F.when(joint > 0, joint / n * F.log(joint * n / (row * column))).otherwise(0.0)


def mutual_information(features: DataFrame, pheno: DataFrame, k: int) -> DataFrame:
    """``(drug, feature, mi, rank)``: the k features of each drug with the highest mutual information (nats) with the label; ties to the smaller feature."""
    totals = pheno.groupBy("drug").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("pheno").cast("double").alias("r"))
    t = contingency(features, pheno).join(totals, "drug")
    n, r, has = F.col("n"), F.col("r"), F.col("n_r") + F.col("n_s")
    s, lacks = n - r, n - has
    mi = _xlogx(F.col("n_r"), has, r, n) + _xlogx(F.col("n_s"), has, s, n) + _xlogx(r - F.col("n_r"), lacks, r, n) + _xlogx(s - F.col("n_s"), lacks, s, n)
    scored = t.select("drug", "feature", F.round(mi, 6).alias("mi"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("drug").orderBy(F.desc("mi"), "feature")))
    return ranked.where(F.col("rank") <= k)


def nearest_neighbour(queries: DataFrame, base: DataFrame) -> DataFrame:
    """``(sample_id, neighbour, distance)``: for each query sample the base sample with the fewest differing features; ties to the smaller id.

    Only samples that share a feature are compared; the distance is
    |a| + |b| - 2 shared. Shared features are counted in blocks (``common``), and each block gives its nearest.
    """
    from cladeworks.operators import common as cm
    from cladeworks.plans.lineage import materialise

    codes = materialise(encode(base))
    (a, n_a), (b, n_b) = (cm.blocks(df.join(codes, "feature", "left").select("sample_id", F.coalesce("code", F.lit(-1)).alias("code")), "sample_id", "code") for df in (queries, base))
    kind = base.schema["sample_id"].dataType.simpleString()

    def make(p: cm.Pairs) -> Iterator[pa.RecordBatch]:
        itself = pc.fill_null(pc.index_in(p.a.items, p.b.items), -1).to_numpy()
        for first, last in p.stretches():
            (shared,) = p.count(first, last)
            own = itself[first:last]
            shared[np.flatnonzero(own >= 0), own[own >= 0]] = 0
            distance = np.where(shared > 0, p.a.sizes[first:last, None] + p.b.sizes - 2 * shared, np.iinfo(np.int64).max)
            best = distance.argmin(1)
            found = np.flatnonzero(shared[np.arange(last - first), best] > 0)
            yield pa.RecordBatch.from_arrays([p.a.items.take(pa.array(found + first)), p.b.items.take(pa.array(best[found])), pa.array(distance[found, best[found]])], ["sample_id", "neighbour", "distance"])

    d = cm.over_pairs(a, n_a, b, n_b, f"sample_id {kind}, neighbour {kind}, distance long", make, False)
    return d.groupBy("sample_id").agg(F.min(F.struct("distance", "neighbour")).alias("m")).select("sample_id", "m.neighbour", "m.distance")


def dictionary_coverage(entries: DataFrame, observed: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """``(drug, feature, gene, hit, n)``: each entry as seen at its point, in a gene that some sample has ``broken (sample_id, gene)``, in a changed gene, or missing; n samples have the entry itself."""
    point = observed.groupBy("feature").agg(F.countDistinct("sample_id").alias("n"))
    gene = observed.select("gene").distinct().withColumn("in_gene", F.lit(1))
    lost = (broken if broken is not None else observed.limit(0)).select("gene").distinct().withColumn("lost", F.lit(1))
    rows = entries.join(point, "feature", "left").join(gene, "gene", "left").join(lost, "gene", "left")
    hit = F.when(F.col("n").isNotNull(), "point").when(F.col("lost") == 1, "broken").when(F.col("in_gene") == 1, "changed").otherwise("missing")
    return rows.select("drug", "feature", "gene", hit.alias("hit"), F.coalesce("n", F.lit(0)).alias("n"))


def dictionary_totals(entries: DataFrame, observed: DataFrame) -> DataFrame:
    """``(drug, n_entries, n_present, n_left)``: entries of a drug, those that some sample has, and observed features of its genes that it does not list."""
    seen = observed.select("feature", "gene").where("feature is not null").distinct()
    listed = entries.select("drug", "feature", "gene").distinct()
    present = listed.join(seen.select("feature").distinct(), "feature", "left_semi").groupBy("drug").agg(F.count(F.lit(1)).alias("n_present"))
    left = listed.select("drug", "gene").distinct().join(seen, "gene").join(listed.select("drug", "feature"), ["drug", "feature"], "left_anti").groupBy("drug").agg(F.countDistinct("feature").alias("n_left"))
    n = listed.groupBy("drug").agg(F.count(F.lit(1)).alias("n_entries"))
    return n.join(present, "drug", "left").join(left, "drug", "left").select("drug", "n_entries", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_present", "n_left")])


def membership_groups(rows: DataFrame) -> DataFrame:
    """``(feature, leader, n)``: features that exactly the same samples have share a leader (the smallest of them)."""
    sets = rows.select("sample_id", "feature").distinct().groupBy("feature").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("sample_id"))), ","), 256).alias("_set"))
    group = sets.groupBy("_set").agg(F.min("feature").alias("leader"), F.count(F.lit(1)).alias("n"))
    return sets.join(group, "_set").select("feature", "leader", "n")


def running_totals(rows: DataFrame, order: str, value: str) -> DataFrame:
    """``(order, value, code, before)``: rows numbered from 0 in their order, with the sum of the values before each.

    Ranges of the order are numbered and summed inside themselves and shifted by what the ranges before have.
    """
    from cladeworks.plans.lineage import materialise

    dealt = materialise(rows.select(order, value).repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))  # one row per range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"))
    placed = dealt.withColumns({"_k": F.count(F.lit(1)).over(inside), "_t": F.coalesce(F.sum(value).over(inside), F.lit(0))})
    return placed.join(shift, "_range").select(order, value, (F.col("_n0") + F.col("_k")).alias("code"), (F.col("_s0") + F.col("_t")).alias("before"))


def list_splits(weights: DataFrame, order: str, weight: str, tiles: int, batch: int, shares: int) -> DataFrame:
    """``(order, tile, batch, share)``: a sorted list cut into ``tiles`` parts of even length (the first ones longer), batches of fixed length, and ``shares`` of even weight."""
    rows = running_totals(weights, order, weight)
    rows = rows.withColumns({"n": weights.agg(F.count(F.lit(1))).scalar(), "total": weights.agg(F.sum(weight)).scalar()}).withColumns({"q": F.floor(F.col("n") / tiles), "r": F.col("n") % tiles})
    long = F.col("r") * (F.col("q") + 1)
    tile = F.when(F.col("code") < long, F.floor(F.col("code") / (F.col("q") + 1))).otherwise(F.col("r") + F.floor((F.col("code") - long) / F.greatest(F.col("q"), F.lit(1))))
    return rows.select(order, (tile + 1).cast("int").alias("tile"), F.floor(F.col("code") / batch).cast("int").alias("batch"), F.floor(F.col("before") * shares / F.col("total")).cast("int").alias("share"))
