"""Neighbourhoods of gene sets in an interaction graph, and permutation tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.operators.features import encode
from cladeworks.plans.lineage import materialise


def neighbours(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct nodes with an edge from ``members (node)`` that are not members."""
    reached = edges.join(members.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return reached.join(members, "node", "left_anti")


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(code, n)``: how many rows have each bit of the four words of ``word``."""
    for batch in batches:
        word = batch.column("word").to_numpy()
        masks = np.stack([batch.column(f"m{k}").to_numpy() for k in range(4)], 1).astype("<i8")
        for one in np.unique(word):
            mine = masks[word == one]
            n = sum(np.unpackbits(mine[at : at + 4096].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64) for at in range(0, len(mine), 4096))
            code = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(code + one * 256), pa.array(n[code])], ["code", "n"])


def induced(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``(grp, n_edges)``: undirected edges with both ends in the group; ``groups (grp, node)`` may repeat nodes.

    A node has a bit for each group that it is in, 256 to a row; an edge is in the groups whose bits both of its ends have, so it has a row for
    256 groups and not for each.
    """
    own = materialise(groups.distinct())
    codes = materialise(encode(own.select(F.col("grp").alias("feature"))).select(F.col("feature").alias("grp"), "code"))
    bit = F.expr("shiftleft(1L, cast(code % 64 as int))")
    words = [F.bit_or(F.when(F.floor(F.col("code") / 64) % 4 == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in range(4)]
    masks = materialise(own.join(codes, "grp").groupBy("node", F.floor(F.col("code") / 256).alias("word")).agg(*words))  # read for both ends
    half = edges.where("src < dst").join(masks.withColumnRenamed("node", "src"), "src")
    ends = masks.select(F.col("node").alias("dst"), "word", *[F.col(f"m{k}").alias(f"_m{k}") for k in range(4)])
    both = half.join(ends, ["dst", "word"]).select("word", *[F.col(f"m{k}").bitwiseAND(F.col(f"_m{k}")).alias(f"m{k}") for k in range(4)]).where("(m0 | m1 | m2 | m3) <> 0")
    counts = both.mapInArrow(_bits, "code long, n long").groupBy("code").agg(F.sum("n").alias("n_edges"))
    return codes.join(counts, "code", "left").select("grp", "n_edges").fillna(0, ["n_edges"])


def draws(universe: DataFrame, n: int, size: int, permutations: int, seed: str) -> DataFrame:
    """``(grp, node)``: seeded draws with replacement of ``size`` nodes for each permutation.

    ``universe (node, idx)`` numbers its ``n`` nodes from 0. Draws are an md5
    of (seed, permutation, slot), so every run gives the same.
    """
    spark = universe.sparkSession
    slots = spark.range(permutations * size).select(F.floor(F.col("id") / size).alias("grp"), (F.col("id") % size).alias("slot"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("grp").cast("string"), F.col("slot").cast("string")))
    idx = F.pmod(F.conv(F.substring(key, 1, 12), 16, 10).cast("long"), F.lit(n))
    return slots.withColumn("idx", idx).join(universe, "idx").select("grp", "node")


def category_distance(members: DataFrame, universe: DataFrame) -> DataFrame:
    """``(grp, distance)``: sum over categories of squared differences between the group's and the universe's shares.

    ``members (grp, category)``, ``universe (category)``.
    """
    all_n = universe.agg(F.count(F.lit(1)).alias("n"))
    base = universe.groupBy("category").agg(F.count(F.lit(1)).alias("c")).select("category", (F.col("c") / all_n.scalar()).alias("q"))
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    own = members.groupBy("grp", "category").agg(F.count(F.lit(1)).alias("c")).join(sizes, "grp").join(base, "category")
    # Categories a group lacks add q squared: take all of them, then put the group's own right.
    p = F.col("c") / F.col("size")
    rest = base.agg(F.sum(F.col("q") * F.col("q")).alias("s"))
    part = own.groupBy("grp").agg(F.sum((p - F.col("q")) * (p - F.col("q")) - F.col("q") * F.col("q")).alias("d"))
    return part.select("grp", F.round(F.col("d") + rest.scalar(), 6).alias("distance"))


def p_value(null: DataFrame, value: str, observed: Column, permutations: int) -> DataFrame:
    """One row: the share of permutations that reach the observed value."""
    return null.agg(F.round(F.count(F.when(F.col(value) >= observed, 1)) / F.lit(permutations), 6).alias("p_value"))


def selected_genes(genes: DataFrame, tag: str | None = None, pseudogenes: bool = True, hypothetical: bool = True, known: bool = True) -> DataFrame:
    """Rows of a gene table without names that hold ``tag``; pseudogenes, hypothetical genes and those with a known label on request left out."""
    keep = F.lit(True) if tag is None else ~F.contains(F.col("name"), F.lit(tag))
    for wanted, out in ((pseudogenes, F.col("is_pseudogene")), (hypothetical, F.col("is_hypothetical")), (known, F.col("label") != "miss")):
        keep = keep if wanted else keep & ~out
    return genes.where(keep)


def with_features(rows: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Rows with ``feature`` (the name) of the feature whose name is the key, or else whose locus is; rows without one go."""
    own = features.where("ftype <> 'upstream'")
    by = lambda c, n: own.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(key)).agg(F.min("name").alias(n))
    found = rows.join(by("name", "_a"), key, "left").join(by("locus", "_b"), key, "left").withColumn("feature", F.coalesce("_a", "_b"))
    return found.where("feature is not null").drop("_a", "_b")


def fdr_cuts(curve: DataFrame, level: float = 0.1, cap: float = 0.05) -> DataFrame:
    """``(drug, cut)``: the largest p at which expected / observed is below ``level``, at most ``cap``; ``curve (drug, p, observed, expected)``."""
    return curve.where(F.col("expected") / F.col("observed") < level).groupBy("drug").agg(F.least(F.max("p"), F.lit(cap)).alias("cut"))


def cut_sites(sites: DataFrame, cuts: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Sites ``(drug, pos, p)`` up to the cut of their drug, without those among ``markers (pos)``."""
    kept = sites.join(cuts, "drug").where("p <= cut").drop("cut")
    return kept if markers is None else kept.join(markers.select("pos").distinct(), "pos", "left_anti").select(sites.columns)


def zero_sites(sites: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Sites with p = 0, without those among ``markers (pos)``."""
    kept = sites.where("p = 0")
    return kept if markers is None else kept.join(markers.select("pos").distinct(), "pos", "left_anti").select(sites.columns)


def known_labels(variants: DataFrame, sites: DataFrame, genes: DataFrame) -> DataFrame:
    """``variants (pos, gene, indel)`` with ``label``: what is known of their (gene, pos), of their gene for insertions and deletions, or ``miss``.

    Of several labels the first in order counts. Both tables of labels are merged, never sent to every task: sites are several for each gene,
    which Spark's guess of their size leaves out.
    """
    by_site = sites.groupBy("gene", "pos").agg(F.min("label").alias("_s")).hint("merge")
    by_gene = genes.groupBy("gene").agg(F.min("label").alias("_g")).hint("merge")
    found = variants.join(by_site, ["gene", "pos"], "left").join(by_gene, "gene", "left")
    return found.select("pos", "gene", "indel", F.coalesce(F.when(F.col("indel"), F.col("_g")).otherwise(F.col("_s")), F.lit("miss")).alias("label"))
