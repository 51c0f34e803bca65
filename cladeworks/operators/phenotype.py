"""Phenotype labels, wide and long forms, and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mic_label(mic: Column, threshold: Column) -> Column:
    """R, S or - for a concentration string: ``<=x`` S if x <= t; ``>x`` R if t <= x; ``a-b`` S if b <= t, R if a > t."""
    at_most = F.regexp_extract(mic, r"^<=([0-9.]+)$", 1).try_cast("double")
    over = F.regexp_extract(mic, r"^>([0-9.]+)$", 1).try_cast("double")
    low = F.regexp_extract(mic, r"^([0-9.]+)-([0-9.]+)$", 1).try_cast("double")
    high = F.regexp_extract(mic, r"^([0-9.]+)-([0-9.]+)$", 2).try_cast("double")
    return F.when(at_most <= threshold, "S").when(over >= threshold, "R").when(high <= threshold, "S").when(low > threshold, "R").otherwise("-")


def label(value: Column) -> Column:
    """S/R or 0/1 as text to 0/1; anything else is null."""
    return F.when(value.isin("S", "0"), 0).when(value.isin("R", "1"), 1)


def resistant_to_all(columns: list[str]) -> Column:
    """1 if all are 1, 0 if any is 0, else null."""
    every = F.lit(True)
    some = F.lit(False)
    for c in columns:
        every = every & (F.col(c) == 1)
        some = some | (F.col(c) == 0)
    return F.when(every, 1).when(some, 0)


def susceptible_to_all(columns: list[str], strict: bool) -> Column:
    """1 if all are 0; 0 if any is 1; a missing value gives null, or is passed over unless ``strict``."""
    value = lambda c: F.col(c) if strict else F.coalesce(F.col(c), F.lit(0))
    every, some = F.lit(True), F.lit(False)
    for c in columns:
        every = every & (value(c) == 0)
        some = some | (F.col(c) == 1)
    return F.when(some, 0).when(every, 1)


def to_wide(pheno: DataFrame, drugs: list[str]) -> DataFrame:
    return pheno.groupBy("sample_id").pivot("drug", drugs).agg(F.max("pheno"))


def to_long(wide: DataFrame, drugs: list[str]) -> DataFrame:
    return wide.unpivot("sample_id", drugs, "drug", "pheno").where("pheno is not null")


def resolve_ids(names: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """``(name, id)``: the id of each name in the first map that has it; among several the one listed first. Maps are ``(name, id, row_idx)``."""
    out, found = names.select("name").distinct(), []
    for i, m in enumerate(maps):
        first = m.groupBy("name").agg(F.min_by("id", "row_idx").alias(f"_id{i}"))
        out = out.join(first, "name", "left")
        found.append(F.col(f"_id{i}"))
    return out.select("name", F.coalesce(*found).alias("id"))


def expand_aliases(entries: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """``(feature, drug)`` with each code replaced by its one to three names; unknown codes go."""
    table = F.create_map(*[x for code, names in aliases.items() for x in (F.lit(code), F.array(*[F.lit(n) for n in names]))])
    return entries.select("feature", F.explode(F.element_at(table, F.col("code"))).alias("drug"))


def unknown_codes(entries: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """``(code, n)``: the codes that have no name, with their number of entries."""
    return entries.where(~F.col("code").isin(list(aliases))).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def best_of_clusters(links: DataFrame, pheno: DataFrame) -> DataFrame:
    """``(cluster, sample_id)``: of each cluster of duplicates the sample with a label for the rarest drug.

    ``links (a, b)``: a star per cluster. Ties go to more labels, then the smaller id.
    """
    members = links.select(F.col("a").alias("cluster"), F.col("b").alias("sample_id")).union(links.select("a", "a")).distinct()
    rarity = pheno.groupBy("drug").agg(F.count(F.lit(1)).alias("n"))
    score = pheno.join(rarity, "drug").groupBy("sample_id").agg(F.min("n").alias("rarest"), F.count(F.lit(1)).alias("labels"))
    ranked = members.join(score, "sample_id", "left").withColumn("_k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.asc_nulls_last("rarest"), F.desc_nulls_last("labels"), "sample_id")))
    return ranked.where("_k = 1").select("cluster", "sample_id")


def folds(rows: DataFrame, by: list[str], key: str, seed: str, k: int) -> DataFrame:
    """Column ``fold`` in 0..k-1: the place in a seeded order of the group, modulo k."""
    order = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("fold", (F.row_number().over(order) - 1) % k)


def fold_phenotypes(folded: DataFrame, k: int) -> DataFrame:
    """``(drug, sample_id, fold, value)``: the labels that each of ``k`` folds trains on as text, ``NA`` for those it leaves out and unknown ones."""
    rows = folded.select("drug", "sample_id", "pheno", F.col("fold").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    return rows.select("drug", "sample_id", "fold", F.coalesce(F.when(F.col("fold") != F.col("own"), F.col("pheno").cast("string")), F.lit("NA")).alias("value"))


def organism_of(ids: DataFrame, runs: DataFrame, samples: DataFrame, prefix: str = "SAM") -> DataFrame:
    """``(id, organism)``: ids that begin with ``prefix`` looked up among ``samples``, the others among ``runs``, both ``(id, organism)``; null if unknown."""
    table = lambda t, c: t.groupBy("id").agg(F.min("organism").alias(c))
    own = ids.select("id").distinct().join(table(samples, "_s"), "id", "left").join(table(runs, "_r"), "id", "left")
    return own.select("id", F.when(F.startswith("id", F.lit(prefix)), F.col("_s")).otherwise(F.col("_r")).alias("organism"))
