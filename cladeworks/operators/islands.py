"""Runs of adjacent rows (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_adjacent(df: DataFrame, by: list[str], pos: str = "pos", first: str = "start_pos") -> DataFrame:
    """``(*by, first, length)`` of every maximal run of consecutive distinct positions; the last run counts too."""
    rows = df.select(*by, pos).distinct()
    run = F.col(pos) - F.row_number().over(Window.partitionBy(*by).orderBy(pos))
    return rows.withColumn("_run", run).groupBy(*by, "_run").agg(F.min(pos).alias(first), F.count(F.lit(1)).alias("length")).drop("_run")


def split_runs(df: DataFrame, start: str = "start_pos", length: str = "length") -> DataFrame:
    """One row per position of each run, in column ``pos``; runs of no length give none."""
    keep = [c for c in df.columns if c not in (start, length)]
    return df.where(F.col(length) > 0).select(*keep, F.explode(F.sequence(F.col(start), F.col(start) + F.col(length) - 1)).alias("pos"))


def spacers(features: DataFrame, by: list[str]) -> DataFrame:
    """Gaps between a feature and the one before it within ``by``: ``(*by, name, gap_start, gap_end)``, only where there is a gap."""
    before = F.max("end_pos").over(Window.partitionBy(*by).orderBy("start_pos", "name").rowsBetween(Window.unboundedPreceding, -1))
    return features.withColumn("_end", before).where(F.col("_end") + 1 < F.col("start_pos")).select(*by, "name", (F.col("_end") + 1).alias("gap_start"), (F.col("start_pos") - 1).alias("gap_end"))
