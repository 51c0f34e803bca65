"""Writers of results; each is idempotent (overwrites its own path)."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_variants(kept: DataFrame, path: str) -> None:
    """Calls as Parquet in a folder per sample."""
    kept.repartition("sample_id").sortWithinPartitions("sample_id", "pos").write.mode("overwrite").partitionBy("sample_id").parquet(path)


def write_filter_outputs(kept: DataFrame, low_sites: DataFrame, samples: DataFrame, path: str) -> None:
    """Kept calls, kept positions, low-covered positions, and kept and dropped samples (``samples (sample_id, kept)``)."""
    write_variants(kept, f"{path}/variants")
    for name, rows in (("positions", kept.select("pos").distinct()), ("low_positions", low_sites), ("kept_samples", samples.where("kept").select("sample_id")), ("dropped_samples", samples.where("not kept").select("sample_id"))):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def write_params(spark: SparkSession, params: object, path: str, run_id: str) -> None:
    """A run's parameters as one row ``(name, value)`` each in the folder of the run; those of other runs stay, a run written twice is there once."""
    rows = [(k, str(v)) for k, v in asdict(params).items()]
    spark.createDataFrame(rows, "name string, value string").write.mode("overwrite").json(f"{path}/run_id={run_id}")


def write_fasta(rows: DataFrame, path: str) -> None:
    """``(name, seq)`` as FASTA."""
    rows.select(F.concat(F.lit(">"), F.col("name").cast("string"), F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def write_depth(depth: DataFrame, path: str) -> None:
    """The depths of each sample alone, one a line in the order of their positions, in a folder per sample."""
    depth.repartition("sample_id").sortWithinPartitions("sample_id", "pos").select("sample_id", F.col("depth").cast("string").alias("value")).write.mode("overwrite").partitionBy("sample_id").text(path)


def write_alignment(lines: DataFrame, path: str, row: str = "sample_id") -> None:
    """``(row, block, line)`` as FASTA in part files that follow each other: the lines of a record are its stretches, in order."""
    head = F.when(F.col("block") == 0, F.concat(F.lit(">"), F.col(row).cast("string"), F.lit("\n"))).otherwise("")
    ordered = lines.repartitionByRange(row, "block").sortWithinPartitions(row, "block")
    ordered.select(F.concat(head, "line").alias("value")).write.mode("overwrite").text(path)


def write_edge_table(edges: DataFrame, path: str) -> None:
    """``(child, parent, dist, syn, change, nonsyn)`` with tabs, lists joined by ``;``: the names of the columns, the root alone, then the edges by child.

    The part files follow each other in this order.
    """
    cells = [F.array_join(c, ";") if t.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, t in edges.select("child", "parent", "dist", "syn", "change", "nonsyn").dtypes]
    root = F.col("parent").isNull()
    rows = edges.select(F.when(root, 1).otherwise(2).alias("rank"), F.col("child").cast("string").alias("child"), F.when(root, F.col("child").cast("string")).otherwise(F.concat_ws("\t", *cells)).alias("value"))
    head = edges.sparkSession.createDataFrame([(0, "", "child\tparent\tlength")], rows.schema)
    rows.union(head).repartitionByRange("rank", "child").sortWithinPartitions("rank", "child").select("value").write.mode("overwrite").text(path)


def write_drug_codes(codes: DataFrame, path: str) -> None:
    """``(drug, code)`` by code: what the numbers in the changes of an edge table stand for."""
    codes.repartitionByRange("code").sortWithinPartitions("code").select(F.concat_ws("\t", "drug", F.col("code").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Rates with two decimals; rounding happens only here."""
    cells = [F.format_string("%1.2f", c) if t == "double" else F.col(c).cast("string") for c, t in metrics.dtypes]
    metrics.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def write_selected(selected: DataFrame, path: str) -> None:
    """``(feature, coefficient, p_value)``, strongest first within each file."""
    ordered = selected.repartitionByRange(F.desc(F.abs("coefficient"))).sortWithinPartitions(F.desc(F.abs("coefficient")), "feature")
    ordered.select(F.concat_ws("\t", "feature", F.col("coefficient").cast("string"), F.col("p_value").cast("string")).alias("value")).write.mode("overwrite").text(path)
