"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def share_below(key: Column, share: float) -> Column:
    """True for about ``share`` of all keys, by a hash of the key that no fold uses."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in pieces, so that what is derived from a piece stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in batches of 4 MB at most, so that long texts don't fill the memory of an executor's workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def dense(counts: DataFrame, index: str, value: str, size: int, dtype: str = "bigint") -> Column:
    """A scalar array of fixed ``size`` whose element i+1 is ``value`` where ``index`` = i, else 0.

    Only for tables whose size is fixed beforehand: the array travels with the plan.
    """
    spark = counts.sparkSession
    full = (
        spark.range(size).select(F.col("id").cast("long").alias("_i"))
        .join(counts.select(F.col(index).cast("long").alias("_i"), F.col(value).cast(dtype).alias("_v")), "_i", "left")
        .agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_v", F.lit(0).cast(dtype)).alias("_v")))).alias("_a"))
        .select(F.col("_a._v").alias("_a"))
    )
    return full.scalar()


def bit_array(keys: DataFrame, key: str, words: int) -> Column:
    """A scalar bitmap of ``words`` longs (fixed size) in which the bit of every key is set."""
    at = F.pmod(F.col(key), F.lit(words * 64))
    packed = (
        keys.where(F.col(key).isNotNull())
        .select(F.shiftright(at, 6).alias("w"), (at % 64).cast("int").alias("b"))
        .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    )
    return dense(packed, "w", "bits", words)


def bit_is_set(bitmap: Column, key: Column, words: int) -> Column:
    """False only for keys that are surely not in ``bit_array``."""
    at = F.pmod(key, F.lit(words * 64))
    word = F.element_at(bitmap, (F.shiftright(at, 6) + 1).cast("int"))
    return F.getbit(word, (at % 64).cast("int")) == 1
