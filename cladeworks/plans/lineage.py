"""Cutting lineage in a way that survives lost executors.

Intermediate results go, as Parquet, to the shared folder that the cluster
names in ``spark.checkpoint.dir``. Only where that setting is missing and the
master is local (tests) does the session get a temporary folder of its own; a
cluster must name a folder that its executors share.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}
#: Shuffle files go when the write that made them has ended, not whenever the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='cladeworks-')}"
        spark.sparkContext.setCheckpointDir(own)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/cladeworks-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _WRITTEN[path] = spark
    _release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._cladeworks_path = path
    return out


def _release(spark: SparkSession) -> None:
    """Let go of the plans, scalars and broadcasts of steps that are done; long chains of steps would fill the driver with them."""
    gc.collect()  # frames that Python still holds in cycles keep their plans in the JVM
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote; nothing may read ``df`` afterwards."""
    path = getattr(df, "_cladeworks_path", None)
    if path is not None:
        _delete(path)


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_WRITTEN):
        try:
            _delete(path)
        except Exception:  # the JVM may be gone already
            return
