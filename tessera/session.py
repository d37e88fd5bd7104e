"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Settings every job relies on: AQE re-plans joins at runtime (broadcast only
# when the measured side is small, split skewed partitions), UTC everywhere,
# Arrow for the few pandas paths, and no web UI.
DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # sizing for large inputs: AQE coalesces shuffle partitions towards
    # 256 MB, scans split files at 256 MB, a partition 3x the median (and
    # above 256 MB) counts as skewed and is split, and a join side is
    # broadcast only when its measured size is below 64 MB
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # joins partition on their full key set: sharing a partitioning on a
    # low-cardinality prefix ({event_type} inside {event_type, k}) would put
    # the whole table into a handful of tasks
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
}


def get_spark(master: str | None = None, app: str = "tessera",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests use
    ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or "local[*]")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we use it as
    is. Only a local session without one gets a scratch folder, so tests can
    call ``checkpoint()``.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def written(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read
    back: cuts the lineage, survives a lost executor, and the size of the files
    (not an estimate that grows with every join before) drives later joins.
    ``schema``: that of the rows read back, if it differs."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
