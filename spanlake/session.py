"""Session settings the engine relies on, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings; all of them can be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Display maps keep the last of duplicate attribute keys.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Payloads are one unbroken base64 text.
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Stream state lives on disk beside the executor, not in its heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Top-k per lane may be pruned before the shuffle up to this many rows.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    fresh = tempfile.mkdtemp(prefix="spanlake-")
    spark.conf.set("spark.checkpoint.dir", fresh)
    return fresh


def run_dir(spark: SparkSession, label: str) -> str:
    """A new, so far unused folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table below the shared folder and read it back.

    The table outlives lost executors, is computed once, and keeps later plans short.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
