"""Session defaults and the shared folder that long lineages are cut into."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", app: str = "murmurline", shuffle_partitions: int = 8, driver_memory: str = "8g", **extra: str) -> SparkSession:
    """A local session with the defaults above; on a cluster the submitted configuration wins."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": driver_memory, "spark.ui.showConsoleProgress": "false"} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the session has it.

    Only where the setting is missing (tests, one machine) a temporary folder is used, which is deleted at the end.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = os.path.join(tempfile.gettempdir(), f"murmurline-checkpoints-{os.getpid()}")
    if not os.path.isdir(base):
        os.makedirs(base, exist_ok=True)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager)
