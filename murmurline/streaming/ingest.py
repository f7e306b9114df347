"""Incremental ingestion of canonical documents: new content only, each micro-batch at most once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from murmurline.operators.upserts import new_rows
from murmurline.sources.versions import file_system


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the writer that owns a checkpoint, given when the checkpoint is new and lost with it."""
    fs, at = file_system(spark, f"{checkpoint}/writers")
    if not fs.exists(at):
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(at, uuid.uuid4().hex[:12]))
    return sorted(s.getPath().getName() for s in fs.listStatus(at))[0]


def ingest_documents(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the documents whose content hash is not in the table yet, by writer and batch.

    A batch writes to its own directory and overwrites it when retried; a writer whose checkpoint was lost gets another name
    and overwrites nothing of its predecessor's.  The anti-join reads the hashes only and keeps the state in the table.
    """
    writer = writer_of(stream.sparkSession, checkpoint)

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs, root = file_system(spark, path)
        held = "content_hash string, writer string, batch bigint"
        old = spark.read.schema(held).parquet(path) if fs.exists(root) else spark.createDataFrame([], held)
        others = old.filter((F.col("writer") != writer) | (F.col("batch") != batch_id))
        fresh = new_rows(others, batch, ["content_hash"], [F.col("ingested_at"), F.col("external_id")])
        fresh.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
