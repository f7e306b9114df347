"""Late-event counters kept up by micro-batches.

A batch appends the registers of its own deliveries; nothing that is there is read or rewritten, so its work is in
proportion to the batch.  The state is the merge of all that was appended.  As the merge is idempotent, a batch that
is retried, split, reordered or left half-written by a lost writer gives the same state, and exactly-once delivery is
not needed.  Now and then the appended registers are merged into a new version of the base table; they are deleted only
after that version counts, and registers that are in both change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from murmurline.operators import late_counters
from murmurline.sources.versions import file_system, read_table, swap_table

STATE_SCHEMA = "key_id int, source_id bigint, version bigint, event_us bigint, known_us bigint, weight double"
COMPACT_EVERY = 50


def _appended(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, f"{path}/appended")
    return sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")) if fs.exists(at) else []


def _state(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    base = read_table(spark, f"{path}/base", STATE_SCHEMA)
    return late_counters.merge(base, spark.read.schema(STATE_SCHEMA).parquet(*files)) if files else base


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """The registers after all batches so far, empty before the first."""
    return _state(spark, path, _appended(spark, path))


def compact(spark: SparkSession, path: str) -> None:
    """Merges what was appended so far into a new version of the base table."""
    files = _appended(spark, path)
    if not files:
        return
    swap_table(_state(spark, path, files), f"{path}/base")
    for name in files:
        fs, at = file_system(spark, name)
        fs.delete(at, False)


def keep_registers(stream: DataFrame, path: str, checkpoint: str, columns: dict[str, str], on_batch: Callable[[int], None] | None = None, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Starts a query that appends the registers of every available delivery to the state at ``path`` and ends.

    ``columns`` names key, source, event_time, known_time and weight among the stream's columns.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        new = late_counters.registers(batch, columns["key"], columns["source"], columns["event_time"], columns["known_time"], columns["weight"])
        new.write.mode("append").parquet(f"{path}/appended")
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, path)
        if on_batch is not None:
            on_batch(batch_id)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
