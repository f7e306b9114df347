"""The log of ingestion runs: an append-only table with one row for each event of a run.

A run has a row when it starts (``running``) and one when it ends (``success`` or ``error``); :func:`runs` gives the state
of each.  A run whose process was lost stays ``running``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurline.schemas import RUN_STATES, TABLES
from murmurline.sources.versions import append_rows, read_table


def get_or_create_source(spark: SparkSession, folder: str, kind: str, name: str, config_ref: str | None, now: datetime) -> int:
    """The id of the source of this name, which is added if it is not there yet."""
    held = read_table(spark, f"{folder}/sources", TABLES["sources"])
    row = held.filter(F.col("name") == name).agg(F.min("id").alias("id")).first()
    if row["id"] is not None:
        return row["id"]
    number = held.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"] + 1
    append_rows(spark.createDataFrame([(number, kind, name, config_ref, now)], TABLES["sources"]), f"{folder}/sources")
    return number


def _add(spark: SparkSession, folder: str, row: tuple) -> None:
    append_rows(spark.createDataFrame([row], TABLES["ingestion_runs"]).coalesce(1), f"{folder}/ingestion_runs")


def start_run(spark: SparkSession, folder: str, source_id: int, now: datetime) -> tuple[int, datetime]:
    """(id, start) of a new run, visible as ``running`` before any other work."""
    held = read_table(spark, f"{folder}/ingestion_runs", TABLES["ingestion_runs"])
    number = held.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"] + 1
    _add(spark, folder, (number, source_id, now, None, RUN_STATES[0], 0, 0, None, None))
    return number, now


def finish_run(spark: SparkSession, folder: str, run: tuple[int, datetime], source_id: int, now: datetime, status: str, rows_fetched: int = 0, rows_inserted: int = 0, raw_path: str | None = None, error: str | None = None) -> None:
    """The end of a run, with what it fetched and wrote or why it failed."""
    if status not in RUN_STATES[1:]:
        raise ValueError(f"a run ends with one of {RUN_STATES[1:]}, not {status}")
    _add(spark, folder, (run[0], source_id, run[1], now, status, rows_fetched, rows_inserted, raw_path, error))


def runs(log: DataFrame) -> DataFrame:
    """The state of each run: its end if it has one, else its start."""
    rest = [c for c in log.columns if c != "id"]
    last = log.groupBy("id").agg(F.max(F.struct(F.col("finished_at").isNotNull().alias("ended"), *rest)).alias("r"))
    return last.select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def recent_runs(state: DataFrame, sources: DataFrame, limit: int = 20) -> DataFrame:
    """The latest runs with their sources' names: a top-k report.  A run of an unknown source has no name."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return state.join(names, "source_id", "left").orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)
