"""Sinks: the raw lake, whole-day partitions, append-only logs, samples and the scorecard; :mod:`murmurline.sources.versions` has keyed tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurline.session import cut_lineage


def write_bronze(raw: DataFrame, lake: str, source: str, at: datetime) -> dict | None:
    """Appends a batch as gzip JSON lines under ``<source>/dt=<day>/<batch>`` with a manifest; an empty batch writes nothing.

    The manifest's checksum does not depend on the order of rows, which a distributed write does not fix: the SHA-256
    of the rows' own SHA-256 sums added up modulo 2^120, and of their number.
    """
    raw = cut_lineage(raw)  # a fetch is not asked for twice
    third = [F.sum(F.conv(F.substring("h", 10 * i + 1, 10), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(3)]
    hashed = raw.select(F.sha2(F.to_json(F.struct(*raw.columns), {"ignoreNullFields": "false"}), 256).alias("h"))
    counted = hashed.agg(F.count(F.lit(1)).alias("rows"), *third).first()
    if not counted["rows"]:
        return None
    joined = ":".join(str(x) for x in (counted["rows"], *[int(counted[f"h{i}"]) % 2**40 for i in range(3)]))
    day, stem = at.date().isoformat(), f"{source}-{at.strftime('%Y%m%dT%H%M%SZ')}-{uuid.uuid4().hex[:8]}"
    path = f"{lake}/{source}/dt={day}/{stem}"
    raw.write.mode("error").option("compression", "gzip").option("ignoreNullFields", "false").json(path)
    manifest = {"source": source, "path": path, "rows": counted["rows"], "sha256": hashlib.sha256(joined.encode()).hexdigest(), "written_at": at.isoformat()}
    raw.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("error").text(f"{lake}/_manifests/{stem}")
    return manifest


def overwrite_days(panel: DataFrame, path: str, survivors: DataFrame | None = None, rows_a_file: int = 5_000_000) -> None:
    """Replaces exactly the days in ``panel``; rows of ``survivors`` on those days without a new row stay.

    A day's rows are spread over as many tasks as its size asks for, so a large day is not written by one.
    """
    out = panel
    if survivors is not None:
        days = panel.select("date").distinct()
        kept = survivors.join(F.broadcast(days), "date", "left_semi").join(panel.select("entity_id", "date"), ["entity_id", "date"], "left_anti")  # one row a day
        out = cut_lineage(panel.unionByName(kept.select(panel.columns)))  # reads the days it replaces
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows_of_day") / rows_a_file))
    sizes = out.groupBy("date").agg(F.count(F.lit(1)).alias("rows_of_day"))
    placed = out.join(F.broadcast(sizes), "date").withColumn("part", F.pmod(F.xxhash64("entity_id"), parts))  # one row a day
    placed.repartition("date", "part").drop("part", "rows_of_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends to an append-only log such as runs, quality results or topic versions."""
    rows.write.mode("append").parquet(path)


def sample_files(raw: DataFrame, path: str, rows: int = 100, csv: bool = False) -> None:
    """The raw records and a sample of ``rows`` of them, as JSON or CSV: a sampling feature."""
    raw.write.mode("overwrite").json(f"{path}/raw")
    sample = raw.limit(rows)
    if csv:
        sample.write.mode("overwrite").option("header", True).csv(f"{path}/sample")
    else:
        sample.write.mode("overwrite").json(f"{path}/sample")


def markdown_table(rows: list, columns: list[str]) -> str:
    """A small report as Markdown, NULL cells empty."""
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows]) + "\n"


def write_scorecard(card: DataFrame, path: str) -> str:
    """The scorecard, a row for each candidate source, as CSV with a header and as Markdown; returns the Markdown."""
    columns = card.columns
    card.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(f"{path}/csv")
    text = markdown_table(card.orderBy("source").collect(), columns)
    card.sparkSession.createDataFrame([(line,) for line in text.splitlines()], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
    return text
