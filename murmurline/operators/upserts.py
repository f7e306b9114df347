"""Writes by natural key on tables without MERGE, as frames of the table after the write.

Each function gives the new state; :mod:`murmurline.sources.sinks` writes it beside the old one and swaps.
A re-run with the same batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rn__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn__ = 1").drop("rn__")


def new_rows(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of ``batch`` whose key is not there yet; of one key in the batch the first by ``order``."""
    return _one_per_key(batch, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")


def insert_if_absent(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First wins: ``existing`` and the new rows."""
    return existing.unionByName(new_rows(existing, batch, keys, order).select(existing.columns))


def upsert_last_wins(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[Column], keep_first: list[str] | None = None) -> DataFrame:
    """Last wins: rows of ``batch`` replace those of the same key; of one key in the batch the last by ``order``.

    ``keep_first``: columns that keep the value they had, such as the first time of arrival.
    """
    last = _one_per_key(batch, keys, [o.desc() for o in order])
    kept = existing.join(last.select(*keys), keys, "left_anti").select(existing.columns)
    if not keep_first:
        return kept.unionByName(last.select(existing.columns))
    old = existing.select(*keys, *[F.col(c).alias(f"old_{c}") for c in keep_first])
    merged = last.join(old, keys, "left")
    values = [F.coalesce(f"old_{c}", c).alias(c) if c in keep_first else F.col(c) for c in existing.columns]
    return kept.unionByName(merged.select(*values))


def seed_entities(existing: DataFrame, universe: DataFrame, now: Column, update: bool = False) -> DataFrame:
    """Entities by ticker: names default to the ticker, aliases to none; ``update`` refreshes and re-activates."""
    filled = universe.select("ticker", F.coalesce("name", "ticker").alias("name"), "sector", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    once = _one_per_key(filled, ["ticker"], [F.col("name")])
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    fresh = once.join(existing.select("ticker"), "ticker", "left_anti").withColumn("k", F.lit(1)).join(top.withColumn("k", F.lit(1)), "k")
    # The universe is a configuration table of bounded size, so one ordered window numbers it.
    numbered = fresh.withColumn("id", (F.col("top") + F.row_number().over(Window.partitionBy("k").orderBy("ticker"))).cast("int"))
    added = numbered.select("id", "ticker", "name", "sector", "aliases", F.lit(True).alias("active"), now.alias("created_at"))
    if not update:
        return existing.unionByName(added)
    u = once.select("ticker", F.col("name").alias("u_name"), F.col("sector").alias("u_sector"), F.col("aliases").alias("u_aliases"), F.lit(True).alias("hit"))
    met = existing.join(u, "ticker", "left")
    hit = F.coalesce("hit", F.lit(False))
    refreshed = met.select("id", "ticker", *[F.when(hit, F.col(f"u_{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "sector", "aliases")], (hit | F.col("active")).alias("active"), "created_at")
    return refreshed.unionByName(added)


def stamp(documents: DataFrame, stage: str, at: Column) -> DataFrame:
    """(document_id, stage, at): marks every scanned document, matched or not; appended beside the documents."""
    return documents.select(F.col("id").alias("document_id"), F.lit(stage).alias("stage"), at.alias("at"))


def unstamped(documents: DataFrame, stamps: DataFrame, stage: str) -> DataFrame:
    """Documents that a stage has not seen."""
    return documents.join(stamps.filter(F.col("stage") == stage).select(F.col("document_id").alias("id")), "id", "left_anti")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key by ``order``; ties by the remaining columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def continue_ids(existing: DataFrame, new: DataFrame, order: list[Column], bucket: Column, buckets: int = 1024) -> DataFrame:
    """``new`` with ids from max(id) + 1 on in ingestion order, numbered in ``bucket`` order without one big sort.

    ``bucket`` is an integer from 0 to ``buckets`` - 1 that rises with the order, such as a time slice.
    """
    held = new.withColumn("b__", bucket)
    sizes = held.groupBy("b__").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("b__", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("b__").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    numbered = held.join(offsets, "b__").withColumn("id", F.lit(top) + F.col("before") + F.row_number().over(Window.partitionBy("b__").orderBy(*order)))
    return numbered.drop("b__", "before")
