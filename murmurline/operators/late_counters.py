"""Period totals by event time that late, repeated and reordered records can't spoil.

The state is a table of conflict-free counters.  Each *source* of a counter (here the document that
mentions a key) owns one register: the contribution it makes and the *version* that made it.  The
merge of two states keeps, for each (key, source), the register of the greatest version, and a
period's total is the sum over its sources.  As the merge is a maximum it is associative, commutative
and idempotent: retried batches, other batch sizes and any order of arrival give the same table.

The version of a register is its first time of arrival, the earlier the greater, so that a later
delivery of the same link never changes what was counted.

Defined results: a NULL event time keeps its register but belongs to no period and has no outcome; a
NULL arrival loses to any known arrival; equal arrivals are settled by the smaller event time, then
the smaller weight; NULL keys form a key of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAR = 9_000_000_000_000_000_000
STATE = ["key_id", "source_id", "version", "event_us", "known_us", "weight"]


def registers(df: DataFrame, key: str, source: str, event_time: str, known_time: str, weight: str) -> DataFrame:
    """The state after all deliveries in ``df``: one register for each (key, source)."""
    known = F.unix_micros(F.col(known_time).cast("timestamp"))
    rows = df.select(F.col(key).alias("key_id"), F.col(source).alias("source_id"), (-F.coalesce(known, F.lit(FAR))).alias("version"), F.unix_micros(F.col(event_time).cast("timestamp")).alias("event_us"), known.alias("known_us"), F.col(weight).cast("double").alias("weight"))
    return _highest(rows)


def _highest(rows: DataFrame) -> DataFrame:
    """The greatest register of each (key, source); partial maxima are taken before the shuffle."""
    order = F.struct("version", (-F.coalesce("event_us", F.lit(FAR))).alias("e"), (-F.coalesce("weight", F.lit(float("inf")))).alias("w"), "event_us", "known_us", "weight")
    best = rows.groupBy("key_id", "source_id").agg(F.max(order).alias("r"))
    return best.select("key_id", "source_id", "r.version", "r.event_us", "r.known_us", "r.weight")


def merge(*states: DataFrame) -> DataFrame:
    """The state that holds all deliveries of ``states``, however often and in whatever order they came."""
    rows = states[0].select(STATE)
    for other in states[1:]:
        rows = rows.unionByName(other.select(STATE))
    return _highest(rows)


def outcomes(state: DataFrame, lateness_us: int) -> DataFrame:
    """Adds ``period`` (UTC day of the event) and ``outcome`` to each register with an event time.

    ``too_late``: it arrived more than ``lateness_us`` after the event.  ``correction``: it arrived on a
    later day, so it corrects a closed period.  ``on_time``: any other, also if published in advance.
    """
    day_us = F.lit(86_400_000_000)

    def day(us: Column) -> Column:
        return F.floor(us / day_us)

    late = F.when(F.col("known_us") - F.col("event_us") > lateness_us, "too_late").when(day(F.col("known_us")) > day(F.col("event_us")), "correction").otherwise("on_time")
    return state.filter("event_us IS NOT NULL").withColumns({"period": F.date_from_unix_date(day(F.col("event_us")).cast("int")), "outcome": late})


def period_totals(state: DataFrame, lateness_us: int) -> DataFrame:
    """For each (key, period): what the period held when it closed, after corrections, and what came too late.

    Weights are summed as decimals, so the totals don't depend on the order of rows or partitions.
    """
    o, w = F.col("outcome"), F.coalesce(F.col("weight"), F.lit(0.0)).cast("decimal(28,10)")

    def count(*kinds: str) -> Column:
        return F.count_if(o.isin(*kinds))

    return outcomes(state, lateness_us).groupBy("key_id", "period").agg(
        count("on_time").alias("closed_count"), count("on_time", "correction").alias("corrected_count"), count("correction").alias("corrections"), count("too_late").alias("too_late"),
        F.sum(F.when(o == "on_time", w).otherwise(0)).cast("double").alias("closed_weight"), F.sum(F.when(o != "too_late", w).otherwise(0)).cast("double").alias("corrected_weight"),
    )
