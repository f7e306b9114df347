"""Validation of candidate sources: completeness, freshness, monthly volume, and the scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECOMMENDED_COMPLETENESS = 0.80


def present(df: DataFrame, name: str) -> Column:
    """Whether a field counts as filled: not NULL, empty text, or an empty list; 0 and false do."""
    kind = dict(df.dtypes)[name]
    col = F.col(name)
    if kind == "string":
        return col.isNotNull() & (col != "")
    if kind.startswith(("array", "map")):
        return col.isNotNull() & (F.size(col) > 0)
    return col.isNotNull()


def field_completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, completeness): the share of filled values; 0 for no rows."""
    shares = df.agg(*[F.coalesce(F.avg(F.when(present(df, f), 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"c{i}") for i, f in enumerate(fields)])
    return shares.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("completeness")) for i, f in enumerate(fields)])))


def monthly_volume(df: DataFrame, group: str, epoch: str, hours: float = 720.0) -> DataFrame:
    """(group, estimated): records a month from the middle half of the times, which a few odd ones don't disturb.

    The quartiles are the values at positions floor(p * (n - 1)); NULL with fewer than 4 times or no span.
    Times are counted by value first and the positions found in running counts, so no group is sorted as a list.
    """
    times = df.filter(F.col(epoch).isNotNull()).groupBy(F.col(group).alias("g"), F.col(epoch).cast("double").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = times.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("g"))})

    def at(p: float) -> Column:
        position = F.floor(F.lit(p) * (F.col("all") - 1))
        return F.min(F.when(F.col("upto") > position, F.col("t")))

    quartiles = ranked.groupBy("g").agg(F.max("all").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    span = (F.col("q3") - F.col("q1")) / 3600.0
    rate = F.when((F.col("n") >= 4) & (span > 0), 0.5 * F.col("n") / span)
    return quartiles.select(F.col("g").alias(group), F.bround(rate * hours).cast("bigint").alias("estimated"))


def freshness_hours(df: DataFrame, epoch: str, now_epoch: float) -> DataFrame:
    """One row: hours since the newest record."""
    return df.agg(F.bround((F.lit(now_epoch) - F.max(F.col(epoch).cast("double"))) / 3600.0, 2).alias("freshness_hours"))


def scorecard(rows: DataFrame) -> DataFrame:
    """Adds ``recommended`` to (source, status, records, completeness, ...): ok, not empty, complete enough."""
    good = (F.col("status") == "ok") & (F.col("records") > 0) & (F.col("completeness") >= RECOMMENDED_COMPLETENESS)
    return rows.withColumn("recommended", F.coalesce(good, F.lit(False)))
