"""Ranks within groups of any size, without sorting a group in one task.

Rows are ranked inside buckets cut from their value's own bits (sign, exponent, leading fraction), and what
lies below each bucket comes from a small histogram.  A bucket that holds more than ``CROWDED`` rows, such as one
with a value that a third of all rows share, is not sorted row by row: its equal values are counted first, which
shrinks it before the shuffle, and the rows look their value up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmurline.session import cut_lineage

CROWDED = 1_000_000
COARSE = 16  # fine buckets that are ranked together


def value_bucket(value: Column) -> Column:
    """A number that never falls as ``value`` grows; values of one bucket differ by less than 1 %."""
    size = F.abs(value)
    exponent = F.when(size == 0, -1075).when(size == float("inf"), 1025).otherwise(F.floor(F.log2(size)))
    step = F.when((size == 0) | (size == float("inf")), 0).otherwise(F.least(F.greatest(F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * 128), F.lit(-64)), F.lit(191)))
    code = (exponent + 1100) * 256 + step + 64
    return F.when(value < 0, -code).otherwise(code).cast("long")


def value_ranks(long: DataFrame, group: list[str]) -> DataFrame:
    """(group, value, below, held, total): how many rows are smaller, equal, and in the group.

    ``long`` has the group columns and ``value``, a double that is not NULL.
    """
    counted = long.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("held")).withColumn("bucket", value_bucket(F.col("value")))
    buckets = counted.groupBy(*group, "bucket").agg(F.sum("held").alias("in_bucket"))
    by_group = Window.partitionBy(*group)
    offsets = buckets.select(*group, "bucket", (F.sum("in_bucket").over(by_group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_bucket")).alias("before"), F.sum("in_bucket").over(by_group).alias("total"))
    inside = Window.partitionBy(*group, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("held").over(inside)).join(offsets, [*group, "bucket"])
    return ranked.select(*group, "value", (F.col("before") + F.col("upto") - F.col("held")).alias("below"), "held", "total")


def ranked_rows(long: DataFrame, group: list[str], crowded: int = CROWDED) -> DataFrame:
    """``long`` plus ``below``, ``held`` and ``total``: how many rows of its group are smaller, equal, and there are.

    ``long`` has the group columns, ``value``, a double that is not NULL, and any others; it is read twice.
    """
    # Very small buckets would cost a window each for a row or two.
    rows = long.withColumn("bucket", F.floor(value_bucket(F.col("value")) / COARSE))
    keys = [*group, "bucket"]
    running = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    offsets = cut_lineage(counts.select(*keys, "n", (F.sum("n").over(running) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(*group)).alias("total")))
    hot = offsets.filter(F.col("n") > crowded).select(*keys)
    any_hot = not hot.isEmpty()
    light = rows.join(hot, keys, "left_anti") if any_hot else rows
    # One shuffle by bucket and one sort serve both windows and the join with the offsets.
    inside = light.withColumns({"inside": F.rank().over(Window.partitionBy(*keys).orderBy("value")) - 1, "held": F.count(F.lit(1)).over(Window.partitionBy(*keys, "value"))})
    ranked = inside.join(offsets.drop("n"), keys).withColumn("below", F.col("before") + F.col("inside")).select(*long.columns, "below", "held", "total")
    if not any_hot:
        return ranked
    dense = rows.join(hot, keys, "left_semi")
    # Adaptive execution splits the rows of a hot value over tasks.
    looked_up = dense.drop("bucket").join(value_ranks(long, group), [*group, "value"])
    return ranked.unionByName(looked_up.select(*long.columns, "below", "held", "total"))


def places(rows: DataFrame, group: str, item: str, score: str, resolution: int = 4096) -> DataFrame:
    """Adds ``place`` to each (group, item): 1 for the highest score, NULL last, equal ones by item."""
    known = rows.withColumn("bucket", F.when(F.col(score).isNull(), F.lit(2**62)).otherwise(-F.floor(F.col(score) * resolution).cast("long")))
    buckets = known.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    above = buckets.select(group, "bucket", (F.sum("in_bucket").over(Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_bucket")).alias("above"))
    order = Window.partitionBy(group, "bucket").orderBy(F.col(score).desc_nulls_last(), F.col(item))
    placed = known.withColumn("inside", F.row_number().over(order)).join(above, [group, "bucket"])
    return placed.withColumn("place", F.col("above") + F.col("inside")).drop("bucket", "inside", "above")
