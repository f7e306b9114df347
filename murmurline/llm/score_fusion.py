"""One ranking from several scores on unlike scales.

Each score becomes its empirical percentile within its group (ties share the average), the percentile
goes through the inverse normal distribution, and items are ordered by the weighted mean of the
results, so no score counts more for its range or tails.

A group may hold any share of all rows and is never sorted in one task: rows are ranked inside buckets cut
from their value's own bits (sign, exponent, leading fraction), and the rows below each bucket are added
from a small histogram.

Defined results: NULL and NaN scores are left out of their score's percentiles and count neither for
nor against the item; an item without any score has a NULL fused score and comes last; infinities rank
as the extremes; equal fused scores are settled by the smaller key; a score held by one item only has
percentile 0.5; rows with a NULL group are left out; an empty input gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurline.functions.ranks import places, ranked_rows
from murmurline.session import cut_lineage

# The rational approximations of the inverse normal distribution in algorithm AS 241 (PPND16).
CENTRE_TOP = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
CENTRE_BOTTOM = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
MIDDLE_TOP = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
MIDDLE_BOTTOM = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
FAR_TOP = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
FAR_BOTTOM = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _ratio(x: Column, top: tuple, bottom: tuple) -> Column:
    def horner(c: tuple) -> Column:
        acc = F.lit(c[-1])
        for a in reversed(c[:-1]):
            acc = acc * x + F.lit(a)
        return acc

    return horner(top) / horner(bottom)


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1, to about 16 digits, in generated code."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(r <= 5, _ratio(r - 1.6, MIDDLE_TOP, MIDDLE_BOTTOM)).otherwise(_ratio(r - 5.0, FAR_TOP, FAR_BOTTOM))
    return F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, CENTRE_TOP, CENTRE_BOTTOM)).when(q < 0, -tail).otherwise(tail)


def percentile_ranks(long: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``percentile`` of ``value`` within ``group``: (average rank - 0.5) / count, strictly inside 0 and 1.

    ``long`` has no NULL values.
    """
    percentile = (F.col("below") + F.col("held") / 2.0) / F.col("total")
    return ranked_rows(long, group).select(*long.columns, percentile.alias("percentile"))


def fused_scores(df: DataFrame, group: str, item: str, scores: dict[str, float]) -> DataFrame:
    """(group_id, item_id, fused, used): the weighted mean of the normal scores and how many scores counted.

    ``scores`` maps a numeric column to its weight.  ``df`` has one row for each (group, item).
    """
    names = list(scores)
    # Every score reads the rows again, for its counts and for its ranks.
    base = cut_lineage(df.filter(F.col(group).isNotNull()).select(F.col(group).alias("group_id"), F.col(item).alias("item_id"), *[(F.col(n).cast("double") + F.lit(0.0)).alias(f"s{i}") for i, n in enumerate(names)]))
    entries = F.array(*[F.struct(F.lit(i).cast("byte").alias("score_no"), F.col(f"s{i}").alias("value")) for i in range(len(names))])
    known = base.select("group_id", "item_id", F.inline(entries)).filter("value IS NOT NULL AND NOT isnan(value)")
    normal = percentile_ranks(known, ["group_id", "score_no"]).select("group_id", "item_id", "score_no", inverse_normal(F.col("percentile")).alias("z"))
    # All scores of an item meet again; a column for each makes the sum independent of row order.
    none = F.lit(True)
    for i in range(len(names)):
        none = none & (F.col(f"s{i}").isNull() | F.isnan(f"s{i}"))
    without = base.filter(none).select("group_id", "item_id", F.lit(-1).cast("byte").alias("score_no"), F.lit(None).cast("double").alias("z"))
    # They are brought together as they are: an item's scores come from different tasks, so aggregating before finds no two of it.
    met = normal.unionByName(without).repartition("group_id", "item_id").groupBy("group_id", "item_id")
    wide = met.agg(*[F.max(F.when(F.col("score_no") == i, F.col("z"))).alias(f"z{i}") for i in range(len(names))])
    total, weight, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for i, n in enumerate(names):
        there = F.col(f"z{i}").isNotNull()
        total = total + F.when(there, F.col(f"z{i}") * float(scores[n])).otherwise(0.0)
        weight = weight + F.when(there, float(scores[n])).otherwise(0.0)
        used = used + there.cast("int")
    return wide.select("group_id", "item_id", F.when(weight > 0, total / weight).alias("fused"), used.alias("used"))


def best_of_groups(fused: DataFrame) -> DataFrame:
    """The first item of each group's ranking; maxima are taken before the shuffle."""
    best = fused.filter("fused IS NOT NULL").groupBy("group_id").agg(F.max(F.struct("fused", (-F.col("item_id")).alias("order"), "item_id")).alias("b"))
    return best.select("group_id", F.col("b.item_id").alias("item_id"), F.col("b.fused").alias("fused"))


def ranking(fused: DataFrame) -> DataFrame:
    """Adds ``place``: 1 for the highest fused score of the group, NULL scores last, equal ones by item."""
    return places(fused, "group_id", "item_id", "fused")
