"""Trailing totals for every entity and day, from event-contribution deltas.

Each daily amount adds at its day and subtracts when it leaves a window; the running sum of these
deltas is the trailing total.  Only days on which something changes are sorted and summed, and each
resulting step is laid out over its days at the end, so no entity-by-day grid is joined.

Defined results: days without activity have totals of 0; amounts are exact decimals, so a total comes
back to exactly 0; NULL amounts count 0; rows with a NULL entity form an entity of their own; rows
with a NULL day, or before ``first_day``, take no part; entities of ``entities`` without any row have
zero rows for the whole range; an empty input with empty ``entities`` gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DECIMAL = "decimal(38,8)"


def daily_amounts(df: DataFrame, entity: str, day: Column, amount: Column) -> DataFrame:
    """(entity_id, day, mentions, amount): one row for each entity and active day, combined before the shuffle."""
    rows = df.select(F.col(entity).alias("entity_id"), day.alias("day"), amount.alias("amount"))
    return rows.groupBy("entity_id", "day").agg(F.count(F.lit(1)).alias("mentions"), F.coalesce(F.sum("amount"), F.lit(0)).cast(DECIMAL).alias("amount"))


def trailing_totals(daily: DataFrame, entities: DataFrame, first_day: str, last_day: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(entity_id, day, mentions_w, amount_w for each window w) for every entity and day of the range.

    ``daily`` comes from :func:`daily_amounts`; ``entities`` has ``entity_id``.  A window of w days ends
    with the day itself.
    """
    start, end = F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day))

    def delta(day: Column, window: int | None, sign: int) -> Column:
        columns = [day.alias("day")]
        for w in windows:
            counts = sign if w == window or window is None else 0
            columns += [(F.col("mentions") * counts).cast("bigint").alias(f"m{w}"), (F.col("amount") * F.lit(counts)).cast(DECIMAL).alias(f"a{w}")]
        return F.struct(*columns)

    active = daily.filter(F.col("day").between(start, end))
    # Every active entity also has a move of nothing on the first day, so that its series begins there.
    moves = [delta(F.col("day"), None, 1), *[delta(F.date_add("day", w), w, -1) for w in windows], delta(start, 0, 0)]
    zero = [F.lit(0).cast(kind).alias(f"{name}{w}") for w in windows for name, kind in (("m", "bigint"), ("a", DECIMAL))]
    seeds = entities.select("entity_id", start.alias("day"), *zero)
    deltas = active.select("entity_id", F.inline(F.array(*moves))).filter(F.col("day") <= end).unionByName(seeds)
    sums = [F.sum(f"{name}{w}").cast(kind).alias(f"{name}{w}") for w in windows for name, kind in (("m", "bigint"), ("a", DECIMAL))]
    changes = deltas.groupBy("entity_id", "day").agg(*sums)
    order = Window.partitionBy("entity_id").orderBy("day")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = [F.sum(f"m{w}").over(running).alias(f"mentions_{w}") for w in windows] + [F.sum(f"a{w}").over(running).cast(DECIMAL).alias(f"amount_{w}") for w in windows]
    steps = changes.select("entity_id", "day", F.lead("day").over(order).alias("next_day"), *totals)
    until = F.coalesce(F.date_sub("next_day", 1), end)
    names = [f"{n}_{w}" for n in ("mentions", "amount") for w in windows]
    return steps.select("entity_id", F.explode(F.sequence("day", until)).alias("day"), *names)
