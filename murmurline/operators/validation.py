"""Optional analytics over the panel: forward returns and the daily rank correlation with scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmurline.functions.ranks import ranked_rows
from murmurline.session import cut_lineage


def forward_returns(bars: DataFrame, sessions: int = 5) -> DataFrame:
    """(entity_id, date, forward_return): return of the adjusted close over the next sessions; NULL at the end.

    ``bars`` has one row for each (entity_id, date); sessions without a positive price are left out.
    """
    w = Window.partitionBy("entity_id").orderBy("date")
    good = bars.filter("adj_close > 0")
    return good.select("entity_id", "date", (F.lead("adj_close", sessions).over(w) / F.col("adj_close") - 1).alias("forward_return"))


def rank_correlation(df: DataFrame, group: str, item: str, a: str, b: str) -> DataFrame:
    """(group, pairs, ic): Spearman correlation with averaged ties of each group's complete pairs; NULL for fewer than 3."""
    long = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(group, item, F.inline(F.array(*[F.struct(F.lit(i).alias("no"), (F.round(F.col(c), 9) + F.lit(0.0)).alias("value")) for i, c in enumerate((a, b))])))
    ranked = ranked_rows(cut_lineage(long), [group, "no"]).select(group, item, "no", (F.col("below") + (F.col("held") + 1) / 2.0).alias("rank"))
    wide = ranked.groupBy(group, item).agg(F.max(F.when(F.col("no") == 0, F.col("rank"))).alias("x"), F.max(F.when(F.col("no") == 1, F.col("rank"))).alias("y"))
    # Ranks are half integers, so these sums are exact in any order.
    s = wide.groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    n = F.col("pairs")
    top = n * F.col("sxy") - F.col("sx") * F.col("sy")
    bottom = F.sqrt(n * F.col("sxx") - F.col("sx") * F.col("sx")) * F.sqrt(n * F.col("syy") - F.col("sy") * F.col("sy"))
    return s.select(group, "pairs", F.when((n >= 3) & (bottom > 0), top / bottom).alias("ic"))
