"""The daily attention panel: per-day aggregates, trailing growth and momentum, topic velocity, ranks.

Days are UTC days of the *known* time (``ingested_at``).  Sums are taken over exact decimals, so results
don't depend on partitioning.  NULL means unknown or too little history, 0 means observed no change.

Inputs have one row for each natural key: links (document_id, entity_id, confidence, ingested_at,
published_at, engagement JSON, sentiment) and topic rows (document_id, topic_id, version, probability,
ingested_at, published_at); :func:`first_deliveries` reduces repeated deliveries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmurline.functions.engagement import engagement_value
from murmurline.functions.ranks import places, ranked_rows
from murmurline.params import SignalParams
from murmurline.session import cut_lineage

EXACT = "decimal(38,12)"
COMPONENTS = ("mention_growth", "sentiment_momentum", "topic_velocity", "engagement_growth")


def exact(x: Column) -> Column:
    return x.cast(EXACT)


def first_deliveries(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the delivery with the earliest ``ingested_at``; NULL arrivals last, ties by the other columns."""
    rest = [c for c in df.columns if c not in keys and c != "ingested_at"]
    best = df.groupBy(*keys).agg(F.min(F.struct(F.col("ingested_at").isNull().alias("unknown"), "ingested_at", *rest)).alias("r"))
    return best.select(*[F.col(k) if k in keys else F.col(f"r.{k}").alias(k) for k in df.columns])


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def is_stale(published: Column, ingested: Column, max_age_days: int) -> Column:
    """Known more than ``max_age_days`` after publication, as instants; an unknown publication is fresh."""
    age = F.unix_micros(ingested.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))
    return F.coalesce(age > max_age_days * 86_400_000_000, F.lit(False))


def fresh(df: DataFrame, params: SignalParams) -> DataFrame:
    return df.filter(F.col("ingested_at").isNotNull() & ~is_stale(F.col("published_at"), F.col("ingested_at"), params.max_doc_age_days)).withColumn("day", utc_day(F.col("ingested_at")))


def stale_rows(df: DataFrame, params: SignalParams) -> DataFrame:
    """The rows kept but left out of all signals."""
    return df.filter(is_stale(F.col("published_at"), F.col("ingested_at"), params.max_doc_age_days))


def daily_entity_aggregates(links: DataFrame, params: SignalParams) -> DataFrame:
    """(entity_id, day, mentions, sentiment, engagement) over fresh links, weighted by confidence."""
    return _aggregates(fresh(links, params).withColumn("engaged", engagement_value(F.col("engagement"))))


def _aggregates(day_links: DataFrame) -> DataFrame:
    c, s = F.col("confidence"), F.col("sentiment")
    scored = F.sum(F.when(s.isNotNull(), exact(c)))
    grouped = day_links.groupBy("entity_id", "day").agg(
        F.coalesce(F.sum(exact(c)), F.lit(0)).cast(EXACT).alias("mentions"), F.sum(exact(c * s)).alias("weighted"), scored.alias("scored"), F.coalesce(F.sum(exact(c * F.col("engaged"))), F.lit(0)).cast(EXACT).alias("engagement")
    )
    sentiment = F.when(F.coalesce(F.col("scored"), F.lit(0)) != 0, F.col("weighted").cast("double") / F.col("scored").cast("double"))
    return grouped.select("entity_id", "day", "mentions", sentiment.alias("sentiment"), "engagement")


def panel_origin(links: DataFrame, params: SignalParams) -> DataFrame:
    """One row: the first day with a fresh link (NULL without any)."""
    return fresh(links.select("ingested_at", "published_at"), params).agg(F.min("day").alias("origin"))


def origin_day(links: DataFrame, params: SignalParams) -> str | None:
    """The panel origin as a literal for plans that start there; reads two columns."""
    row = panel_origin(links, params).first()
    return str(row["origin"]) if row and row["origin"] is not None else None


def dense_series(aggregates: DataFrame, entities: DataFrame, origin: str | None, end_day: str, start: str | None = None) -> DataFrame:
    """Every entity on every day from the origin to ``end_day``, zero mentions and engagement where nothing happened.

    With ``start``, days before it are left out, while the history still counts from the origin.  Without an origin,
    or with one after ``end_day``, there is no row.
    """
    first, last = F.to_date(F.lit(origin)), F.to_date(F.lit(end_day))
    begin = first if start is None else F.greatest(first, F.to_date(F.lit(start)))
    spine = entities.select(F.col("id").alias("entity_id")).distinct().filter(begin <= last).select("entity_id", first.alias("origin"), F.explode(F.sequence(begin, last)).alias("day"))
    zero = F.lit(0).cast(EXACT)
    return spine.join(aggregates, ["entity_id", "day"], "left").select("entity_id", "day", F.datediff("day", "origin").alias("history"), F.unix_date("day").alias("day_no"), F.coalesce("mentions", zero).alias("mentions"), "sentiment", F.coalesce("engagement", zero).alias("engagement"))


def _trailing(keys: list[str], days: int):
    return Window.partitionBy(*keys).orderBy("day_no").rangeBetween(-days, -1)


def growth(value: Column, keys: list[str], params: SignalParams) -> Column:
    """(value - mean) / max(mean, 1) against the trailing window, which ends the day before.

    The mean divides by the window's length in days, clipped at the origin; needs ``day_no`` and ``history``.
    """
    length = F.least(F.lit(params.window_days), F.col("history"))
    mean = F.coalesce(F.sum(value).over(_trailing(keys, params.window_days)), F.lit(0)).cast("double") / length
    rate = (value.cast("double") - mean) / F.greatest(mean, F.lit(1.0))
    return F.when((F.col("history") >= params.min_history_days) & (length > 0), rate)


def momentum(value: Column, keys: list[str], params: SignalParams) -> Column:
    """value - mean of the defined values in the trailing window; NULL if today or the history is undefined."""
    w = _trailing(keys, params.window_days)
    enough = (F.col("history") >= params.min_history_days) & (F.count(value).over(w) >= max(params.min_history_days, 1))
    return F.when(enough, value - F.avg(value).over(w))


def topic_day_weights(topic_rows: DataFrame, params: SignalParams) -> DataFrame:
    """(version, topic_id, day, weight): probability mass of fresh documents, linked to an entity or not."""
    return fresh(topic_rows, params).groupBy("version", "topic_id", "day").agg(F.sum(exact(F.col("probability"))).cast(EXACT).alias("weight"))


def version_spans(versions: DataFrame, end_day: str) -> DataFrame:
    """(day, version): the latest version fitted by the end of each day; equal times: the greatest name.

    ``versions`` has one row for each fit (version, created_at) and is a table of a few rows.
    """
    firsts = versions.groupBy("version").agg(F.min("created_at").alias("created_at")).withColumn("from_day", utc_day(F.col("created_at")))
    # Of versions fitted on one day the last holds; each span then ends where the next begins.
    of_day = firsts.groupBy("from_day").agg(F.max_by("version", F.struct("created_at", "version")).alias("version"))
    until = F.coalesce(F.date_sub(F.lead("from_day").over(Window.partitionBy(F.lit(0)).orderBy("from_day")), 1), F.to_date(F.lit(end_day)))
    return of_day.withColumn("until", until).filter("from_day <= until").select("version", F.explode(F.sequence("from_day", "until")).alias("day"))


def topic_velocity(links: DataFrame, topic_rows: DataFrame, versions: DataFrame, origin: str | None, end_day: str, params: SignalParams, after: str | None = None) -> DataFrame:
    """(entity_id, day, topic_velocity): mean growth of the day's topics, weighted by confidence x probability.

    Only days after ``after`` come out, if it is given; the rows of the window before it are still needed.
    """
    return _velocity(fresh(links, params).select("document_id", "entity_id", "confidence", "day"), topic_rows, versions, origin, end_day, params, after)


def _velocity(day_links: DataFrame, topic_rows: DataFrame, versions: DataFrame, origin: str | None, end_day: str, params: SignalParams, after: str | None = None) -> DataFrame:
    spans = version_spans(versions, end_day)  # one row a day
    asked_links = day_links if after is None else day_links.filter(F.col("day") > F.to_date(F.lit(after)))
    assigned = topic_rows.select("version", "document_id", "topic_id", "probability")
    met = asked_links.join(F.broadcast(spans), "day").join(assigned, ["version", "document_id"])
    mass = cut_lineage(met.groupBy("entity_id", "day", "version", "topic_id").agg(F.sum(exact(F.col("confidence") * F.col("probability"))).cast(EXACT).alias("mass")))
    asked = mass.select("version", "topic_id", "day", F.lit(0).cast(EXACT).alias("weight"))
    series = topic_day_weights(topic_rows, params).unionByName(asked).groupBy("version", "topic_id", "day").agg(F.sum("weight").cast(EXACT).alias("weight"))
    start = F.to_date(F.lit(origin))
    clipped = series.filter(F.col("day") >= start).withColumns({"history": F.datediff("day", start), "day_no": F.unix_date("day")})
    rates = clipped.select("version", "topic_id", "day", growth(F.col("weight"), ["version", "topic_id"], params).alias("rate")).filter("rate IS NOT NULL")
    sums = mass.join(rates, ["version", "topic_id", "day"]).groupBy("entity_id", "day").agg(F.sum(exact(F.col("mass").cast("double") * F.col("rate"))).alias("top"), F.sum("mass").alias("bottom"))
    return sums.select("entity_id", "day", F.when(F.col("bottom") != 0, F.col("top").cast("double") / F.col("bottom").cast("double")).alias("topic_velocity"))


def centred_ranks(df: DataFrame, group: str, item: str, columns: list[str]) -> DataFrame:
    """(group, item, <column>_rank...): average ranks of the group's non-NULL values scaled to [-1, 1]; one value alone: 0."""
    entries = F.array(*[F.struct(F.lit(i).alias("no"), (F.round(F.col(c), 9) + F.lit(0.0)).alias("value")) for i, c in enumerate(columns)])
    long = df.select(group, item, F.inline(entries)).filter("value IS NOT NULL AND NOT isnan(value)")
    middle = (F.col("total") + 1) / 2.0
    centred = F.when(F.col("total") == 1, 0.0).otherwise((F.col("below") + (F.col("held") + 1) / 2.0 - middle) / ((F.col("total") - 1) / 2.0))
    placed = ranked_rows(long, [group, "no"]).select(group, item, "no", centred.alias("rank"))
    wide = placed.groupBy(group, item).agg(*[F.max(F.when(F.col("no") == i, F.col("rank"))).alias(f"{c}_rank") for i, c in enumerate(columns)])
    return df.select(group, item).join(wide, [group, item], "left")


def composite(weights: dict[str, float]) -> Column:
    """Weighted mean of the defined component ranks; NULL without any, or without weight."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, weight in weights.items():
        rank = F.col(f"{name}_rank")
        top = top + F.coalesce(rank * weight, F.lit(0.0))
        bottom = bottom + F.when(rank.isNotNull(), F.lit(float(weight))).otherwise(0.0)
    return F.when(bottom > 0, top / bottom)


def components(links: DataFrame, topic_rows: DataFrame, versions: DataFrame, entities: DataFrame, end_day: str, params: SignalParams, origin: str | None = None, after: str | None = None) -> DataFrame:
    """(entity_id, date, the four components) of every active entity and closed day.

    Links and topic rows are read once each; what is kept of them has no text.  With ``after``, a day, only later days come
    out; ``origin`` is then the panel's first day, and the inputs need only hold what became known from one window before.
    """
    day_links = cut_lineage(fresh(links, params).select("document_id", "entity_id", "confidence", "sentiment", engagement_value(F.col("engagement")).alias("engaged"), "day"))
    aggregates = cut_lineage(_aggregates(day_links))
    topic_rows = cut_lineage(topic_rows.select("document_id", "topic_id", "version", "probability", "ingested_at", "published_at"))
    if origin is None:
        row = aggregates.agg(F.min("day").cast("string").alias("origin")).first()
        origin = row["origin"]
    start = None if after is None else _shifted(links, after, 1 - params.window_days)
    dense = dense_series(aggregates, entities.filter("active"), origin, end_day, start)
    key = ["entity_id"]
    measured = dense.select("entity_id", "day", growth(F.col("mentions"), key, params).alias("mention_growth"), momentum(F.col("sentiment"), key, params).alias("sentiment_momentum"), growth(F.col("engagement"), key, params).alias("engagement_growth"))
    velocity = _velocity(day_links, topic_rows, versions, origin, end_day, params, after)
    met = measured.join(velocity, ["entity_id", "day"], "left").select("entity_id", F.col("day").alias("date"), *COMPONENTS)
    return met if after is None else met.filter(F.col("date") > F.to_date(F.lit(after)))


def _shifted(df: DataFrame, day: str, by: int) -> str:
    return df.sparkSession.range(1).select(F.date_add(F.to_date(F.lit(day)), by).cast("string").alias("d")).first()["d"]


def build_panel(links: DataFrame, topic_rows: DataFrame, versions: DataFrame, entities: DataFrame, end_day: str, params: SignalParams | None = None, origin: str | None = None, after: str | None = None) -> DataFrame:
    """(entity_id, date, components, score, rank): the panel of the closed days up to ``end_day``, all or those after ``after``."""
    params = params or SignalParams()
    parts = components(links, topic_rows, versions, entities, end_day, params, origin, after)
    return ranked_panel(parts, params)


def ranked_panel(parts: DataFrame, params: SignalParams) -> DataFrame:
    """Adds ``score`` and ``rank`` to components that are given by (entity_id, date).

    Components and scores are read several times each, so both are kept in the shared checkpoint folder.
    """
    parts = cut_lineage(parts)
    ranks = centred_ranks(parts, "date", "entity_id", list(COMPONENTS))
    scored = parts.join(ranks, ["date", "entity_id"]).withColumn("score", composite(params.weights))
    placed = places(cut_lineage(scored.withColumn("rounded", F.round("score", 9))), "date", "entity_id", "rounded")
    return placed.select("entity_id", "date", *COMPONENTS, "score", F.when(F.col("score").isNotNull(), F.col("place")).cast("int").alias("rank"))
