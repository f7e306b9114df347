"""The general training-data queries, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurline.functions.engagement import engagement_amount
from murmurline.operators import instants, late_counters, spikes
from murmurline.operators.trailing_totals import daily_amounts, trailing_totals
from murmurline.sources.tables import table


BAR_FIELDS = {"close": spikes.PRICE, "adj_close": spikes.PRICE, "volume": spikes.COUNT}


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, sf_dir, "market_data"), "entity_id", "date", "ingested_at", BAR_FIELDS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every impossible, wildly deviating or no longer updating reading of a bar."""
    return _readings(spark, sf_dir).select(F.col("source_id").cast("int").alias("entity_id"), F.col("day").cast("string").alias("bar_date"), "field").distinct()


def p1_readings_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings of each entity, field and kind are implausible."""
    return _readings(spark, sf_dir).groupBy(F.col("source_id").alias("entity_id"), "field", "kind").agg(F.count("*").alias("readings"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one UTC instant (or trading day) of every usable record of the three raw feeds."""
    zones = table(spark, sf_dir, "feed_zones")
    rss = instants.normalize_instants(table(spark, sf_dir, "rss_raw"), ["record_id"], "published_date", "source", zones)
    hn = instants.normalize_instants(table(spark, sf_dir, "hn_raw"), ["id"], "timestamp", F.lit("hackernews"), zones, numeric=True)
    bars = instants.trading_day(instants.normalize_instants(table(spark, sf_dir, "bars_raw"), ["record_id"], "date", F.lit("yahoo"), zones))

    def found(df: DataFrame, origin: str, key: str) -> DataFrame:
        kept = df.filter((F.col("kind") == "instant") & instants.usable(F.col("instant_us")))
        return kept.select(F.lit(origin).alias("origin"), F.col(key).cast("long").alias("record_id"), instants.iso_utc_millis(F.col("instant_us")).alias("utc_value"))

    days = bars.filter(F.col("kind").isNotNull() & F.col("day").between("2020-01-01", "2029-12-31")).select(F.lit("yahoo").alias("origin"), F.col("record_id").cast("long").alias("record_id"), F.col("day").alias("utc_value"))
    return found(rss, "rss", "record_id").unionByName(found(hn, "hackernews", "id").distinct()).unionByName(days)


WEEK_US = 7 * 86_400_000_000


def _states(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "links": late_counters.registers(table(spark, sf_dir, "links"), "entity_id", "document_id", "published_at", "ingested_at", "confidence"),
        "topic_rows": late_counters.registers(table(spark, sf_dir, "topic_rows"), "topic_id", "document_id", "published_at", "ingested_at", "probability"),
    }


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and topic rows that corrected a closed day, or came too late for it."""
    parts = [late_counters.outcomes(state, WEEK_US).filter("outcome <> 'on_time'").select(F.lit(origin).alias("origin"), F.col("source_id").alias("document_id"), F.col("key_id").cast("int").alias("key_id"), "outcome") for origin, state in _states(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


def p3_day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day totals by event time: as the day closed, as corrected, and what came too late."""
    parts = []
    for origin, state in _states(spark, sf_dir).items():
        totals = late_counters.period_totals(state, WEEK_US)
        parts.append(totals.select(F.lit(origin).alias("origin"), F.col("key_id").cast("int").alias("key_id"), F.col("period").cast("string").alias("day"), "closed_count", "corrected_count", "corrections", "too_late", F.round("closed_weight", 6).alias("closed_weight"), F.round("corrected_weight", 6).alias("corrected_weight")))
    return parts[0].unionByName(parts[1])


FIRST_DAY, LAST_DAY, FIRST_CASE = "2025-12-15", "2026-04-30", "2026-01-13"


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "links").select("document_id", "entity_id", "published_at", "ingested_at", "engagement")
    first = links.groupBy("document_id", "entity_id").agg(F.min(F.struct(F.col("ingested_at").isNull().alias("unknown"), "ingested_at", "published_at", "engagement")).alias("r"))
    day = F.to_date(F.coalesce("r.published_at", "r.ingested_at"))
    daily = daily_amounts(first, "entity_id", day, engagement_amount(F.col("r.engagement")))
    entities = table(spark, sf_dir, "entities").select(F.col("id").alias("entity_id"))
    return trailing_totals(daily, entities, FIRST_DAY, LAST_DAY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and days that had no link for 7 days but engagement within 30 days."""
    cases = (F.col("day") >= F.lit(FIRST_CASE).cast("date")) & (F.col("mentions_7") == 0) & (F.col("amount_30") > 0)
    return _trailing(spark, sf_dir).filter(cases).select(F.col("entity_id").cast("int").alias("entity_id"), F.col("day").cast("string").alias("day"))


def p7_trailing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and daily averages of mentions and engagement over 7 and 30 days, for every entity and day."""
    columns = []
    for w in (7, 30):
        amount = F.col(f"amount_{w}").cast("double")
        columns += [F.col(f"mentions_{w}"), F.round(amount, 6).alias(f"engagement_{w}"), F.round(F.col(f"mentions_{w}") / w, 6).alias(f"mean_mentions_{w}"), F.round(amount / w, 6).alias(f"mean_engagement_{w}")]
    return _trailing(spark, sf_dir).select(F.col("entity_id").cast("int").alias("entity_id"), F.col("day").cast("string").alias("day"), *columns)


QUERIES = {"p1_found": p1_found, "p1_readings_by_kind": p1_readings_by_kind, "p2_found": p2_found, "p3_found": p3_found, "p3_day_totals": p3_day_totals, "p7_found": p7_found, "p7_trailing_totals": p7_trailing_totals}

_FIRST = """
WITH rows_ AS (
  SELECT 'links' AS origin, document_id, entity_id AS key_id, ingested_at, published_at, confidence AS weight FROM links
  UNION ALL
  SELECT 'topic_rows', document_id, topic_id, ingested_at, published_at, probability FROM topic_rows
), first_ AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin, document_id, key_id ORDER BY ingested_at NULLS LAST, published_at NULLS LAST, weight NULLS LAST) AS n FROM rows_) WHERE n = 1
), judged AS (
  SELECT *, CAST(published_at AT TIME ZONE 'UTC' AS DATE) AS d,
    CASE WHEN epoch_us(ingested_at) - epoch_us(published_at) > 604800000000 THEN 'too_late'
         WHEN CAST(ingested_at AT TIME ZONE 'UTC' AS DATE) > CAST(published_at AT TIME ZONE 'UTC' AS DATE) THEN 'correction' ELSE 'on_time' END AS outcome
  FROM first_ WHERE published_at IS NOT NULL
)
"""
_TRAILING = """
WITH first_ AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, entity_id ORDER BY ingested_at NULLS LAST, published_at, engagement) AS n FROM links) WHERE n = 1
), amounts AS (
  SELECT entity_id, CAST(coalesce(published_at, ingested_at) AT TIME ZONE 'UTC' AS DATE) AS d,
    CASE WHEN json_valid(engagement) AND json_type(engagement) = 'OBJECT' THEN
      CASE WHEN json_type(engagement, '$.score') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(engagement, '$.score') AS DOUBLE) ELSE 0 END
      + CASE WHEN json_type(engagement, '$.comments') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(engagement, '$.comments') AS DOUBLE) ELSE 0 END
    ELSE 0 END AS amount
  FROM first_
), daily AS (
  SELECT entity_id, d, count(*) AS mentions, sum(CAST(amount AS DECIMAL(28,8))) AS amount FROM amounts WHERE d BETWEEN DATE '2025-12-15' AND DATE '2026-04-30' GROUP BY ALL
), grid AS (
  SELECT e.entity_id, CAST(t.d AS DATE) AS d FROM (SELECT id AS entity_id FROM entities UNION SELECT entity_id FROM daily) e, generate_series(DATE '2025-12-15', DATE '2026-04-30', INTERVAL 1 DAY) t(d)
), totals AS (
  SELECT g.entity_id, g.d,
    coalesce(sum(y.mentions) OVER w7, 0) AS m7, coalesce(sum(y.mentions) OVER w30, 0) AS m30, coalesce(sum(y.amount) OVER w7, 0) AS a7, coalesce(sum(y.amount) OVER w30, 0) AS a30
  FROM grid g LEFT JOIN daily y ON y.entity_id = g.entity_id AND y.d = g.d
  WINDOW w7 AS (PARTITION BY g.entity_id ORDER BY g.d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY g.entity_id ORDER BY g.d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
)
"""
ORACLES = {
    "p3_found": _FIRST + "SELECT origin, document_id, CAST(key_id AS INTEGER) AS key_id, outcome FROM judged WHERE outcome <> 'on_time'",
    "p3_day_totals": _FIRST + """SELECT origin, CAST(key_id AS INTEGER) AS key_id, strftime(d, '%Y-%m-%d') AS day,
      count(*) FILTER (outcome = 'on_time') AS closed_count, count(*) FILTER (outcome <> 'too_late') AS corrected_count, count(*) FILTER (outcome = 'correction') AS corrections, count(*) FILTER (outcome = 'too_late') AS too_late,
      round(CAST(coalesce(sum(CAST(weight AS DECIMAL(28,10))) FILTER (outcome = 'on_time'), 0) AS DOUBLE), 6) AS closed_weight, round(CAST(coalesce(sum(CAST(weight AS DECIMAL(28,10))) FILTER (outcome <> 'too_late'), 0) AS DOUBLE), 6) AS corrected_weight
      FROM judged GROUP BY ALL""",
    "p7_found": _TRAILING + "SELECT entity_id, strftime(d, '%Y-%m-%d') AS day FROM totals WHERE d >= DATE '2026-01-13' AND m7 = 0 AND a30 > 0",
    "p7_trailing_totals": _TRAILING + """SELECT entity_id, strftime(d, '%Y-%m-%d') AS day, CAST(m7 AS BIGINT) AS mentions_7, round(CAST(a7 AS DOUBLE), 6) AS engagement_7, round(m7 / 7, 6) AS mean_mentions_7, round(CAST(a7 AS DOUBLE) / 7, 6) AS mean_engagement_7,
      CAST(m30 AS BIGINT) AS mentions_30, round(CAST(a30 AS DOUBLE), 6) AS engagement_30, round(m30 / 30, 6) AS mean_mentions_30, round(CAST(a30 AS DOUBLE) / 30, 6) AS mean_engagement_30 FROM totals""",
}
