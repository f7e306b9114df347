"""Queries of the daily panel over the links, topic rows and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurline.operators import panel as P
from murmurline.params import SignalParams
from murmurline.sources.tables import table

PARAMS, END_DAY = SignalParams(), "2026-04-30"


def links_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_deliveries(table(spark, sf_dir, "links"), ["document_id", "entity_id"])


def topics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_deliveries(table(spark, sf_dir, "topic_rows"), ["document_id", "topic_id", "version"])


def versions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit times of the topic versions, which carry their day in their name."""
    versions = table(spark, sf_dir, "topic_rows").select("version").distinct()
    return versions.select("version", F.try_to_timestamp(F.regexp_extract("version", r"(\d{4}-\d{2}-\d{2})$", 1)).alias("created_at"))


def _day(name: str = "day") -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def _r(name: str) -> Column:
    return F.round(F.col(name).cast("double"), 6).alias(name)


def daily_entity_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_entity_aggregates(links_of(spark, sf_dir), PARAMS).select("entity_id", _day(), _r("mentions"), _r("sentiment"), _r("engagement"))


def panel_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.panel_origin(links_of(spark, sf_dir), PARAMS).select(_day("origin"))


def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stale_rows(links_of(spark, sf_dir), PARAMS).select("document_id", "entity_id")


def topic_day_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.topic_day_weights(topics_of(spark, sf_dir), PARAMS).select("version", "topic_id", _day(), _r("weight"))


def topic_version_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.version_spans(versions_of(spark, sf_dir), END_DAY).select(_day(), "version")


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "entities")
    return P.components(links_of(spark, sf_dir), topics_of(spark, sf_dir), versions_of(spark, sf_dir), entities, END_DAY, PARAMS)


def _one(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _components(spark, sf_dir).select("entity_id", _day("date"), _r(name))

    query.__doc__ = f"The component {name} of every entity and day."
    return query


def centered_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _latest_panel(spark, sf_dir)
    ranks = P.centred_ranks(latest, "date", "entity_id", list(P.COMPONENTS))
    return ranks.select("entity_id", _day("date"), *[_r(f"{c}_rank") for c in P.COMPONENTS])


def _latest_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "daily_panel").groupBy("date", "entity_id").agg(F.max(F.struct("computed_at", *P.COMPONENTS)).alias("r"))
    return rows.select("entity_id", "date", *[F.col(f"r.{c}").alias(c) for c in P.COMPONENTS])


def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and ranks of the stored components."""
    return P.ranked_panel(_latest_panel(spark, sf_dir), PARAMS).select("entity_id", _day("date"), _r("score"), "rank")


def attention_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole daily panel."""
    parts = _components(spark, sf_dir)
    return P.ranked_panel(parts, PARAMS).select("entity_id", _day("date"), *[_r(c) for c in P.COMPONENTS], _r("score"), "rank")


def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten first places of the last stored day: a top-k report."""
    latest = _latest_panel(spark, sf_dir)
    day = latest.agg(F.max("date").alias("date"))
    of_day = latest.join(F.broadcast(day), "date")  # one row
    return P.ranked_panel(of_day, PARAMS).filter("rank <= 10").select("entity_id", _day("date"), _r("score"), "rank")


QUERIES = {
    "daily_entity_aggregates": daily_entity_aggregates, "panel_origin": panel_origin, "stale_documents": stale_documents, "topic_day_weights": topic_day_weights,
    "topic_version_as_of": topic_version_as_of, "mention_growth": _one("mention_growth"), "sentiment_momentum": _one("sentiment_momentum"),
    "engagement_growth": _one("engagement_growth"), "topic_velocity": _one("topic_velocity"), "centered_ranks": centered_ranks,
    "composite_scores": composite_scores, "attention_panel": attention_panel, "top_movers": top_movers,
}

_NUMBER = "CASE WHEN json_type(engagement, '$.{0}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(engagement, '$.{0}') AS DOUBLE) ELSE 0 END"
_BASE = f"""
WITH links_ AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, entity_id ORDER BY ingested_at NULLS LAST, confidence, published_at, engagement, sentiment) AS n FROM links) WHERE n = 1
), topics_ AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, topic_id, version ORDER BY ingested_at NULLS LAST, published_at, probability) AS n FROM topic_rows) WHERE n = 1
), fresh_links AS (
  SELECT *, CAST(ingested_at AT TIME ZONE 'UTC' AS DATE) AS d, CASE WHEN json_valid(engagement) AND json_type(engagement) = 'OBJECT' THEN {_NUMBER.format('score')} + {_NUMBER.format('comments')} ELSE 0 END AS e
  FROM links_ WHERE published_at IS NULL OR epoch_us(ingested_at) - epoch_us(published_at) <= 604800000000
), fresh_topics AS (
  SELECT *, CAST(ingested_at AT TIME ZONE 'UTC' AS DATE) AS d FROM topics_ WHERE published_at IS NULL OR epoch_us(ingested_at) - epoch_us(published_at) <= 604800000000
), aggregates AS (
  SELECT entity_id, d, sum(CAST(confidence AS DECIMAL(38,12))) AS mentions,
    CASE WHEN coalesce(sum(CAST(confidence AS DECIMAL(38,12))) FILTER (sentiment IS NOT NULL), 0) <> 0 THEN CAST(sum(CAST(confidence * sentiment AS DECIMAL(38,12))) AS DOUBLE) / CAST(sum(CAST(confidence AS DECIMAL(38,12))) FILTER (sentiment IS NOT NULL) AS DOUBLE) END AS sentiment,
    sum(CAST(confidence * e AS DECIMAL(38,12))) AS engagement
  FROM fresh_links GROUP BY ALL
), origin_ AS (SELECT min(d) AS o FROM fresh_links),
versions_ AS (SELECT DISTINCT version, CAST(regexp_extract(version, '(\\d{{4}}-\\d{{2}}-\\d{{2}})$', 1) AS DATE) AS v FROM topic_rows),
days_ AS (SELECT CAST(t.d AS DATE) AS d FROM origin_, generate_series(CAST(o AS TIMESTAMP), TIMESTAMP '{END_DAY}', INTERVAL 1 DAY) t(d)),
as_of AS (SELECT CAST(t.d AS DATE) AS d, (SELECT arg_max(version, (v, version)) FROM versions_ WHERE v <= CAST(t.d AS DATE)) AS version FROM (SELECT min(v) AS s FROM versions_) m, generate_series(CAST(m.s AS TIMESTAMP), TIMESTAMP '{END_DAY}', INTERVAL 1 DAY) t(d))
"""
_GROWTH = "CASE WHEN h >= 3 THEN (CAST({0} AS DOUBLE) - coalesce(CAST(sum({0}) OVER w AS DOUBLE), 0) / least(7, h)) / greatest(coalesce(CAST(sum({0}) OVER w AS DOUBLE), 0) / least(7, h), 1.0) END"
_COMPONENTS = _BASE + f"""
, dense AS (
  SELECT n.id AS entity_id, s.d, date_diff('day', o, s.d) AS h, date_diff('day', DATE '1970-01-01', s.d) AS n, coalesce(a.mentions, 0) AS mentions, a.sentiment, coalesce(a.engagement, 0) AS engagement
  FROM (SELECT DISTINCT id FROM entities WHERE active) n, days_ s, origin_ LEFT JOIN aggregates a ON a.entity_id = n.id AND a.d = s.d
), measured AS (
  SELECT entity_id, d, {_GROWTH.format('mentions')} AS mention_growth, {_GROWTH.format('engagement')} AS engagement_growth,
    CASE WHEN h >= 3 AND count(sentiment) OVER w >= 3 THEN sentiment - avg(sentiment) OVER w END AS sentiment_momentum
  FROM dense WINDOW w AS (PARTITION BY entity_id ORDER BY n RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)
), mass AS (
  SELECT l.entity_id, l.d, v.version, t.topic_id, sum(CAST(l.confidence * t.probability AS DECIMAL(38,12))) AS mass
  FROM fresh_links l JOIN as_of v ON v.d = l.d JOIN topics_ t ON t.version = v.version AND t.document_id = l.document_id GROUP BY ALL
), weights AS (
  SELECT version, topic_id, d, sum(w) AS weight FROM (SELECT version, topic_id, d, CAST(probability AS DECIMAL(38,12)) AS w FROM fresh_topics UNION ALL SELECT version, topic_id, d, 0 FROM mass) GROUP BY ALL
), rates AS (
  SELECT version, topic_id, d, {_GROWTH.format('weight')} AS rate
  FROM (SELECT *, date_diff('day', o, d) AS h, date_diff('day', DATE '1970-01-01', d) AS n FROM weights, origin_ WHERE d >= o)
  WINDOW w AS (PARTITION BY version, topic_id ORDER BY n RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)
), velocity AS (
  SELECT entity_id, m.d, CASE WHEN sum(mass) <> 0 THEN CAST(sum(CAST(CAST(mass AS DOUBLE) * rate AS DECIMAL(38,12))) AS DOUBLE) / CAST(sum(mass) AS DOUBLE) END AS topic_velocity
  FROM mass m JOIN rates r ON r.version = m.version AND r.topic_id = m.topic_id AND r.d = m.d WHERE rate IS NOT NULL GROUP BY ALL
), parts AS (SELECT m.entity_id, m.d AS date, m.mention_growth, m.sentiment_momentum, v.topic_velocity, m.engagement_growth FROM measured m LEFT JOIN velocity v ON v.entity_id = m.entity_id AND v.d = m.d)
"""


def _ranked(source: str) -> str:
    def rank(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN NULL WHEN count({c}) OVER (PARTITION BY date) = 1 THEN 0.0 ELSE (rank() OVER (PARTITION BY date ORDER BY round({c}, 9) NULLS LAST) + (count(*) OVER (PARTITION BY date, round({c}, 9)) - 1) / 2.0 - (count({c}) OVER (PARTITION BY date) + 1) / 2.0) / ((count({c}) OVER (PARTITION BY date) - 1) / 2.0) END AS {c}_rank"

    top = " + ".join(f"coalesce({c}_rank * 0.25, 0)" for c in P.COMPONENTS)
    bottom = " + ".join(f"CASE WHEN {c}_rank IS NULL THEN 0 ELSE 0.25 END" for c in P.COMPONENTS)
    return f""", ranks AS (SELECT *, {', '.join(rank(c) for c in P.COMPONENTS)} FROM {source}),
    scored AS (SELECT *, CASE WHEN {bottom} > 0 THEN CAST(({top}) / ({bottom}) AS DOUBLE) END AS score FROM ranks),
    final AS (SELECT *, CASE WHEN score IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC NULLS LAST, entity_id) AS INTEGER) END AS rank FROM scored)
    """


_STORED = f"""WITH stored AS (SELECT entity_id, date, {', '.join(P.COMPONENTS)} FROM (SELECT *, row_number() OVER (PARTITION BY date, entity_id ORDER BY computed_at DESC, {', '.join(c + ' DESC NULLS LAST' for c in P.COMPONENTS)}) AS n FROM daily_panel) WHERE n = 1)"""
_DATE = "strftime(date, '%Y-%m-%d') AS date"
ORACLES = {
    "daily_entity_aggregates": _BASE + "SELECT entity_id, strftime(d, '%Y-%m-%d') AS day, round(CAST(mentions AS DOUBLE), 6) AS mentions, round(sentiment, 6) AS sentiment, round(CAST(engagement AS DOUBLE), 6) AS engagement FROM aggregates",
    "panel_origin": _BASE + "SELECT strftime(o, '%Y-%m-%d') AS origin FROM origin_",
    "stale_documents": _BASE + "SELECT document_id, entity_id FROM links_ WHERE epoch_us(ingested_at) - epoch_us(published_at) > 604800000000",
    "topic_day_weights": _BASE + "SELECT version, topic_id, strftime(d, '%Y-%m-%d') AS day, round(CAST(sum(CAST(probability AS DECIMAL(38,12))) AS DOUBLE), 6) AS weight FROM fresh_topics GROUP BY ALL",
    "topic_version_as_of": _BASE + "SELECT strftime(d, '%Y-%m-%d') AS day, version FROM as_of",
    **{c: _COMPONENTS + f"SELECT entity_id, {_DATE}, round({c}, 6) AS {c} FROM parts" for c in P.COMPONENTS},
    "centered_ranks": _STORED + _ranked("stored") + f"SELECT entity_id, {_DATE}, {', '.join(f'round(CAST({c}_rank AS DOUBLE), 6) AS {c}_rank' for c in P.COMPONENTS)} FROM ranks",
    "composite_scores": _STORED + _ranked("stored") + f"SELECT entity_id, {_DATE}, round(score, 6) AS score, rank FROM final",
    "attention_panel": _COMPONENTS + _ranked("parts") + f"SELECT entity_id, {_DATE}, {', '.join(f'round({c}, 6) AS {c}' for c in P.COMPONENTS)}, round(score, 6) AS score, rank FROM final",
    "top_movers": _STORED + _ranked("stored") + f"SELECT entity_id, {_DATE}, round(score, 6) AS score, rank FROM final WHERE rank <= 10 AND date = (SELECT max(date) FROM stored)",
}
