"""Queries of the stages: run log, backlog of a stage, the panel's views, listings, and the scorecard of the raw sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurline.functions.text import number
from murmurline.operators import enrich, resolution, topics, upserts
from murmurline.plans import pipeline, runlog
from murmurline.queries.panel import _latest_panel, links_of
from murmurline.sources import raw
from murmurline.sources.tables import table

MODEL, OTHER_MODEL = "tone", "other"
NOW_EPOCH = 1_777_593_600  # 2026-05-01


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of one run for each source and day of arrival: a row for its start, and one for its end unless it is the source's last."""
    docs = table(spark, sf_dir, "source_docs").select("source_id", "ingested_at")
    day = F.to_date("ingested_at")
    days = docs.groupBy("source_id", day.alias("day")).agg(F.min("ingested_at").alias("started_at"), F.max("ingested_at").alias("ended_at"), F.count("*").alias("n"))
    number_ = F.unix_date("day").cast("long") * 100 + F.col("source_id")
    last = docs.groupBy("source_id").agg(F.max(day).alias("last_day"))
    none = F.lit(None)
    start = days.select(number_.alias("id"), "source_id", "started_at", none.cast("timestamp").alias("finished_at"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("rows_fetched"))
    ended = days.join(last, "source_id").filter("day < last_day")
    return start.unionByName(ended.select(number_.alias("id"), "source_id", "started_at", F.col("ended_at").alias("finished_at"), F.lit("success").alias("status"), F.col("n").alias("rows_fetched")))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each run; the last of each source has not ended."""
    return runlog.runs(_log(spark, sf_dir)).select("id", "source_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "status", "rows_fetched")


def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest runs with their sources' names: a top-k report."""
    return runlog.recent_runs(runlog.runs(_log(spark, sf_dir)), table(spark, sf_dir, "sources")).select("id", "source_name", "status", "rows_fetched")


def _backlog(spark: SparkSession, sf_dir: str, stage: str, column: str) -> DataFrame:
    docs = table(spark, sf_dir, "source_docs").select("id", column)
    stamps = upserts.stamp(docs.filter(F.col(column).isNotNull()), stage, F.col(column))
    return upserts.unstamped(docs, stamps, stage).select("id")


def unresolved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no resolution run has seen."""
    return _backlog(spark, sf_dir, pipeline.RESOLVE, "resolved_at")


def unenriched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no enrichment run has seen."""
    return _backlog(spark, sf_dir, pipeline.ENRICH, "enriched_at")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment scores by document: the panel's model where a sentiment is known, and another model's neutral for every document."""
    s = F.col("sentiment")
    known = links_of(spark, sf_dir).filter("sentiment IS NOT NULL").groupBy("document_id").agg(F.max("sentiment").alias("sentiment"))
    ours = known.select("document_id", F.lit(MODEL).alias("model"), F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral").alias("label"), F.abs(s).alias("score"))
    return ours.unionByName(table(spark, sf_dir, "source_docs").select(F.col("id").alias("document_id"), F.lit(OTHER_MODEL).alias("model"), F.lit("neutral").alias("label"), F.lit(1.0).alias("score")))


def _entities_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(spark, sf_dir).select("document_id", "entity_id", "confidence")


def links_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their entities and the sentiment of one model, unscored documents included."""
    view = enrich.links_view(table(spark, sf_dir, "source_docs"), _entities_of_documents(spark, sf_dir), _scores(spark, sf_dir), MODEL)
    return view.select("document_id", "entity_id", "confidence", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "engagement", "sentiment")


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics of the topic rows; a topic is as old as its first document."""
    return table(spark, sf_dir, "topic_rows").groupBy(F.col("topic_id").alias("id"), F.col("version").alias("topic_model_version")).agg(F.min("ingested_at").alias("created_at"))


def topic_rows_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their topics of all versions."""
    assigned = table(spark, sf_dir, "topic_rows").groupBy("document_id", "topic_id").agg(F.max("probability").alias("probability"))
    view = enrich.topic_rows_view(table(spark, sf_dir, "source_docs"), assigned, _topics(spark, sf_dir))
    return view.select("document_id", "topic_id", "version", "probability", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"))


def topics_of_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics of the version fitted last, by id."""
    held = _topics(spark, sf_dir)
    version = topics.latest_version(held).first()["version"]
    return topics.topics_of_version(held, version).select("id", F.col("topic_model_version").alias("version"))


def ordered_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored panel by day and entity."""
    return _latest_panel(spark, sf_dir).orderBy("date", "entity_id").select(F.date_format("date", "yyyy-MM-dd").alias("date"), "entity_id", F.round("mention_growth", 6).alias("mention_growth"))


def ranked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's entities, the surest first, equal ones by ticker."""
    ranked = resolution.ranked_matches(_entities_of_documents(spark, sf_dir), table(spark, sf_dir, "entities"))
    return ranked.select("document_id", "ticker", "confidence", "place")


def first_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed records as search results: each link under the first feed that has it, the first twenty of each feed (a feature of the search)."""
    records = table(spark, sf_dir, "rss_raw").filter("url IS NOT NULL").select(F.col("url").alias("ref"), F.col("source").alias("term_no"), F.col("record_id").alias("position"))
    return raw.top_per_term(records).select("ref", "term_no", "position")


def source_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard of the raw tables: completeness, freshness, volume, verdict."""
    at = lambda name, columns, epoch: pipeline.Candidate(lambda s, n=name: table(s, sf_dir, n), columns, epoch)
    candidates = {
        "feeds": at("rss_raw", ("title", "summary", "url", "published_date", "source"), None),
        "stories": pipeline.Candidate(lambda s: table(s, sf_dir, "hn_raw").withColumn("timestamp", F.when(F.col("timestamp").between(0, 4_000_000_000), F.col("timestamp"))), ("id", "title", "timestamp", "url"), "timestamp"),
        "bars": pipeline.Candidate(lambda s: table(s, sf_dir, "bars_raw").withColumn("close", number(F.col("close"))), ("ticker", "date", "close")),
    }
    card = pipeline.recon_stage(spark, candidates, NOW_EPOCH)
    return card.select("source", "status", "records", F.round("completeness", 4).alias("completeness"), "freshness_hours", "estimated_monthly", "recommended")


_NAMES = (run_log, recent_runs, unresolved_documents, unenriched_documents, links_view, topic_rows_view, topics_of_latest_version, ordered_panel, ranked_matches, first_terms, source_scorecard)
QUERIES = {f.__name__: f for f in _NAMES}

_T = "strftime({0} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"
_FIRST = "first_links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, entity_id ORDER BY ingested_at NULLS LAST, confidence, published_at, engagement, sentiment) AS n FROM links) WHERE n = 1)"
_RUNS = """days AS (SELECT source_id, CAST(ingested_at AT TIME ZONE 'UTC' AS DATE) AS day, min(ingested_at) AS started_at, count(*) AS n FROM source_docs GROUP BY ALL),
  r AS (SELECT date_diff('day', DATE '1970-01-01', day) * 100 + source_id AS id, source_id, started_at, CASE WHEN day = max(day) OVER (PARTITION BY source_id) THEN 'running' ELSE 'success' END AS status, CASE WHEN day = max(day) OVER (PARTITION BY source_id) THEN 0 ELSE n END AS rows_fetched FROM days)"""
_FILLED = "avg(CASE WHEN {0} IS NULL OR CAST({0} AS VARCHAR) = '' THEN 0.0 ELSE 1.0 END)"


def _share(*columns: str) -> str:
    return f"round(({' + '.join(_FILLED.format(c) for c in columns)}) / {len(columns)}, 4)"


ORACLES = {
    "run_log": f"WITH {_RUNS} SELECT id, source_id, {_T.format('started_at')} AS started_at, status, rows_fetched FROM r",
    "recent_runs": f"WITH {_RUNS} SELECT r.id, s.name AS source_name, status, rows_fetched FROM r LEFT JOIN sources s ON s.id = r.source_id ORDER BY started_at DESC, r.id DESC LIMIT 20",
    "unresolved_documents": "SELECT id FROM source_docs WHERE resolved_at IS NULL",
    "unenriched_documents": "SELECT id FROM source_docs WHERE enriched_at IS NULL",
    "links_view": f"""WITH {_FIRST}, scores AS (SELECT document_id, max(sentiment) AS sentiment FROM first_links WHERE sentiment IS NOT NULL GROUP BY document_id)
      SELECT l.document_id, l.entity_id, l.confidence, {_T.format('d.ingested_at')} AS ingested_at, {_T.format('d.published_at')} AS published_at, d.engagement, s.sentiment FROM first_links l JOIN source_docs d ON d.id = l.document_id LEFT JOIN scores s ON s.document_id = l.document_id""",
    "topic_rows_view": f"""SELECT t.document_id, t.topic_id, v.version, t.probability, {_T.format('d.ingested_at')} AS ingested_at FROM (SELECT document_id, topic_id, max(probability) AS probability FROM topic_rows GROUP BY ALL) t
      JOIN source_docs d ON d.id = t.document_id JOIN (SELECT DISTINCT topic_id, version FROM topic_rows) v ON v.topic_id = t.topic_id""",
    "topics_of_latest_version": "WITH t AS (SELECT topic_id AS id, version, min(ingested_at) AS created_at FROM topic_rows GROUP BY ALL) SELECT id, version FROM t WHERE version = (SELECT version FROM t ORDER BY created_at DESC, id DESC LIMIT 1)",
    "ordered_panel": "SELECT strftime(date, '%Y-%m-%d') AS date, entity_id, round(mention_growth, 6) AS mention_growth FROM (SELECT *, row_number() OVER (PARTITION BY date, entity_id ORDER BY computed_at DESC, mention_growth DESC NULLS LAST, sentiment_momentum DESC NULLS LAST, topic_velocity DESC NULLS LAST, engagement_growth DESC NULLS LAST) AS n FROM daily_panel) WHERE n = 1",
    "ranked_matches": f"WITH {_FIRST} SELECT document_id, ticker, confidence, CAST(row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, ticker) AS INTEGER) AS place FROM first_links JOIN entities e ON e.id = entity_id",
    "first_terms": "WITH a AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source, record_id) AS n FROM rss_raw WHERE url IS NOT NULL) SELECT url AS ref, source AS term_no, record_id AS position FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY record_id, url) AS m FROM a WHERE n = 1) WHERE m <= 20",
    "source_scorecard": f"""WITH hn AS (SELECT * REPLACE (CASE WHEN timestamp BETWEEN 0 AND 4000000000 THEN timestamp END AS timestamp) FROM hn_raw), q AS (SELECT len(l) AS n, (l[CAST(floor(0.75 * (len(l) - 1)) AS INTEGER) + 1] - l[CAST(floor(0.25 * (len(l) - 1)) AS INTEGER) + 1]) / 3600.0 AS span, l[len(l)] AS newest FROM (SELECT list_sort(list(timestamp)) AS l FROM hn WHERE timestamp IS NOT NULL)),
      card AS (SELECT 'feeds' AS source, count(*) AS records, {_share('title', 'summary', 'url', 'published_date', 'source')} AS completeness, CAST(NULL AS DOUBLE) AS freshness_hours, CAST(NULL AS BIGINT) AS estimated_monthly FROM rss_raw
        UNION ALL SELECT 'stories', count(*), {_share('id', 'title', 'timestamp', 'url')}, (SELECT round_even(({NOW_EPOCH} - newest) / 3600.0, 2) FROM q), (SELECT CASE WHEN n >= 4 AND span > 0 THEN CAST(round_even(0.5 * n / span * 720, 0) AS BIGINT) END FROM q) FROM hn
        UNION ALL SELECT 'bars', count(*), {_share('ticker', 'date', 'close')}, NULL, NULL FROM bars_raw)
      SELECT source, 'ok' AS status, records, completeness, freshness_hours, estimated_monthly, completeness >= 0.8 AS recommended FROM card""",
}
