"""Schemas of all tables as DDL, with their keys; readers pass them and never infer."""

from __future__ import annotations

TABLES = {
    "entities": "id int, ticker string, name string, sector string, aliases array<string>, active boolean, created_at timestamp",
    "sources": "id int, type string, name string, config_ref string, created_at timestamp",
    "documents": "id bigint, source_id int, external_id string, url string, author string, title string, raw_text string, lang string, content_hash string, published_at timestamp, ingested_at timestamp, engagement string, resolved_at timestamp, enriched_at timestamp",
    "document_stamps": "document_id bigint, stage string, at timestamp",
    "document_entities": "document_id bigint, entity_id int, confidence double, method string, resolved_at timestamp",
    "sentiment_scores": "document_id bigint, model string, label string, score double, scored_at timestamp",
    "embeddings": "document_id bigint, model string, vector array<float>, embedded_at timestamp",
    "topics": "id int, topic_model_version string, label string, keywords array<string>, created_at timestamp",
    "document_topics": "document_id bigint, topic_id int, probability double",
    "market_data": "entity_id int, date date, open double, high double, low double, close double, adj_close double, volume bigint, ingested_at timestamp",
    "ingestion_runs": "id bigint, source_id int, started_at timestamp, finished_at timestamp, status string, rows_fetched bigint, rows_inserted bigint, raw_path string, error string",
    "daily_panel": "entity_id int, date date, mention_growth double, sentiment_momentum double, topic_velocity double, engagement_growth double, score double, rank int, computed_at timestamp",
    "data_quality_checks": "check_name string, source_name string, status string, value double, threshold double, details string, ran_at timestamp",
}
KEYS = {
    "entities": ["ticker"], "sources": ["name"], "documents": ["content_hash"], "document_entities": ["document_id", "entity_id"],
    "sentiment_scores": ["document_id", "model"], "embeddings": ["document_id", "model"], "document_topics": ["document_id", "topic_id"],
    "market_data": ["entity_id", "date"], "daily_panel": ["entity_id", "date"],
}
RAW = {
    "rss": "title string, summary string, url string, published_date string, source string",
    "hackernews": "id bigint, title string, score bigint, comments bigint, timestamp bigint, url string, author string, type string",
    "bars": "ticker string, date string, open double, high double, low double, close double, adj_close double, volume bigint",
    "reddit": "id string, title string, body string, score bigint, comments bigint, created_utc double, subreddit string, author string",
    "kaggle": "ref string, title string, size string, license string, last_updated string, download_count bigint, vote_count bigint, usability_rating double, search_term string",
}
EMBEDDING_DIM = 384
LABELS = ("positive", "negative", "neutral")
RUN_STATES = ("running", "success", "error")


def violations(df, table: str):
    """Rows with a NULL or repeated key: the constraints that parquet does not enforce."""
    from pyspark.sql import functions as F

    keys = KEYS[table]
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > 1) | missing)
