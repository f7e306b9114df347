"""Queries of ingestion, keyed writes, resolution, quality and validation over the raw and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurline.functions.engagement import engagement_value
from murmurline.functions.text import ZONES, content_hash, document_text, parse_utc, strip_html
from murmurline.operators import enrich, instants, near_duplicates, quality, recon, resolution, topics, upserts, validation
from murmurline.queries.panel import _latest_panel, links_of
from murmurline.params import SignalParams
from murmurline.operators.panel import COMPONENTS, ranked_panel
from murmurline.session import cut_lineage
from murmurline.sources import raw
from murmurline.sources.tables import table

NOW = "2026-05-01 00:00:00"
DUPLICATE = 0.85


def _at(text: str = NOW):
    return F.lit(f"{text}+00:00").cast("timestamp")


def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items stored more than once: their content hash, how often, and the first id."""
    docs = table(spark, sf_dir, "source_docs")
    hashed = docs.select("id", content_hash(F.col("url"), F.col("title"), F.col("raw_text")).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids inserted when all documents arrive at a table that holds those of the first source."""
    docs = table(spark, sf_dir, "source_docs").select("id", "source_id", "content_hash")
    return upserts.new_rows(docs.filter("source_id = 1"), docs, ["content_hash"], [F.col("id")]).select("id", "source_id")


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after redeliveries from March on replaced the earlier ones."""
    links = table(spark, sf_dir, "links").select("document_id", "entity_id", "confidence", "ingested_at", "sentiment")
    march = _at("2026-03-01 00:00:00")
    keys = ["document_id", "entity_id"]
    state = upserts.latest_per_key(links.filter(F.col("ingested_at") < march), keys, ["ingested_at"])
    after = upserts.upsert_last_wins(state, links.filter(F.col("ingested_at") >= march), keys, [F.col("ingested_at"), F.col("confidence"), F.col("sentiment")])
    return after.select("document_id", "entity_id", "confidence", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"))


def bars_restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the latest prices and the first time of arrival."""
    bars = table(spark, sf_dir, "market_data").select("entity_id", "date", "close", "adj_close", "volume", "ingested_at")
    first = bars.groupBy("entity_id", "date").agg(F.min(F.struct("ingested_at", "close", "adj_close", "volume")).alias("r")).select("entity_id", "date", "r.close", "r.adj_close", "r.volume", "r.ingested_at")
    after = upserts.upsert_last_wins(first, bars, ["entity_id", "date"], [F.col("ingested_at"), F.col("close"), F.col("adj_close"), F.col("volume")], keep_first=["ingested_at"])
    return after.select("entity_id", F.col("date").cast("string").alias("date"), "close", "adj_close", "volume", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest embedding time of each document and model."""
    v = table(spark, sf_dir, "doc_vectors").select("document_id", "model", "embedded_at")
    return upserts.latest_per_key(v, ["document_id", "model"], ["embedded_at"]).select("document_id", "model", F.date_format("embedded_at", "yyyy-MM-dd HH:mm:ss").alias("embedded_at"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "source_docs"), "id", "title")


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different title classes that are near duplicates, by their representatives."""
    return near_duplicates.similar_classes(_titles(spark, sf_dir), DUPLICATE).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def near_duplicates_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of equal titles and the number of classes it is similar to."""
    members = _titles(spark, sf_dir)
    return near_duplicates.duplicate_documents(members, near_duplicates.similar_classes(members, DUPLICATE))


def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rate(table(spark, sf_dir, "source_docs"), "id", "title").select(*quality.RESULT)


def duplicate_rate_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate rate of the whole table; ``duplicate_rate`` reports on recent rows."""
    return quality.duplicate_rate(table(spark, sf_dir, "source_docs"), "id", "title", scanned=None).select(*quality.RESULT)


def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities found in the documents by cash tag, ticker and name."""
    phrases = resolution.dictionary(table(spark, sf_dir, "entities"))
    return resolution.resolve(table(spark, sf_dir, "source_docs").select("id", "title", "raw_text"), phrases)


def resolver_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the resolver's pairs compare with the stored links."""
    stored = links_of(spark, sf_dir).select("document_id", "entity_id")
    rated = resolution.precision_recall(resolve_links(spark, sf_dir).select("document_id", "entity_id"), stored, ["document_id", "entity_id"])
    return resolution.gated(rated, "precision", resolution.PRECISION_GATE).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "passed")


def _text():
    return document_text(F.col("title"), F.col("raw_text"))


UP, DOWN = ("surged", "jumped", "rallied"), ("plunged", "tumbled", "slid")


def keyword_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the keyword stand-in, scored in batches behind the model seam."""
    docs = table(spark, sf_dir, "source_docs").select("id", "title", "raw_text")
    scored = enrich.score_texts(docs, lambda: enrich.keyword_sentiment(UP, DOWN), "keywords", _at())
    return scored.select("document_id", "label", "score")


def sentiment_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in's labels against the signs of the stored link sentiments."""
    truth = F.when(F.col("sentiment") > 0.3, "positive").when(F.col("sentiment") < -0.3, "negative").otherwise("neutral")
    pairs = links_of(spark, sf_dir).filter("sentiment IS NOT NULL").select("document_id", truth.alias("truth")).join(keyword_sentiment(spark, sf_dir).select("document_id", F.col("label").alias("predicted")), "document_id")
    return resolution.gated(resolution.macro_f1(pairs), "macro_f1", resolution.MACRO_F1_GATE).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "passed")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One successful run for each source and day of arrival."""
    docs = table(spark, sf_dir, "source_docs").select("source_id", "ingested_at")
    day = F.to_date("ingested_at")
    return docs.groupBy("source_id", day.alias("day")).agg(F.min("ingested_at").alias("started_at"), F.max("ingested_at").alias("finished_at"), F.count("*").alias("rows_fetched")).select(F.unix_date("day").cast("long").alias("id"), "source_id", "started_at", "finished_at", F.lit("success").alias("status"), "rows_fetched")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).filter(F.col("finished_at") <= _at())
    return quality.freshness(table(spark, sf_dir, "sources"), runs, _at()).select(*quality.RESULT)


def volume_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.volume_anomaly(table(spark, sf_dir, "sources"), _runs(spark, sf_dir)).select(*quality.RESULT)


def resolution_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resolution_coverage(table(spark, sf_dir, "source_docs"), table(spark, sf_dir, "links")).select(*quality.RESULT)


def enrichment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "links").filter("sentiment IS NOT NULL")
    return quality.enrichment_coverage(table(spark, sf_dir, "source_docs"), scored).select(*quality.RESULT)


def panel_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.panel_freshness(table(spark, sf_dir, "daily_panel"), table(spark, sf_dir, "links"), "2026-05-01").select(*quality.RESULT)


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks as rows of one log."""
    checks = (duplicate_rate, freshness, volume_anomaly, resolution_coverage, enrichment_coverage, panel_freshness)
    return quality.all_checks(*[f(spark, sf_dir) for f in checks])


def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["title", "summary", "url", "published_date", "source"]
    return recon.field_completeness(table(spark, sf_dir, "rss_raw"), fields).select("field", F.round("completeness", 6).alias("completeness"))


def monthly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "source_docs").select("source_id", F.unix_seconds("ingested_at").alias("epoch"))
    return recon.monthly_volume(docs, "source_id", "epoch")


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rss_raw").select("record_id", strip_html(F.col("summary")).alias("summary"))


def rss_first_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which each link keeps the first."""
    return raw.first_of_links(table(spark, sf_dir, "rss_raw"), "url", [F.col("record_id")]).select("record_id")


def rss_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical documents of the feed records; dates that are neither ISO nor RFC 822 are unknown."""
    docs = raw.rss_documents(table(spark, sf_dir, "rss_raw"), 1, _at())
    return docs.select("external_id", "title", "content_hash", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "engagement")


def hn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories as documents; of a story fetched twice the first snapshot is kept."""
    stories = table(spark, sf_dir, "hn_raw").withColumn("timestamp", F.when(F.col("timestamp").between(0, 253402300799), F.col("timestamp")))
    docs = raw.hn_documents(stories, 2, _at())
    return docs.groupBy("content_hash").agg(F.min("external_id").alias("external_id"), F.count("*").alias("fetched"))


def bars_of_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor bars by entity and trading day."""
    zones = table(spark, sf_dir, "feed_zones")
    bars = table(spark, sf_dir, "bars_raw")
    days = instants.trading_day(instants.normalize_instants(bars, ["record_id"], "date", F.lit("yahoo"), zones)).select("record_id", F.col("day").alias("bar_day"))
    dated = bars.join(days, "record_id")
    good, _ = raw.bars_of_entities(dated.filter("close IS NOT NULL"), table(spark, sf_dir, "entities"), F.to_date("bar_day"), _at())
    return good.filter("date IS NOT NULL").select("entity_id", F.col("date").cast("string").alias("date"), "close", "volume")


def unknown_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = table(spark, sf_dir, "bars_raw")
    _, unknown = raw.bars_of_entities(bars, table(spark, sf_dir, "entities"), F.to_date(F.lit("2026-01-01")), _at())
    return unknown


def engagement_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total engagement of each entity over all deliveries."""
    links = table(spark, sf_dir, "links")
    return links.groupBy("entity_id").agg(F.round(F.sum(engagement_value(F.col("engagement")).cast("decimal(28,8)")).cast("double"), 6).alias("engagement"))


def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's published date as UTC microseconds, NULL where it is no ISO timestamp."""
    return table(spark, sf_dir, "rss_raw").select("record_id", F.unix_micros(parse_utc(F.col("published_date"))).alias("epoch_us"))


def recent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thousand most recent documents: a top-k report."""
    return table(spark, sf_dir, "source_docs").select("id", "source_id").orderBy(F.col("id").desc()).limit(1000)


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to documents or entities that don't exist."""
    links = table(spark, sf_dir, "links").select("document_id", "entity_id").distinct()
    docs, entities = table(spark, sf_dir, "source_docs").select(F.col("id").alias("document_id")), table(spark, sf_dir, "entities").select(F.col("id").alias("entity_id"))
    return links.join(docs, "document_id", "left_anti").unionByName(links.join(entities, "entity_id", "left_anti").select("document_id", "entity_id")).distinct()


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = table(spark, sf_dir, "market_data").select("entity_id", "date", "adj_close", "ingested_at")
    return bars.groupBy("entity_id", "date").agg(F.max(F.struct("ingested_at", "adj_close")).alias("r")).select("entity_id", "date", "r.adj_close")


def forward_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.forward_returns(_bars(spark, sf_dir)).select("entity_id", F.col("date").cast("string").alias("date"), F.round("forward_return", 6).alias("forward_return"))


def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the stored scores with five-session returns, by day."""
    scores = ranked_panel(_latest_panel(spark, sf_dir), SignalParams()).select("entity_id", "date", "score")
    met = scores.join(validation.forward_returns(_bars(spark, sf_dir)), ["entity_id", "date"])
    return validation.rank_correlation(met, "date", "entity_id", "score", "forward_return").select(F.col("date").cast("string").alias("date"), "pairs", F.round("ic", 6).alias("ic"))


def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of the topics of every version, each version weighed on its own."""
    docs = table(spark, sf_dir, "source_docs").select(F.col("id").alias("document_id"), _text().alias("text"))
    rows = table(spark, sf_dir, "topic_rows").select("document_id", "topic_id", "version").distinct()
    return topics.class_keywords(docs, rows, version="version").select("version", "topic_id", "keyword", F.round("weight", 6).alias("weight"), "place")


def topic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic fit on the stored vectors of each model; a model of too few documents has no row."""
    v = table(spark, sf_dir, "doc_vectors").filter("size(vector) = 384")
    latest = v.groupBy("model", "document_id").agg(F.max(F.struct("embedded_at", "vector")).alias("r")).select("model", "document_id", F.col("r.vector").cast("array<double>").alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = cut_lineage(latest.withColumn("norm", norm).filter("norm > 0").select("model", "document_id", F.expr("transform(vector, x -> x / norm)").alias("vector")))
    out = spark.createDataFrame([], "model string, document_id long, topic_id int, probability double")
    for row in v.select("model").distinct().orderBy("model").collect():  # one row for each configured model
        fit = topics.centre_fit(unit.filter(F.col("model").eqNullSafe(row["model"])).drop("model"))
        if fit is not None:
            out = out.unionByName(fit.select(F.lit(row["model"]).cast("string").alias("model"), "document_id", "topic_id", "probability"))
    return out


_NAMES = (
    content_hash_dedup, insert_if_absent, upsert_last_wins, bars_restatement, latest_per_key, near_duplicate_classes, near_duplicates_of_documents, duplicate_rate, duplicate_rate_of_all, resolve_links,
    resolver_precision_recall, keyword_sentiment, sentiment_macro_f1, freshness, volume_anomaly, resolution_coverage, enrichment_coverage, panel_freshness, quality_report,
    field_completeness, monthly_volume, html_clean, rss_first_of_links, rss_documents, hn_documents, bars_of_entities, unknown_tickers, engagement_values, iso_dates,
    recent_documents, orphans, forward_return, rank_ic, topic_keywords, topic_fit,
)
QUERIES = {f.__name__: f for f in _NAMES}

_SPACE = r"[\s\x{0B}\x{1c}-\x{1f}\x{85}\p{Z}]+"


def _canon(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize(coalesce({x}, '')), '{_SPACE}', ' ', 'g'), ' ')"


def _hash(*parts: str) -> str:
    return f"sha256(concat_ws(chr(31), {', '.join(_canon(p) for p in parts)}))"


_TOKENS = """tok AS (SELECT id, list_sort(list_distinct(regexp_extract_all(replace(lower(coalesce(title, '')), '-', ''), '[a-z0-9]+'))) AS t FROM {0}),
  sets AS (SELECT id, t, len(t) AS n, min(id) OVER (PARTITION BY t) AS class_id FROM tok WHERE len(t) >= 3),
  reps AS (SELECT * FROM sets WHERE id = class_id),
  words AS (SELECT id, n, unnest(t) AS w FROM reps),
  pairs AS (SELECT a.id AS id_a, b.id AS id_b, count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) AS similarity FROM words a JOIN words b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) GROUP BY a.id, b.id HAVING count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) >= 0.85)"""
_DICTIONARY = """phrases AS (
    SELECT id AS entity_id, 1.0 AS confidence, 'cashtag' AS method, '$' || ticker AS phrase FROM entities WHERE active
    UNION ALL SELECT id, 0.9, 'ticker', ticker FROM entities WHERE active AND upper(ticker) NOT IN ({0})
    UNION ALL SELECT id, 0.8, 'alias', unnest(list_distinct(list_append(coalesce(aliases, []), name))) FROM entities WHERE active
  ), texts AS MATERIALIZED (SELECT *, ' ' || regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ' AS spaced, lower(text) AS low FROM (SELECT id AS document_id, nfc_normalize(concat_ws(chr(32) || chr(10), nullif(title, ''), nullif(raw_text, ''))) AS text FROM source_docs)),
  spaced_phrases AS MATERIALIZED (SELECT *, lower(phrase) AS low_phrase, ' ' || trim(regexp_replace(phrase, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ') || ' ' AS spaced_phrase FROM phrases),
  met AS (SELECT document_id, entity_id, confidence, method FROM texts, spaced_phrases
    WHERE CASE WHEN method = 'ticker' THEN contains(text, phrase) AND contains(spaced, spaced_phrase) ELSE contains(low, low_phrase) AND contains(lower(spaced), lower(spaced_phrase)) END),
  resolved AS (SELECT document_id, entity_id, max(confidence) AS confidence, arg_max(method, confidence) AS method FROM met GROUP BY ALL)""".format(", ".join(f"'{t}'" for t in resolution.AMBIGUOUS_TICKERS))
_FIRST_LINKS = "first_links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, entity_id ORDER BY ingested_at NULLS LAST, confidence, published_at, engagement, sentiment) AS n FROM links) WHERE n = 1)"
_LABELS = f"""labelled AS (SELECT id AS document_id, concat_ws(chr(10), nullif(title, ''), nullif(raw_text, '')) AS text FROM source_docs),
  scored AS (SELECT document_id, CASE WHEN regexp_matches(lower(text), '{'|'.join(UP)}') THEN 'positive' WHEN regexp_matches(lower(text), '{'|'.join(DOWN)}') THEN 'negative' ELSE 'neutral' END AS label FROM labelled WHERE text <> '')"""
_RUNS = "runs AS (SELECT source_id, CAST(ingested_at AT TIME ZONE 'UTC' AS DATE) AS day, min(ingested_at) AS started_at, max(ingested_at) AS finished_at, count(*) AS rows_fetched FROM source_docs GROUP BY ALL)"
_T = "strftime({0} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"
_NUM = "CASE WHEN json_type(engagement, '$.{0}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(engagement, '$.{0}') AS DOUBLE) ELSE 0 END"
_NEAR_DUPLICATES = """extras AS (SELECT id FROM sets WHERE id <> class_id UNION SELECT id_b FROM pairs), linked AS (SELECT class_id AS id_a, id AS id_b FROM sets WHERE id <> class_id UNION ALL SELECT id_a, id_b FROM pairs),
      r AS (SELECT n, (SELECT count(*) FROM extras) / CAST(n AS DOUBLE) AS rate, (SELECT coalesce(string_agg('[' || id_a || ',' || id_b || ']', ',' ORDER BY id_a, id_b), '') FROM (SELECT * FROM linked ORDER BY id_a, id_b LIMIT 10)) AS p FROM (SELECT count(*) AS n FROM {0}))
      SELECT 'duplicate_rate' AS check_name, CAST(NULL AS VARCHAR) AS source_name, CASE WHEN rate > 0.02 THEN 'fail' WHEN rate > 0.01 THEN 'warn' ELSE 'pass' END AS status, round(rate, 6) AS value, CAST(0.02 AS DOUBLE) AS threshold, '{{"window":' || n || ',"pairs":[' || p || ']}}' AS details FROM r"""
_CHECKS = {
    "duplicate_rate": f"WITH recent AS (SELECT id, title FROM source_docs ORDER BY id DESC LIMIT 1000), {_TOKENS.format('recent')}, {_NEAR_DUPLICATES.format('recent')}",
    "freshness": f"""WITH {_RUNS}, l AS (SELECT s.name, max(r.finished_at) AS last FROM sources s LEFT JOIN runs r ON r.source_id = s.id AND r.finished_at <= TIMESTAMPTZ '{NOW}+00' GROUP BY s.id, s.name), h AS (SELECT *, (epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(last)) / 3.6e9 AS hours FROM l)
      SELECT 'freshness' AS check_name, name AS source_name, CASE WHEN last IS NULL OR hours > 48 THEN 'fail' WHEN hours > 26 THEN 'warn' ELSE 'pass' END AS status, round(hours, 2) AS value, CAST(48 AS DOUBLE) AS threshold, CASE WHEN last IS NULL THEN '{{"reason":"no successful run recorded"}}' ELSE '{{}}' END AS details FROM h""",
    "volume_anomaly": f"""WITH {_RUNS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC) AS n FROM runs), g AS (SELECT source_id, max(rows_fetched) FILTER (n = 1) AS now_rows, avg(rows_fetched) FILTER (n > 1) AS mean, count(*) AS runs FROM ranked WHERE n <= 10 GROUP BY source_id),
      v AS (SELECT s.name, g.*, CASE WHEN mean = 0 THEN 1.0 ELSE now_rows / mean END AS ratio FROM sources s LEFT JOIN g ON g.source_id = s.id)
      SELECT 'volume_anomaly' AS check_name, name AS source_name, CASE WHEN coalesce(runs, 0) < 3 THEN 'pass' WHEN ratio = 0 AND mean > 0 THEN 'fail' WHEN ratio < 0.5 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN runs >= 3 THEN round(ratio, 4) END AS value, CAST(0.5 AS DOUBLE) AS threshold,
        CASE WHEN coalesce(runs, 0) < 3 THEN '{{"reason":"insufficient history","runs":' || coalesce(runs, 0) || '}}' ELSE '{{"latest":' || now_rows || ',"trailing_mean":' || round_even(mean, 2) || '}}' END AS details FROM v""",
    "resolution_coverage": """WITH c AS (SELECT count(*) AS total, count(resolved_at) AS resolved, count(*) FILTER (id IN (SELECT document_id FROM links)) AS linked FROM source_docs)
      SELECT 'resolution_coverage' AS check_name, CAST(NULL AS VARCHAR) AS source_name, CASE WHEN resolved >= 100 AND linked = 0 THEN 'warn' ELSE 'pass' END AS status, round(coalesce(linked / CAST(nullif(resolved, 0) AS DOUBLE), 0), 4) AS value, CAST(NULL AS DOUBLE) AS threshold, '{"total":' || total || ',"unresolved":' || (total - resolved) || ',"with_links":' || linked || '}' AS details FROM c""",
    "enrichment_coverage": """WITH c AS (SELECT count(*) AS total, count(enriched_at) AS enriched, count(*) FILTER (id IN (SELECT document_id FROM links WHERE sentiment IS NOT NULL)) AS scored FROM source_docs), v AS (SELECT *, coalesce(enriched / CAST(nullif(total, 0) AS DOUBLE), 0) AS value FROM c)
      SELECT 'enrichment_coverage' AS check_name, CAST(NULL AS VARCHAR) AS source_name, CASE WHEN (enriched >= 100 AND scored = 0) OR (total >= 100 AND 1 - value > 0.5) THEN 'warn' ELSE 'pass' END AS status, round(value, 4) AS value, CAST(NULL AS DOUBLE) AS threshold, '{"total":' || total || ',"unenriched":' || (total - enriched) || ',"with_sentiment":' || scored || '}' AS details FROM v""",
    "panel_freshness": """WITH c AS (SELECT max(date) AS latest, (SELECT count(DISTINCT document_id) FROM links) AS linked FROM daily_panel), v AS (SELECT *, date_diff('day', latest, DATE '2026-05-01') - 1 AS lag FROM c)
      SELECT 'panel_freshness' AS check_name, CAST(NULL AS VARCHAR) AS source_name, CASE WHEN latest IS NULL THEN CASE WHEN linked >= 100 THEN 'warn' ELSE 'pass' END WHEN lag >= 2 THEN 'warn' ELSE 'pass' END AS status, CAST(lag AS DOUBLE) AS value, CAST(2 AS DOUBLE) AS threshold,
        CASE WHEN latest IS NULL THEN '{"reason":"no panel rows",' ELSE '{"latest_day":"' || strftime(latest, '%Y-%m-%d') || '",' END || '"linked_documents":' || linked || '}' AS details FROM v""",
}
_LATEST_BARS = "bars AS (SELECT entity_id, date, adj_close FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, date ORDER BY ingested_at DESC, adj_close DESC NULLS LAST) AS n FROM market_data) WHERE n = 1 AND adj_close > 0), forward AS (SELECT entity_id, date, lead(adj_close, 5) OVER (PARTITION BY entity_id ORDER BY date) / adj_close - 1 AS forward_return FROM bars)"


def _ic_sql() -> str:
    from murmurline.queries.panel import _STORED, _ranked

    ranks = ", ".join(f"rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0 AS {n}" for c, n in (("a", "x"), ("b", "y")))
    return f"""{_STORED}, {_LATEST_BARS}{_ranked('stored')}, met AS (SELECT date, round(score, 9) AS a, round(forward_return, 9) AS b FROM final JOIN forward USING (entity_id, date) WHERE score IS NOT NULL AND forward_return IS NOT NULL), rk AS (SELECT date, {ranks} FROM met)
      SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS pairs, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS ic FROM rk GROUP BY date"""


# The forms of ISO timestamps that the column holds; anything else must come out as NULL.
_D = "published_date"
_ISO_SQL = f"""CASE WHEN regexp_full_match({_D}, '\\d{{4}}-\\d{{2}}-\\d{{2}}(.\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d+)?)?(Z|[+-]\\d{{2}}:\\d{{2}})?)?')
    THEN TRY_CAST(substr({_D}, 1, 10) || CASE WHEN length({_D}) > 10 THEN 'T' || regexp_replace(regexp_replace(regexp_replace(substr({_D}, 12), '(\\.\\d{{6}})\\d+', '\\1'), '^(\\d{{2}}:\\d{{2}})(Z|[+-]|$)', '\\1:00\\2'), '(\\d)$', CASE WHEN regexp_matches({_D}, '[+-]\\d{{2}}:\\d{{2}}$') AND length({_D}) > 16 THEN '\\1' ELSE '\\1+00:00' END) ELSE 'T00:00:00+00:00' END AS TIMESTAMPTZ)
    WHEN regexp_full_match({_D}, '\\d{{8}}T\\d{{6}}Z?') THEN CAST(try_strptime(substr({_D}, 1, 8) || substr({_D}, 10, 6), '%Y%m%d%H%M%S') AS TIMESTAMP) AT TIME ZONE 'UTC'
    WHEN regexp_full_match({_D}, '\\d{{13}}') THEN try_strptime(substr({_D}, 1, 8) || substr({_D}, 10, 4), '%Y%m%d%H%M') AT TIME ZONE 'UTC' END"""
_MAIL_RE = "'^\\s*(?:[A-Za-z]{3,9},?\\s+)?(\\d{1,2})\\s+([A-Za-z]{3})[A-Za-z]*\\s+(\\d{4})\\s+(\\d{1,2}):(\\d{2})(?::(\\d{2}))?(?:\\s+([A-Za-z]{1,5}|[+-]\\d{2}:?\\d{2}))?\\s*$'"
_G = lambda i: f"regexp_extract({_D}, {_MAIL_RE}, {i})"
_MAIL_SQL = f"""CASE WHEN regexp_matches({_D}, {_MAIL_RE}) THEN (try_strptime({_G(1)} || ' ' || {_G(2)} || ' ' || {_G(3)} || ' ' || {_G(4)} || ':' || {_G(5)} || ':' || coalesce(nullif({_G(6)}, ''), '0'), '%d %b %Y %H:%M:%S') - to_minutes(
    CASE WHEN regexp_matches({_G(7)}, '^[+-]') THEN (CAST(substr(replace({_G(7)}, ':', ''), 2, 2) AS BIGINT) * 60 + CAST(substr(replace({_G(7)}, ':', ''), 4, 2) AS BIGINT)) * CASE WHEN {_G(7)}[1] = '-' THEN -1 ELSE 1 END
    ELSE CASE lower({_G(7)}) {' '.join(f"WHEN '{z}' THEN {m}" for z, m in ZONES.items())} END END)) AT TIME ZONE 'UTC' END"""


# The vendor's days, and its instants on the clock of its exchange.
_BAR_FORMS = (("\\d{4}-\\d{2}-\\d{2}", "%Y-%m-%d"), ("\\d{2}/\\d{2}/\\d{4}", "%m/%d/%Y"), ("\\d{8}", "%Y%m%d"), ("\\d{1,2}-[A-Za-z]{3}-\\d{4}", "%d-%b-%Y"), ("[A-Za-z]{3} \\d{1,2}, \\d{4}", "%b %d, %Y"))
_BAR_DAY = f"""CASE {' '.join(f"WHEN regexp_full_match(b.date, '{form}') THEN CAST(try_strptime(b.date, '{pattern}') AS DATE)" for form, pattern in _BAR_FORMS)}
    WHEN regexp_full_match(b.date, '\\d{{4}}-\\d{{2}}-\\d{{2}}[ T]\\d{{2}}:\\d{{2}}:\\d{{2}}(Z|[+-]\\d{{2}}:\\d{{2}})') THEN CAST(TRY_CAST(b.date AS TIMESTAMPTZ) AT TIME ZONE z.zone_name AS DATE)
    WHEN regexp_full_match(b.date, '\\d{{1,7}}|\\d{{9,11}}') THEN CAST(to_timestamp(CAST(b.date AS BIGINT)) AT TIME ZONE z.zone_name AS DATE)
    WHEN regexp_full_match(b.date, '\\d{{12,13}}') THEN CAST(to_timestamp(CAST(b.date AS BIGINT) // 1000) AT TIME ZONE z.zone_name AS DATE) END"""
ORACLES = {
    "bars_of_entities": f"SELECT entity_id, strftime(day, '%Y-%m-%d') AS date, close, volume FROM (SELECT e.id AS entity_id, {_BAR_DAY} AS day, close, volume FROM bars_raw b JOIN entities e ON e.ticker = b.ticker JOIN feed_zones z ON z.source = 'yahoo' WHERE close IS NOT NULL AND NOT isnan(close)) WHERE day IS NOT NULL",
    "content_hash_dedup": f"SELECT * FROM (SELECT {_hash('url', 'title', 'raw_text')} AS hash, count(*) AS copies, min(id) AS first_id FROM source_docs GROUP BY 1) WHERE copies > 1",
    "insert_if_absent": "SELECT id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS n FROM source_docs) WHERE n = 1 AND content_hash NOT IN (SELECT content_hash FROM source_docs WHERE source_id = 1)",
    "upsert_last_wins": f"SELECT document_id, entity_id, confidence, {_T.format('ingested_at')} AS ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id, entity_id ORDER BY ingested_at DESC, confidence DESC, sentiment DESC NULLS LAST) AS n FROM links) WHERE n = 1",
    "bars_restatement": f"""SELECT entity_id, strftime(date, '%Y-%m-%d') AS date, close, adj_close, volume, {_T.format('first_at')} AS ingested_at FROM (SELECT *, min(ingested_at) OVER (PARTITION BY entity_id, date) AS first_at, row_number() OVER (PARTITION BY entity_id, date ORDER BY ingested_at DESC, close DESC NULLS LAST, adj_close DESC NULLS LAST, volume DESC NULLS LAST) AS n FROM market_data) WHERE n = 1""",
    "latest_per_key": f"SELECT document_id, model, {_T.format('max(embedded_at)')} AS embedded_at FROM doc_vectors GROUP BY document_id, model",
    "near_duplicate_classes": f"WITH {_TOKENS.format('source_docs')} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM pairs",
    "near_duplicates_of_documents": f"WITH {_TOKENS.format('source_docs')}, ends AS (SELECT c, count(*) AS links FROM (SELECT id_a AS c FROM pairs UNION ALL SELECT id_b FROM pairs) GROUP BY c) SELECT s.id, s.class_id, coalesce(e.links, 0) AS links FROM sets s LEFT JOIN ends e ON e.c = s.class_id",
    "resolve_links": f"WITH {_DICTIONARY} SELECT document_id, entity_id, CAST(confidence AS DOUBLE) AS confidence, method FROM resolved",
    "resolver_precision_recall": f"""WITH {_DICTIONARY}, s AS (SELECT DISTINCT document_id, entity_id FROM links), c AS (SELECT count(*) FILTER (r.document_id IS NOT NULL AND s.document_id IS NOT NULL) AS tp, count(*) FILTER (s.document_id IS NULL) AS fp, count(*) FILTER (r.document_id IS NULL) AS fn FROM resolved r FULL JOIN s ON s.document_id = r.document_id AND s.entity_id = r.entity_id)
      SELECT tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2.0 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, tp / CAST(tp + fp AS DOUBLE) >= 0.90 AS passed FROM c""",
    "keyword_sentiment": f"WITH {_LABELS} SELECT document_id, label, CAST(CASE label WHEN 'positive' THEN 0.9 WHEN 'negative' THEN 0.8 ELSE 0.6 END AS DOUBLE) AS score FROM scored",
    "sentiment_macro_f1": f"""WITH {_LABELS}, {_FIRST_LINKS}, p AS (SELECT CASE WHEN sentiment > 0.3 THEN 'positive' WHEN sentiment < -0.3 THEN 'negative' ELSE 'neutral' END AS truth, label AS predicted FROM first_links JOIN scored USING (document_id) WHERE sentiment IS NOT NULL),
      l AS (SELECT x AS label, count(*) FILTER (truth = x AND predicted = x) AS tp, count(*) FILTER ((truth = x) <> (predicted = x)) AS miss FROM p, unnest(['positive', 'negative', 'neutral']) u(x) GROUP BY x)
      SELECT round((SELECT avg(CAST(truth = predicted AS INTEGER)) FROM p), 6) AS accuracy, round(avg(2.0 * tp / (2 * tp + miss)), 6) AS macro_f1, avg(2.0 * tp / (2 * tp + miss)) >= 0.70 AS passed FROM l WHERE tp + miss > 0""",
    **_CHECKS,
    "duplicate_rate_of_all": f"WITH {_TOKENS.format('source_docs')}, {_NEAR_DUPLICATES.format('source_docs')}",
    "quality_report": " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in _CHECKS.values()),
    "field_completeness": " UNION ALL ".join(f"SELECT '{f}' AS field, round(avg(CASE WHEN {f} IS NOT NULL AND {f} <> '' THEN 1.0 ELSE 0.0 END), 6) AS completeness FROM rss_raw" for f in ("title", "summary", "url", "published_date", "source")),
    "monthly_volume": """WITH t AS (SELECT source_id, epoch_us(ingested_at) // 1000000 AS e FROM source_docs), l AS (SELECT source_id, list_sort(list(e)) AS es FROM t GROUP BY source_id), q AS (SELECT source_id, len(es) AS n, (es[CAST(floor(0.75 * (len(es) - 1)) AS INTEGER) + 1] - es[CAST(floor(0.25 * (len(es) - 1)) AS INTEGER) + 1]) / 3600.0 AS span FROM l)
      SELECT source_id, CASE WHEN n >= 4 AND span > 0 THEN CAST(round_even(0.5 * n / span * 720, 0) AS BIGINT) END AS estimated FROM q""",
    "html_clean": f"SELECT record_id, substring(trim(regexp_replace(regexp_replace(summary, '<[^>]+>', ' ', 'g'), '{_SPACE}', ' ', 'g'), ' '), 1, 600) AS summary FROM rss_raw",
    "rss_first_of_links": "SELECT record_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY record_id) AS n FROM rss_raw) WHERE n = 1 OR url IS NULL",
    "rss_documents": f"""SELECT url AS external_id, title, {_hash("'rss'", 'url', 'title', 'summary')} AS content_hash, strftime(coalesce({_ISO_SQL}, {_MAIL_SQL}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS published_at, '{{"feed":"' || source || '"}}' AS engagement FROM rss_raw""",
    "hn_documents": f"SELECT {_hash(repr('hackernews'), 'CAST(id AS VARCHAR)', 'title', 'NULL')} AS content_hash, min(CAST(id AS VARCHAR)) AS external_id, count(*) AS fetched FROM hn_raw GROUP BY 1",
    "unknown_tickers": "SELECT DISTINCT ticker FROM bars_raw WHERE ticker NOT IN (SELECT ticker FROM entities)",
    "engagement_values": f"SELECT entity_id, round(CAST(sum(CAST(CASE WHEN json_valid(engagement) AND json_type(engagement) = 'OBJECT' THEN {_NUM.format('score')} + {_NUM.format('comments')} ELSE 0 END AS DECIMAL(28,8))) AS DOUBLE), 6) AS engagement FROM links GROUP BY entity_id",
    "iso_dates": f"SELECT record_id, epoch_us({_ISO_SQL}) AS epoch_us FROM rss_raw",
    "recent_documents": "SELECT id, source_id FROM source_docs ORDER BY id DESC LIMIT 1000",
    "orphans": "SELECT DISTINCT document_id, entity_id FROM links WHERE document_id NOT IN (SELECT id FROM source_docs) OR entity_id NOT IN (SELECT id FROM entities)",
    "forward_return": f"WITH {_LATEST_BARS} SELECT entity_id, strftime(date, '%Y-%m-%d') AS date, round(forward_return, 6) AS forward_return FROM forward",
    "rank_ic": _ic_sql(),
    "topic_keywords": f"""WITH w AS (SELECT id AS document_id, unnest(regexp_extract_all(lower(concat_ws(chr(10), nullif(title, ''), nullif(raw_text, ''))), '[\\p{{L}}][\\p{{L}}\\p{{N}}_]+')) AS keyword FROM source_docs),
      a AS (SELECT DISTINCT document_id, topic_id, version FROM topic_rows),
      tf AS (SELECT version, topic_id, keyword, count(*) AS tf FROM w JOIN a USING (document_id) WHERE keyword NOT IN ({', '.join(f"'{w}'" for w in topics.STOP_WORDS)}) GROUP BY ALL),
      x AS (SELECT *, tf * ln(1 + sum(tf) OVER (PARTITION BY version) / CAST(topics AS DOUBLE) / sum(tf) OVER (PARTITION BY version, keyword)) AS weight FROM tf JOIN (SELECT version, count(DISTINCT topic_id) AS topics FROM tf GROUP BY version) USING (version))
      SELECT version, topic_id, keyword, round(weight, 6) AS weight, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY version, topic_id ORDER BY round(weight, 9) DESC, keyword) AS INTEGER) AS place FROM x) WHERE place <= 10""",
}
