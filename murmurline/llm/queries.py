"""The queries of the text, vector and score operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurline.llm import encoding_repair, mixing, nearest_vectors, packing, score_fusion, tokens, truncation
from murmurline.sources.tables import table

SCORES = {"mention_growth": 0.25, "sentiment_momentum": 0.25, "topic_velocity": 0.25, "engagement_growth": 0.25}


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = table(spark, sf_dir, "daily_panel")
    # Sorted once, behind the shuffle: hardly any two rows of a key meet before it.
    latest = panel.select("date", "entity_id", "computed_at", *SCORES).repartition("date", "entity_id").groupBy("date", "entity_id").agg(F.max(F.struct("computed_at", *SCORES)).alias("r"))
    return score_fusion.fused_scores(latest.select("date", "entity_id", *[F.col(f"r.{s}").alias(s) for s in SCORES]), "date", "entity_id", SCORES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity in first place of each day."""
    best = score_fusion.best_of_groups(_fused(spark, sf_dir))
    return best.select(F.col("item_id").cast("int").alias("entity_id"), F.col("group_id").cast("string").alias("day"))


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's whole ranking."""
    placed = score_fusion.ranking(_fused(spark, sf_dir))
    return placed.select(F.col("group_id").cast("string").alias("day"), F.col("item_id").cast("int").alias("entity_id"), F.round("fused", 6).alias("fused"), F.col("used").cast("int").alias("used"), F.col("place").cast("long").alias("place"))


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables of texts as one collection: (id, source, text), ids and sources told apart by their table."""
    rss = table(spark, sf_dir, "rss_raw").select(F.struct(F.lit("rss_raw").alias("origin"), F.col("record_id").alias("id")).alias("id"), F.concat(F.lit("rss_raw:"), F.col("source")).alias("source"), F.col("summary").alias("text"))
    docs = table(spark, sf_dir, "source_docs").select(F.struct(F.lit("source_docs").alias("origin"), F.col("id").alias("id")).alias("id"), F.concat(F.lit("source_docs:"), F.col("source_id").cast("string")).alias("source"), F.col("raw_text").alias("text"))
    return rss.unionByName(docs)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose text lost its end."""
    cut = truncation.truncated_texts(_ends(spark, sf_dir), "id", "source", "text")
    return cut.select("key.origin", F.col("key.id").cast("long").alias("record_id")).distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each feed or source lost their end."""
    texts = _ends(spark, sf_dir)
    rates = truncation.truncation_rates(texts, truncation.truncated_texts(texts, "id", "source", "text"), "source", "text")
    return rates.select("source_id", "texts", "truncated", "share")


DIMENSIONS, NEIGHBOURS = 384, 3


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = nearest_vectors.usable_vectors(table(spark, sf_dir, "doc_vectors"), "document_id", "model", "vector", "embedded_at", DIMENSIONS)
    return nearest_vectors.nearest_vectors(units, nearest_vectors.fit_indexes(units), NEIGHBOURS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of which one is among the other's 3 most similar, at a cosine of 0.8 or more."""
    pairs = nearest_vectors.similar_pairs(_neighbours(spark, sf_dir), 0.8)
    return pairs.select(F.col("group_id").alias("model"), F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 most similar documents of every document under each model."""
    return _neighbours(spark, sf_dir).select(F.col("group_id").alias("model"), F.col("id").alias("document_id"), "neighbour", F.round("similarity", 4).alias("similarity"), "place")


def _token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return tokens.with_token_counts(documents, {"id": F.col("doc_id").cast("long"), "source": F.col("source"), "lang": F.col("lang")}, "text")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_texts(_token_sizes(spark, sf_dir).select("id", "tokens"), table(spark, sf_dir, "pack_capacities"))


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack of every document, or of each part of one that alone exceeds the capacity."""
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many packs of each capacity are used and how full they are."""
    return packing.pack_report(_packed(spark, sf_dir), table(spark, sf_dir, "pack_capacities"))


# Domains of the document sources, the first level of the mixing tree.
DOMAINS = {
    "wire_story": "news", "newsletter": "news", "press_release": "news",
    "analyst_note": "research", "earnings_call": "research", "filing_note": "research",
    "forum_post": "social", "hn_thread": "social", "glossary": "reference",
}


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    selection, _ = mixing.mixed_selection(_token_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), DOMAINS)
    return selection.withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target and actual share of each source."""
    _, report = mixing.mixed_selection(_token_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), DOMAINS)
    return report


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents garbled by a wrong decoding, and whether their text can be recovered."""
    garbled = encoding_repair.garbled_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return garbled.select(F.col("key").cast("long").alias("doc_id"), F.when(F.col("restorable"), "yes").otherwise("no").alias("restorable")).distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original text of every restorable document, with the encoding chains that were undone."""
    garbled = encoding_repair.garbled_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return garbled.filter("restorable").select(F.col("key").alias("doc_id"), "chain", F.col("restored").alias("text"))


QUERIES = {"p4_found": p4_found, "p4_ranking": p4_ranking, "p5_found": p5_found, "p5_rates": p5_rates, "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p8_packs": p8_packs, "p8_fill": p8_fill, "p9_selection": p9_selection, "p9_shares": p9_shares, "p10_found": p10_found, "p10_restored": p10_restored}


def _sql_inverse_normal(p: str) -> str:
    def poly(c: tuple, x: str) -> str:
        acc = repr(c[-1])
        for a in reversed(c[:-1]):
            acc = f"({acc} * {x} + CAST({a!r} AS DOUBLE))"
        return acc

    def ratio(x: str, top: tuple, bottom: tuple) -> str:
        return f"({poly(top, x)} / {poly(bottom, x)})"

    s = score_fusion
    r = f"sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    tail = f"CASE WHEN {r} <= 5 THEN {ratio(f'({r} - 1.6)', s.MIDDLE_TOP, s.MIDDLE_BOTTOM)} ELSE {ratio(f'({r} - 5.0)', s.FAR_TOP, s.FAR_BOTTOM)} END"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))', s.CENTRE_TOP, s.CENTRE_BOTTOM)} WHEN {p} < 0.5 THEN -({tail}) ELSE {tail} END"


_FUSED = f"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, entity_id ORDER BY computed_at DESC, mention_growth DESC, sentiment_momentum DESC, topic_velocity DESC, engagement_growth DESC) AS n FROM daily_panel) WHERE n = 1
), entries AS (
  SELECT date, entity_id, s.k, CAST(s.v AS DOUBLE) AS v FROM latest, unnest([{', '.join(f"{{'k': {i}, 'v': {n}}}" for i, n in enumerate(SCORES))}]) u(s)
), ranked AS (
  SELECT *, (rank() OVER (PARTITION BY date, k ORDER BY v) + (count(*) OVER (PARTITION BY date, k, v) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY date, k) AS p FROM entries WHERE v IS NOT NULL AND NOT isnan(v)
), fused_ AS (
  SELECT date, entity_id, list_reduce(list(0.25 * z ORDER BY k), lambda a, b: a + b) / (0.25 * count(*)) AS fused, count(*) AS used
  FROM (SELECT *, {_sql_inverse_normal('p')} AS z FROM ranked) GROUP BY date, entity_id
), placed AS (
  SELECT l.date, l.entity_id, f.fused, coalesce(f.used, 0) AS used, row_number() OVER (PARTITION BY l.date ORDER BY f.fused DESC NULLS LAST, l.entity_id) AS place
  FROM latest l LEFT JOIN fused_ f ON f.date = l.date AND f.entity_id = l.entity_id
)
"""
ORACLES = {
    "p4_found": _FUSED + "SELECT entity_id, strftime(date, '%Y-%m-%d') AS day FROM placed WHERE place = 1 AND fused IS NOT NULL",
    "p4_ranking": _FUSED + "SELECT strftime(date, '%Y-%m-%d') AS day, entity_id, round(fused, 6) AS fused, CAST(used AS INTEGER) AS used, CAST(place AS BIGINT) AS place FROM placed",
}
