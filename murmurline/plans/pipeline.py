"""Stages over a folder of tables: ingest, resolve, enrich, topics, panel, quality, recon.

Each reads tables, composes operators and writes; a re-run with nothing new writes nothing.  The clock is a parameter.
Documents are never rewritten: what a stage has seen is kept beside them, as rows (document_id, stage, at).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurline.operators import enrich, panel, quality, recon, resolution, topics, upserts
from murmurline.params import SignalParams
from murmurline.plans import runlog
from murmurline.schemas import KEYS, TABLES
from murmurline.session import cut_lineage
from murmurline.sources.plugin import CredentialsMissing
from murmurline.sources.sinks import append_log, overwrite_days, write_bronze
from murmurline.sources.versions import append_rows, read_table, swap_table

RESOLVE, ENRICH = "resolve", "enrich"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by its schema, empty where it does not exist."""
    return read_table(spark, f"{folder}/{name}", TABLES[name])


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def documents_with_stamps(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with ``resolved_at`` and ``enriched_at`` as the stages' stamps say; a stored value stands where there is no stamp."""
    stamps = load(spark, folder, "document_stamps").groupBy(F.col("document_id").alias("id")).agg(*[F.max(F.when(F.col("stage") == s, F.col("at"))).alias(f"{s}_stamp") for s in (RESOLVE, ENRICH)])
    met = load(spark, folder, "documents").join(stamps, "id", "left")
    return met.withColumns({"resolved_at": F.coalesce(f"{RESOLVE}_stamp", "resolved_at"), "enriched_at": F.coalesce(f"{ENRICH}_stamp", "enriched_at")}).drop(f"{RESOLVE}_stamp", f"{ENRICH}_stamp")


def _todo(spark: SparkSession, folder: str, stage: str, column: str, everything: bool) -> DataFrame:
    """The documents that a stage has to scan, kept, so that all its writes are about the same ones."""
    documents = load(spark, folder, "documents")
    if not everything:
        documents = upserts.unstamped(documents.filter(F.col(column).isNull()), load(spark, folder, "document_stamps"), stage)
    return cut_lineage(documents.select("id", "title", "raw_text"))


def _keep(spark: SparkSession, folder: str, name: str, rows: DataFrame, order: str, everything: bool) -> int:
    """Writes rows by key and returns how many: those of new documents are added, a full run replaces the keys it has."""
    rows = cut_lineage(rows)
    written = rows.count()
    path = f"{folder}/{name}"
    if not written:
        return 0
    if everything:
        swap_table(upserts.upsert_last_wins(load(spark, folder, name), rows, KEYS[name], [F.col(order)]), path)
    else:
        # A run that stopped before its stamps may have left some of these rows.
        append_rows(rows.join(load(spark, folder, name).select(*KEYS[name]), KEYS[name], "left_anti").select(rows.columns), path)
    return written


@dataclass(frozen=True)
class Ingestion:
    """A source to ingest: how its raw records are fetched, made canonical, and written."""

    name: str
    kind: str
    fetch: Callable[[SparkSession], DataFrame]
    normalize: Callable[[DataFrame, int, Column], DataFrame]
    persist: Callable[[SparkSession, str, DataFrame], int]
    config_ref: str | None = None


@dataclass
class IngestResult:
    """What became of one source's run."""

    source: str
    status: str
    rows_fetched: int = 0
    rows_inserted: int = 0
    raw_path: str | None = None
    run_id: int | None = None
    error: str | None = None
    notes: dict = field(default_factory=dict)


def add_documents(spark: SparkSession, folder: str, documents: DataFrame) -> int:
    """Adds the documents whose content is new, with ids from the largest on; returns how many were written."""
    held = load(spark, folder, "documents")
    fresh = cut_lineage(upserts.new_rows(held, documents, KEYS["documents"], [F.col("ingested_at"), F.col("external_id"), F.col("title")]))
    if fresh.isEmpty():
        return 0
    # Ids follow the hash, in slices, so that numbering is spread over tasks.
    slice_no = F.conv(F.substring("content_hash", 1, 3), 16, 10).cast("int")
    numbered = upserts.continue_ids(held, fresh, [F.col("content_hash")], slice_no, 4096)
    for name in ("resolved_at", "enriched_at"):
        numbered = numbered.withColumn(name, F.lit(None).cast("timestamp"))
    columns = [c.split()[0] for c in TABLES["documents"].split(", ")]
    append_rows(numbered.select(*[F.col(c).cast(dict(held.dtypes)[c]) for c in columns]), f"{folder}/documents")
    return fresh.count()


def upsert_bars(spark: SparkSession, folder: str, bars: DataFrame) -> int:
    """Bars by entity and day: later prices replace earlier ones, the first time of arrival stays; returns how many were given."""
    bars = cut_lineage(bars)
    if not (given := bars.count()):
        return 0
    state = upserts.upsert_last_wins(load(spark, folder, "market_data"), bars, KEYS["market_data"], [F.col("ingested_at")], keep_first=["ingested_at"])
    swap_table(state, f"{folder}/market_data")
    return given


def ingest_stage(spark: SparkSession, folder: str, lake: str, sources: list[Ingestion], clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> list[IngestResult]:
    """Runs each source on its own: run row, fetch, raw lake, canonical rows, table, end of the run.

    A failure ends its own run with ``error`` and stops no other; what reached the lake before it stays there.
    """
    results = []
    for source in sources:
        source_id = runlog.get_or_create_source(spark, folder, source.kind, source.name, source.config_ref, clock())
        run = runlog.start_run(spark, folder, source_id, clock())
        result = IngestResult(source.name, "success", run_id=run[0])
        try:
            raw = cut_lineage(source.fetch(spark))
            result.rows_fetched = raw.count()
            manifest = write_bronze(raw, lake, source.name, run[1])
            result.raw_path = manifest and manifest["path"]
            result.rows_inserted = source.persist(spark, folder, source.normalize(raw, source_id, F.lit(run[1]).cast("timestamp")))
        except Exception as problem:  # noqa: BLE001 - a source's failure is a result
            result.status, result.error = "error", f"{type(problem).__name__}: {problem}"[:500]
        runlog.finish_run(spark, folder, run, source_id, clock(), result.status, result.rows_fetched, result.rows_inserted, result.raw_path, result.error)
        results.append(result)
    return results


def resolve_stage(spark: SparkSession, folder: str, now: str, everything: bool = False) -> int:
    """Links the documents no run has seen (or all) and stamps every scanned one; returns how many were scanned."""
    todo = _todo(spark, folder, RESOLVE, "resolved_at", everything)
    if not (scanned := todo.count()):
        return 0
    found = resolution.resolve(todo, resolution.dictionary(load(spark, folder, "entities"))).withColumn("resolved_at", _at(now))
    _keep(spark, folder, "document_entities", found, "resolved_at", everything)
    append_rows(upserts.stamp(todo, RESOLVE, _at(now)), f"{folder}/document_stamps")
    return scanned


@dataclass(frozen=True)
class Models:
    """The models of the enrichment stage, by name, behind their factories."""

    sentiment: str
    sentiment_factory: Callable[[], enrich.SentimentModel]
    embedding: str
    embedding_factory: Callable[[], enrich.EmbeddingModel]


def enrich_stage(spark: SparkSession, folder: str, now: str, models: Models, everything: bool = False) -> dict[str, int]:
    """Scores and embeds the documents no run has seen (or all) and stamps every scanned one, also those without text."""
    todo = _todo(spark, folder, ENRICH, "enriched_at", everything)
    scanned = todo.count()
    if not scanned:
        return {"scanned": 0, "sentiments": 0, "embeddings": 0}
    # Both models' output is complete before anything is written.
    scores = cut_lineage(enrich.score_texts(todo, models.sentiment_factory, models.sentiment, _at(now)))
    vectors = cut_lineage(enrich.embed_texts(todo, models.embedding_factory, models.embedding, _at(now)))
    written = {"scanned": scanned, "sentiments": _keep(spark, folder, "sentiment_scores", scores, "scored_at", everything), "embeddings": _keep(spark, folder, "embeddings", vectors, "embedded_at", everything)}
    append_rows(upserts.stamp(todo, ENRICH, _at(now)), f"{folder}/document_stamps")
    return written


def topics_stage(spark: SparkSession, folder: str, now: str, embedding: str, fitter: Callable[[DataFrame], DataFrame | None] = topics.centre_fit, prefix: str = "centres") -> dict:
    """A new version of topics over all documents embedded by one model; too few documents are skipped and said so.

    ``fitter`` maps (document_id, vector) to (document_id, topic_id, probability), topics numbered from 0 and outliers left
    out.  Versions are added, never changed.
    """
    vectors = cut_lineage(load(spark, folder, "embeddings").filter(F.col("model") == embedding).join(load(spark, folder, "documents").select(F.col("id").alias("document_id")), "document_id", "left_semi").select("document_id", "vector"))
    used = vectors.count()
    fit = fitter(vectors)
    if fit is None:
        return {"documents": used, "skipped": f"{used} documents embedded by {embedding}; a fit needs {topics.MIN_DOCUMENTS}"}
    fit = cut_lineage(fit)
    version = spark.range(1).select(topics.version_name(prefix, _at(now)).alias("v")).first()["v"]
    held = load(spark, folder, "topics")
    first = held.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"] + 1
    texts = load(spark, folder, "documents").select(F.col("id").alias("document_id"), enrich.document_text(F.col("title"), F.col("raw_text")).alias("text"))
    words = topics.class_keywords(texts, fit).groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    # A topic without any word that counts has none.
    named = fit.select("topic_id").distinct().join(words, "topic_id", "left").select("topic_id", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    rows = named.select((F.col("topic_id") + first).cast("int").alias("id"), F.lit(version).alias("topic_model_version"), F.concat_ws("_", F.col("topic_id").cast("string"), F.slice("keywords", 1, 4)).alias("label"), "keywords", _at(now).alias("created_at"))
    rows = cut_lineage(rows)
    append_rows(fit.select("document_id", (F.col("topic_id") + first).cast("int").alias("topic_id"), "probability"), f"{folder}/document_topics")
    # The assignments count from here on, as views join them with their topics.
    append_rows(rows, f"{folder}/topics")
    assigned = fit.count()
    return {"version": version, "documents": used, "topics": rows.count(), "assigned": assigned, "outliers": used - assigned}


def panel_stage(spark: SparkSession, folder: str, as_of: str, now: str, sentiment: str, rebuild: bool = False, params: SignalParams | None = None) -> int:
    """Writes the closed days after the stored ones (or all); returns how many rows were written.

    A run for new days reads what became known from one window before them on; where the panel begins is known from the
    stored rows, as nothing becomes known before what is already there.
    """
    params = params or SignalParams()
    stored = load(spark, folder, "daily_panel")
    known = stored.agg(F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last")).first()
    end = spark.range(1).select(F.date_sub(F.to_date(F.lit(as_of)), 1).cast("string").alias("d")).first()["d"]
    if known["last"] is not None and known["last"] >= end and not rebuild:
        return 0
    after = None if rebuild else known["last"]
    documents = load(spark, folder, "documents").select("id", "ingested_at", "published_at", "engagement")
    if after is not None:
        documents = documents.filter(F.to_date("ingested_at") > F.date_sub(F.to_date(F.lit(after)), params.window_days))
    links = enrich.links_view(documents, load(spark, folder, "document_entities"), load(spark, folder, "sentiment_scores"), sentiment)
    held = load(spark, folder, "topics")
    topic_rows = enrich.topic_rows_view(documents, load(spark, folder, "document_topics"), held)
    versions = held.groupBy(F.col("topic_model_version").alias("version")).agg(F.min("created_at").alias("created_at"))
    rows = panel.build_panel(links, topic_rows, versions, load(spark, folder, "entities"), end, params, origin=None if after is None else known["first"], after=after)
    columns = [c.split()[0] for c in TABLES["daily_panel"].split(", ")]
    rows = cut_lineage(rows.withColumn("computed_at", _at(now)).select(*columns))
    written = rows.count()
    if written:
        overwrite_days(rows, f"{folder}/daily_panel", stored)
    return written


def quality_stage(spark: SparkSession, folder: str, now: str) -> bool:
    """Appends a row for each check of the folder's tables to the log; whether any failed."""
    documents, links = documents_with_stamps(spark, folder), load(spark, folder, "document_entities")
    sources, runs = load(spark, folder, "sources"), runlog.runs(load(spark, folder, "ingestion_runs"))
    checks = [
        quality.duplicate_rate(documents, "id", "title"), quality.freshness(sources, runs, _at(now)), quality.volume_anomaly(sources, runs), quality.resolution_coverage(documents, links),
        quality.enrichment_coverage(documents, load(spark, folder, "sentiment_scores")), quality.panel_freshness(load(spark, folder, "daily_panel"), links, now[:10]),
    ]
    rows = cut_lineage(quality.all_checks(*checks).withColumn("ran_at", _at(now)).coalesce(1))
    append_log(rows, f"{folder}/data_quality_checks")
    return quality.any_failure(rows)


@dataclass(frozen=True)
class Candidate:
    """A source under test: a sample of it, the fields it must have, where its time is, and what is said about it."""

    fetch: Callable[[SparkSession], DataFrame]
    fields: tuple[str, ...]
    epoch: str | None = None
    difficulty: str | None = None


def recon_stage(spark: SparkSession, candidates: dict[str, Candidate], now_epoch: float) -> DataFrame:
    """The scorecard: each candidate's status (ok, empty, needs_credentials, error), completeness, freshness, volume, verdict."""
    rows = []
    for name, candidate in candidates.items():
        row = {"source": name, "status": "ok", "records": 0, "completeness": None, "freshness_hours": None, "estimated_monthly": None, "difficulty": candidate.difficulty, "note": None}
        try:
            sample = cut_lineage(candidate.fetch(spark))
            row["records"] = sample.count()
            if not row["records"]:
                row["status"] = "empty"
            else:
                row["completeness"] = round(recon.field_completeness(sample, list(candidate.fields)).agg(F.avg("completeness").alias("c")).first()["c"], 4)
                if candidate.epoch:
                    row["freshness_hours"] = recon.freshness_hours(sample, candidate.epoch, now_epoch).first()["freshness_hours"]
                    row["estimated_monthly"] = recon.monthly_volume(sample.withColumn("one__", F.lit(1)), "one__", candidate.epoch).first()["estimated"]
        except CredentialsMissing as problem:
            row |= {"status": "needs_credentials", "note": str(problem)}
        except Exception as problem:  # noqa: BLE001 - a source's failure is a result
            row |= {"status": "error", "note": f"{type(problem).__name__}: {problem}"[:500]}
        rows.append(tuple(row.values()))
    schema = "source string, status string, records long, completeness double, freshness_hours double, estimated_monthly long, difficulty string, note string"
    return recon.scorecard(spark.createDataFrame(rows, schema))
