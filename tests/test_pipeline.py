"""Stages over a folder of tables: idempotent runs, run log, isolation of failures, increments, recon statuses."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurline.functions.text import feed_time
from murmurline.operators import enrich
from murmurline.plans import pipeline, runlog
from murmurline.schemas import TABLES, violations
from murmurline.sources import raw
from murmurline.sources.plugin import CredentialsMissing

AT = datetime(2026, 7, 5)


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, TABLES[name]).write.parquet(f"{folder}/{name}")


def document(i, title, body=None, at=AT, engagement="{}"):
    return (i, 1, None, None, None, title, body, None, f"h{i}", None, at, engagement, None, None)


def entity(i, ticker, active=True):
    return (i, ticker, ticker, None, [], active, AT)


def test_resolve_stage_is_idempotent(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, "entities", [entity(1, "NVDA")])
    put(spark, folder, "documents", [document(1, "$NVDA up"), document(2, "nothing"), document(3, None)])
    assert pipeline.resolve_stage(spark, folder, "2026-07-05 00:00:00") == 3
    assert pipeline.resolve_stage(spark, folder, "2026-07-06 00:00:00") == 0
    assert pipeline.load(spark, folder, "document_entities").count() == 1
    assert pipeline.documents_with_stamps(spark, folder).filter("resolved_at IS NULL").count() == 0
    assert pipeline.load(spark, folder, "documents").filter("resolved_at IS NULL").count() == 3  # documents are not rewritten
    assert pipeline.resolve_stage(spark, folder, "2026-07-07 00:00:00", everything=True) == 3
    links = pipeline.load(spark, folder, "document_entities")
    assert violations(links, "document_entities").count() == 0 and str(links.first().resolved_at)[:10] == "2026-07-07"


MODELS = pipeline.Models("kw", enrich.keyword_sentiment, "hash", enrich.hashed_embedding)


def test_enrich_stage_scores_what_is_new_and_stamps_everything(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, "documents", [document(1, "Shares surge"), document(2, ""), document(3, None, "They plunge")])
    assert pipeline.enrich_stage(spark, folder, "2026-07-05 00:00:00", MODELS) == {"scanned": 3, "sentiments": 2, "embeddings": 2}
    assert pipeline.enrich_stage(spark, folder, "2026-07-06 00:00:00", MODELS)["scanned"] == 0
    assert pipeline.documents_with_stamps(spark, folder).filter("enriched_at IS NOT NULL").count() == 3
    other = pipeline.Models("kw2", lambda: lambda texts: [("NEUTRAL", 0.5)] * len(texts), "hash", enrich.hashed_embedding)
    pipeline.enrich_stage(spark, folder, "2026-07-07 00:00:00", other, everything=True)
    scores = {(r.document_id, r.model): r.label for r in pipeline.load(spark, folder, "sentiment_scores").collect()}
    assert scores == {(1, "kw"): "positive", (3, "kw"): "negative", (1, "kw2"): "neutral", (3, "kw2"): "neutral"}
    vectors = pipeline.load(spark, folder, "embeddings")
    assert vectors.count() == 2 and {str(r.embedded_at)[:10] for r in vectors.collect()} == {"2026-07-07"}


@pytest.mark.parametrize("sentiment, width", [(lambda: lambda texts: [("odd", 1.0)] * len(texts), 384), (lambda: lambda texts: [], 384), (enrich.keyword_sentiment, 12)])
def test_enrich_stage_writes_nothing_if_a_model_misbehaves(spark, tmp_path, sentiment, width):
    folder = str(tmp_path)
    put(spark, folder, "documents", [document(1, "Shares surge")])
    bad = pipeline.Models("bad", sentiment, "hash", lambda: lambda texts: np.ones((len(texts), width), np.float32))
    with pytest.raises(Exception, match="does not fit"):
        pipeline.enrich_stage(spark, folder, "2026-07-05 00:00:00", bad)
    assert [pipeline.load(spark, folder, t).count() for t in ("sentiment_scores", "embeddings", "document_stamps")] == [0, 0, 0]


def test_topics_stage_adds_versions_and_says_when_it_skips(spark, tmp_path):
    folder = str(tmp_path)
    few = [document(i, "alpha beta" if i % 2 else "gamma delta") for i in range(10)]
    put(spark, folder, "documents", few)
    pipeline.enrich_stage(spark, folder, "2026-07-05 00:00:00", MODELS)
    assert "skipped" in pipeline.topics_stage(spark, folder, "2026-07-05 00:00:00", "hash")
    pipeline.append_rows(spark.createDataFrame([document(i, "alpha beta" if i % 2 else "gamma delta") for i in range(10, 60)], TABLES["documents"]), f"{folder}/documents")
    pipeline.enrich_stage(spark, folder, "2026-07-06 00:00:00", MODELS)
    first, second = (pipeline.topics_stage(spark, folder, f"2026-07-0{d} 10:00:00", "hash") for d in (7, 8))
    assert (first["topics"], first["assigned"], first["outliers"]) == (2, 60, 0) and first["version"] == "centres-20260707T100000Z" != second["version"]
    held = pipeline.load(spark, folder, "topics").collect()
    assert sorted(r.id for r in held) == [1, 2, 3, 4] and {tuple(sorted(r.keywords)) for r in held} == {("alpha", "beta"), ("delta", "gamma")}
    view = enrich.topic_rows_view(pipeline.load(spark, folder, "documents"), pipeline.load(spark, folder, "document_topics"), pipeline.load(spark, folder, "topics"))
    assert view.groupBy("version").count().filter("count = 60").count() == 2
    assert "skipped" in pipeline.topics_stage(spark, folder, "2026-07-09 00:00:00", "no such model")


def test_links_view_pins_one_model_and_keeps_unscored_documents(spark):
    docs = spark.createDataFrame([document(i, "t") for i in (1, 2, 3)], TABLES["documents"])
    linked = spark.createDataFrame([(1, 7, 1.0), (2, 7, 0.9)], "document_id long, entity_id int, confidence double")
    scores = spark.createDataFrame([(1, "a", "negative", 0.5), (1, "b", "positive", 0.9), (2, "b", "positive", 0.9)], "document_id long, model string, label string, score double")
    got = {r.document_id: r.sentiment for r in enrich.links_view(docs, linked, scores, "a").collect()}
    assert got == {1: -0.5, 2: None}


def days_of(spark, folder, known):
    rng = np.random.default_rng(3)
    rows, linked, scores, topics = [], [], [], []
    for i in range(200):
        day = int(rng.integers(1, known + 1))
        rows.append(document(i, "t", at=datetime(2026, 7, day, int(rng.integers(0, 24))), engagement=f'{{"score": {int(rng.integers(0, 9))}}}'))
        linked.append((i, int(rng.integers(1, 4)), float(rng.choice([0.8, 0.9, 1.0])), "alias", AT))
        if rng.random() < 0.7:
            scores.append((i, "m", str(rng.choice(["positive", "negative", "neutral"])), float(rng.random()), AT))
        topics.append((i, int(rng.integers(1, 5)), float(rng.random())))
    return rows, linked, scores, topics


def test_panel_stage_writes_new_days_as_a_rebuild_would(spark, tmp_path):
    rows, linked, scores, topics = days_of(spark, None, 20)
    whole, steps = str(tmp_path / "whole"), str(tmp_path / "steps")
    for folder in (whole, steps):
        put(spark, folder, "entities", [entity(1, "A"), entity(2, "B"), entity(3, "C", False), entity(4, "D")])
        put(spark, folder, "documents", rows)
        put(spark, folder, "document_entities", linked)
        put(spark, folder, "sentiment_scores", scores)
        put(spark, folder, "document_topics", topics)
        put(spark, folder, "topics", [(t, "v1" if t < 3 else "v2", "x", [], datetime(2026, 7, 1 if t < 3 else 12)) for t in range(1, 5)])
    run = lambda folder, day, **k: pipeline.panel_stage(spark, folder, day, "2026-08-01 00:00:00", "m", **k)
    panel = lambda folder: sorted(str(r) for r in pipeline.load(spark, folder, "daily_panel").collect())
    first = run(whole, "2026-07-21")
    assert first == 3 * 20
    written = [run(steps, day) for day in ("2026-07-05", "2026-07-05", "2026-07-06", "2026-07-15", "2026-07-21", "2026-07-10")]
    assert written == [3 * 4, 0, 3, 3 * 9, 3 * 6, 0]
    assert panel(steps) == panel(whole)
    assert run(steps, "2026-07-21", rebuild=True) == 60 and panel(steps) == panel(whole)
    assert run(str(tmp_path / "none"), "2026-07-21") == 0


FEED = "title string, summary string, url string, published_date string, source string"


def feed(spark, titles):
    return spark.createDataFrame([(t, "s", f"u{t}", "2026-07-03T10:00:00Z", "f") for t in titles], FEED)


def ingestion(name, fetch, normalize=lambda r, i, at: raw.rss_documents(r, i, at, feed_time(F.col("published_date")))):
    return pipeline.Ingestion(name, "rss", fetch, normalize, pipeline.add_documents)


def test_ingestion_logs_runs_and_isolates_failures(spark, tmp_path):
    folder, lake = str(tmp_path / "t"), str(tmp_path / "lake")
    ticks = iter(datetime(2026, 7, 5, tzinfo=timezone.utc) + timedelta(minutes=i) for i in range(100))
    seen = []

    def bad(spark):
        seen.append({(r.id, r.status) for r in runlog.runs(pipeline.load(spark, folder, "ingestion_runs")).collect()})
        raise ValueError("no feed")

    def broken(r, i, at):
        raise KeyError("title")

    sources = [ingestion("bad", bad), ingestion("good", lambda s: feed(s, ["a", "b", "b"])), ingestion("late", lambda s: feed(s, ["x"]), broken), ingestion("empty", lambda s: feed(s, []))]
    run = lambda: {r.source: r for r in pipeline.ingest_stage(spark, folder, lake, sources, lambda: next(ticks))}
    got = run()
    assert seen == [{(1, "running")}]  # the run is on record before anything is fetched
    assert {n: (r.status, r.rows_fetched, r.rows_inserted) for n, r in got.items()} == {"bad": ("error", 0, 0), "good": ("success", 3, 2), "late": ("error", 1, 0), "empty": ("success", 0, 0)}
    assert "no feed" in got["bad"].error and got["empty"].raw_path is None
    assert spark.read.json(got["late"].raw_path).count() == 1  # what was fetched outlives the failure behind it
    again = run()
    assert (again["good"].rows_fetched, again["good"].rows_inserted) == (3, 0)
    documents = pipeline.load(spark, folder, "documents")
    assert sorted(r.id for r in documents.collect()) == [1, 2] and violations(documents, "documents").count() == 0
    assert documents.filter("published_at IS NULL").count() == 0
    log = runlog.runs(pipeline.load(spark, folder, "ingestion_runs"))
    assert log.count() == 8 and log.filter("status = 'running'").count() == 0 and pipeline.load(spark, folder, "sources").count() == 4
    named = runlog.recent_runs(log, pipeline.load(spark, folder, "sources"), 3).collect()
    assert [r.source_name for r in named] == ["empty", "late", "good"]
    with pytest.raises(ValueError):
        runlog.finish_run(spark, folder, (9, AT), 1, AT, "done")


def test_bars_keep_their_first_arrival(spark, tmp_path):
    folder = str(tmp_path)
    bar = lambda close, at: spark.createDataFrame([(1, datetime(2026, 7, 3).date(), 1.0, 1.0, 1.0, close, close, 5, at)], TABLES["market_data"])
    assert pipeline.upsert_bars(spark, folder, bar(1.0, AT)) == 1 and pipeline.upsert_bars(spark, folder, bar(2.0, AT + timedelta(days=1))) == 1
    row = pipeline.load(spark, folder, "market_data").first()
    assert (row.close, row.ingested_at) == (2.0, AT)


def test_quality_stage_logs_every_check(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, "documents", [document(1, "one two three"), document(2, "one two three")])
    runlog.get_or_create_source(spark, folder, "rss", "never", None, AT)
    assert pipeline.quality_stage(spark, folder, "2026-07-05 00:00:00") is True
    rows = {(r.check_name, r.source_name): (r.status, r.threshold, r.details) for r in pipeline.load(spark, folder, "data_quality_checks").collect()}
    assert rows["duplicate_rate", None] == ("fail", 0.02, '{"window":2,"pairs":[[1,2]]}')
    assert rows["freshness", "never"] == ("fail", 48.0, '{"reason":"no successful run recorded"}')
    assert rows["volume_anomaly", "never"] == ("pass", 0.5, '{"reason":"insufficient history","runs":0}')
    assert rows["resolution_coverage", None] == ("pass", None, '{"total":2,"unresolved":2,"with_links":0}')
    assert rows["enrichment_coverage", None] == ("pass", None, '{"total":2,"unenriched":2,"with_sentiment":0}')
    assert rows["panel_freshness", None] == ("pass", 2.0, '{"reason":"no panel rows","linked_documents":0}') and len(rows) == 6
    pipeline.quality_stage(spark, folder, "2026-07-06 00:00:00")
    assert pipeline.load(spark, folder, "data_quality_checks").count() == 12


def test_recon_tells_what_became_of_each_source(spark):
    def bad(_):
        raise ValueError("no feed")

    def locked(_):
        raise CredentialsMissing("needs a key")

    some = spark.createDataFrame([("x", 100.0), ("", 200.0)], "title string, epoch double")
    card = pipeline.recon_stage(spark, {"a": pipeline.Candidate(lambda s: some, ("title",), "epoch", "easy"), "b": pipeline.Candidate(lambda s: some.limit(0), ("title",)), "c": pipeline.Candidate(bad, ()), "d": pipeline.Candidate(locked, ())}, 3800.0)
    rows = {r.source: r for r in card.collect()}
    assert {n: r.status for n, r in rows.items()} == {"a": "ok", "b": "empty", "c": "error", "d": "needs_credentials"}
    assert (rows["a"].completeness, rows["a"].freshness_hours, rows["a"].recommended, rows["a"].difficulty, rows["c"].note) == (0.5, 1.0, False, "easy", "ValueError: no feed")
