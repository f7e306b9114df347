"""What the plans must not do: compare all pairs, read a table again, or read columns nobody asked for."""

import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from murmurline.operators import panel as P
from murmurline.operators import resolution
from murmurline.queries import panel, problems, stages, store

QUERIES = {n: q for m in (panel, problems, stages, store) for n, q in m.QUERIES.items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p7_found", "attention_panel", "topic_velocity", "resolve_links", "near_duplicate_classes", "links_view", "topic_rows_view", "rank_ic"])
def test_no_query_compares_all_pairs(spark, tiny, name):
    if not Path(tiny).exists():
        pytest.skip("no test tables here")
    text = plan(QUERIES[name](spark, tiny))
    assert not re.search(r"NestedLoopJoin|CartesianProduct", text), text


def test_the_panel_reads_links_and_topic_rows_once(spark):
    counted = {}

    def watched(df, name):
        counter = counted[name] = spark.sparkContext.accumulator(0)

        def count(batches):
            for pdf in batches:
                counter.add(len(pdf))
                yield pdf

        return df.mapInPandas(count, df.schema)

    at = lambda d: datetime(2026, 7, d)
    links = spark.createDataFrame([(i, 1 + i % 3, 1.0, at(1 + i % 9), None, "{}", 0.5) for i in range(40)], "document_id long, entity_id int, confidence double, ingested_at timestamp, published_at timestamp, engagement string, sentiment double")
    topics = spark.createDataFrame([(i, 1 + i % 2, "v", 0.5, at(1 + i % 9), None) for i in range(40)], "document_id long, topic_id int, version string, probability double, ingested_at timestamp, published_at timestamp")
    versions = spark.createDataFrame([("v", at(1))], "version string, created_at timestamp")
    entities = spark.createDataFrame([(i, True) for i in (1, 2, 3)], "id int, active boolean")
    rows = P.build_panel(watched(links, "links"), watched(topics, "topics"), versions, entities, "2026-07-09")
    assert rows.filter("topic_velocity IS NOT NULL").count() > 0
    assert {n: c.value for n, c in counted.items()} == {"links": 40, "topics": 40}


def test_scans_read_what_is_asked_for(spark, tiny):
    if not Path(tiny).exists():
        pytest.skip("no test tables here")
    text = plan(QUERIES["unresolved_documents"](spark, tiny))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) and all("raw_text" not in s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text))
    text = plan(QUERIES["latest_per_key"](spark, tiny))
    assert "vector" not in " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    text = plan(store.raw.first_of_links(spark.read.parquet(f"{tiny}/rss_raw.parquet"), "url", [F.col("record_id")]))
    assert "PushedFilters: [IsNotNull(url)]" in text and "PushedFilters: [IsNull(url)]" in text  # records without a link are never shuffled by it


def test_pieces_of_texts_grow_with_the_text(spark):
    """Each word travels with a few behind it and not with the whole text."""
    entities = spark.createDataFrame([(1, "ABCD", "Alpha Beta Works", [], True), (2, None, "The Very Long Name Of A Company That Nobody Shortens", [], True)], "id int, ticker string, name string, aliases array<string>, active boolean")
    text = "plain words go on and on " * 2000 + "alpha  beta works" + " and end" * 1000 + " $abcd"
    docs = spark.createDataFrame([(1, None, text), (2, "Alpha Beta", "Works"), (3, "Alpha Beta Works", None), (4, "xAlpha Beta Works", "ABCDE _ABCD"), (5, "(ABCD)", None)], "id long, title string, raw_text string")
    got = {r.document_id: r.method for r in resolution.resolve(docs, resolution.dictionary(entities)).collect()}
    assert got == {1: "cashtag", 3: "alias", 5: "ticker"}
    docs = spark.createDataFrame([(1, "We met the very long name of a company that nobody shortens, twice", None), (2, "the very long name of a company that nobody shorten", None)], "id long, title string, raw_text string")
    assert [(r.document_id, r.entity_id) for r in resolution.resolve(docs, resolution.dictionary(entities)).collect()] == [(1, 2)]
    assert resolution.resolve(docs, resolution.dictionary(entities.limit(0))).count() == 0
