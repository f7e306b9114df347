"""Hand-computed cases of the panel operators, and independence of partitioning."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from murmurline.functions import ranks
from murmurline.operators import panel as P
from murmurline.params import SignalParams

PARAMS = SignalParams()
LINK = "document_id long, entity_id int, confidence double, ingested_at timestamp, published_at timestamp, engagement string, sentiment double"


def ts(text):
    return datetime.fromisoformat(text)


def link(doc, entity, conf, day, published=None, engagement="{}", sentiment=None):
    return (doc, entity, conf, ts(f"2026-07-{day:02d}T12:00:00"), published, engagement, sentiment)


def test_stale_is_strict_and_unknown_is_fresh(spark):
    rows = [link(1, 1, 1.0, 10, ts("2026-07-03T12:00:00")), link(2, 1, 1.0, 10, ts("2026-07-03T11:59:59")), link(3, 1, 1.0, 10)]
    df = spark.createDataFrame(rows, LINK)
    assert [r.document_id for r in P.stale_rows(df, PARAMS).collect()] == [2]


def test_weighted_aggregates(spark):
    rows = [link(1, 7, 0.9, 4, None, '{"score": 20}', 0.5), link(2, 7, 0.3, 4, None, '{"score": 1, "comments": 9}', -0.7), link(3, 7, 0.8, 4), link(4, 8, 0.4, 4), link(5, 8, 0.2, 5, None, '{"score": true}', 0.0)]
    got = {(r.entity_id, str(r.day)[-2:]): r for r in P.daily_entity_aggregates(spark.createDataFrame(rows, LINK), PARAMS).collect()}
    a = got[7, "04"]
    assert (float(a.mentions), float(a.engagement)) == (2.0, 21.0) and a.sentiment == pytest.approx((0.9 * 0.5 - 0.3 * 0.7) / 1.2)
    assert got[8, "04"].sentiment is None and (got[8, "05"].sentiment, float(got[8, "05"].engagement)) == (0.0, 0.0)


def series(spark, values, start):
    rows = [(1, d, d - start, v) for d, v in values]
    return spark.createDataFrame(rows, "k int, day_no int, history int, v double")


def brute_growth(values, start, day, window=7, least=3):
    history = day - start
    if history < least or not (length := min(window, history)):
        return None
    mean = sum(values.get(d, 0.0) for d in range(day - window, day)) / length
    return (values[day] - mean) / max(mean, 1.0)


def brute_momentum(values, start, day, window=7, least=3):
    known = [v for d in range(day - window, day) if (v := values.get(d)) is not None]
    return None if day - start < least or values[day] is None or len(known) < least else values[day] - sum(known) / len(known)


@pytest.mark.parametrize("seed", range(3))
def test_growth_and_momentum_against_brute_force(spark, seed):
    rng = random.Random(seed)
    counts = {d: rng.choice([0.0, 0.0, 0.4, 2.0, 11.0, 35.0]) for d in range(3, 33)}
    moods = {d: rng.choice([None, None, -0.9, 0.15, 0.55]) for d in range(3, 33)}
    for values, operator, brute in ((counts, P.growth, brute_growth), (moods, P.momentum, brute_momentum)):
        df = series(spark, values.items(), 3)
        got = {r.day_no: r.x for r in df.select("day_no", operator(F.col("v"), ["k"], PARAMS).alias("x")).collect()}
        want = {d: brute(values, 3, d) for d in values}
        assert {d for d in got if got[d] is None} == {d for d in want if want[d] is None}
        assert all(got[d] == pytest.approx(w) for d, w in want.items() if w is not None)


def test_version_as_of(spark):
    at = [("old", "2026-03-02T23:59:59"), ("mid", "2026-03-04T00:00:00"), ("twin", "2026-03-04T00:00:00"), ("new", "2026-03-06T12:00:00"), ("old", "2026-03-05T12:00:00")]
    versions = spark.createDataFrame([(v, ts(t)) for v, t in at], "version string, created_at timestamp")
    got = {str(r.day)[-2:]: r.version for r in P.version_spans(versions, "2026-03-07").collect()}
    assert got == {"02": "old", "03": "old", "04": "twin", "05": "twin", "06": "new", "07": "new"}


def brute_ranks(values):
    known = [v for v in values if v is not None]
    rank = lambda v: sum(x < v for x in known) + (sum(x == v for x in known) + 1) / 2
    n = len(known)
    return [None if v is None else 0.0 if n == 1 else (rank(v) - (n + 1) / 2) / ((n - 1) / 2) for v in values]


@pytest.mark.parametrize("values", [[3.5], [None, -2.0, None], [2.0, 2.0, 2.0], [7.0, -1.0, None, 7.0, 0.0, -1.0, 7.0, 1e9], [0.0, -0.0, 4.0]])
@pytest.mark.parametrize("crowded", [1, 10**6])
def test_centred_ranks(spark, monkeypatch, values, crowded):
    """Buckets that hold more rows than ``CROWDED`` go another way to the same ranks."""
    monkeypatch.setattr(ranks.ranked_rows, "__defaults__", (crowded,))
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(values)], "date string, entity_id int, x double")
    got = P.centred_ranks(df, "date", "entity_id", ["x"]).orderBy("entity_id").collect()
    assert [r.x_rank for r in got] == brute_ranks(values)


def test_final_rank_ties_and_nulls(spark):
    rows = [("e", 11, None), ("e", 12, -3.0), ("e", 13, 8.0), ("e", 14, -3.0), ("e", 15, 2.5)]
    df = spark.createDataFrame([(i, d, v, v, v, v) for d, i, v in rows], "entity_id int, date string, " + ", ".join(f"{c} double" for c in P.COMPONENTS))
    got = {r.entity_id: r["rank"] for r in P.ranked_panel(df, PARAMS).collect()}
    assert got == {13: 1, 15: 2, 12: 3, 14: 4, 11: None}


def test_panel_of_three_entities(spark):
    """Components by the brute force above, over six days on which two of three entities are active."""
    rng = random.Random(9)
    rows = [link(n, 1 + n % 2, rng.choice([0.25, 0.5, 1.0]), rng.randint(10, 15), None, f'{{"comments": {rng.randint(0, 30)}}}', rng.choice([None, -0.5, 0.25, 0.75])) for n in range(60)]
    links = spark.createDataFrame(rows, LINK)
    topics = spark.createDataFrame([], "document_id long, ingested_at timestamp, published_at timestamp, topic_id int, version string, probability double")
    versions = spark.createDataFrame([], "version string, created_at timestamp")
    entities = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "id int, active boolean")
    got = {(r.entity_id, int(str(r.date)[-2:])): r for r in P.build_panel(links, topics, versions, entities, "2026-07-16").collect()}
    assert set(got) == {(e, d) for e in (1, 2, 4) for d in range(10, 17)}
    for e in (1, 2, 4):
        of = lambda d: [r for r in rows if r[1] == e and r[3].day == d]  # noqa: B023, E731
        mentions = {d: sum(r[2] for r in of(d)) for d in range(10, 17)}
        engaged = {d: sum(r[2] * json.loads(r[5])["comments"] for r in of(d)) for d in range(10, 17)}
        scored = {d: [(r[2], r[6]) for r in of(d) if r[6] is not None] for d in range(10, 17)}
        mood = {d: sum(c * s for c, s in x) / sum(c for c, _ in x) if x else None for d, x in scored.items()}
        for d in range(10, 17):
            r = got[e, d]
            for have, want in ((r.mention_growth, brute_growth(mentions, 10, d)), (r.engagement_growth, brute_growth(engaged, 10, d)), (r.sentiment_momentum, brute_momentum(mood, 10, d))):
                assert have == (None if want is None else pytest.approx(want))
            assert r.topic_velocity is None and (d > 12 or r.score is None)
    for d in range(13, 17):
        order = sorted((e for e in (1, 2, 4) if got[e, d].score is not None), key=lambda e: (-round(got[e, d].score, 9), e))
        assert [got[e, d]["rank"] for e in order] == list(range(1, len(order) + 1))
    shuffled = P.build_panel(links.repartition(7, "document_id"), topics, versions, entities.repartition(3), "2026-07-16")
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got.values()))
    assert P.build_panel(links.limit(0), topics, versions, entities, "2026-07-16").count() == 0
