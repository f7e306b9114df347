"""The general training-data operators against brute force, and their defined edge cases."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmurline.operators import instants, late_counters, spikes
from murmurline.operators.trailing_totals import daily_amounts, trailing_totals
from murmurline.functions.engagement import engagement_value

ZONES = [("ny", "America/New_York", "EST", "EDT", False), ("berlin", "Europe/Berlin", "CET", "CEST", True), ("utc", "UTC", "UTC", None, False)]
CASES = [
    ("2026-03-08T06:50:32Z", "ny", "2026-03-08T06:50:32.000Z"), ("2026-04-02 11:12:21", "ny", "2026-04-02T15:12:21.000Z"),
    ("Sat, 18 Oct 2025 05:31:55 CEST", "berlin", "2025-10-18T03:31:55.000Z"), ("04/02/2026 11:12", "berlin", "2026-02-04T10:12:00.000Z"),
    ("04/02/2026 11:12", "ny", "2026-04-02T15:12:00.000Z"), ("1771476493", "ny", "2026-02-19T04:48:13.000Z"), ("1772955145672", "ny", "2026-03-08T07:32:25.672Z"),
    ("2025-11-02 01:30:00", "ny", "2025-11-02T05:30:00.000Z"), ("Sun, 2 Nov 2025 01:30:00 EST", "ny", "2025-11-02T06:30:00.000Z"),
    ("2026-04-01T11:03:46.251999999Z", "utc", "2026-04-01T11:03:46.251Z"), ("Mar 11, 2026 12:18:05 AM", "utc", "2026-03-11T00:18:05.000Z"),
    ("22. Februar 2026, 06:59 Uhr", "berlin", "2026-02-22T05:59:00.000Z"), ("10 février 2026 à 11:48:22", "berlin", "2026-02-10T10:48:22.000Z"),
    ("17 de diciembre de 2025 10:55", "utc", "2025-12-17T10:55:00.000Z"), ("20260219T082359Z", "ny", "2026-02-19T08:23:59.000Z"),
    ("2026-02-30 10:00", "utc", None), ("Mon, 99 Foo 2026", "utc", None), ("", "utc", None), (None, "utc", None), ("2026-02-28", "utc", None), ("Feb 2, 2026 13:00 PM", "utc", None), ("x" * 100_000, "utc", None),
    ("2026-04-02 11:12:21 XYZ", "ny", None), ("2026-04-02 11:12", "nowhere", "2026-04-02T11:12:00.000Z"), ("0000-00-00 00:00:00", "utc", None),
]


def test_instants(spark):
    zones = spark.createDataFrame(ZONES, "source string, zone_name string, std_abbrev string, dst_abbrev string, day_first boolean")
    df = spark.createDataFrame([(i, v, s, "x") for i, (v, s, _) in enumerate(CASES)], "id int, value string, source string, zone_name string")
    out = instants.normalize_instants(df, ["id"], "value", "source", zones)
    got = {r.id: r.utc for r in out.select("id", F.when(F.col("kind") == "instant", instants.iso_utc_millis(F.col("instant_us"))).alias("utc")).collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: w for i, (_, _, w) in enumerate(CASES)}
    assert instants.normalize_instants(df.limit(0), ["id"], "value", "source", zones).count() == 0


def test_trading_day_and_numeric(spark):
    zones = spark.createDataFrame(ZONES, "source string, zone_name string, std_abbrev string, dst_abbrev string, day_first boolean")
    df = spark.createDataFrame([(1, "2025-10-02T02:20:47+00:00"), (2, "10/01/2025"), (3, "02-Oct-2025"), (4, "20251001"), (5, "latest")], "id int, v string")
    got = {r.id: r.day for r in instants.trading_day(instants.normalize_instants(df, ["id"], "v", F.lit("ny"), zones)).collect()}
    assert got == {1: "2025-10-01", 2: "2025-10-01", 3: "2025-10-02", 4: "2025-10-01", 5: None}
    numbers = spark.createDataFrame([(1, 1760695434423065259), (2, 20251001), (3, -1), (4, None)], "id int, v long")
    out = {r.id: r.instant_us for r in instants.normalize_instants(numbers, ["id"], "v", F.lit("utc"), zones, numeric=True).collect()}
    assert out == {1: 1760695434423065, 2: 20251001 * 10**6, 3: -(10**6), 4: None}


EVENT = "key int, doc long, published timestamp, ingested timestamp, w double"


def deliveries():
    moment = st.integers(0, 20 * 24).map(lambda h: datetime(2026, 1, 1) + timedelta(hours=h))
    return st.lists(st.tuples(st.integers(1, 2), st.integers(1, 4), st.one_of(st.none(), moment), moment, st.sampled_from([0.5, 1.0])), max_size=12)


def brute(rows):
    first = {}
    for k, d, p, i, w in rows:
        order = (i, p is None, p or datetime.min, w)
        if (k, d) not in first or order < first[k, d][0]:
            first[k, d] = (order, p, i)
    out = set()
    for (k, d), (_, p, i) in first.items():
        if p is not None:
            out.add((k, d, "too_late" if i - p > timedelta(days=7) else "correction" if i.date() > p.date() else "on_time"))
    return out


@settings(max_examples=6, deadline=None)
@given(rows=deliveries(), cut=st.integers(0, 12))
def test_counters_ignore_order_batches_and_retries(spark, rows, cut):
    def state(part):
        return late_counters.registers(spark.createDataFrame(part, EVENT), "key", "doc", "published", "ingested", "w")

    whole = {(r.key_id, r.source_id, r.outcome) for r in late_counters.outcomes(state(rows), 7 * 86_400_000_000).collect()}
    assert whole == brute(rows)
    a, b = state(rows[:cut]), state(list(reversed(rows[cut:])))
    merged = late_counters.merge(b, a, b)
    assert sorted(map(str, merged.collect())) == sorted(map(str, late_counters.merge(state(rows)).collect()))


def test_trailing_totals_against_brute_force(spark):
    rng = np.random.default_rng(5)
    start = date(2026, 1, 1)
    rows = [(int(rng.integers(1, 4)), start + timedelta(days=int(rng.integers(0, 50))), float(rng.integers(0, 5)) / 10) for _ in range(60)] + [(None, start, 1.0), (1, None, 3.0)]
    df = spark.createDataFrame(rows, "e int, d date, a double")
    entities = spark.createDataFrame([(1,), (2,), (9,)], "entity_id int")
    got = {(r.entity_id, r.day): (r.mentions_7, float(r.amount_7), r.mentions_30, float(r.amount_30)) for r in trailing_totals(daily_amounts(df, "e", F.col("d"), F.col("a").cast("decimal(28,8)")), entities, "2026-01-01", "2026-02-28").collect()}
    assert {k[0] for k in got} == {1, 2, 3, 9, None} and len(got) == 5 * 59
    for (e, day), values in got.items():
        for at, w in ((0, 7), (2, 30)):
            hit = [a for x, d, a in rows if x == e and d is not None and day - timedelta(days=w - 1) <= d <= day]
            assert values[at] == len(hit) and values[at + 1] == pytest.approx(sum(hit), abs=1e-9)


def test_engagement_values(spark):
    texts = ['{"score":10,"comments":2}', '{"feed":"x"}', '{"score":null,"comments":3}', '{"score":true}', "{}", None, "", '{"score": 6, "comm', '[{"score":5}]', '{"score":"12"}', '{"score":7} x', '{"score":NaN}', "null", '{"score":30.5}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", engagement_value(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [12, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 30.5]


def bars(values, volumes=None, e=1, day=0):
    base = date(2026, 1, 1)
    return [(e, base + timedelta(days=i), v, v, (volumes or [1000 + 7 * (i % 11) for i in range(len(values))])[i], datetime(2026, 6, 1)) for i, v in enumerate(values)]


BAR = "entity_id int, date date, close double, adj_close double, volume long, ingested_at timestamp"
FIELDS = {"close": spikes.PRICE, "adj_close": spikes.PRICE, "volume": spikes.COUNT}


def judged(spark, rows):
    out = spikes.implausible_readings(spark.createDataFrame(rows, BAR), "entity_id", "date", "ingested_at", FIELDS).collect()
    return {(r.source_id, (r.day - date(2026, 1, 1)).days, r.field, r.kind) for r in out}


def test_spikes_ranges_stuck_and_lasting_levels(spark):
    rng = np.random.default_rng(3)
    walk = [float(x) for x in 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))]
    odd = list(walk)
    odd[30], odd[60], odd[61] = odd[30] * 1.5, odd[60] * 3, odd[61] * 3
    odd[80] = -5.0
    odd[90:99] = [odd[90]] * 9
    split = [v if i < 50 else v / 4 for i, v in enumerate(walk)]
    got = judged(spark, bars(odd) + bars(split, e=2) + bars(walk[:5], e=3) + [(4, None, 1.0, 1.0, 1, None), (None, date(2026, 1, 1), -1.0, 1.0, 1, None)])
    close = {(d, k) for e, d, f, k in got if e == 1 and f == "close"}
    assert {(30, "spike"), (60, "spike"), (61, "spike"), (80, "range")} <= close
    assert {d for d, k in close if k == "stuck"} == set(range(91, 99)) and len(close) == 12
    assert not {x for x in got if x[0] != 1}
    assert judged(spark, []) == set()


def test_latest_reading_counts(spark):
    rows = bars([100.0 + 0.1 * (i % 5) for i in range(40)])
    wrong = (1, date(2026, 1, 11), 900.0, 900.0, 1000, datetime(2026, 5, 1))
    assert judged(spark, rows + [wrong]) == set()


def test_pursuit_separates_sparse_from_low_rank():
    rng = np.random.default_rng(0)
    low = rng.normal(size=(60, 1)) @ rng.normal(size=(1, 7))
    sparse = np.zeros((60, 7))
    sparse[rng.integers(0, 60, 12), rng.integers(0, 7, 12)] = 8.0
    l, s = spikes.principal_component_pursuit((low + sparse)[None])
    # Seven columns are too few for exact recovery of every cell.
    assert np.quantile(np.abs(l[0] - low), 0.9) < 0.1 and ((np.abs(s[0]) > 4) == (sparse > 0)).mean() > 0.99
