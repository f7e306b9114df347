"""Text functions, keyed writes, resolution, quality ladders, recon bounds, sinks and streams."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from murmurline.functions import text as T
from murmurline.operators import enrich, near_duplicates, quality, recon, resolution, topics, upserts, validation
from murmurline.queries import store
from murmurline.sources import config, plugin, raw, sinks, snapshots, versions
from murmurline.streaming import ingest, late_counts

NOW = datetime(2026, 7, 10)


def test_hashes(spark):
    rows = [("a  b\n", None), ("a b", ""), ("a \u001fb", None), ("é", None), ("é", None), ("ab", "c"), ("a", "bc")]
    h = [r.h for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").select("i", T.content_hash(F.col("a"), F.col("b")).alias("h")).orderBy("i").collect()]
    assert h[0] == h[1] == h[2] and h[3] == h[4] and h[5] != h[6]


def test_text_helpers(spark):
    df = spark.createDataFrame([("<p>A &amp;  <b>b</b></p>", "2026-07-03T10:00:00+02:00"), (None, "junk"), ("", "2026-07-03T10:00:00")], "t string, d string")
    got = df.select(T.strip_html(F.col("t")).alias("s"), T.tokens(F.lit("Start-up 5, start-up")).alias("k"), F.date_format(T.parse_utc(F.col("d")), "HH").alias("h"), T.document_text(F.col("t"), F.lit("x")).alias("x")).collect()
    assert got[0].s == "A &amp; b" and sorted(got[0].k) == ["5", "startup"] and [r.h for r in got] == ["08", None, "10"] and [r.x for r in got[1:]] == ["x", "x"]


def iso_micros(value):
    """ISO timestamps by the standard library."""
    try:
        at = datetime.fromisoformat((value or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    return ((at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def test_iso_timestamps_against_brute_force(spark):
    rng = random.Random(3)
    values = [None, "", " ", "n/a", "2026", "2026-07", " 2026-07-03", "2026-07-03 ", "2025-02-29", "2026-W53-1", "2020-W53-7", "2020-W00-1", "2026-07-03T", "2026-07-03T24:00:01", "2026-07-03T10:00:60", "2026-07-03T10:00 UTC", "T10:00", "0000-01-01", "1772955145672", "2026-7-3", "2026-0703", "2026-07-03Z", "2026-07-03T10:00:00.5\n"]
    for _ in range(1500):
        dash, colon = rng.choice(["-", ""]), rng.choice([":", ""])
        y, h = rng.choice([1969, 2020, 2024, 2026]), rng.randint(0, 24)
        day = rng.choice([f"{y}{dash}{rng.randint(0, 13):02}{dash}{rng.randint(0, 32):02}", f"{y}{dash}W{rng.randint(0, 54):02}{dash}{rng.randint(1, 7)}", f"{y}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"])
        time = f"{h:02}" + rng.choice(["", f"{colon}{rng.randint(0, 60):02}", f"{colon}{rng.randint(0, 59):02}{colon}{rng.randint(0, 60):02}" + rng.choice(["", f"{rng.choice('.,')}{rng.choice(['5', '012', '1234567', '999999999'])}"])])
        zone = rng.choice(["", "Z", f"{rng.choice('+-')}{rng.randint(0, 24):02}" + rng.choice(["", f"{colon}{rng.randint(0, 59):02}", f"{colon}30{colon}{rng.randint(0, 59):02}"])])
        values.append(day + rng.choice(["", rng.choice("T _") + time + zone]))
    df = spark.createDataFrame(list(enumerate(values)), "i int, d string").select("i", F.unix_micros(T.parse_utc(F.col("d"))).alias("us"))
    assert [(values[r.i], r.us, iso_micros(values[r.i])) for r in df.collect() if r.us != iso_micros(values[r.i])] == []


def test_iso_dates_have_every_record(spark, tiny):
    want = {r.record_id: iso_micros(r.published_date) for r in spark.read.parquet(f"{tiny}/rss_raw.parquet").collect()}
    got = {r.record_id: r.epoch_us for r in store.iso_dates(spark, tiny).collect()}
    assert got == want and None in want.values() and any(us % 10**6 for us in want.values() if us)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    batch = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 2)], "k int, v string, t int")
    first = upserts.insert_if_absent(old, batch, ["k"], [F.col("t")])
    assert sorted(tuple(r) for r in first.collect()) == [(1, "a", 1), (2, "b", 1), (3, "e", 2)]
    assert upserts.new_rows(first, batch, ["k"], [F.col("t")]).count() == 0
    last = upserts.upsert_last_wins(old, batch, ["k"], [F.col("t")], keep_first=["t"])
    assert sorted(tuple(r) for r in last.collect()) == [(1, "a", 1), (2, "d", 1), (3, "e", 2)]
    ids = upserts.continue_ids(spark.createDataFrame([(7,)], "id long"), batch.drop("k"), [F.col("t"), F.col("v")], F.col("t"))
    assert [r.v for r in ids.orderBy("id").collect()] == ["c", "e", "d"] and ids.agg(F.min("id")).first()[0] == 8


def test_seed(spark):
    have = spark.createDataFrame([(1, "AAA", "Old", None, ["x"], False, NOW)], "id int, ticker string, name string, sector string, aliases array<string>, active boolean, created_at timestamp")
    universe = spark.createDataFrame([("AAA", "New", "Tech", None), ("BBB", None, None, None)], "ticker string, name string, sector string, aliases array<string>")
    kept = {r.ticker: r for r in upserts.seed_entities(have, universe, F.lit(NOW)).collect()}
    assert kept["AAA"].name == "Old" and not kept["AAA"].active and (kept["BBB"].id, kept["BBB"].name, kept["BBB"].aliases) == (2, "BBB", [])
    new = {r.ticker: r for r in upserts.seed_entities(have, universe, F.lit(NOW), update=True).collect()}
    assert new["AAA"].name == "New" and new["AAA"].active and new["AAA"].aliases == []


def test_resolver(spark):
    entities = spark.createDataFrame([(1, "NVDA", "NVIDIA", ["Nvidia Corp"], True), (2, "ALL", "Allstate", None, True), (3, "AMZN", "Amazon.com, Inc.", ["Amazon"], True), (4, "OFF", "Gone", [], False), (5, None, None, None, True)], "id int, ticker string, name string, aliases array<string>, active boolean")
    texts = ["$nvda up", "NVDA up", "nvda up", "nvidia corp up", "ALL in", "$ALL in", "éNVDA", "Amazon.com, Inc. grows", "amazonia", "Gone OFF", "", "NVDA and $NVDA"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(99, None, None)], "id long, title string, raw_text string")
    got = {(r.document_id, r.entity_id): r.method for r in resolution.resolve(docs, resolution.dictionary(entities)).collect()}
    assert got == {(0, 1): "cashtag", (1, 1): "ticker", (2, 1): "alias", (3, 1): "alias", (5, 2): "cashtag", (7, 3): "alias", (11, 1): "cashtag"} or got == {(0, 1): "cashtag", (1, 1): "ticker", (3, 1): "alias", (5, 2): "cashtag", (7, 3): "alias", (11, 1): "cashtag"}
    assert resolution.resolve(docs.limit(0), resolution.dictionary(entities)).count() == 0


def test_metrics(spark):
    p, e = spark.createDataFrame([(1, "a"), (2, "b")], "d int, t string"), spark.createDataFrame([(1, "a"), (3, "c")], "d int, t string")
    r = resolution.precision_recall(p, e, ["d", "t"]).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    pairs = spark.createDataFrame([("pos", "pos"), ("pos", "neu"), ("neg", "neg"), ("neu", "neu")], "truth string, predicted string")
    m = resolution.macro_f1(pairs).first()
    assert m.accuracy == 0.75 and m.macro_f1 == pytest.approx((2 / 3 + 1 + 2 / 3) / 3)
    assert resolution.precision_recall(p.limit(0), e.limit(0), ["d", "t"]).first().precision == 1.0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(14)]
    rows = [(i, " ".join(rng.sample(words, rng.randint(2, 10)))) for i in range(150)]
    rows += [(200 + i, rows[i][1].upper()) for i in range(10)] + [(300, None), (301, ""), (302, "a b")]
    members = near_duplicates.classes(spark.createDataFrame(rows, "id int, title string"), "id", "title")
    pairs = near_duplicates.similar_classes(members, 0.8)
    got = {(r.id_a, r.id_b) for r in pairs.collect()}
    sets = {i: frozenset(t.lower().split()) for i, t in rows if t and len(set(t.lower().split())) >= 3}
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    want = {(a, b) for s, a in reps.items() for t, b in reps.items() if a < b and len(s & t) / len(s | t) >= 0.8}
    assert got == want and {r.id: r.class_id for r in members.collect()} == {i: reps[s] for i, s in sets.items()}
    assert near_duplicates.duplicate_documents(members, pairs).count() == len(sets)


def status(df):
    return {(r.source_name, r.status) for r in df.collect()}


def test_quality_ladders(spark):
    sources = spark.createDataFrame([(1, "a"), (2, "b"), (3, "never")], "id int, name string")
    run = "id long, source_id int, started_at timestamp, finished_at timestamp, status string, rows_fetched long"
    runs = spark.createDataFrame([(1, 1, NOW, NOW - timedelta(hours=1), "success", 5), (2, 2, NOW, NOW - timedelta(hours=30), "success", 5), (3, 3, NOW, NOW, "error", 5)], run)
    assert status(quality.freshness(sources, runs, F.lit(NOW))) == {("a", "pass"), ("b", "warn"), ("never", "fail")}
    volumes = {1: [100, 110, 90, 10], 2: [100, 100, 100, 0], 3: [5]}
    log = spark.createDataFrame([(i, s, NOW + timedelta(days=i), NOW, "success", n) for s, ns in volumes.items() for i, n in enumerate(ns)], run)
    assert status(quality.volume_anomaly(sources, log)) == {("a", "warn"), ("b", "fail"), ("never", "pass")}
    docs = spark.createDataFrame([(1, "start-up raises new funding round today"), (2, "startup raises new funding round today"), (3, "something else entirely here now")], "id long, title string")
    r = quality.duplicate_rate(docs, "id", "title").first()
    assert (r.status, r.value) == ("fail", 0.333333)
    panel = spark.createDataFrame([(datetime(2026, 7, 9).date(),)], "date date")
    links = spark.createDataFrame([(i,) for i in range(120)], "document_id long")
    one = lambda df: (df.first().status, df.first().value)
    assert one(quality.panel_freshness(panel, links, "2026-07-10")) == ("pass", 0) and one(quality.panel_freshness(panel, links, "2026-07-14")) == ("warn", 4)
    assert one(quality.panel_freshness(panel.limit(0), links, "2026-07-10")) == ("warn", None) and one(quality.panel_freshness(panel.limit(0), links.limit(0), "2026-07-10")) == ("pass", None)


def test_duplicate_rate_of_the_whole_table(spark):
    rows = [(i, "the same old title") for i in range(100)] + [(100 + i, f"title number a{i} b{i} c{i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "id long, title string")
    assert quality.duplicate_rate(docs, "id", "title").first().value == 0 and quality.duplicate_rate(docs, "id", "title", scanned=None).first().value == 0.09


def test_monthly_volume_and_completeness(spark):
    rows = [("a", 1_700_000_000 + 3600 * i) for i in range(100)] + [("b", 1_700_000_000 + 3600 * i) for i in range(100)] + [("b", 0)] + [("c", 1)] * 3 + [("c", None)]
    got = {r.s: r.estimated for r in recon.monthly_volume(spark.createDataFrame(rows, "s string, e long"), "s", "e").collect()}
    assert 650 <= got["a"] <= 800 and 650 <= got["b"] <= 800 and got["c"] is None
    full = recon.field_completeness(spark.createDataFrame([("x", 0, []), ("", None, ["y"])], "a string, b int, c array<string>"), ["a", "b", "c"])
    assert {r.field: r.completeness for r in full.collect()} == {"a": 0.5, "b": 0.5, "c": 0.5}


def test_sources(spark, tmp_path):
    wide = spark.createDataFrame([("2026-01-01", 1.0, 2.0), ("2026-01-02", float("nan"), 3.0)], "date string, `close|A` double, `close|B` double")
    assert sorted((r.ticker, r.close) for r in raw.long_bars(wide, ["A", "B"]).collect()) == [("A", 1.0), ("B", 2.0), ("B", 3.0)]
    feed = tmp_path / "one.xml"
    feed.write_text("<rss><channel><item><title>t</title><description>&lt;p&gt;hi&lt;/p&gt;</description><link>u</link><pubDate>d</pubDate></item><item><title>again</title><link>u</link></item></channel></rss>")
    assert [(r.title, r.summary, r.url) for r in raw.read_rss(spark, [str(feed)]).collect()] == [("again", None, "u")] or [(r.title, r.summary, r.url) for r in raw.read_rss(spark, [str(feed)]).collect()] == [("t", "hi", "u")]
    spec = plugin.register(plugin.SourceSpec("fetched_stories", "hackernews", lambda part, options: iter([{"id": part, "title": "x"}, None]), partitions=3))
    spark.dataSource.register(plugin.data_source(spec))
    assert sorted(r.id for r in spark.read.format("fetched_stories").load().collect()) == [0, 1, 2]
    with pytest.raises(plugin.CredentialsMissing):
        plugin.SourceSpec("r", "reddit", lambda p, o: iter([]), credentials=("client_id",)).check({})
    labels = tmp_path / "labels.jsonl"
    labels.write_text('{"text": "a", "label": "positive"}\n\n{"text": "b", "label": "odd"}\n')
    assert raw.read_labels(spark, str(labels), "text string, label string").count() == 2
    with pytest.raises(Exception, match="unknown label"):
        raw.read_labels(spark, str(labels), "text string, label string", "label", ("positive", "negative")).collect()


def test_feeds_keep_their_order_dates_and_neighbours(spark, tmp_path):
    item = lambda title, link, date, tag="pubDate": f"<item><title>{title}</title>" + (f"<link>{link}</link>" if link else "") + (f"<{tag}>{date}</{tag}>" if date else "") + "</item>"
    for name, items in {"a": [item("A1", "u1", "Fri, 03 Jul 2026 10:00:00 -0500"), item("A2", None, "soon")], "b": [item("B1", "u1", "2026-07-03"), item("B2", "u2", "2026-07-03T10:00:00+02:00", "updated"), item("B3", None, None)]}.items():
        (tmp_path / f"{name}.xml").write_text(f"<rss><channel>{''.join(items)}</channel></rss>")
    failed = []
    got = {r.title: r.published_date for r in raw.read_rss(spark, [str(tmp_path / "a.xml"), str(tmp_path / "dead.xml"), str(tmp_path / "b.xml")], failed=failed).collect()}
    assert got == {"A1": "2026-07-03T15:00:00Z", "A2": "soon", "B2": "2026-07-03T08:00:00Z", "B3": None} and [f.rsplit("/", 1)[1] for f in failed] == ["dead.xml"]
    assert raw.read_rss(spark, [str(tmp_path / "dead.xml")]).count() == 0


def test_mail_dates(spark):
    dates = {"Sun, 08 Mar 2026 06:40:14 GMT": "2026-03-08 06:40:14", "8 Mar 2026 05:04 EDT": "2026-03-08 09:04:00", "Tue, 31 Mar 2026 05:23:24 -0430": "2026-03-31 09:53:24", "1 January 2026 00:00:00 +01:00": "2025-12-31 23:00:00", "31 Feb 2026 10:00": None, "8 Mar 2026 10:00 AEDT": None, "8 Foo 2026 10:00": None, "8 Mar 2026 24:00": None, "": None, "8 Mar 2026": None}
    got = spark.createDataFrame([(d,) for d in dates] + [(None,)], "d string").select("d", F.date_format(T.mail_time(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    assert {r.d: r.t for r in got} == dates | {None: None}


def test_numbers_keep_infinities(spark):
    got = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("x",), (None,)], "v string").select(T.number(F.col("v")).alias("n"), T.whole_number(F.col("v")).alias("w")).collect()
    assert [(r.n, r.w) for r in got] == [(1.5, 1), (None, None), (float("inf"), None), (None, None), (None, None)]


def test_configuration_and_files_of_fetched_stories(spark, tmp_path):
    (tmp_path / "u.yaml").write_text("entities:\n- {ticker: AAA, name: Alpha, aliases: [Al]}\n- {ticker: BBB}\n- {name: none}\nrss:\n  feeds: [one, {url: two}]\n")
    rows = {r.ticker: (r.name, r.aliases) for r in config.universe(spark, str(tmp_path / "u.yaml")).collect()}
    assert rows == {"AAA": ("Alpha", ["Al"]), "BBB": (None, [])} and config.feeds(str(tmp_path / "u.yaml")) == ["one", "two"]
    (tmp_path / "item").mkdir()
    (tmp_path / "topstories.json").write_text("[3, 1, 2, 9]")
    for n, body in {1: "null", 2: '{"id": 2, "title": "t", "descendants": null}', 3: '{"id": 3, "descendants": 4, "score": 5}'}.items():
        (tmp_path / "item" / f"{n}.json").write_text(body)
    got = list(snapshots.stories(0, {"path": str(tmp_path), "limit": 3}))
    assert [(g and g["id"], g and g["comments"]) for g in got] == [(3, 4), (None, None), (2, 0)]
    waits = []
    with pytest.raises(OSError):
        snapshots.retried(lambda: (tmp_path / "gone").read_text(), wait=waits.append)
    assert waits == [0.5, 1.0]
    (tmp_path / "x.json").write_text('[{"id": "a", "num_comments": 1}, {"id": "b"}, {"id": "c"}]')
    assert [p["id"] for p in snapshots.posts(0, {"path": str(tmp_path), "subreddits": "x", "limit": 2})] == ["a", "b"]
    with pytest.raises(plugin.CredentialsMissing):
        snapshots.POSTS.check({})


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "title string, n int")
    lake = str(tmp_path / "lake")
    manifest = sinks.write_bronze(rows, lake, "rss", NOW)
    assert manifest["rows"] == 1 and spark.read.json(manifest["path"]).count() == 1 and "dt=2026-07-10" in manifest["path"]
    many = spark.createDataFrame([(f"t{i}", i) for i in range(50)], "title string, n int")
    sums = [sinks.write_bronze(df, lake, "rss", NOW)["sha256"] for df in (many, many.repartition(5), many.withColumn("n", F.col("n") + 1))]
    assert sums[0] == sums[1] != sums[2]
    assert sinks.write_bronze(rows.limit(0), lake, "rss", NOW) is None and raw.read_jsonl(spark, f"{lake}/rss/*/*", "rss").count() == 151
    path = str(tmp_path / "panel")
    day = "entity_id int, date string, x int"
    sinks.overwrite_days(spark.createDataFrame([(1, "2026-07-01", 1), (1, "2026-07-02", 1)], day), path)
    sinks.overwrite_days(spark.createDataFrame([(1, "2026-07-02", 2)], day), path)
    assert sorted((str(r.date), r.x) for r in spark.read.parquet(path).collect()) == [("2026-07-01", 1), ("2026-07-02", 2)]
    sinks.overwrite_days(spark.createDataFrame([(i, "2026-07-03", i) for i in range(20)], day), path, spark.createDataFrame([(99, "2026-07-03", 9), (5, "2026-07-03", 9)], day), rows_a_file=4)
    third = {r.entity_id: r.x for r in spark.read.parquet(path).filter("date = '2026-07-03'").collect()}
    assert third == {i: i for i in range(20)} | {99: 9}
    sinks.sample_files(many, str(tmp_path / "s"), rows=10)
    sinks.sample_files(many, str(tmp_path / "c"), rows=10, csv=True)
    assert spark.read.json(str(tmp_path / "s" / "sample")).count() == 10 == spark.read.option("header", True).csv(str(tmp_path / "c" / "sample")).count()
    assert spark.read.json(str(tmp_path / "s" / "raw")).count() == 50
    card = recon.scorecard(spark.createDataFrame([("a", "ok", 5, 0.9, None), ("b", "error", 0, None, "no feed")], "source string, status string, records long, completeness double, note string"))
    assert sinks.write_scorecard(card, str(tmp_path / "card")).splitlines() == ["| source | status | records | completeness | note | recommended |", "|---|---|---|---|---|---|", "| a | ok | 5 | 0.9 |  | True |", "| b | error | 0 |  | no feed | False |"]
    assert [r.note for r in spark.read.option("header", True).csv(str(tmp_path / "card" / "csv")).orderBy("source").collect()] == [None, "no feed"]


def test_a_write_that_stops_leaves_the_old_or_the_new_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one = lambda *ns: spark.createDataFrame([(n,) for n in ns], "n int")
    state = lambda: sorted(r.n for r in versions.read_table(spark, path, "n int").collect())
    assert state() == []

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    for step in ("commit", "clean"):  # stopped before the marker, and after it
        for old, write, new in ((1, versions.swap_table, 2), (2, versions.swap_table, 3), (3, versions.append_rows, 4)):
            versions.swap_table(one(old), path)
            with monkeypatch.context() as m:
                m.setattr(versions, step, stop)
                try:
                    write(one(new), path)
                except Stop:
                    pass
            after = [old] if step == "commit" else [new] if write is versions.swap_table else [old, new]
            assert state() == after
    versions.swap_table(versions.read_table(spark, path, "n int").withColumn("n", F.col("n") + 10), path)  # reads itself
    assert state() == [13, 14]
    for n in range(5):
        versions.append_rows(one(n), path)
    versions.swap_table(one(7), path)
    assert state() == [7]
    versions.swap_table(one(8), path)
    assert state() == [8] and len(list((tmp_path / "t").glob("p*"))) == 2  # the state and the one before it


def test_plain_files_become_a_versioned_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1,)], "n int").write.parquet(path)
    state = lambda: sorted(r.n for r in versions.read_table(spark, path, "n int").collect())
    versions.append_rows(spark.createDataFrame([(2,)], "n int"), path)
    assert state() == [1, 2]
    for _ in range(2):
        versions.swap_table(versions.read_table(spark, path, "n int").withColumn("n", F.col("n") * 2), path)
    assert state() == [4, 8] and not list((tmp_path / "t").glob("*.parquet"))


def test_streams(spark, tmp_path):
    schema = "key int, doc long, published timestamp, ingested timestamp, w double"
    rows = [(1, 1, NOW, NOW, 1.0), (1, 1, NOW, NOW + timedelta(days=1), 1.0), (1, 2, NOW, NOW + timedelta(days=9), 1.0)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    columns = {"key": "key", "source": "doc", "event_time": "published", "known_time": "ingested", "weight": "w"}
    for round_no in range(2):  # the second run sees everything again, as after a lost checkpoint
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        late_counts.keep_registers(stream, str(tmp_path / "state"), str(tmp_path / f"c{round_no}"), columns).awaitTermination()
    state = lambda: sorted(map(str, late_counts.current_state(spark, str(tmp_path / "state")).collect()))
    before = state()
    late_counts.compact(spark, str(tmp_path / "state"))
    assert len(before) == 2 and state() == before and not list((tmp_path / "state" / "appended").glob("*.parquet"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    late_counts.keep_registers(stream, str(tmp_path / "state"), str(tmp_path / "c9"), columns, compact_every=1).awaitTermination()
    assert state() == before
    docs = "content_hash string, external_id string, ingested_at timestamp"
    spark.createDataFrame([("h1", "a", NOW), ("h1", "b", NOW), ("h2", "c", NOW)], docs).repartition(2).write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    ingest.ingest_documents(stream, str(tmp_path / "out"), str(tmp_path / "c_docs")).awaitTermination()
    held = lambda: sorted(r.content_hash for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert held() == ["h1", "h2"]
    # A lost checkpoint, and a source that no longer has the old files: what was written stays.
    spark.createDataFrame([("h2", "d", NOW), ("h3", "e", NOW)], docs).write.parquet(str(tmp_path / "docs2"))
    stream = spark.readStream.schema(docs).parquet(str(tmp_path / "docs2"))
    ingest.ingest_documents(stream, str(tmp_path / "out"), str(tmp_path / "c_new")).awaitTermination()
    assert held() == ["h1", "h2", "h3"]


def test_enrichment_and_topics(spark):
    docs = spark.createDataFrame([(1, "Shares surge", None), (2, None, "They plunge"), (3, "", None)], "id long, title string, raw_text string")
    got = {r.document_id: r.label for r in enrich.score_texts(docs, enrich.keyword_sentiment, "m", F.lit(NOW)).collect()}
    assert got == {1: "positive", 2: "negative"}
    v = enrich.embed_texts(docs, enrich.hashed_embedding, "m", F.lit(NOW)).first().vector
    assert len(v) == 384 and sum(x * x for x in v) == pytest.approx(1, abs=1e-5)
    assert topics.centre_fit(spark.createDataFrame([(1, [1.0, 0.0])], "document_id long, vector array<double>")) is None


def test_topic_fit_finds_its_number_of_topics_and_leaves_outliers(spark):
    rng = random.Random(1)
    axis = lambda i: [1.0 if j == i else rng.uniform(-0.05, 0.05) for j in range(8)]
    rows = [(i, axis(i % 3)) for i in range(120)] + [(200 + i, axis(3)) for i in range(4)]
    norm = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    vectors = spark.createDataFrame([(i, norm(v)) for i, v in rows], "document_id long, vector array<double>")
    got = {r.document_id: (r.topic_id, r.probability) for r in topics.centre_fit(vectors).collect()}
    assert {t for t, _ in got.values()} == {0, 1, 2} and not any(i >= 200 for i in got)
    assert all(len({got[i][0] for i in range(k, 120, 3)}) == 1 for k in range(3)) and all(0 < p <= 1 for _, p in got.values())
    assert topics.merged_centres([[1.0, 0.0], [0.0, 1.0], [0.995, 0.0998], [0.1, 0.995]], 0.9) == [0, 1, 0, 1]


def test_every_model_is_fitted(spark, tmp_path):
    rows = [(i, m, [1.0 + i % 7 if j % 8 == i % 8 else 0.01 for j in range(384)], NOW) for m, n in (("a", 80), ("b", 60), ("few", 5)) for i in range(n)]
    spark.createDataFrame(rows, "document_id long, model string, vector array<float>, embedded_at timestamp").write.parquet(str(tmp_path / "doc_vectors.parquet"))
    got = store.topic_fit(spark, str(tmp_path)).collect()
    assert {m: len({r.document_id for r in got if r.model == m}) for m in {r.model for r in got}} == {"a": 80, "b": 60}


def test_keywords_of_each_version_stand_alone(spark):
    docs = spark.createDataFrame([(1, "alpha alpha beta"), (2, "beta gamma"), (3, "delta")], "document_id long, text string")
    old, new = [(1, 1, "v1"), (2, 2, "v1")], [(2, 3, "v2"), (3, 4, "v2"), (1, 4, "v2")]
    rows = lambda x: spark.createDataFrame(x, "document_id long, topic_id int, version string")
    got = {(r.version, r.topic_id, r.keyword, round(r.weight, 9), r.place) for r in topics.class_keywords(docs, rows(old + new), version="version").collect()}
    alone = {(v, r.topic_id, r.keyword, round(r.weight, 9), r.place) for v, x in (("v1", old), ("v2", new)) for r in topics.class_keywords(docs, rows(x)).collect()}
    assert got == alone and {t for _, t, *_ in got} == {1, 2, 3, 4}


def test_keywords_query_covers_every_topic(spark, tiny):
    got = {(r.version, r.topic_id) for r in store.topic_keywords(spark, tiny).collect()}
    assert got == {(r.version, r.topic_id) for r in spark.read.parquet(f"{tiny}/topic_rows.parquet").collect()}


def test_rank_correlation(spark):
    df = spark.createDataFrame([("d", i, float(i), float(-i)) for i in range(5)] + [("e", 1, 1.0, 2.0)], "date string, entity_id int, a double, b double")
    got = {r.date: r.ic for r in validation.rank_correlation(df, "date", "entity_id", "a", "b").collect()}
    assert got["d"] == pytest.approx(-1) and got["e"] is None
