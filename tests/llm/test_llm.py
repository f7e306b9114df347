"""The text, vector and score operators: brute force, round trips, held-out accuracy and edge cases."""

import math
import random
from collections import Counter
from datetime import datetime
from pathlib import Path
from statistics import NormalDist

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmurline.llm import encoding_repair, mixing, nearest_vectors, packing, score_fusion, tokens, truncation

SCORES = {"a": 1.0, "b": 1.0}


def brute_fusion(rows):
    out = {}
    for name in ("a", "b"):
        known = [(i, v) for i, a, b in rows if (v := {"a": a, "b": b}[name]) is not None and v == v]
        for i, v in known:
            below, held = sum(x < v for _, x in known), sum(x == v for _, x in known)
            out.setdefault(i, []).append(NormalDist().inv_cdf((below + held / 2) / len(known)))
    return {i: sum(z) / len(z) for i, z in out.items()}


number = st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.0, -1.0, float("nan")]), st.floats(-1e6, 1e6))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(number, number), max_size=15))
def test_fusion_against_brute_force(spark, values):
    rows = [(i, a, b) for i, (a, b) in enumerate(values)]
    df = spark.createDataFrame([("d", *r, "x") for r in rows], "day string, item int, a double, b double, fused string")
    fused = score_fusion.fused_scores(df, "day", "item", SCORES)
    got = {r.item_id: r.fused for r in fused.collect()}
    want = brute_fusion(rows)
    assert set(got) == {r[0] for r in rows}
    assert all(v is None if i not in want else v == pytest.approx(want[i], abs=1e-9) for i, v in got.items())
    places = {r.item_id: r.place for r in score_fusion.ranking(fused).collect()}
    assert sorted(places.values()) == list(range(1, len(rows) + 1))


def test_inverse_normal(spark):
    ps = [1e-9, 1e-4, 0.02, 0.3, 0.5, 0.9, 0.99999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(score_fusion.inverse_normal(F.col("p")).alias("z")).collect()
    assert [r.z for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-9)


WORDS = ["élevés", "société", "bénéfice", "Grünwerder", "schließt", "café-sized", "doesn’t", "€5", "£7", "“soft”", "зaвод".replace("a", "а"), "компания", "директоров", "прогноз", "złotego", "ação", "año", "°C", "™", "größere", "prévision", "été", "kündigte", "спрос", "бумаги"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS + ["plain", "words", "here"]) for _ in range(12)) for _ in range(n)]


def test_encoding_round_trip_and_accuracy(spark):
    texts = corpus(300)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rng, truth = random.Random(2), {}
    for i in range(0, 300, 10):
        chain = rng.choice([c for c, (n, _) in enumerate(encoding_repair.CHAINS) if n in ("utf8_as_cp1252", "utf8_as_latin1", "utf8_as_cp437", "utf8_as_mac", "utf8_as_cp1251", "utf8_twice_as_cp1252")])
        truth[i] = texts[i]
        rows[i] = (i, encoding_repair.garble(texts[i], chain), "x")
    rows += [(900, texts[0].replace("é", "�"), "x"), (901, None, "x"), (902, "", "x"), (903, "ascii " * 50_000, "x"), (904, "é" * 200_000, "x")]
    df = spark.createDataFrame(rows, "id long, text string, restored string")
    got = {r.key: r for r in encoding_repair.garbled_texts(df, "id", "text").collect()}
    lossy = {i for i, t, _ in rows if t and "�" in t}
    changed = {i for i in truth if rows[i][1] != truth[i]}
    assert set(got) == changed | lossy and not any(got[i].restorable for i in lossy)
    assert sum(got[i].restored == truth[i] for i in changed) >= 0.95 * len(changed)
    assert encoding_repair.garbled_texts(df.limit(0), "id", "text").count() == 0


def test_top_prediction_of_every_chain_on_words_left_out():
    path = Path("/root/testdata/sf0.1/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    texts = [t for t in pq.read_table(path, columns=["text"]).column("text").to_pylist() if t]
    held = Counter(w for t in texts for w in set(encoding_repair.WORD.findall(t)) if len(w) <= 60)
    alphabet = frozenset(c for c, n in Counter(c for t in texts for c in set(t) if ord(c) > 127).items() if n >= 3) - {encoding_repair.LOST}
    broken = lambda w: any((y := encoding_repair.invert(r, c)) is not None and alphabet.issuperset(y) for r in encoding_repair.RUN.findall(w) for c in range(encoding_repair.CLEAN) if c not in encoding_repair.SINGLE_BYTE)
    common = [w for w, n in sorted(held.items(), key=lambda kv: (-kv[1], kv[0])) if n >= 3]
    clean = [w for w in common if alphabet.issuperset(c for c in w if ord(c) > 127) and not broken(w) and not any(0x80 <= ord(c) < 0xA0 for c in w)]
    asked, right = Counter(), Counter()
    for fold in (1, 5):  # of eight
        model = encoding_repair.train([[w] for i, w in enumerate(clean) if i % 8 != fold for _ in range(2)], alphabet)
        words, labels = encoding_repair.examples(clean[fold::8])
        asked.update(labels)
        right.update(label for label, top in zip(labels, model.probabilities(words).argmax(axis=1).tolist()) if label == top)
    for chain in range(encoding_repair.CLEAN + 1):
        name = "clean" if chain == encoding_repair.CLEAN else encoding_repair.CHAINS[chain][0]
        # Few words of the tables can be garbled by the last chain.
        assert right[chain] / asked[chain] >= (0.98 if asked[chain] >= 100 else 0.8), (name, asked[chain], right[chain])
    assert sum(right.values()) / sum(asked.values()) >= 0.99


def test_single_byte_stretches_within_clean_text():
    rng = random.Random(5)
    russian = "компания прогноз директоров спрос бумаги рынок акции выросли прибыль квартал отчёт аналитики снижение облигации".split()
    polish = "wzrosła złotego osłabił się żywności cenę obniżyli importerów uderzyło również spółka ogłosiła między".split()
    other = "être très bénéfice año España größere prévision ação não".split()
    docs = [[rng.choice(group) for _ in range(12)] for group in (russian, polish, other) for _ in range(60)]
    model = encoding_repair.train(docs, frozenset(c for d in docs for w in d for c in w if ord(c) > 127))
    chain = {name: i for i, (name, _) in enumerate(encoding_repair.CHAINS)}
    bad = lambda words, name: [encoding_repair.garble(w, chain[name]) for w in words]
    for name, words in (("cp1251_as_cp1252", russian), ("koi8_as_cp1251", russian), ("cp1250_as_cp1252", polish)):
        filler = [rng.choice(words) for _ in range(25)]
        part = " ".join(filler + bad(words[:10], name) + filler)
        whole = " ".join(bad(words, name))
        assert encoding_repair.judge([part, whole], model) == [(True, True, name, " ".join(filler + words[:10] + filler)), (True, True, name, " ".join(words))]
    assert not any(g for g, *_ in encoding_repair.judge([" ".join(d) for d in docs] + ["КОМПАНИЯ ПРОГНОЗ РЫНОК АКЦИИ СПРОС", "dań être peña ñandú"], model))


RUSSIAN = "компания прогноз директоров спрос бумаги рынок акции выросли прибыль квартал отчёт аналитики снижение облигации".split()
POLISH = "wzrosła złotego osłabił się żywności cenę obniżyli importerów uderzyło również spółka ogłosiła między".split()


def test_words_of_every_document_are_counted(spark):
    rng = random.Random(7)
    ids = [r.id for r in spark.range(4100).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, " ".join(rng.choice(RUSSIAN if n < 4000 else POLISH) for _ in range(12))) for n, i in enumerate(ids)]
    chain = next(c for c, (name, _) in enumerate(encoding_repair.CHAINS) if name == "cp1250_as_cp1252")
    # A language that only the last hundred documents by the hash of their id are written in, and one word's count.
    last, whole = ids[-1], "wzrosła złotego żywności cenę spółka ogłosiła"
    rows[-1] = (last, encoding_repair.garble(whole, chain))
    df = spark.createDataFrame(rows, "id long, text string")
    assert [(r.key, r.chain, r.restored) for r in encoding_repair.garbled_texts(df, "id", "text").collect()] == [(last, "cp1250_as_cp1252", whole)]
    _, vocabulary = encoding_repair.fit(df, "text")
    held = Counter(w for _, t in rows[:-1] for w in set(t.split()) if not w.isascii())
    assert {r.core: r.n for r in vocabulary.collect()} == held


def test_collections_without_clean_words(spark):
    for texts, lost in ((["� lost", "� lost", "Ã©tÃ© é"], 2), (["€ € “”"] * 4, 0), (["w³" * 500 + " é"] * 3, 0)):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
        assert encoding_repair.garbled_texts(df, "id", "text").filter("not restorable").count() == lost


def test_fit_on_executors_is_that_in_memory(spark, monkeypatch):
    monkeypatch.setattr(encoding_repair, "WORDS_A_PART", 40)
    texts = corpus(200) + ["ż" * 100 + " plain"] * 2 + [f"{a}{b}é{c}" for a in "bcdfgh" for b in "aeiou" for c in "xyz"] * 2
    texts += [encoding_repair.garble(t, c) for c, t in enumerate(texts[: encoding_repair.CLEAN]) if encoding_repair.garble(t, c)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    alphabet = encoding_repair.alphabet_of(df, "text")
    here = encoding_repair.train([encoding_repair.WORD.findall(t) for t in texts], alphabet)
    clean = encoding_repair.clean_words(encoding_repair.word_counts(df, "text"), alphabet)
    words, labels = encoding_repair.examples([r.word for r in clean.collect()])
    assert Counter((r.word, r.label) for r in encoding_repair.spread_examples(clean).collect()) == Counter(zip(words, labels))
    fits = [encoding_repair.fit(df.repartition(parts), "text") for parts in (1, 5)]
    for model, vocabulary in fits:
        assert {r.core: r.n for r in vocabulary.collect()} == here.vocabulary and "ż" * 100 in here.vocabulary
        assert model.pairs == here.pairs and model.alphabet == here.alphabet
        assert (model.probabilities(words).argmax(axis=1) == here.probabilities(words).argmax(axis=1)).mean() > 0.99
    assert np.array_equal(fits[0][0].weights, fits[1][0].weights) and np.array_equal(fits[0][0].bias, fits[1][0].bias)


@given(st.text(max_size=40), st.integers(0, encoding_repair.CLEAN - 1))
def test_invert_undoes_garble(text, chain):
    y = encoding_repair.garble(text, chain)
    assert y is None or encoding_repair.invert(y, chain) in (text, None)


def sentences(n, seed=0):
    rng = random.Random(seed)
    subject, verb, tail = ["The board", "A supplier", "The regulator", "One analyst"], ["approved", "reviewed", "postponed", "questioned"], ["the annual dividend plan", "the merger proposal", "the inventory forecast", "the freight contract"]
    return [" ".join(f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(tail)}." for _ in range(rng.randint(1, 6))) for _ in range(n)]


def test_truncation(spark):
    whole = sentences(400)
    rows = [(i, "free", t) for i, t in enumerate(whole)]
    long = [t for t in sentences(600, 4) if len(t) > 90]
    rows += [(1000 + i, "capped", t[:90]) for i, t in enumerate(long[:60])] + [(1200 + i, "capped", t) for i, t in enumerate(sentences(300, 6)) if len(t) < 90]
    odd = {2000: "The board approved the ann", 2001: "The board approved the", 2002: "The board approved the annual dividend plan", 2003: "The board approved the annual dividend plan [...]", 2004: "The board approved the divid�", 2005: "One analyst questioned the freight contract lol. The regulator postponed the merg", 2006: None, 2007: "", 2008: "   ", 2009: "The board approved the annual dividend plan. Read more: https://feed.example/ab12cd"}
    long_word = "inventory" * 200
    odd |= {2011: f"The board approved {long_word}.", 2012: f"The regulator reviewed {long_word}.", 2013: f"One analyst questioned {long_word[:1500]}", 2014: "The board approved the annual dividend plan. " * 3000 + "The regulator postponed the merg"}
    rows += [(i, "free", t) for i, t in odd.items()] + [(2010, None, "The regulator reviewed the inv")]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    got = {r.key: r.evidence for r in truncation.truncated_texts(df, "id", "source", "text").collect()}
    assert {k: got[k] for k in got if k >= 2000} == {2000: "word", 2001: "sentence", 2003: "mark", 2004: "byte+word", 2005: "word", 2010: "word", 2013: "word", 2014: "word"}
    cut = {1000 + i for i, t in enumerate(long[:60]) if t[:90][-1] != "."}
    assert {k for k in got if 1000 <= k < 1200} == cut and not [k for k in got if k < 1000 or 1200 <= k < 2000]
    inside = [i for i in cut if (t := dict(enumerate(long))[i - 1000])[90:91].isalpha() and t[89].isalpha()]
    assert inside and all(got[i] in ("word+limit", "limit") for i in cut) and sum(got[i] == "word+limit" for i in inside) >= 0.9 * len(inside)
    rates = {r.source_id: r.truncated for r in truncation.truncation_rates(df, truncation.truncated_texts(df, "id", "source", "text"), "source", "text").collect()}
    assert rates["free"] == 7 and rates[None] == 1
    assert truncation.truncated_texts(df.limit(0), "id", "source", "text").count() == 0


VECTOR = "id long, model string, vector array<float>, at timestamp"


def test_nearest_vectors_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = np.repeat(centres, 50, axis=0) + rng.normal(scale=0.4, size=(3000, 16))
    now = datetime(2026, 1, 1)
    rows = [(i, "m", [float(v) for v in x[i]], now) for i in range(3000)]
    rows += [(0, "m", [9.0] * 16, datetime(2025, 1, 1)), (5000, "m", None, now), (5001, "m", [0.0] * 16, now), (5002, "m", [1.0], now), (5003, "m", [float("nan")] * 16, now), (5004, None, [1.0] * 16, now), (1, "other", [1.0] * 16, now), (2, "other", [1.0] * 16, now), (3, "lonely", [1.0] * 16, now)]
    units = nearest_vectors.usable_vectors(spark.createDataFrame(rows, VECTOR), "id", "model", "vector", "at", 16)
    got = nearest_vectors.nearest_vectors(units, nearest_vectors.fit_indexes(units), 3).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    truth = {(i, int(j)) for i in range(3000) for j in np.argsort(-s[i])[:3]}
    mine = {(r.id, r.neighbour) for r in got if r.group_id == "m"}
    assert len(mine & truth) / len(truth) >= 0.9
    assert {(r.id, r.neighbour) for r in got if r.group_id != "m"} == {(1, 2), (2, 1)}
    empty = units.limit(0)
    assert nearest_vectors.nearest_vectors(empty, nearest_vectors.fit_indexes(empty), 3).count() == 0


def unit_rows(x, ids=None):
    return [(int(i), "m", [float(c) for c in v], datetime(2026, 1, 1)) for i, v in zip(range(len(x)) if ids is None else ids, x)]


def nearest(spark, rows, size, k=3):
    units = nearest_vectors.usable_vectors(spark.createDataFrame(rows, VECTOR), "id", "model", "vector", "at", size)
    return {(r.id, r.place): (r.neighbour, r.similarity) for r in nearest_vectors.nearest_vectors(units, nearest_vectors.fit_indexes(units), k).collect()}


def test_many_cells_and_lists_keep_the_recall(spark, monkeypatch):
    monkeypatch.setattr(nearest_vectors, "CELL", 500)
    monkeypatch.setattr(nearest_vectors, "LIST", 120)
    rng = np.random.default_rng(2)
    # A third of all vectors in one crowded region, the rest in many small ones.
    x = np.concatenate([1.0 + rng.normal(size=(1400, 12)) * 0.05, np.repeat(rng.normal(size=(70, 12)), 40, axis=0) + rng.normal(scale=0.3, size=(2800, 12))])
    got = nearest(spark, unit_rows(x), 12)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1)[:, :3]
    assert len(got) == 3 * len(x)
    mine = {(i, n) for (i, _), (n, _) in got.items()}
    assert np.mean([(i, int(j)) in mine for i in range(len(x)) for j in top[i]]) >= 0.9
    assert all(v == pytest.approx(s[i, n], abs=2e-5) for (i, _), (n, v) in got.items())


def test_vector_asks_in_a_cell_without_postings(spark, monkeypatch):
    """Members of a large class are posted by their first ids only, so a cell may be asked and hold little or nothing."""
    monkeypatch.setattr(nearest_vectors, "CELL", 4)
    monkeypatch.setattr(nearest_vectors, "LEAST_SAMPLE", 10_000)
    monkeypatch.setattr(nearest_vectors, "CELLS", {"post": (0.0, 1), "probe": (9.0, 9)})
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    got = nearest(spark, unit_rows(x), 6)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert len(got) == 120 and np.mean([got[i, 1][0] == int(s[i].argmax()) for i in range(40)]) >= 0.9


@pytest.mark.parametrize("broadcast", [True, False])
def test_equal_vectors_are_answered_from_their_first_ids(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(nearest_vectors, "MOST_CLASSES", 0)
    rng = np.random.default_rng(5)
    other = rng.normal(size=(30, 6))
    x = np.concatenate([np.tile([[1.0, 2, 3, 4, 5, 6]], (200, 1)) * np.arange(1, 201)[:, None], other])
    got = nearest(spark, unit_rows(x), 6)
    assert len(got) == 3 * len(x)
    for i in range(200):
        want = [j for j in range(4) if j != i][:3]
        assert [got[i, p] for p in (1, 2, 3)] == [(j, 1.0) for j in want]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(200, 230):
        s = np.round(u @ u[i], 6)
        s[i] = -9
        want = sorted(range(len(x)), key=lambda j: (-s[j], j))[:3]
        assert [got[i, p][0] for p in (1, 2, 3)] == want


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(900, 24)).astype(np.float32)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[:300] + rng.normal(scale=0.1, size=(300, 24)).astype(np.float32)
    numbers, sims = nearest_vectors.Index(centres).search(x, 4)
    exact = np.argsort(-(x @ centres.T), axis=1)[:, 0]
    assert (numbers[:, 0] == exact).mean() > 0.95 and (np.diff(sims, axis=1) <= 1e-6).all()


def test_centres_are_balanced():
    rng = np.random.default_rng(6)
    x = np.concatenate([1.0 + rng.normal(size=(3000, 8)) * 0.02, rng.normal(size=(3000, 8))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = nearest_vectors.balanced_centres(x, 200)
    assert np.bincount((x @ centres.T).argmax(axis=1)).max() <= 400
    assert len(nearest_vectors.balanced_centres(np.tile(x[:1], (50, 1)), 5)) == 1  # equal rows can't be parted


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(50, 60))
def test_sum_of_squares_respects_capacity(sizes, capacity):
    pack = packing.sum_of_squares(np.array(sizes, np.int64), capacity)
    fill = {}
    for p, s in zip(pack, sizes):
        fill[p] = fill.get(p, 0) + s
    assert all(f <= capacity for f in fill.values()) and set(fill) == set(range(len(fill)))


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 200)
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 90)) for i in range(1500)] + [(2000, 250), (2001, 200), (2002, 0), (3, 10), (3, 10), (None, 7), (None, 7), (None, 120)]
    caps = spark.createDataFrame([("small", 100), ("none", 0), ("null", None)], "pack_name string, capacity_tokens int")
    out = packing.packed_texts(spark.createDataFrame(rows, "id long, tokens int"), caps).collect()
    fill, parts = {}, {}
    for r in out:
        fill[r.pack] = fill.get(r.pack, 0) + r.tokens
        parts.setdefault((r.id, r.copy), []).append(r.tokens)
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(t for _, t in rows)
    assert sorted(parts[2000, 1]) == [50, 100, 100] and parts[2001, 1] == [100, 100] and (2002, 1) not in parts
    assert all(len(p) == 1 for (i, _), p in parts.items() if i is not None and i < 2000)
    assert sorted((c, sorted(p)) for (i, c), p in parts.items() if i is None) == [(1, [7]), (2, [7]), (3, [20, 100])]
    assert sum(fill.values()) / (100 * len(fill)) > 0.85
    assert packing.packed_texts(spark.createDataFrame([], "id long, tokens int"), caps).count() == 0


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, s, lang, rng.randint(5, 60)) for i, (s, lang) in enumerate([("a", "en")] * 500 + [("a", "de-DE")] * 200 + [("b", None)] * 200 + [("c", "fr")] * 10 + [("x", "en")] * 50 + [(None, "en")] * 5)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mixed_selection(spark.createDataFrame(rows, "id long, source string, lang string, tokens int"), targets, {"a": "one", "b": "one"})
    used = {r.id: r for r in selection.collect()}
    shares = {r.source: r for r in report.collect()}
    assert max(r.uses for r in used.values() if r.source == "a") == 1 and max(r.uses for r in used.values()) <= 3
    assert {r.source for r in used.values()} == {"a", "b", "c"} and shares["gone"].actual_share == 0
    assert shares["c"].most_uses == 2 and shares["c"].texts == 10
    assert shares["a"].actual_share / shares["b"].actual_share == pytest.approx(5 / 3, rel=0.06)
    again, _ = mixing.mixed_selection(spark.createDataFrame(rows[::-1], "id long, source string, lang string, tokens int"), targets, {"a": "one", "b": "one"})
    assert {r.id: r.uses for r in again.collect()} == {i: r.uses for i, r in used.items()}


def test_shortage_goes_to_siblings_first():
    leaves = {("one", "a", "en"): (0.4, 1000), ("one", "b", "en"): (0.4, 100), ("two", "c", "en"): (0.2, 1000)}
    assert mixing.plan(leaves, 1000) == {("one", "a", "en"): 700, ("one", "b", "en"): 100, ("two", "c", "en"): 200}


def test_token_counts(spark):
    texts = [None, "", "Hello world", "größere Käufe " * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.tokens for r in tokens.with_token_counts(df, {"id": F.col("id")}, "text").collect()}
    enc = tokens.encoding(f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}")
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert math.isclose(got[2], 2)
