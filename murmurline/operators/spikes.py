"""Implausible readings of numeric series, each source against its own normal behaviour.

For every source and block of days the series becomes a *profile matrix*: one row for each session,
the log reading with its neighbours, less the row's median.  Robust principal components (principal
component pursuit by an inexact augmented Lagrangian) split it into a low-rank part, what the source
normally does, and a sparse part, what it does not.  A reading is a spike if its sparse part is large
against the source's moves around that day and the reading is far from the levels before *and* after
it, so that splits, gaps and other lasting new levels are none.  A wrong level is found if it lasts at
most ``REACH`` sessions; a longer one is the majority of its own profiles.  Impossible values (range) and
constant runs far longer than the source's own habit are tested separately.

Work is split by (source, block of ``BLOCK_DAYS``) with a margin on both sides, so that no group grows
with a source's history; repeated readings of one session are reduced before anything is gathered.

Defined results: of each (source, day) the reading with the latest arrival counts (equal arrivals: the
greatest values); NULL and NaN are never cases and are skipped, also inside a constant run; rows with
a NULL source or day take no part; series too short for profiles (``MIN_SESSIONS``) get the range and run tests
only; an empty input gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_DAYS, MARGIN_DAYS = 1000, 60
MIN_SESSIONS = 12
REACH = 3  # neighbours on either side in a profile
LOCAL = 12  # sessions on either side that tell how much the source moves


def _shrink(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0.0)


def principal_component_pursuit(d: np.ndarray, iterations: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse part of each matrix of a (batch, rows, columns) array, rows >= columns.

    The singular value threshold goes through the small Gram matrix, for the whole batch at once.
    """
    rows = np.maximum((np.abs(d).sum(axis=2) > 0).sum(axis=1), d.shape[2])
    lam = (1.0 / np.sqrt(rows))[:, None, None]
    top = np.sqrt(np.maximum(np.linalg.eigvalsh(np.einsum("bij,bik->bjk", d, d))[:, -1], 1e-24))[:, None, None]
    peak = np.abs(d).max(axis=(1, 2), keepdims=True)
    y = d / np.maximum(np.maximum(top, peak / lam), 1e-12)
    mu, sparse, low = 1.25 / top, np.zeros_like(d), d
    for _ in range(iterations):
        x = d - sparse + y / mu
        values, vectors = np.linalg.eigh(np.einsum("bij,bik->bjk", x, x))
        sigma = np.sqrt(np.maximum(values, 1e-24))
        keep = np.maximum(sigma - 1.0 / mu[:, :, 0], 0.0) / sigma
        low = x @ ((vectors * keep[:, None, :]) @ vectors.transpose(0, 2, 1))
        sparse = _shrink(d - low + y / mu, lam / mu)
        y = y + mu * (d - low - sparse)
        mu = np.minimum(mu * 1.5, 1e12 / top)
    return low, sparse


def _profiles(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sessions, 2*REACH+1) windows less their median, mirrored at the ends; and the medians."""
    w = np.lib.stride_tricks.sliding_window_view(np.pad(x, REACH, mode="reflect"), 2 * REACH + 1)
    level = np.median(w, axis=1)
    return w - level[:, None], level


def _quantile(w: np.ndarray, q: float) -> np.ndarray:
    """Quantile of each row without its NaNs (NaN for rows of nothing else), linear between ranks."""
    w = np.sort(w, axis=1)  # NaNs go last
    known = w.shape[1] - np.isnan(w).sum(axis=1)
    at = np.maximum(known - 1, 0) * q
    low = np.floor(at).astype(int)
    high, row = np.minimum(low + 1, np.maximum(known - 1, 0)), np.arange(len(w))
    return w[row, low] + (at - low) * (w[row, high] - w[row, low])


def _rolling(x: np.ndarray, reach: int, q: float) -> np.ndarray:
    padded = np.pad(x, reach, constant_values=np.nan)
    return _quantile(np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1), q)


def _side_levels(x: np.ndarray, reach: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Median of the sessions before, and after, each session; NaN where there are none."""
    padded = np.pad(x, reach, constant_values=np.nan)
    w = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
    return _quantile(w[:, :reach], 0.5), _quantile(w[:, reach + 1 :], 0.5)


def spike_scores(series: list[np.ndarray]) -> list[np.ndarray]:
    """For each log series, the size of every reading's sparse part, 0 where it is at home on one side."""
    out = [np.zeros(len(x)) for x in series]
    judged = [i for i, x in enumerate(series) if len(x) >= MIN_SESSIONS]
    if not judged:
        return out
    length = max(len(series[i]) for i in judged)
    batch = np.zeros((len(judged), length, 2 * REACH + 1))
    for k, i in enumerate(judged):
        profile, _ = _profiles(series[i])
        unit = max(float(np.median(np.abs(profile))), 1e-4)
        batch[k, : len(profile)] = profile / unit
    _, sparse = principal_component_pursuit(batch)
    for k, i in enumerate(judged):
        x = series[i]
        profile, _ = _profiles(x)
        unit = max(float(np.median(np.abs(profile))), 1e-4)
        part = np.abs(sparse[k, : len(x), REACH]) * unit
        before, after = _side_levels(x)
        out[i] = np.fmin(part, np.fmin(np.abs(x - before), np.abs(x - after)))
    return out


def local_moves(x: np.ndarray, suspect: np.ndarray) -> np.ndarray:
    """How much the series moves around each session (0.8 quantile of absolute changes), suspects left out."""
    clean = x.copy()
    if suspect.any() and not suspect.all():
        clean[suspect] = np.interp(np.flatnonzero(suspect), np.flatnonzero(~suspect), x[~suspect])
    moves = np.abs(np.diff(clean, prepend=clean[:1]))
    moves[0] = np.nan
    return _rolling(moves, LOCAL, 0.8)


def stuck(values: np.ndarray, rarity: float, shortest: int) -> np.ndarray:
    """Positions that repeat the value before them within a run the source's habit doesn't explain.

    The chance of a repeat is taken from the source's other sessions (the run itself left out).  A run
    is a case if fewer than ``rarity`` such runs are to be expected among all its sessions.
    """
    n, flags = len(values), np.zeros(len(values), bool)
    if n < 2:
        return flags
    same = values[1:] == values[:-1]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(int)))
    runs = list(zip(edges[::2], edges[1::2]))  # same[a:b] holds, i.e. values a..b are equal
    long = [(a, b) for a, b in runs if b - a + 1 >= shortest]
    if not long:
        return flags
    others = same.sum() - sum(b - a for a, b in long)
    for a, b in sorted(long, key=lambda r: r[0] - r[1]):
        rest = [r for r in long if r != (a, b)]
        # Other long runs count as habit only if they are many: a habit shows again and again.
        habit = others + (sum(y - x for x, y in rest) if len(rest) >= 3 else 0)
        room = n - 1 - (b - a) - (0 if len(rest) >= 3 else sum(y - x for x, y in rest))
        p = (habit + 1.0) / (max(room, 1) + 2.0)
        if n * min(p, 1.0) ** (b - a) < rarity:
            flags[a + 1 : b + 1] = True
    return flags


def _judge(pdf: pd.DataFrame, fields: dict[str, dict]) -> pd.DataFrame:
    found: list[tuple] = []
    for field, rule in fields.items():
        held, logs = [], []
        for k, (days, raw) in enumerate(zip(pdf["days"], pdf[field])):
            v = np.array([np.nan if a is None else a for a in raw], float)
            d = np.asarray(days)
            wrong = ~np.isnan(v) & ((v < 0) | ~np.isfinite(v) | ((v == 0) & rule["positive"]))
            found.extend((k, int(d[i]), field, "range") for i in np.flatnonzero(wrong))
            here = ~np.isnan(v) & ~wrong
            held.append((d[here], v[here]))
            logs.append(np.log(v[here] + (0 if rule["positive"] else 1.0)))
        for k, ((d, v), x, score) in enumerate(zip(held, logs, spike_scores(logs))):
            found.extend((k, int(d[i]), field, "stuck") for i in np.flatnonzero(stuck(v, rule["rarity"], rule["shortest"])))
            if len(x) < MIN_SESSIONS:
                continue
            suspect = score > rule["least"]
            limit = np.maximum(rule["least"], rule["times"] * (local_moves(x, suspect) + 1e-3))
            found.extend((k, int(d[i]), field, "spike") for i in np.flatnonzero(score > limit))
    table = pd.DataFrame(found, columns=["k", "day_no", "field", "kind"])
    own = pdf["block"].to_numpy()[table["k"].to_numpy(int)] if len(table) else np.array([], int)
    table = table[table["day_no"].to_numpy() // BLOCK_DAYS == own]
    return pd.DataFrame({"source_id": pdf["source_id"].to_numpy()[table["k"].to_numpy(int)], "day_no": table["day_no"].astype("int32"), "field": table["field"], "kind": table["kind"]})


#: ``positive``: 0 is impossible; ``least``: smallest log distance of a spike; ``times``: against the local moves.
#: The limits lie in gaps of the scores on sf0.1: prices reach 7.8 times their local moves in ordinary sessions and 11.4 or
#: more in wrong ones, and wrong ones that pass that test differ by 0.068 or more where ordinary ones reach 0.055; volumes
#: reach 2.2 and 3.3, and whatever lies beyond is at least 2.9 times the local moves.
PRICE = {"positive": True, "least": 0.06, "times": 8.8, "rarity": 1e-3, "shortest": 4}
COUNT = {"positive": False, "least": 2.75, "times": 2.0, "rarity": 1e-3, "shortest": 4}


def implausible_readings(df: DataFrame, source: str, day: str, arrival: str, fields: dict[str, dict]) -> DataFrame:
    """(source_id, day date, field, kind): every implausible reading, ``kind`` being range, spike or stuck.

    ``fields`` maps a numeric column to its rule, such as :data:`PRICE` or :data:`COUNT`.
    """
    names = list(fields)
    rows = df.select(F.col(source).alias("source_id"), F.unix_date(F.col(day).cast("date")).alias("day_no"), F.col(arrival).alias("arrival"), *[F.col(f).cast("double").alias(f"v_{f}") for f in names]).filter("source_id IS NOT NULL AND day_no IS NOT NULL")
    latest = rows.groupBy("source_id", "day_no").agg(F.max(F.struct("arrival", *[f"v_{f}" for f in names])).alias("r"))
    own = F.floor(F.col("day_no") / BLOCK_DAYS)
    blocks = F.array_distinct(F.array(F.floor((F.col("day_no") - MARGIN_DAYS) / BLOCK_DAYS), own, F.floor((F.col("day_no") + MARGIN_DAYS) / BLOCK_DAYS)))
    placed = latest.select("source_id", "day_no", *[F.col(f"r.v_{f}").alias(f"v_{f}") for f in names], F.explode(blocks).alias("block"))
    # Judging costs far more than its bytes show, so the number of tasks is set and not left to their size.
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    gathered = placed.repartition(tasks, "source_id", "block").groupBy("source_id", "block").agg(F.array_sort(F.collect_list(F.struct("day_no", *[f"v_{f}" for f in names]))).alias("s"))
    series = gathered.select("source_id", "block", F.col("s.day_no").alias("days"), *[F.col(f"s.v_{f}").alias(f) for f in names])
    kind = dict(df.dtypes)[source]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                yield _judge(pdf.iloc[at : at + 200].reset_index(drop=True), fields)

    flagged = series.mapInPandas(judge, f"source_id {kind}, day_no int, field string, kind string")
    return flagged.select("source_id", F.date_from_unix_date("day_no").alias("day"), "field", "kind")
