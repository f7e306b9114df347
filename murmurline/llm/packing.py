"""Filling fixed-capacity packs with texts by sum-of-squares online packing.

An item goes to the fill level that keeps the sum of squared counts of partially filled packs
smallest; the counts are held in an array with one entry for each level.  A text longer than the
capacity is split into full packs and one remainder, any other is never split.

The work is spread over shards of about ``SHARD_ITEMS`` items, drawn by the hash of the id, so every
shard sees the collection's mix of lengths and no task sees more than its shard.  Packs that a shard
leaves partly filled are items of the next round, packed again over as many shards as they need, until
one shard holds them or a round no longer joins packs (at most ``MOST_ROUNDS``).

Defined results: NULL and empty texts have no tokens and take no room: they are put in no pack; equal
texts are items of their own; NULL or non-positive capacities are left out; an empty table gives no
row.  Repeated ids, and NULL ones, are packed as often as they occur and told apart by ``copy``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmurline.session import cut_lineage

SHARD_ITEMS = 20_000
MOST_ROUNDS = 6
FULL_ENOUGH = 0.999
COPIES_AT_ONCE = 100_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The pack number of each item, in the order given; every size is between 1 and the capacity."""
    count = np.zeros(capacity + 1, np.int64)  # packs at each fill level; 0 and the capacity don't count
    at_level: list[list[int]] = [[] for _ in range(capacity + 1)]
    pack = np.zeros(len(sizes), np.int64)
    made = 0
    levels = np.zeros(0, np.int64)
    stale = True
    for i, size in enumerate(sizes.tolist()):
        if stale:
            levels = np.flatnonzero(count)
            stale = False
        fit = levels[: np.searchsorted(levels, capacity - size, "right")]
        # The change of the sum of squares if a pack of level h becomes one of level h + size, or a full one.
        change = np.where(fit + size < capacity, 2 * (count[fit + size] - count[fit]) + 2, 1 - 2 * count[fit])
        new = 2 * count[size] + 1 if size < capacity else 0
        level = 0
        if len(fit):
            best = len(fit) - 1 - int(np.argmin(change[::-1]))  # of equal ones, the fullest
            if change[best] <= new:
                level = int(fit[best])
        if level:
            p = at_level[level].pop()
            count[level] -= 1
            stale |= count[level] == 0
        else:
            p, made = made, made + 1
        pack[i] = p
        if level + size < capacity:
            at_level[level + size].append(p)
            count[level + size] += 1
            stale |= count[level + size] == 1
    return pack


def _pack_groups(items: DataFrame, shards_of: dict[str, int], round_no: int) -> DataFrame:
    """One round: every shard of every capacity packed for itself; pack names tell round and shard.

    ``items`` has pack_name, capacity, item (a text that tells items apart and orders them), tokens, and any columns to keep.
    """
    shards = F.element_at(F.create_map(*[F.lit(x) for name, n in shards_of.items() for x in (name, n)]), F.col("pack_name"))
    placed = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(round_no)), shards).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        # A fixed shuffled order: the method is online and needs no sorting.
        pdf = pdf.assign(order=pd.util.hash_array(pdf["item"].to_numpy(object))).sort_values(["order", "item"])
        number = sum_of_squares(pdf["tokens"].to_numpy(), int(pdf["capacity"].iloc[0]))
        prefix = f"{pdf['pack_name'].iloc[0]}-{round_no}-{pdf['shard'].iloc[0]}-"
        return pdf.drop(columns=["order", "shard"]).assign(pack=[f"{prefix}{n}" for n in number])

    schema = ", ".join(f"{name} {kind}" for name, kind in items.dtypes) + ", pack string"
    spark = items.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(tasks, "pack_name", "shard").groupBy("pack_name", "shard").applyInPandas(pack, schema)


def packed_texts(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, id, copy, part, tokens, pack): where each text, or each part of a longer one, went.

    ``sizes`` has ``id`` bigint and ``tokens``; ``capacities`` has ``pack_name`` and ``capacity_tokens``
    and is a configuration table of a few rows.
    """
    caps = {r["pack_name"]: r["capacity_tokens"] for r in capacities.collect() if r["pack_name"] is not None and (r["capacity_tokens"] or 0) > 0}
    numbered = sizes.filter("tokens > 0").groupBy("id", "tokens").agg(F.count(F.lit(1)).alias("times"))
    upto = F.sum("times").over(Window.partitionBy("id").orderBy("tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    numbered = numbered.select("id", "tokens", upto.alias("upto"), F.col("times").cast("int").alias("times"))
    # Copies are numbered in slices, so that an id of very many rows makes no long array.
    slices = numbered.select("id", "tokens", "upto", F.explode(F.sequence(F.col("upto") - F.col("times") + 1, "upto", F.lit(COPIES_AT_ONCE))).alias("first"))
    numbered = cut_lineage(slices.select("id", "tokens", F.explode(F.sequence("first", F.least(F.col("first") + COPIES_AT_ONCE - 1, "upto"))).alias("copy")))
    if not caps:
        return sizes.sparkSession.createDataFrame([], "pack_name string, id long, copy int, part int, tokens int, pack string")
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(int(c)).alias("capacity")) for n, c in sorted(caps.items())]))
    each = numbered.select("id", "copy", "tokens", kinds.alias("c")).select("id", "copy", "tokens", "c.pack_name", "c.capacity")
    whole = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    rest = (F.col("tokens") % F.col("capacity")).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")).cast("int")), lambda p: F.struct(p.alias("part"), F.when(p <= whole, F.col("capacity")).otherwise(rest).cast("int").alias("size")))
    told = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "copy", "part")
    items = each.select("pack_name", "capacity", "id", "copy", F.inline(parts)).select("pack_name", "capacity", "id", "copy", "part", told.alias("item"), F.col("size").alias("tokens"))
    full = items.filter("tokens = capacity").withColumn("pack", F.concat_ws("-", "pack_name", F.lit("whole"), "item"))
    loose = items.filter("tokens < capacity")

    def shards_for(groups: DataFrame) -> tuple[dict[str, int], int]:
        counts = {r["pack_name"]: r["n"] for r in groups.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {n: max(1, -(-counts.get(n, 0) // SHARD_ITEMS)) for n in caps}, sum(counts.values())

    shards, _ = shards_for(loose)
    state = cut_lineage(_pack_groups(loose, shards, 0))
    before, round_no = None, 0
    while max(shards.values()) > 1 and round_no < MOST_ROUNDS:
        fills = state.groupBy("pack_name", "capacity", "pack").agg(F.sum("tokens").cast("int").alias("fill"))
        open_packs = cut_lineage(fills.filter(F.col("fill") < F.col("capacity") * FULL_ENOUGH).select("pack_name", "capacity", F.col("pack").alias("item"), F.col("fill").alias("tokens")))
        shards, now = shards_for(open_packs)
        if before is not None and now > 0.95 * before:
            break  # what is left does not fit together
        before, round_no = now, round_no + 1
        merged = _pack_groups(open_packs, shards, round_no).select("pack_name", F.col("item").alias("pack"), F.col("pack").alias("new_pack"))
        state = cut_lineage(state.join(merged, ["pack_name", "pack"], "left").select("pack_name", "capacity", "id", "copy", "part", "tokens", F.coalesce("new_pack", "pack").alias("pack")))
    columns = ["pack_name", "id", "copy", "part", "tokens", "pack"]
    return state.select(*columns).unionByName(full.select(*columns))


def pack_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, packs, tokens, filled): how much of the opened room is used."""
    used = packed.groupBy("pack_name").agg(F.countDistinct("pack").alias("packs"), F.sum("tokens").alias("tokens"))
    met = used.join(capacities.select("pack_name", "capacity_tokens"), "pack_name")
    return met.select("pack_name", "packs", "tokens", F.round(F.col("tokens") / (F.col("packs") * F.col("capacity_tokens")), 6).alias("filled"))
