"""Mixing sources to target shares of all tokens, small ones repeated a capped number of times.

Budgets come from a tree (domain, language, source): weights add up from the leaves, the total budget
flows down from the root, and at each node children that can't use their part pass it to their
siblings by weight; only what a whole node can't use reaches its parent's other children.  A source's
target is divided among its leaves by the tokens it holds in each language, so its leaves add up to the
target unless the source as a whole is short.  Each leaf then takes its budget as a token prefix of
seeded epochs: whole epochs first, then the beginning of one more in that epoch's own order.

The tree has one leaf for each (language, source) and is planned on the driver; texts never leave the
executors.  A prefix is found by a histogram over hash buckets and the exact order inside the one
bucket where the budget ends, so a leaf may hold any share of the texts.  The sizes are kept once in the
shared checkpoint folder, as every step reads them and counting tokens is what costs most.

Defined results: a source without a target, or with a NULL source, is not used; a target without texts
is reported with share 0; texts without tokens are not used; repeated ids count as texts of their own
with the same order (ties by id); NULL or non-positive repeats or shares mean the source is not used; an
empty table gives no selection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmurline.session import cut_lineage

BUCKETS = 1 << 14


@dataclass
class Node:
    """A part of the tree; leaves have the tokens they hold and how often these may be used."""

    name: tuple[str, ...]
    weight: float = 0.0
    room: int = 0
    children: dict[str, Node] = field(default_factory=dict)


def plan(leaves: dict[tuple[str, ...], tuple[float, int]], total: int) -> dict[tuple[str, ...], int]:
    """Budget of each leaf, from its (weight, room), for ``total`` tokens at most."""
    root = Node(())
    for path, (weight, room) in sorted(leaves.items()):
        node = root
        for depth in range(len(path) + 1):
            node.weight += weight
            node.room += room
            if depth < len(path):
                node = node.children.setdefault(path[depth], Node(path[: depth + 1]))
    budgets: dict[tuple[str, ...], int] = {}

    def share(node: Node, budget: int) -> None:
        if not node.children:
            budgets[node.name] = min(budget, node.room)
            return
        given = _fill(list(node.children.values()), min(budget, node.room))
        for child, part in zip(node.children.values(), given):
            share(child, part)

    share(root, total)
    return budgets


def _fill(children: list[Node], budget: int) -> list[int]:
    """``budget`` by weight, no child beyond its room; what one can't use goes to the others by weight."""
    given = [0.0] * len(children)
    open_ = [i for i, c in enumerate(children) if c.weight > 0 and c.room > 0]
    left = float(budget)
    while open_ and left > 1e-6:
        weight = sum(children[i].weight for i in open_)
        parts = {i: left * children[i].weight / weight for i in open_}
        full = [i for i in open_ if given[i] + parts[i] >= children[i].room]
        for i in full or open_:
            part = min(parts[i], children[i].room - given[i])
            given[i] += part
            left -= part
        open_ = [i for i in open_ if i not in full] if full else []
    return [int(g + 1e-6) for g in given]


def _reachable_total(goals: dict[str, tuple[float, int]], held: dict[str, int], smallest: float) -> int:
    """The size at which all sources reach their targets but the short ones, which give all they may."""
    everything = sum(held.values())
    room = {s: held.get(s, 0) * repeats for s, (_, repeats) in goals.items()}
    kept = [s for s, (share, _) in goals.items() if room[s] / share >= smallest * everything and room[s] > 0]
    if not kept:
        return everything
    weight = sum(goals[s][0] for s in kept)
    return int(min(room[s] * weight / goals[s][0] for s in kept)) + sum(room[s] for s in goals if s not in kept)


def language_code(lang: Column) -> Column:
    """Two-letter code of a language tag; anything else is ``und``."""
    code = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2})(?:[-_].*)?\s*$", 1))
    return F.when(F.length(code) == 2, code).otherwise(F.lit("und"))


def mixed_selection(sizes: DataFrame, targets: DataFrame, domains: dict[str, str], total: int | None = None, smallest: float = 0.5, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The selection (id, source, tokens, uses) and the report by source.

    ``sizes`` has id, source, lang and tokens; ``targets`` has source, target_share and max_repeats, one row
    for each source.  ``total`` is the wanted number of tokens; by default the largest at which every source
    reaches its target, except sources that would shrink the mixture below ``smallest`` of all tokens held:
    these are used as often as they may be, and their shortage is passed on.
    """
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect() if r["source"] is not None and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    rows = sizes.select("id", "source", language_code(F.col("lang")).alias("lang"), F.col("tokens").cast("long").alias("tokens")).filter(F.col("source").isin(list(goals)) & (F.col("tokens") > 0))
    rows = cut_lineage(rows)
    held = {(r["source"], r["lang"]): r["tokens"] for r in rows.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()}
    by_source: dict[str, int] = {}
    for (source, _), tokens in held.items():
        by_source[source] = by_source.get(source, 0) + tokens
    leaves = {(domains.get(s, "other"), lang, s): (goals[s][0] * tokens / by_source[s], tokens * goals[s][1]) for (s, lang), tokens in held.items()}
    wanted = _reachable_total(goals, by_source, smallest) if total is None else total
    budgets = {(source, lang): b for (_, lang, source), b in plan(leaves, wanted).items()} if leaves else {}

    spark = sizes.sparkSession
    table = [(s, lang, held[s, lang] and budgets[s, lang] // held[s, lang], budgets[s, lang] % held[s, lang]) for s, lang in sorted(budgets)]
    leaf = spark.createDataFrame(table, "source string, lang string, epochs long, rest long")
    # One row a leaf, that is at most (sources with a target) x 677 language codes.
    order = F.xxhash64(F.lit(seed), "epochs", "id")
    placed = rows.join(F.broadcast(leaf), ["source", "lang"]).withColumn("order", order).withColumn("bucket", F.shiftright(F.col("order"), 50))
    buckets = placed.groupBy("source", "lang", "rest", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    upto = F.sum("in_bucket").over(Window.partitionBy("source", "lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The budget ends inside the first bucket that passes it: one row a leaf, as the rest is less than the leaf holds.
    passed = buckets.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
    edges = passed.groupBy("source", "lang").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("below"))).alias("e")).select("source", "lang", F.col("e.bucket").alias("edge"), F.col("e.below").alias("below"))
    met = placed.join(F.broadcast(edges), ["source", "lang"])
    running = F.sum("tokens").over(Window.partitionBy("source", "lang").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Only the rows of the edge buckets are put in order, about one in BUCKETS.
    edge = met.filter(F.col("bucket") == F.col("edge")).withColumn("taken", F.when(F.col("below") + running <= F.col("rest"), 1).otherwise(0))
    others = met.filter(F.col("bucket") != F.col("edge")).withColumn("taken", F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0))
    used = others.unionByName(edge).select("id", "source", "tokens", (F.col("epochs") + F.col("taken")).cast("int").alias("uses"))
    selection = used.filter("uses > 0")

    wanted_shares = spark.createDataFrame([(s, w, m, by_source.get(s, 0)) for s, (w, m) in sorted(goals.items())], "source string, target_share double, max_repeats int, held_tokens long")
    reached = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"), F.count(F.lit(1)).alias("texts"))
    whole = Window.partitionBy()
    report = wanted_shares.join(reached, "source", "left").fillna(0, ["used_tokens", "most_uses", "texts"])
    report = report.withColumn("actual_share", F.round(F.coalesce(F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(whole), F.lit(0)), F.lit(0.0)), 6))
    return selection, report.select("source", "target_share", "actual_share", "max_repeats", "most_uses", "held_tokens", "used_tokens", "texts")
