"""Near-duplicate texts by the Jaccard similarity of their token sets, exactly.

Texts with equal token sets are one class, which its smallest id represents; only representatives are
compared.  Two sets at similarity t or more share a token among the rarest ``size - ceil(t * size) + 1``
of each (prefix filter), so only these are joined, and only sets whose sizes can be that similar: sizes
fall into bands, and the smaller set looks into its own band and the next.  A frequent token is thereby
split by size, and what still meets must agree in size and in what can follow the shared token's place
in both (positional filter), before the exact similarity is computed from the sets.  No link between
different texts is lost, and copies are not expanded into pairs.

Defined results: NULL texts and texts with fewer than ``least`` tokens take no part; repeated ids count
once, by the set of the smallest hash; ties in token frequency are settled by the token; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurline.functions.text import tokens
from murmurline.session import cut_lineage


def classes(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(id, class_id, tokens): texts with at least ``least`` tokens, the smallest id with the same token set, and the class's set beside that id."""
    sets = df.select(F.col(key).alias("id"), F.array_sort(tokens(F.col(text))).alias("tokens")).filter(F.size("tokens") >= least)
    hashed = sets.withColumn("set_hash", F.sha2(F.array_join("tokens", " "), 256))
    # Kept without the sets: equal sets are told by their hash, and one of each class is enough.
    slim = cut_lineage(hashed.groupBy("id").agg(F.min("set_hash").alias("set_hash")))
    smallest = cut_lineage(slim.groupBy("set_hash").agg(F.min("id").alias("class_id")))
    members = slim.join(smallest, "set_hash").select("id", "class_id")
    of_first = hashed.join(smallest.select(F.col("class_id").alias("id"), "set_hash"), ["id", "set_hash"], "left_semi").dropDuplicates(["id"]).select("id", "tokens")
    return members.join(of_first, "id", "left").select("id", "class_id", "tokens")


def similar_classes(members: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id_a, id_b, similarity), a < b: pairs of class representatives at ``threshold`` or more."""
    # The sets are read for the prefixes and once for either side of the candidates.
    reps = cut_lineage(members.filter("id = class_id").select("id", "tokens", F.size("tokens").alias("n")))
    # Tokens travel as hashes; two tokens with one hash only make more candidates.
    words = reps.select("id", "n", F.explode(F.transform("tokens", lambda w: F.xxhash64(w))).alias("token"))
    frequency = words.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # Two words of 64 bits say which tokens may be there.
    bit = F.pmod("token", F.lit(128))
    marks = [F.bit_or(F.when((bit >= low) & (bit < low + 64), F.expr(f"shiftleft(1L, cast(pmod(token, 128) as int) - {low})")).otherwise(F.lit(0).cast("long"))).alias(name) for name, low in (("m0", 0), ("m1", 64))]
    ordered = words.join(frequency, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"), *marks)
    length = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9).cast("int")
    prefix = ordered.select("id", "n", "m0", "m1", band.alias("band"), F.posexplode(F.slice("t", F.lit(1), length)).alias("at", "p")).select("id", "n", "m0", "m1", "band", "at", F.col("p.token").alias("token"))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "m0", "m1", "at")]
    # Sizes up to n / threshold lie in the band of n or the next; one more is for rounding at the edge.
    small = prefix.select(*side("s"), "token", F.explode(F.sequence("band", F.col("band") + 2)).alias("band"))
    large = prefix.select(*side("l"), "token", "band")
    other = (F.col("n_s") < F.col("n_l")) | ((F.col("n_s") == F.col("n_l")) & (F.col("id_s") < F.col("id_l")))
    sizes = F.col("n_s") >= F.col("n_l") * threshold - 1e-9
    both = F.col("n_s") + F.col("n_l")
    # At most so many tokens can be shared before the one they meet at, and with and after it.
    reach = F.least(F.col("at_s"), F.col("at_l")) + F.least(F.col("n_s") - F.col("at_s"), F.col("n_l") - F.col("at_l"))
    # Each bit that only one of them has stands for a token that only one of them has.
    apart = F.bit_count(F.col("m0_s").bitwiseXOR(F.col("m0_l"))) + F.bit_count(F.col("m1_s").bitwiseXOR(F.col("m1_l")))
    near = (reach >= threshold / (1 + threshold) * both - 1e-9) & (apart <= (1 - threshold) / (1 + threshold) * both + 1e-9)
    candidates = small.join(large, ["token", "band"]).filter(other & sizes & near).select(F.least("id_s", "id_l").alias("id_a"), F.greatest("id_s", "id_l").alias("id_b")).distinct()
    sets = reps.select("id", "tokens")
    met = candidates.join(sets.select(F.col("id").alias("id_a"), F.col("tokens").alias("t_a")), "id_a").join(sets.select(F.col("id").alias("id_b"), F.col("tokens").alias("t_b")), "id_b")
    shared = F.size(F.array_intersect("t_a", "t_b"))
    similarity = shared / (F.size("t_a") + F.size("t_b") - shared)
    return met.select("id_a", "id_b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)


def duplicate_documents(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, links): every member, its class and how many other classes its class is similar to."""
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return members.select("id", "class_id").join(ends, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def extra_documents(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that are the larger id of some near-duplicate pair: what a duplicate rate counts."""
    copies = members.filter("id <> class_id").select("id")
    # A representative is an extra if a similar class holds a smaller id, that is, a smaller representative.
    larger = pairs.select(F.col("id_b").alias("id"))
    return copies.unionByName(larger).distinct()
