"""Topic fits behind a seam: any fitter gives (document_id, topic_id, probability); versions are appended, never changed.

The fitter here starts from more spherical k-means centres than topics can be, merges centres that lie close together,
leaves documents far from every centre and topics of too few documents unassigned, and numbers the rest by size.  So the
number of topics follows the corpus and outliers belong to none, as with a density-based method, whose clusters it does
not claim to reproduce.  Keywords are class-based TF-IDF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmurline.session import cut_lineage

MIN_DOCUMENTS = 50  # a corpus below this is not fitted
MIN_TOPIC = 5  # documents of a topic
MOST_CENTRES, MERGED_AT, LEAST_SIMILARITY = 200, 0.85, 0.2
# Words that say nothing about a topic: a parameter of the keywords.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each "
    "few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our "
    "out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with would you your".split()
)


def kmeans_centres(vectors: DataFrame, centres: int, seed: int = 42) -> list[list[float]]:
    """Unit centres of (document_id, unit vector) by spherical k-means; the driver holds the centres only."""
    held = vectors.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=centres, seed=seed, maxIter=10, distanceMeasure="cosine").fit(held)
    return [[float(x) for x in c / max(float((c * c).sum()) ** 0.5, 1e-12)] for c in model.clusterCenters()]


def merged_centres(centres: list[list[float]], at: float) -> list[int]:
    """For each centre the smallest number of the centres it is chained to by similarities of ``at`` or more."""
    x = np.array(centres)
    close = x @ x.T >= at
    group = list(range(len(centres)))
    for i in range(len(centres)):
        for j in np.flatnonzero(close[i, :i]):
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    return group


def centre_fit(vectors: DataFrame, centres: int | None = None, least_similarity: float = LEAST_SIMILARITY, merged_at: float = MERGED_AT, least: int = MIN_TOPIC, seed: int = 42) -> DataFrame | None:
    """(document_id, topic_id, probability) of assigned documents; None for a corpus below ``MIN_DOCUMENTS``.

    ``vectors`` has document_id and a unit ``vector``.  ``centres`` is how many k-means starts with: by default the root of half
    the number of documents, ``MOST_CENTRES`` at most, which bounds what the driver and each task hold.
    """
    count = vectors.count()
    if count < MIN_DOCUMENTS:
        return None
    found = kmeans_centres(vectors, centres or max(2, min(MOST_CENTRES, int((count / 2) ** 0.5))), seed)
    group = merged_centres(found, merged_at)
    number = lambda i: F.element_at(F.array(*[F.lit(g) for g in group]), i)
    held = np.array(found, np.float32)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sims = np.stack(pdf["vector"].to_list()).astype(np.float32) @ held.T if len(pdf) else np.zeros((0, len(held)), np.float32)
            odds = np.exp(10.0 * sims)
            best = sims.argmax(axis=1) if len(pdf) else np.zeros(0, int)
            yield pd.DataFrame({"document_id": pdf["document_id"], "centre": best + 1, "similarity": sims.max(axis=1) if len(pdf) else [], "probability": odds.max(axis=1) / odds.sum(axis=1) if len(pdf) else []})

    near = vectors.select("document_id", F.col("vector").cast("array<float>").alias("vector")).mapInPandas(compare, "document_id long, centre int, similarity double, probability double")
    near = cut_lineage(near.filter(F.col("similarity") >= least_similarity).select("document_id", number(F.col("centre")).alias("first"), "probability"))
    sizes = near.groupBy("first").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    numbered = sizes.select("first", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "first")) - 1).cast("int").alias("topic_id"))
    # At most MOST_CENTRES rows.
    return near.join(F.broadcast(numbered), "first").select("document_id", "topic_id", "probability")


def class_keywords(documents: DataFrame, assignments: DataFrame, top: int = 10, stop: tuple[str, ...] = STOP_WORDS, version: str | None = None) -> DataFrame:
    """(topic_id, keyword, weight, place): the ``top`` words of each topic by tf * ln(1 + A / f).

    ``documents`` has document_id and text; A is the mean number of words of a topic, f a word's count over all.
    With ``version``, a column of ``assignments``, it comes first in the result and each version is weighed on its own.
    """
    of = [version] if version else []
    words = documents.select("document_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}][\p{L}\p{N}_]+)"))).alias("keyword")).filter(~F.col("keyword").isin(*stop))
    tf = words.join(assignments.select("document_id", "topic_id", *of), "document_id").groupBy(*of, "topic_id", "keyword").agg(F.count(F.lit(1)).alias("tf"))
    f = F.sum("tf").over(Window.partitionBy(*of, "keyword"))  # a row for each topic that has the word
    size = tf.groupBy(*of).agg((F.sum("tf") / F.countDistinct("topic_id")).alias("mean")).withColumn("k", F.lit(1))
    weight = tf.withColumn("f", f).withColumn("k", F.lit(1)).join(F.broadcast(size), [*of, "k"]).withColumn("weight", F.col("tf") * F.log1p(F.col("mean") / F.col("f")))  # one row a version
    order = Window.partitionBy(*of, "topic_id").orderBy(F.round("weight", 9).desc(), "keyword")
    return weight.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select(*of, "topic_id", "keyword", "weight", "place")


def version_name(prefix: str, at: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def latest_version(topics: DataFrame) -> DataFrame:
    """One row: the version of the latest topic by (created_at, id)."""
    return topics.agg(F.max_by("topic_model_version", F.struct("created_at", "id")).alias("version"))


def topics_of_version(topics: DataFrame, version: str) -> DataFrame:
    """The topics of one version, by id."""
    return topics.filter(F.col("topic_model_version") == version).orderBy("id")
