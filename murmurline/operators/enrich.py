"""Enrichment seams: any sentiment or embedding model as a function over batches of texts.

A model is built once in each Python worker, on the first batch that is not empty.  The stand-ins here are
deterministic; trained weights plug in through the same factories.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurline.functions.text import document_text
from murmurline.schemas import EMBEDDING_DIM, LABELS

SentimentModel = Callable[[list[str]], list[tuple[str, float]]]
EmbeddingModel = Callable[[list[str]], np.ndarray]


def score_texts(documents: DataFrame, factory: Callable[[], SentimentModel], model: str, at: Column, batch: int = 32) -> DataFrame:
    """(document_id, model, label, score, scored_at) of documents with any text; an unknown label is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for pdf in batches:
            out: list[tuple[str, float]] = []
            for i in range(0, len(pdf), batch):
                scorer = scorer or factory()
                texts = pdf["text"].iloc[i : i + batch].tolist()
                scored = [(str(label).lower(), float(score)) for label, score in scorer(texts)]
                if len(scored) != len(texts) or any(label not in LABELS for label, _ in scored):
                    raise ValueError("the model's output does not fit its input")
                out.extend(scored)
            yield pd.DataFrame({"document_id": pdf["document_id"], "label": [x[0] for x in out], "score": [x[1] for x in out]})

    texts = documents.select(F.col("id").alias("document_id"), document_text(F.col("title"), F.col("raw_text")).alias("text")).filter("text <> ''")
    return texts.mapInPandas(run, "document_id long, label string, score double").select("document_id", F.lit(model).alias("model"), "label", "score", at.alias("scored_at"))


def embed_texts(documents: DataFrame, factory: Callable[[], EmbeddingModel], model: str, at: Column, dim: int = EMBEDDING_DIM, batch: int = 32) -> DataFrame:
    """(document_id, model, vector, embedded_at): unit vectors; a wrong width is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = None
        for pdf in batches:
            parts = []
            for i in range(0, len(pdf), batch):
                embedder = embedder or factory()
                v = np.asarray(embedder(pdf["text"].iloc[i : i + batch].tolist()), np.float32)
                if v.shape != (min(batch, len(pdf) - i), dim):
                    raise ValueError("the model's output does not fit its input")
                parts.extend(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
            yield pd.DataFrame({"document_id": pdf["document_id"], "vector": [p.tolist() for p in parts]})

    texts = documents.select(F.col("id").alias("document_id"), document_text(F.col("title"), F.col("raw_text")).alias("text")).filter("text <> ''")
    return texts.mapInPandas(run, "document_id long, vector array<float>").select("document_id", F.lit(model).alias("model"), "vector", at.alias("embedded_at"))


def keyword_sentiment(positive: tuple[str, ...] = ("surge",), negative: tuple[str, ...] = ("plunge",)) -> SentimentModel:
    """A stand-in: by keyword, else neutral."""

    def score(texts: list[str]) -> list[tuple[str, float]]:
        return [("positive", 0.9) if any(p in t.lower() for p in positive) else ("negative", 0.8) if any(n in t.lower() for n in negative) else ("neutral", 0.6) for t in texts]

    return score


def hashed_embedding(dim: int = EMBEDDING_DIM) -> EmbeddingModel:
    """A stand-in: word counts hashed into ``dim`` signed places."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
            out[i, 0] += 1e-3
        return out

    return embed


def signed_sentiment(label: Column, score: Column) -> Column:
    """Positive labels count up, negative ones down, neutral 0; unscored stays NULL."""
    return F.when(label.isNull(), F.lit(None)).when(label == "positive", score).when(label == "negative", -score).otherwise(0.0)


def links_view(documents: DataFrame, document_entities: DataFrame, scores: DataFrame, model: str) -> DataFrame:
    """The panel's links: documents with their entities, and the sentiment of one model where there is any."""
    pinned = scores.filter(F.col("model") == model).select("document_id", signed_sentiment(F.col("label"), F.col("score")).alias("sentiment"))
    d = documents.select(F.col("id").alias("document_id"), "ingested_at", "published_at", "engagement")
    met = document_entities.select("document_id", "entity_id", "confidence").join(d, "document_id").join(pinned, "document_id", "left")
    return met.select("document_id", "entity_id", "confidence", "ingested_at", "published_at", "engagement", "sentiment")


def topic_rows_view(documents: DataFrame, document_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """The panel's topic rows of all versions."""
    d = documents.select(F.col("id").alias("document_id"), "ingested_at", "published_at")
    t = topics.select(F.col("id").alias("topic_id"), F.col("topic_model_version").alias("version"))
    return document_topics.join(d, "document_id").join(t, "topic_id").select("document_id", "ingested_at", "published_at", "topic_id", "version", "probability")
