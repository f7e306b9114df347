"""The configuration that stages read on the driver: the universe of entities and the feeds, as YAML or JSON."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

UNIVERSE = "ticker string, name string, sector string, aliases array<string>"


@lru_cache(maxsize=16)
def read_config(path: str) -> dict:
    """The mapping in a file, read once; an empty file is an empty mapping."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text or "{}")
    try:
        import yaml
    except ImportError as problem:
        raise RuntimeError(f"{path} needs a YAML reader; give the same content as JSON") from problem
    return yaml.safe_load(text) or {}


def universe(spark: SparkSession, path: str) -> DataFrame:
    """The configured entities (ticker, name, sector, aliases), whatever else their entries hold."""
    rows = [(e.get("ticker"), e.get("name"), e.get("sector"), [str(a) for a in e.get("aliases") or []]) for e in read_config(path).get("entities") or []]
    return spark.createDataFrame([r for r in rows if r[0]], UNIVERSE)


def feeds(path: str, kind: str = "rss") -> list[str]:
    """The addresses of the configured feeds of a kind, in their order; each is a text or has a ``url``."""
    listed = read_config(path).get(kind) or {}
    listed = listed.get("feeds") or [] if isinstance(listed, dict) else listed
    return [f["url"] if isinstance(f, dict) else str(f) for f in listed]
