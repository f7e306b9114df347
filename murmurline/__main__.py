"""Queries and stages from the command line.

    python -m murmurline                                lists the queries and stages
    python -m murmurline QUERY TABLES [OUT]             shows a query's rows, or writes them to OUT
    python -m murmurline stage STAGE FOLDER [OPTION=VALUE ...]

Stages work on a folder of tables.  Options: now (a UTC time, by default the present), all=1 (not only what is new), model
(of the embeddings for ``topics``, of the sentiment for ``panel``), as_of (the day a panel run stands on), rebuild=1.
The models of ``enrich`` are the stand-ins of :mod:`murmurline.operators.enrich`.
"""

from __future__ import annotations

import sys
from datetime import datetime, timezone

from murmurline.session import build_session

SENTIMENT, EMBEDDING = "keywords", "hashed"


def core_queries() -> dict:
    """The queries of the core by name; the subpackage beside it has a command of its own."""
    from murmurline.queries import panel, problems, stages, store

    return {n: q for m in (panel, store, stages, problems) for n, q in m.QUERIES.items()}


def stages() -> dict:
    """Each stage as a function of (spark, folder, options)."""
    from murmurline.operators import enrich
    from murmurline.plans import pipeline as p

    models = p.Models(SENTIMENT, enrich.keyword_sentiment, EMBEDDING, enrich.hashed_embedding)
    return {
        "resolve": lambda s, f, o: p.resolve_stage(s, f, o["now"], "all" in o),
        "enrich": lambda s, f, o: p.enrich_stage(s, f, o["now"], models, "all" in o),
        "topics": lambda s, f, o: p.topics_stage(s, f, o["now"], o.get("model", EMBEDDING)),
        "panel": lambda s, f, o: p.panel_stage(s, f, o.get("as_of", o["now"][:10]), o["now"], o.get("model", SENTIMENT), "rebuild" in o),
        "quality": lambda s, f, o: "failed" if p.quality_stage(s, f, o["now"]) else "passed",
    }


def main(arguments: list[str], queries: dict | None = None) -> int:
    queries = core_queries() if queries is None else queries
    if not arguments:
        print("queries:", *sorted(queries), sep="\n  ")
        print("stages:", *stages(), sep="\n  ")
        return 0
    spark = build_session("local[*]", "murmurline")
    spark.sparkContext.setLogLevel("ERROR")
    if arguments[0] == "stage":
        options = {"now": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")} | dict(a.split("=", 1) for a in arguments[3:])
        result = stages()[arguments[1]](spark, arguments[2], options)
        print(arguments[1], result)
        return 1 if result == "failed" else 0
    rows = queries[arguments[0]](spark, arguments[1])
    if len(arguments) > 2:
        rows.write.mode("overwrite").parquet(arguments[2])
    else:
        rows.show(30, False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
