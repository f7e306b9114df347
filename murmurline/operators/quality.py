"""Data-quality checks: each is one aggregate that gives (check_name, source_name, status, value, threshold, details).

The clock is a parameter (``now``); statuses are fail before warn before pass, with strict comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmurline.operators.near_duplicates import classes, extra_documents, similar_classes
from murmurline.session import cut_lineage

RESULT = ["check_name", "source_name", "status", "value", "threshold", "details"]
DUPLICATES_SCANNED, DUPLICATES_WARN, DUPLICATES_FAIL, EVIDENCE = 1000, 0.01, 0.02, 10
FRESH_WARN_HOURS, FRESH_FAIL_HOURS = 26.0, 48.0
RUNS_COMPARED, LEAST_RUNS, LOW_VOLUME = 10, 3, 0.5
ENOUGH, MOST_BACKLOG, LATE_PANEL_DAYS = 100, 0.5, 2


def _row(df: DataFrame, name: str, source: Column, status: Column, value: Column, threshold: Column, **details: Column) -> DataFrame:
    """The result row; ``details`` is a JSON object without its NULL entries."""
    packed = F.to_json(F.struct(*[c.alias(k) for k, c in details.items()])) if details else F.lit("{}")
    return df.select(F.lit(name).alias("check_name"), source.cast("string").alias("source_name"), status.alias("status"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"), packed.alias("details"))


def _ladder(fail: Column, warn: Column) -> Column:
    return F.when(fail, "fail").when(warn, "warn").otherwise("pass")


def duplicate_rate(documents: DataFrame, key: str, title: str, scanned: int | None = DUPLICATES_SCANNED) -> DataFrame:
    """Share of near-duplicate titles among the most recent ``scanned`` documents (a report on recent rows); None: among all.

    The evidence is the first ``EVIDENCE`` pairs by id, of a copy and its class or of two similar classes.
    """
    recent = documents.select(F.col(key).alias("id"), F.col(title).alias("title"))
    recent = recent if scanned is None else recent.orderBy(F.col("id").desc()).limit(scanned)
    members = cut_lineage(classes(recent, "id", "title"))
    pairs = cut_lineage(similar_classes(members))
    extras = extra_documents(members, pairs)
    linked = members.filter("id <> class_id").select(F.col("class_id").alias("id_a"), F.col("id").alias("id_b")).unionByName(pairs.select("id_a", "id_b"))
    first = linked.orderBy("id_a", "id_b").limit(EVIDENCE).agg(F.array_sort(F.collect_list(F.array("id_a", "id_b"))).alias("pairs"))
    one = lambda df: df.withColumn("k", F.lit(1))  # noqa: E731 - three rows of one meet
    counts = one(recent.agg(F.count(F.lit(1)).alias("scanned"))).join(one(extras.agg(F.count(F.lit(1)).alias("extras"))), "k").join(one(first), "k")
    rate = F.coalesce(F.col("extras") / F.nullif(F.col("scanned"), F.lit(0)), F.lit(0.0))
    return _row(counts, "duplicate_rate", F.lit(None), _ladder(rate > DUPLICATES_FAIL, rate > DUPLICATES_WARN), F.bround(rate, 6), F.lit(DUPLICATES_FAIL), window=F.col("scanned"), pairs=F.col("pairs"))


def freshness(sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Hours since each source's latest successful run ended; a source without one, or whose run has no end, fails."""
    last = runs.filter("status = 'success'").groupBy("source_id").agg(F.max_by("finished_at", F.struct("started_at", "id")).alias("last"))
    met = sources.join(last, sources["id"] == last["source_id"], "left")
    hours = (F.unix_micros(now) - F.unix_micros("last")) / 3.6e9
    reason = F.when(F.col("last").isNull(), "no successful run recorded")
    return _row(met, "freshness", F.col("name"), _ladder(F.col("last").isNull() | (hours > FRESH_FAIL_HOURS), hours > FRESH_WARN_HOURS), F.bround(hours, 2), F.lit(FRESH_FAIL_HOURS), reason=reason)


def volume_anomaly(sources: DataFrame, runs: DataFrame, compared: int = RUNS_COMPARED) -> DataFrame:
    """The latest successful run's rows against the mean of the runs before it, at most ``compared - 1``."""
    order = Window.partitionBy("source_id").orderBy(F.col("started_at").desc(), F.col("id").desc())
    latest = runs.filter("status = 'success'").select("source_id", "rows_fetched", F.row_number().over(order).alias("n")).filter(F.col("n") <= compared)
    grouped = latest.groupBy("source_id").agg(F.max(F.when(F.col("n") == 1, F.col("rows_fetched"))).alias("now_rows"), F.avg(F.when(F.col("n") > 1, F.col("rows_fetched"))).alias("mean"), F.count(F.lit(1)).alias("runs"))
    met = sources.join(grouped, sources["id"] == grouped["source_id"], "left")
    runs_known = F.coalesce("runs", F.lit(0))
    enough = runs_known >= LEAST_RUNS
    ratio = F.when(F.col("mean") == 0, 1.0).otherwise(F.col("now_rows") / F.col("mean"))
    status = F.when(~enough, "pass").otherwise(_ladder((ratio == 0) & (F.col("mean") > 0), ratio < LOW_VOLUME))
    details = {"reason": F.when(~enough, "insufficient history"), "runs": F.when(~enough, runs_known), "latest": F.when(enough, F.col("now_rows")), "trailing_mean": F.when(enough, F.bround("mean", 2))}
    return _row(met, "volume_anomaly", F.col("name"), status, F.when(enough, F.bround(ratio, 4)), F.lit(LOW_VOLUME), **details)


def resolution_coverage(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Share of resolved documents that have a link."""
    linked = links.select("document_id").distinct().withColumn("linked", F.lit(1))
    counts = documents.join(linked, documents["id"] == linked["document_id"], "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("resolved_at").isNotNull()).alias("resolved"), F.count("linked").alias("with_links"))
    value = F.coalesce(F.col("with_links") / F.nullif(F.col("resolved"), F.lit(0)), F.lit(0.0))
    warn = (F.col("resolved") >= ENOUGH) & (F.col("with_links") == 0)
    return _row(counts, "resolution_coverage", F.lit(None), _ladder(F.lit(False), warn), F.bround(value, 4), F.lit(None), total=F.col("total"), unresolved=F.col("total") - F.col("resolved"), with_links=F.col("with_links"))


def enrichment_coverage(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """Share of documents that are enriched; warns without any score or with a large backlog."""
    with_score = scored.select("document_id").distinct().withColumn("scored", F.lit(1))
    counts = documents.join(with_score, documents["id"] == with_score["document_id"], "left").agg(F.count(F.lit(1)).alias("total"), F.count("enriched_at").alias("enriched"), F.count("scored").alias("scored"))
    value = F.coalesce(F.col("enriched") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    warn = ((F.col("enriched") >= ENOUGH) & (F.col("scored") == 0)) | ((F.col("total") >= ENOUGH) & (1 - value > MOST_BACKLOG))
    return _row(counts, "enrichment_coverage", F.lit(None), _ladder(F.lit(False), warn), F.bround(value, 4), F.lit(None), total=F.col("total"), unenriched=F.col("total") - F.col("enriched"), with_sentiment=F.col("scored"))


def panel_freshness(panel: DataFrame, links: DataFrame, today: str) -> DataFrame:
    """Days the panel is behind yesterday; without a panel it warns once enough documents are linked."""
    counts = panel.agg(F.max("date").alias("latest")).withColumn("k", F.lit(1)).join(links.agg(F.countDistinct("document_id").alias("linked")).withColumn("k", F.lit(1)), "k")
    lag = F.datediff(F.to_date(F.lit(today)), F.col("latest")) - 1
    warn = F.when(F.col("latest").isNull(), F.col("linked") >= ENOUGH).otherwise(lag >= LATE_PANEL_DAYS)
    return _row(counts, "panel_freshness", F.lit(None), _ladder(F.lit(False), warn), lag, F.lit(LATE_PANEL_DAYS), reason=F.when(F.col("latest").isNull(), "no panel rows"), latest_day=F.col("latest").cast("string"), linked_documents=F.col("linked"))


def all_checks(*results: DataFrame) -> DataFrame:
    """The rows of all checks."""
    out = results[0].select(RESULT)
    for r in results[1:]:
        out = out.unionByName(r.select(RESULT))
    return out


def any_failure(results: DataFrame) -> bool:
    return not results.filter("status = 'fail'").isEmpty()
