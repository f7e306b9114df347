"""Raw records: readers of feeds, stories, bars and the raw lake, and their mapping to canonical rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmurline.functions.text import content_hash, feed_time, number, strip_html, whole_number
from murmurline.schemas import RAW

RSS_ITEM = "title string, description string, link string, pubDate string, updated string"


def read_rss(spark: SparkSession, paths: list[str], target: int | None = None, failed: list[str] | None = None) -> DataFrame:
    """Feed files as RSS records: of one link the first in feed order; items without a link all stay.

    A date that can be read becomes ISO in UTC, the publication before the update; else the text stays.  A feed that
    can't be read is left out and named in ``failed``; the other feeds don't notice.
    """
    frames = []
    for feed_no, path in enumerate(paths):
        try:
            items = spark.read.schema(RSS_ITEM).option("rowTag", "item").xml(path)
        except AnalysisException:  # the path is gone; broken items are handled by the reader itself
            if failed is not None:
                failed.append(path)
            continue
        frames.append(items.withColumns({"feed_no": F.lit(feed_no), "source": F.lit(path.rsplit("/", 1)[-1].rsplit(".", 1)[0])}))
    if not frames:
        return spark.createDataFrame([], RAW["rss"] + ", feed_no int")
    items = frames[0]
    for f in frames[1:]:
        items = items.unionByName(f)
    known = F.date_format(F.coalesce(feed_time(F.col("pubDate")), feed_time(F.col("updated"))), "yyyy-MM-dd'T'HH:mm:ssXXX")
    records = items.select("title", strip_html(F.col("description")).alias("summary"), F.col("link").alias("url"), F.coalesce(known, "pubDate", "updated").alias("published_date"), "source", "feed_no")
    return first_of_links(records, "url", [F.col("feed_no"), F.col("title"), F.col("published_date")], target)


def first_of_links(records: DataFrame, link: str, order: list[Column], target: int | None = None) -> DataFrame:
    """Of each link the first record by ``order``; records without a link are all kept; ``target`` stops early.

    Records without a link, however many, take no part in the shuffle by link.
    """
    first = Window.partitionBy(link).orderBy(*order)
    named = records.filter(F.col(link).isNotNull()).withColumn("rn__", F.row_number().over(first)).filter("rn__ = 1").drop("rn__")
    kept = named.unionByName(records.filter(F.col(link).isNull()))
    return kept if target is None else kept.orderBy(*order).limit(target)


def read_jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Gzip or plain JSON lines of the raw lake under the schema of ``kind``; blank lines are skipped."""
    return spark.read.schema(RAW[kind]).json(path)


def read_labels(spark: SparkSession, path: str, schema: str, label: str | None = None, domain: tuple[str, ...] = ()) -> DataFrame:
    """A labelled sample; a label outside ``domain`` is an error."""
    df = spark.read.schema(schema).json(path)
    if label is None:
        return df
    return df.withColumn(label, F.when(F.col(label).isin(*domain), F.col(label)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.col(label)))))


def long_bars(wide: DataFrame, tickers: list[str], fields: tuple[str, ...] = ("open", "high", "low", "close", "adj_close", "volume")) -> DataFrame:
    """A frame with one column for each (field, ticker), named ``field|ticker``, as one row for each (ticker, date).

    Rows without a close are left out.
    """
    rows = [F.struct(F.lit(t).alias("ticker"), *[number(F.col(f"`{f}|{t}`")).alias(f) if f"{f}|{t}" in wide.columns else F.lit(None).cast("double").alias(f) for f in fields]) for t in tickers]
    long = wide.select("date", F.inline(F.array(*rows)))
    return long.filter("close IS NOT NULL").withColumn("volume", whole_number(F.col("volume")))


def top_per_term(records: DataFrame, per_term: int = 20) -> DataFrame:
    """Metadata records by search term: each reference under its first term only, then at most ``per_term`` of a term.

    ``records`` has ref, term_no (the order of terms) and position (the rank within its term).
    """
    once = records.withColumn("a__", F.row_number().over(Window.partitionBy("ref").orderBy("term_no", "position"))).filter("a__ = 1")
    return once.withColumn("b__", F.row_number().over(Window.partitionBy("term_no").orderBy("position", "ref"))).filter(F.col("b__") <= per_term).drop("a__", "b__")


def rss_documents(raw: DataFrame, source_id: int, ingested_at: Column, published: Column | None = None) -> DataFrame:
    """Canonical documents of RSS records."""
    return raw.select(F.lit(source_id).alias("source_id"), F.col("url").alias("external_id"), "url", F.lit(None).cast("string").alias("author"), "title", F.col("summary").alias("raw_text"), F.lit(None).cast("string").alias("lang"),
                      content_hash(F.lit("rss"), F.col("url"), F.col("title"), F.col("summary")).alias("content_hash"), (feed_time(F.col("published_date")) if published is None else published).alias("published_at"), ingested_at.alias("ingested_at"), F.to_json(F.struct(F.col("source").alias("feed"))).alias("engagement"))


def hn_documents(raw: DataFrame, source_id: int, ingested_at: Column) -> DataFrame:
    """Canonical documents of stories; their scores are engagement and never hashed."""
    return raw.select(F.lit(source_id).alias("source_id"), F.col("id").cast("string").alias("external_id"), "url", "author", "title", F.lit(None).cast("string").alias("raw_text"), F.lit(None).cast("string").alias("lang"),
                      content_hash(F.lit("hackernews"), F.col("id").cast("string"), F.col("title"), F.lit(None).cast("string")).alias("content_hash"), F.timestamp_seconds("timestamp").alias("published_at"), ingested_at.alias("ingested_at"), F.to_json(F.struct("score", F.coalesce("comments", F.lit(0)).alias("comments"))).alias("engagement"))


def bars_of_entities(raw: DataFrame, entities: DataFrame, day: Column, ingested_at: Column) -> tuple[DataFrame, DataFrame]:
    """Bars by entity id, and the tickers that no entity has (reported, never created); inactive entities count."""
    known = raw.join(entities.select("ticker", F.col("id").alias("entity_id")), "ticker")
    numbers = [number(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "adj_close")]
    bars = known.select("entity_id", day.alias("date"), *numbers, whole_number(F.col("volume")).alias("volume"), ingested_at.alias("ingested_at"))
    return bars, raw.join(entities.select("ticker"), "ticker", "left_anti").select("ticker").distinct()
