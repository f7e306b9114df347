"""Links from documents to entities, by cash tag, ticker and name, without a documents x entities loop.

The dictionary becomes one row for each phrase.  A text is cut into overlapping pieces, one for each word: the character
before it, the word and as many words behind it as the longest phrase has.  Pieces meet phrases by their first word, or
first two, and a phrase is then compared with the piece's own characters, so no text is copied or fetched again, a
frequent first word alone finds no longer phrase, and the universe may be of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmurline.functions.text import document_text, nfc

# Tickers that are ordinary words and count only with a cash tag.
AMBIGUOUS_TICKERS = (
    "A", "ALL", "AN", "ANY", "ARE", "AT", "BE", "BIG", "BY", "CAN", "CAR", "DD", "DO", "EAT", "FOR",
    "FUN", "GO", "GOOD", "HAS", "HE", "IT", "KEY", "LOVE", "LOW", "MAN", "NEW", "NEXT", "NICE", "NOW",
    "ON", "ONE", "OPEN", "OR", "OUT", "PLAY", "REAL", "RUN", "SEE", "SO", "STAY", "TECH", "TV", "UP",
    "WELL", "YOU",
)
CONFIDENCE = {"cashtag": 1.0, "ticker": 0.9, "alias": 0.8}
#: What an evaluation must reach: the precision of the resolver, the macro-F1 of a sentiment model.
PRECISION_GATE, MACRO_F1_GATE = 0.90, 0.70
WORD, OUTSIDE = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]"


def dictionary(entities: DataFrame, ambiguous: tuple[str, ...] = AMBIGUOUS_TICKERS) -> DataFrame:
    """(entity_id, ticker, method, cased, needle, lead, words, key): what names each active entity, and the words it is found by.

    ``entities`` has id, ticker, name, aliases and active; NULL aliases count as none, phrases without a word are left out.
    ``lead`` counts the characters before the first word.
    """
    e = entities.filter("active")
    tickers = e.filter("ticker IS NOT NULL").select(F.col("id").alias("entity_id"), "ticker", nfc(F.trim("ticker")).alias("phrase"))
    cash = tickers.select("entity_id", "ticker", F.lit("cashtag").alias("method"), "phrase")
    plain = tickers.filter(~F.upper("phrase").isin(list(ambiguous))).select("entity_id", "ticker", F.lit("ticker").alias("method"), "phrase")
    names = e.select(F.col("id").alias("entity_id"), "ticker", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))).alias("phrase"))
    alias = names.select("entity_id", "ticker", F.lit("alias").alias("method"), nfc(F.trim("phrase")).alias("phrase"))
    phrases = cash.unionByName(plain).unionByName(alias).filter(F.length("phrase") > 0)
    cased = F.col("method") == "ticker"
    needle = F.concat(F.when(F.col("method") == "cashtag", "$").otherwise(""), F.when(cased, F.col("phrase")).otherwise(F.lower("phrase")))
    shaped = phrases.select("entity_id", "ticker", "method", cased.alias("cased"), needle.alias("needle")).distinct()
    words = F.regexp_extract_all(F.lower("needle"), F.lit(f"({WORD})"))
    shaped = shaped.select("*", F.length(F.regexp_extract("needle", f"^({OUTSIDE}*)", 1)).alias("lead"), words.alias("w")).filter(F.size("w") > 0)
    return shaped.select("entity_id", "ticker", "method", "cased", "needle", "lead", F.size("w").alias("words"), F.array_join(F.slice("w", 1, 2), " ").alias("key"))


def resolve(documents: DataFrame, phrases: DataFrame) -> DataFrame:
    """(document_id, entity_id, confidence, method): the strongest match of each entity in each document.

    ``documents`` has id, title and raw_text.  Texts without content have no links; a phrase counts where no letter, digit or
    underscore touches it.
    """
    # A word in front makes the start of the text a place like any other.
    texts = documents.select(F.col("id").alias("document_id"), F.concat(F.lit("x "), nfc(document_text(F.col("title"), F.col("raw_text"), " \n "))).alias("text")).filter(F.length("text") > 2)
    # Phrases of up to 4, 16, 64, ... words are looked for apart, so that one long name makes no long pieces for the others.
    size = F.greatest(F.lit(1), F.ceil(F.round(F.log(4.0, "words"), 9))).cast("int")
    sized = phrases.withColumn("size", size)
    sizes = {r["size"]: r["longest"] for r in sized.groupBy("size").agg(F.max("words").alias("longest")).collect()}
    found = [_places(texts, sized.filter(F.col("size") == n).drop("size"), longest) for n, longest in sorted(sizes.items())] or [_places(texts, phrases, 1)]
    met = found[0]
    for more in found[1:]:
        met = met.unionByName(more)
    strength = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("method"))
    best = met.groupBy("document_id", "entity_id").agg(F.max(F.struct(strength.alias("confidence"), "method")).alias("m"))
    return best.select("document_id", "entity_id", "m.confidence", "m.method")


def _places(texts: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """(document_id, entity_id, method): where a phrase of at most ``longest`` words stands in a text."""
    pieces = F.regexp_extract_all("text", F.lit(rf"(?=({WORD[:-1]}{OUTSIDE}+{WORD}(?:{OUTSIDE}+{WORD}){{0,{longest - 1}}}(?:{OUTSIDE}+{WORD[:-1]}?)?))"), F.lit(1))
    cut = texts.select("document_id", F.explode(pieces).alias("piece"))
    # The first two words by one match; the variable of the lambda holds them for both keys.
    two = F.rtrim(F.regexp_replace(F.lower(F.col("piece")), rf"(?s)^{WORD[:-1]}{OUTSIDE}+({WORD})(?:{OUTSIDE}+({WORD}))?.*$", "$1 $2"))
    keys = F.transform(F.array(two), lambda k: F.array_distinct(F.array(F.substring_index(k, " ", 1), k)))[0]
    keyed = cut.select("document_id", "piece", F.explode(keys).alias("key"))
    met = keyed.join(phrases, "key")
    start = F.length(F.regexp_extract("piece", rf"^{WORD[:-1]}{OUTSIDE}+", 0)) + 1 - F.col("lead")
    there = F.when(F.col("cased"), F.col("piece")).otherwise(F.lower("piece"))
    same = there.substr(start, F.length("needle")) == F.col("needle")
    # The first character is part of another word, so the phrase may not follow it at once.
    free = (start > 2) & ~there.substr(start + F.length("needle"), F.lit(1)).rlike(WORD[:-1])
    return met.filter(same & free).select("document_id", "entity_id", "method")


def ranked_matches(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``ticker`` and ``place`` to each document's links: the surest first, equal ones by ticker."""
    met = links.join(entities.select(F.col("id").alias("entity_id"), "ticker"), "entity_id")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("confidence").desc(), "ticker")))


def precision_recall(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of two sets of pairs; empty denominators count as 1, f1 as 0."""
    p, e = predicted.select(*keys).distinct().withColumn("p", F.lit(1)), expected.select(*keys).distinct().withColumn("e", F.lit(1))
    both = p.join(e, keys, "full").agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    rated = both.withColumns({"precision": precision, "recall": recall})
    return rated.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def macro_f1(pairs: DataFrame) -> DataFrame:
    """One row: accuracy and macro-F1 of (truth, predicted) label pairs; labels without any count take no part."""
    same = F.col("truth") == F.col("predicted")
    labelled = pairs.select(F.inline(F.when(same, F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("tp"), F.lit(0).alias("miss")))).otherwise(F.array(F.struct(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("miss")), F.struct(F.col("truth").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("miss"))))))
    per_label = labelled.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("miss").alias("miss"))
    f1 = 2.0 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("miss"), F.lit(1))
    wrong = F.sum("miss") / 2.0
    return per_label.agg(F.coalesce(F.sum("tp") / F.nullif(F.sum("tp") + wrong, F.lit(0.0)), F.lit(1.0)).alias("accuracy"), F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"))


def gated(rated: DataFrame, measure: str, least: float) -> DataFrame:
    """Adds ``passed``: whether the measure reaches its gate."""
    return rated.withColumn("passed", F.col(measure) >= least)
