"""Texts that lost their end, and how often each source loses ends.

Everything is judged against the collection itself:

* a *vocabulary trie*: every prefix of every known word is a node.  It is a table keyed by prefix, so it
  grows with the vocabulary and not in one process.  The last word of every text without an end is looked up; one
  that is unknown but a node of the trie (a proper prefix of known words) was cut inside a word;
* *length evidence*: a source whose texts pile up at one length (characters or bytes) and hardly ever
  exceed it has a field limit there.  A text at its limit without final punctuation was cut, inside a
  word or between two;
* *sentence endings*: the last words of all punctuated sentences, numbers and names made alike.  A text
  without final punctuation whose last words never end a sentence was cut inside a sentence, though its
  last word is whole and its length says nothing;
* *marks*: ``[...]``, a replacement character, or an ellipsis at the limit or after part of a word.

``evidence`` names all that a text shows, so a text cut inside a word by its limit has ``word+limit``.

Defined results: NULL, empty and blank texts are no cases; a text with final punctuation is complete,
even at the limit, unless white space at the limit shows that more followed; texts of one source that
are equal are judged alike; a NULL source is a source of its own; an empty table gives no row.  All
counts are taken over all texts, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmurline.functions.plan import pinned
from murmurline.session import cut_lineage

BREAK = "\u0003"  # stands for a line break, which ends a sentence
TERMINAL = rf"[.!?{BREAK}][\"”»)'’]*$"
STRIP = r"^[\p{P}\s\x{3}]+|[\p{P}\s\x{3}]+$"
DOTS = r"(…|\.{3})\s*$"
SENTENCE_GAP = rf"(?<=[.!?{BREAK}][\"”»)]{{0,2}}) "
TAIL = "\u0004"
TAIL_WORDS = 8  # of the end of a text; a word of any length
OPEN = r"[,;:–—\-(\[“„«&/]$"


def _words(text: Column) -> Column:
    """The text with digits made alike and line breaks marked, words parted by single spaces."""
    digits = F.regexp_replace(text, r"\d+(?:[.,]\d+)*", "0")
    return F.trim(F.regexp_replace(F.regexp_replace(digits, r"[ \t\r]*\n\s*", BREAK + " "), r"[ \t\r  ]+", " "))


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, STRIP, "")


def _alike(tail: Column) -> Column:
    """The words of a tail without punctuation; names and codes become one symbol."""
    named = F.regexp_replace(tail, r"(?<![^ ])[^\p{L} ]*\p{Lu}[^ ]*", "X")
    return F.trim(F.regexp_replace(named, r"(?<![^ ])[\p{P}\x{3}]+|[\p{P}\x{3}]+(?![^ ])", ""))


def _field_limits(texts: DataFrame, least: int = 3) -> DataFrame:
    """(source_id, unit, field_limit, marks): where a source's lengths pile up and end, if they do, and whether it marks cuts there."""
    dots = F.substring("text", -8, 8).rlike(DOTS)
    sizes = texts.select("source_id", dots.alias("dots"), F.inline(F.array(F.struct(F.lit("chars").alias("unit"), F.char_length("text").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("size")))))
    counts = sizes.groupBy("source_id", "unit", "size").agg(F.count(F.lit(1)).alias("n"), F.count_if("dots").alias("dotted"))
    by_unit = Window.partitionBy("source_id", "unit")
    ranked = counts.withColumns({
        "beyond": F.coalesce(F.sum("n").over(by_unit.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "all": F.sum("n").over(by_unit),
    })
    # Bytes lost inside a character leave a replacement character of three bytes, so a few texts exceed a byte limit by two.
    piles = ranked.filter((F.col("n") >= least) & (F.col("n") >= 0.03 * F.col("all")) & (F.col("beyond") <= 0.1 * F.col("n")))
    best = piles.groupBy("source_id").agg(F.max(F.struct("n", "unit", "size", "dotted")).alias("b"))
    return best.select(F.col("source_id").alias("limit_source"), F.col("b.unit").alias("unit"), F.col("b.size").alias("field_limit"), (F.col("b.dotted") * 2 >= F.col("b.n")).alias("marks"))


def truncated_texts(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source_id, evidence): the texts that lost their end.

    ``evidence`` is one or more of ``mark``, ``byte`` (a character lost in the middle), ``word``, ``limit`` and
    ``sentence``, joined by a plus sign.
    """
    texts = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source_id"), F.col(text).alias("text")).filter(F.length(F.trim(F.col("text"))) > 0)
    limits = _field_limits(texts)
    # Only the end travels to its source's limit: the last words, and the length of the whole text.
    backwards = F.reverse(F.translate("text", "\t\r\u00a0", "   "))
    tail = F.rtrim(F.reverse(F.regexp_extract(backwards, rf"^(\s*(?:\S+\s+){{0,{TAIL_WORDS - 1}}}\S+)", 1)))
    short = texts.select("key", "source_id", tail.alias("tail"), F.substring("text", -1, 1).rlike(r"\s").alias("blank"), F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    ends = short.join(limits, short["source_id"].eqNullSafe(limits["limit_source"]), "left")
    away = F.when(F.col("unit") == "chars", F.col("field_limit") - F.col("chars")).otherwise(F.col("field_limit") - F.col("bytes"))
    ends = pinned(ends, ["key", "source_id", "unit", "marks", "tail", "blank"], {"away": away, "tip": F.regexp_replace("tail", r"[\n ]+$", "")})

    mark = F.col("tip").rlike(r"(\[(\.{3}|…)\]|\((\.{3}|…)\))$")
    lost = F.col("tip").rlike("\ufffd[\"”»)]?$")
    dots, marks = F.col("tip").rlike(DOTS), F.coalesce("marks", F.lit(False))
    body = F.when(dots, F.regexp_replace("tail", r"[\s]{0,3}(…|\.{3})\s*$", "")).when(lost, F.regexp_replace("tail", "\ufffd+[\"”»)]?\\s*$", "")).otherwise(F.col("tail"))
    exact = ~marks & F.coalesce(F.when(F.col("unit") == "chars", F.col("away") == 0).otherwise(F.col("away").between(-2, 3)), F.lit(False))
    near = marks & F.coalesce(F.col("away").between(-2, 3), F.lit(False))
    ended = ~dots & F.col("tip").rlike(r"[.!?][\"”»)'’]*$")
    linked = F.col("tip").rlike(r"(\([^()]*https?://[^\s/()]+/[^\s()]+\)|(^|[^(\S])https?://[^\s/()]+/[^\s()]+)$")
    verdict = (
        F.when(mark, "mark").when(lost, "byte").when(dots & near, "mark").when(ended, F.when(exact & F.col("blank"), "limit").otherwise("complete"))
        .when(linked, "complete").when(exact, "limit")
    )
    judged = pinned(ends, ["key", "source_id"], {"verdict": verdict, "dots": dots, "words": _words(body), "gaping": F.substring(body, -4, 4).rlike(OPEN)})
    # What has no end is looked up: in the trie by its last word, among sentence endings by its last words.
    sentence = F.element_at(F.split("words", SENTENCE_GAP), -1)
    ends_left = judged.filter("verdict IS NULL OR verdict <> 'complete'")
    open_ends = cut_lineage(ends_left.select("key", "source_id", "verdict", "dots", "gaping", _bare(F.element_at(F.split("words", " "), -1)).alias("word"), _alike(F.substring_index(sentence, " ", -4)).alias("ending")))

    vocabulary, endings = corpus_counts(texts)
    # The trie: each prefix of a known word with the uses of all words below it; only nodes that are asked for travel on.
    known = vocabulary.filter((F.col("inside") >= 2) & (F.length("word") > 1))
    nodes = known.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, 1, i))")).alias("node"), "inside")
    # Ends that other evidence explains say nothing about how a word ends texts by itself.
    asked = open_ends.groupBy("word").agg(F.count_if(~F.col("dots") & F.col("verdict").isNull()).alias("last"))
    trie = nodes.groupBy("node").agg(F.sum("inside").alias("below"))
    words = asked.join(vocabulary, "word", "left").join(trie, F.col("word") == F.col("node"), "left").select("word", "last", "inside", "final", "below")
    looked = open_ends.join(words, "word", "left").join(endings, "ending", "left")
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    # Unknown: hardly ever followed by more text, and ending texts only as often as cuts through the words below it explain.
    cut_word = (F.length("word") > 0) & (count("below") > 0) & (count("inside") < 2 + count("below") * 1e-5) & (count("last") < 2 + 0.02 * count("below"))
    closing = (count("final") + count("last")) / F.greatest(count("inside") + count("last"), F.lit(1))
    long_enough = (F.size(F.split("ending", " ")) >= 3) | (closing >= 0.1)
    at_home = ((count("n") >= 3) & long_enough) | (closing >= 0.3)
    unfinished = F.col("gaping") | ((F.length("word") > 0) & ~F.col("dots") & ~at_home)
    alone = F.col("verdict").isNull()
    evidence = F.concat_ws("+", F.when(F.col("verdict").isin("mark", "byte"), F.col("verdict")), F.when(cut_word, "word"), F.when(F.col("verdict") == "limit", "limit"), F.when(alone & ~cut_word & unfinished & ~(F.col("dots") & (F.length("word") > 0)), "sentence"))
    return looked.select("key", "source_id", evidence.alias("evidence")).filter("evidence <> ''")


def corpus_counts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (word, inside, final) and the endings (ending, n) of all texts.

    ``inside`` counts a word except as the last of a text without final punctuation, ``final`` those of
    them that end a sentence.
    """
    spaced = pinned(texts.select(_words(F.col("text")).alias("t")), ["t"], {"ended": F.col("t").rlike(TERMINAL) & ~F.col("t").rlike(r"\.{3}$")})
    w = F.split("t", " ")
    inner = F.when(F.col("ended"), w).otherwise(F.slice(w, F.lit(1), F.size(w) - 1))
    pieces = F.split("t", SENTENCE_GAP)
    finished = F.when(F.col("ended"), pieces).otherwise(F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    tails = F.transform(finished, lambda s: F.concat(F.lit(TAIL), F.substring_index(s, " ", -4)))
    # Words and tails are counted in one pass; the tails carry a mark in front.
    # The counts are kept, or each reader's filter would be pushed below them and count everything again.
    counts = cut_lineage(spaced.select(F.explode(F.concat(inner, tails)).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n")))
    is_tail = F.col("raw").startswith(TAIL)
    counted = counts.filter(~is_tail).select(_bare(F.col("raw")).alias("word"), F.col("n").alias("inside"), F.when(F.col("raw").rlike(TERMINAL), F.col("n")).otherwise(0).alias("final"))
    vocabulary = counted.filter(F.length("word") > 0).groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("final").alias("final"))
    endings = counts.filter(is_tail).select(_alike(F.expr("substring(raw, 2)")).alias("ending"), "n").groupBy("ending").agg(F.sum("n").alias("n"))
    return vocabulary, endings


def truncation_rates(df: DataFrame, found: DataFrame, source: str, text: str) -> DataFrame:
    """(source_id, texts, truncated, share) of every source with any text."""
    all_texts = df.filter(F.length(F.trim(F.col(text))) > 0).groupBy(F.col(source).cast("string").alias("source_id")).agg(F.count(F.lit(1)).alias("texts"))
    cut = found.groupBy(F.col("source_id").alias("cut_source")).agg(F.count(F.lit(1)).alias("truncated"))
    met = all_texts.join(cut, F.col("source_id").eqNullSafe(F.col("cut_source")), "left")
    truncated = F.coalesce("truncated", F.lit(0))
    return met.select("source_id", "texts", truncated.alias("truncated"), F.round(truncated / F.col("texts"), 6).alias("share"))
