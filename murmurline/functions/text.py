"""Text functions: normal form, canonical text, content hashes, tokens, HTML, document text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the content hash sees it: Unicode spaces and the four separator controls.
SPACES = r"(?U)[\s\x{1c}-\x{1f}]+"
SEPARATOR = "\u001f"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode normal form C; of ASCII texts only a NULL leaves the JVM."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def canonical(text: Column) -> Column:
    """Normal form with runs of white space as one space, trimmed; NULL becomes empty."""
    return F.trim(F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), SPACES, " "))


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the canonical parts in order; the separator can't occur inside a canonical part."""
    return F.sha2(F.concat_ws(SEPARATOR, *[canonical(p) for p in parts]), 256)


def tokens(text: Column) -> Column:
    """The set of lower-case ASCII letter and digit runs, hyphens removed; NULL has none."""
    return F.array_distinct(F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("-"), F.lit("")), F.lit("([a-z0-9]+)")))


def strip_html(text: Column, limit: int = 600) -> Column:
    """Tags become spaces, white space collapses, at most ``limit`` characters stay."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), SPACES, " ")), 1, limit)


def document_text(title: Column, body: Column, joint: str = "\n") -> Column:
    """Title and body joined, empty parts left out."""
    return F.concat_ws(joint, F.nullif(title, F.lit("")), F.nullif(body, F.lit("")))


#: Year, dash, month and day, or week and its day; then any one character and hour, colon, minute, second, fraction; then
#: sign, hours, minutes and seconds of the offset.  Colons and dashes are in all places of a part or in none.
_ISO = (
    r"(?s)\A((?!0000)[0-9]{4})(-?)(?:([0-9]{2})\2([0-9]{2})|W([0-9]{2})(?:\2([1-7]))?)"
    r"(?:.([01][0-9]|2[0-3])(?:(:?)([0-5][0-9])(?:\8([0-5][0-9])(?:[.,]([0-9]+))?)?)?"
    r"(?:([+-])([01][0-9]|2[0-3])(?:(:?)([0-5][0-9])(?:\14([0-5][0-9])(?:[.,][0-9]+)?)?)?)?)?\z"
)


def parse_utc(text: Column) -> Column:
    """ISO 8601 timestamps as instants, without a zone in UTC, finer digits than microseconds dropped; anything else is NULL.

    That includes malformed text which Python's ``fromisoformat`` happens to let through, such as ``10:00:00T+02:00``.
    """
    value = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    parts = F.when(value.rlike(_ISO), F.split(F.regexp_replace(value, _ISO, "|".join(f"${n}" for n in (1, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 15, 16))), r"\|"))

    def instant(p: Column) -> Column:
        number = lambda i, least=0: F.coalesce(F.nullif(p[i], F.lit("")).cast("int"), F.lit(least))
        monday = F.date_sub(F.make_date(number(0), F.lit(1), F.lit(4)), F.weekday(F.make_date(number(0), F.lit(1), F.lit(4))))
        week = F.date_add(monday, (number(3) - 1) * 7)
        by_week = F.when((number(3) > 0) & (F.year(F.date_add(week, 3)) == number(0)), F.date_add(week, number(4, 1) - 1))
        by_month = F.to_date(F.try_to_timestamp(F.concat_ws("-", p[0], p[1], p[2]), F.lit("yyyy-MM-dd")))
        day = F.unix_date(F.when(p[3] != "", by_week).otherwise(by_month)).cast("long")
        seconds = day * 86400 + number(5) * 3600 + number(6) * 60 + number(7)
        offset = (number(10) * 3600 + number(11) * 60 + number(12)) * F.when(p[9] == "-", -1).otherwise(1)
        return F.timestamp_micros((seconds - offset) * 1_000_000 + F.rpad(F.substring(p[8], 1, 6), 6, "0").cast("long"))

    return F.transform(F.array(parts), instant)[0]


#: Day, month, year, hour, minute, second, zone; a weekday in front says nothing more.
_MAIL = r"(?i)^\s*(?:[a-z]{3,9},?\s+)?([0-9]{1,2})\s+([a-z]{3})[a-z]*\s+([0-9]{4})\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:\s+([a-z]{1,5}|[+-][0-9]{2}:?[0-9]{2}))?\s*$"
# The months and the zones in minutes from UTC that mail and feed dates may name.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"": 0, "ut": 0, "utc": 0, "gmt": 0, "z": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}


def mail_time(text: Column) -> Column:
    """Dates of mails and feeds (RFC 822) as instants, without a zone in UTC; an unknown zone or anything else is NULL."""

    def instant(p: Column) -> Column:
        number = lambda i: F.coalesce(F.nullif(p[i], F.lit("")).cast("int"), F.lit(0))
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), p[1]).cast("int")
        day = F.try_to_timestamp(F.concat_ws("-", p[2], F.lpad(month.cast("string"), 2, "0"), F.lpad(p[0], 2, "0")), F.lit("yyyy-MM-dd"))
        named = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), p[6])
        digits = F.replace(p[6], F.lit(":"), F.lit(""))
        signed = (F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")) * F.when(digits.startswith("-"), -1).otherwise(1)
        offset = F.when(p[6].rlike("^[+-]"), signed).otherwise(named)
        right = (number(3) < 24) & (number(4) < 60) & (number(5) < 60)
        return F.when(right, F.timestamp_micros((F.unix_seconds(day) + number(3) * 3600 + number(4) * 60 + number(5) - offset * 60).cast("long") * 1_000_000))

    parts = F.when(text.rlike(_MAIL), F.split(F.lower(F.regexp_replace(text, _MAIL, "$1|$2|$3|$4|$5|$6|$7")), r"\|", -1))
    return F.transform(F.array(parts), instant)[0]


def feed_time(text: Column) -> Column:
    """The instant of a feed's date: ISO 8601 or RFC 822; anything else is NULL."""
    return F.coalesce(parse_utc(text), mail_time(text))


def number(value: Column) -> Column:
    """A number, infinities included, or NULL for NaN and what can't be cast."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def whole_number(value: Column) -> Column:
    """The integer part of a number, or NULL where there is none."""
    return number(value).try_cast("bigint")
