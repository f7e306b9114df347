"""Timestamps in many notations, precisions and clocks, as one UTC instant.

Every notation is one alternative of a single regular expression with named groups.  The expression
runs once for each value and rewrites it into a delimited list of components; calendar ranges are
validated on the components and the instant is assembled from integer day numbers.

Defined results
* NULL, empty, unparsable or out-of-calendar values: NULL instant, ``kind`` NULL.
* A value without a time of day: ``kind`` = ``day``; its instant is the local midnight.
* A value without a zone is in its source's zone.  Where the clock shows it twice the first time
  counts; where the clock skips it, the offset before the change is used.
* A zone abbreviation is read by the source's own row (``std``/``dst``); ``UTC``, ``GMT``, ``UT`` and
  ``Z`` are universal; any other abbreviation makes the value unusable.
* Digits finer than a microsecond are dropped.
* Very long texts only cost one failed match: the expression is anchored and has no nested repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurline.functions.plan import pinned

# Month names and their usual short forms (English, French, German, Spanish, Portuguese, Italian).
MONTHS = {
    1: "jan january janvier janv januar jänner enero ene janeiro gennaio",
    2: "feb february février fevrier févr februar febrero fevereiro fev febbraio",
    3: "mar march mars märz marz mär marzo março marco",
    4: "apr april avril avr abril abr aprile",
    5: "may mai mayo maio maggio",
    6: "jun june juin juni junio junho giugno",
    7: "jul july juillet juil juli julio julho luglio",
    8: "aug august août aout agosto ago",
    9: "sep sept september septembre septiembre setembro settembre",
    10: "oct october octobre oktober okt octubre outubro ottobre",
    11: "nov november novembre noviembre novembro",
    12: "dec december décembre decembre déc dezember dez diciembre dic dezembro dicembre",
}

_WS = r"[\s  ]"
_CLOCK = rf"(?<h#>\d{{1,2}}):(?<i#>\d{{2}})(?::(?<s#>\d{{2}})(?:[.,](?<f#>\d{{1,9}}))?)?"
_ZONE = r"(?<z#>[zZ]|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5})"
_WEEKDAY = rf"(?:\p{{L}}{{2,10}}\.?,?{_WS}+)?"
#: Order of the date's numbers: ymd as written, or ``slash`` (the source decides).
FORMATS = {
    "iso": rf"(?<y#>\d{{4}})[-/](?<m#>\d{{1,2}})[-/](?<d#>\d{{1,2}})(?:(?:[Tt]|{_WS}+){_CLOCK}(?:{_WS}*{_ZONE})?)?",
    "compact": rf"(?<y#>\d{{4}})(?<m#>\d{{2}})(?<d#>\d{{2}})(?:[Tt]?(?<h#>\d{{2}})(?<i#>\d{{2}})(?<s#>\d{{2}})?(?:{_WS}*{_ZONE}))?",
    "compact_local": r"(?<y#>\d{4})(?<m#>\d{2})(?<d#>\d{2})[Tt](?<h#>\d{2})(?<i#>\d{2})(?<s#>\d{2})?",
    "rfc": rf"{_WEEKDAY}(?<d#>\d{{1,2}})(?:\.|er|º)?[-{_WS[1:-1]}]+(?:de{_WS}+)?(?<n#>\p{{L}}{{3,10}})\.?[-{_WS[1:-1]}]+(?:de{_WS}+)?(?<y#>\d{{4}})(?:,?{_WS}+(?:à{_WS}+|um{_WS}+|a las{_WS}+)?{_CLOCK}(?:{_WS}*Uhr)?(?:{_WS}*{_ZONE})?)?",
    "us": rf"{_WEEKDAY}(?<n#>\p{{L}}{{3,10}})\.?{_WS}+(?<d#>\d{{1,2}}),?{_WS}+(?<y#>\d{{4}})(?:,?{_WS}+{_CLOCK}(?:{_WS}*(?<p#>[AaPp])\.?[Mm]\.?)?(?:{_WS}*{_ZONE})?)?",
    "slash": rf"(?<a#>\d{{1,2}})[/.](?<b#>\d{{1,2}})[/.](?<y#>\d{{4}})(?:,?{_WS}+{_CLOCK}(?:{_WS}*(?<p#>[AaPp])\.?[Mm]\.?)?(?:{_WS}*{_ZONE})?)?",
    "epoch": r"(?<e#>-?\d{1,19})(?:\.(?<f#>\d{1,9}))?",
}
FIELDS = "yndmabhisfpze"
_MARK, _SEP = "\u0001", "\u0002"


def _alternation(names: tuple[str, ...]) -> tuple[str, str]:
    """The anchored alternation and the replacement that lists the components of whichever matched."""
    alternatives, groups = [], {f: "" for f in FIELDS}
    for k, name in enumerate(names):
        text = FORMATS[name].replace("#", str(k))
        for field in FIELDS:
            if f"(?<{field}{k}>" in text:
                groups[field] += f"${{{field}{k}}}"
        alternatives.append(f"(?<t{k}>){text}")
    return rf"^{_WS}*(?:{'|'.join(alternatives)}){_WS}*$", _MARK + _SEP.join(groups[f] for f in FIELDS)


def components(value: Column, numeric: bool = False) -> Column:
    """The parts of a timestamp text as an array in the order of ``FIELDS``, or NULL; one regex pass."""
    names = ("epoch",) if numeric else tuple(FORMATS)
    pattern, replacement = _alternation(names)
    listed = F.regexp_replace(value, F.lit(pattern), F.lit(replacement))
    return F.when(listed.startswith(_MARK), F.split(F.substr(listed, F.lit(2)), _SEP, -1))


def _month_map() -> Column:
    pairs = [F.lit(x) for number, names in MONTHS.items() for name in names.split() for x in (name, number)]
    return F.create_map(*pairs)


def days_from_civil(y: Column, m: Column, d: Column, y1: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date by integer arithmetic; ``y1`` is the year that starts in March."""
    def div(a: Column, b: int) -> Column:
        return F.floor(a / F.lit(b))

    return y1 * 365 + div(y1, 4) - div(y1, 100) + div(y1, 400) + div((m + F.when(m > 2, -3).otherwise(9)) * 153 + 2, 5) + d - 719469


def iso_utc_millis(micros: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` of UTC microseconds, finer digits dropped; independent of the session zone."""
    day = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    ms = F.floor((micros - day.cast("long") * F.lit(86_400_000_000)) / F.lit(1000)).cast("long")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), F.format_string("%02d:%02d:%02d.%03dZ", F.floor(ms / 3_600_000).cast("long"), F.floor(ms / 60_000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000))


def _local_to_utc(local: Column, zone: Column) -> Column:
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))


def normalize_instants(df: DataFrame, keys: list[str], value: str, source: str | Column, zones: DataFrame, numeric: bool = False, reference_year: int = 2025) -> DataFrame:
    """``keys`` + ``instant_us`` bigint (UTC microseconds), ``kind`` (``instant``, ``day`` or NULL), ``zone_name``.

    ``zones`` has one row for each source (source, zone_name, std_abbrev, dst_abbrev, day_first); it is
    a configuration table of one row per feed.  A source without a row reads as UTC with the month
    first.  ``numeric``: the value is a count of seconds or a finer unit, judged by its digits.
    ``source`` is the name of a column, or a constant.  ``reference_year``: the year whose January and July give the two offsets of a zone's abbreviations.
    Rows are never dropped; keys may repeat and other columns of ``df`` may have any name.
    """
    us = 1_000_000
    fixed = [F.col(source).alias("source")] if isinstance(source, str) else []
    parts = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *fixed, components(F.col(value).cast("string"), numeric).alias("c"))

    def offset_on(day: str) -> Column:
        at = F.unix_micros(F.lit(f"{day} 12:00:00+00:00").cast("timestamp"))
        return at - _local_to_utc(at, F.col("zone_name"))

    # A zone's standard offset is the smaller of those in January and July, in either hemisphere.
    halves = [offset_on(f"{reference_year}-{month}-15") for month in ("01", "07")]
    z = zones.select(F.col("source").alias("z_source"), "zone_name", F.upper("std_abbrev").alias("std"), F.upper("dst_abbrev").alias("dst"), F.least(*halves).alias("std_us"), F.greatest(*halves).alias("dst_us"), "day_first").dropDuplicates(["z_source"])
    if fixed:
        parts = parts.join(z, parts["source"].eqNullSafe(z["z_source"]), "left").drop("z_source")
    else:  # one row of the configuration for all
        row = z.filter(F.col("z_source").eqNullSafe(source)).first()
        parts = parts.withColumns({name: F.lit(row[name] if row else None).cast(kind) for name, kind in z.dtypes if name != "z_source"})

    def part(name: str) -> Column:
        return F.nullif(F.element_at("c", FIELDS.index(name) + 1), F.lit(""))

    def number(name: str) -> Column:
        return part(name).cast("long")

    fields = parts.select(
        *[f"k{i}" for i in range(len(keys))], F.coalesce("zone_name", F.lit("UTC")).alias("zone_name"), "std", "dst", "std_us", "dst_us",
        F.coalesce("day_first", F.lit(False)).alias("day_first"),
        number("y").alias("y"), F.coalesce(number("m"), F.element_at(_month_map(), F.lower(part("n")))).alias("m"), number("d").alias("d"),
        number("a").alias("a"), number("b").alias("b"), number("h").alias("h"), number("i").alias("i"), F.coalesce(number("s"), F.lit(0)).alias("s"),
        F.substring(F.rpad(F.coalesce(part("f"), F.lit("0")), 6, "0"), 1, 6).cast("long").alias("f"),
        F.lower(part("p")).alias("p"), F.upper(part("z")).alias("z"), part("e").alias("e"),
    )
    dated = fields.withColumns({
        "m": F.when(F.col("a").isNull(), F.col("m")).when(F.col("day_first"), F.col("b")).otherwise(F.col("a")),
        "d": F.when(F.col("a").isNull(), F.col("d")).when(F.col("day_first"), F.col("a")).otherwise(F.col("b")),
        "h": F.when(F.col("p").isNull(), F.col("h")).when(~F.col("h").between(1, 12), F.lit(None)).otherwise(F.col("h") % 12 + F.when(F.col("p") == "p", 12).otherwise(0)),
        "timed": F.col("i").isNotNull(),
    })
    y, m, d = F.col("y"), F.col("m"), F.col("d")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    checked = dated.withColumns({
        "valid": y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= length) & (~F.col("timed") | (F.col("h").between(0, 23) & F.col("i").between(0, 59) & F.col("s").between(0, 59))),
        "day_us": F.when(F.col("timed"), (F.col("h") * 3600 + F.col("i") * 60 + F.col("s")) * us + F.col("f")).otherwise(0),
        "y1": y - F.when(m <= 2, 1).otherwise(0),
    })
    placed = checked.withColumn("local_us", F.when(F.col("valid"), days_from_civil(y, m, d, F.col("y1")) * F.lit(86400 * us) + F.col("day_us")))

    zone, local = F.col("z"), F.col("local_us")
    numeric_offset = F.when(zone.startswith("-"), -us).otherwise(us) * (F.substring(zone, 2, 2).cast("long") * 3600 + F.when(F.length(zone) > 3, F.substring(zone, -2, 2).cast("long") * 60).otherwise(0))
    offset = F.when(zone.rlike("^[+-]"), numeric_offset).when(zone == F.col("std"), F.col("std_us")).when(zone == F.col("dst"), F.col("dst_us")).when(zone.isin("Z", "UTC", "GMT", "UT"), F.lit(0))
    digits = F.length(F.ltrim(F.col("e"), F.lit("-")))
    count = F.col("e").try_cast("long")
    epoch_us = F.when(digits <= 11, count * us + F.col("f")).when(digits <= 14, count * 1000).when(digits <= 17, count).otherwise(F.expr("try_cast(e AS BIGINT) div 1000"))
    instant = F.when(F.col("e").isNotNull(), epoch_us).when(zone.isNull(), _local_to_utc(local, F.col("zone_name"))).otherwise(local - offset)
    n = [f"k{i}" for i in range(len(keys))]
    out = pinned(placed, [*n, "zone_name", "e", "timed", "local_us"], {"instant_us": instant})
    kind = F.when(F.col("instant_us").isNull(), F.lit(None)).when(F.col("e").isNotNull() | F.col("timed"), F.lit("instant")).otherwise(F.lit("day"))
    return out.select(*[F.col(k).alias(name) for k, name in zip(n, keys)], "instant_us", kind.alias("kind"), "zone_name", F.when(F.col("e").isNull() & ~F.col("timed"), F.col("local_us")).alias("local_day_us"))


def usable(instant_us: Column, first_year: int = 2020, last_year: int = 2029) -> Column:
    """Whether a UTC instant lies in the years that count."""
    epoch = (first_year - 1970, last_year + 1 - 1970)
    days = [365 * n + (n + 1) // 4 for n in epoch]  # right for 1970-2099
    return (instant_us >= F.lit(days[0] * 86_400_000_000)) & (instant_us < F.lit(days[1] * 86_400_000_000))


def trading_day(df: DataFrame) -> DataFrame:
    """Adds ``day`` (YYYY-MM-DD): of a day as written, of an instant on the clock of its zone."""
    local = F.when(F.col("kind") == "day", F.col("local_day_us")).otherwise(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("instant_us"), F.col("zone_name"))))
    return pinned(df, df.columns, {"day": F.date_from_unix_date(F.floor(local / F.lit(86_400_000_000)).cast("int")).cast("string")})
