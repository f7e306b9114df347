"""The timestamp query against an independent parser, over whole tables."""

import calendar
import re
from datetime import datetime, timedelta, timezone
from pathlib import Path
from zoneinfo import ZoneInfo

import pytest
from compare import oracle_rows

from murmurline.queries.problems import p2_found

NAMES = "jan feb mar apr may jun jul aug sep oct nov dec|janvier février mars avril mai juin juillet août septembre octobre novembre décembre|januar februar märz april mai juni juli august september oktober november dezember|enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
MONTH = {name: i for names in NAMES.split("|") for i, name in enumerate(names.split(), 1)}


def moment(y, mo, d, h, mi, s, frac, zone, feed):
    """('day' or 'instant', datetime or UTC microseconds), or None."""
    zone_name, std, dst, _ = feed
    try:
        t = datetime(y, mo, d, h or 0, mi or 0, s or 0)
    except ValueError:
        return None
    if h is None:
        return "day", t
    if zone is None:
        utc = t.replace(tzinfo=ZoneInfo(zone_name), fold=0).astimezone(timezone.utc)
    elif zone in ("Z", "UTC", "GMT"):
        utc = t
    elif zone[0] in "+-":
        digits = zone.replace(":", "")
        minutes = int(digits[1:3]) * 60 + int(digits[3:5])
        utc = t + timedelta(minutes=minutes if zone[0] == "-" else -minutes)
    else:
        offsets = [datetime(2025, m, 15, tzinfo=ZoneInfo(zone_name)).utcoffset() for m in (1, 7)]
        if zone not in (std, dst):
            return None
        utc = t - (min(offsets) if zone == std else max(offsets))
    return "instant", calendar.timegm(utc.timetuple()) * 10**6 + int((frac or "0").ljust(6, "0")[:6])


def parse(text, feed, numeric):
    if text is None:
        return None
    s = text.strip()
    whole = lambda x: None if x is None else int(x)
    if re.fullmatch(r"-?\d+", s) and (numeric or len(s) != 8):
        scale = {10: 10**6, 13: 1000, 16: 1}.get(len(s))
        return ("instant", int(s) * scale) if scale else ("instant", int(s) // 1000) if len(s) == 19 else None
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?(Z|[+-]\d\d:\d\d)?)?", s):
        return moment(*map(int, m.group(1, 2, 3)), *map(whole, m.group(4, 5, 6)), m[7], m[8], feed)
    if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d)Z)?", s):
        return moment(*map(int, m.group(1, 2, 3)), *map(whole, m.group(4, 5, 6)), None, "Z", feed)
    if (m := re.fullmatch(r"(?:\w{3}, )?(\d{1,2})\.? (?:de )?(\w+) (?:de )?(\d{4})(?:,| à)? (\d\d):(\d\d)(?::(\d\d))?(?: Uhr)?(?: ([A-Z]+|[+-]\d{4}))?", s)) and m[2].lower() in MONTH:
        return moment(int(m[3]), MONTH[m[2].lower()], int(m[1]), *map(whole, m.group(4, 5, 6)), None, m[7], feed)
    if m := re.fullmatch(r"(\w{3}) (\d{1,2}), (\d{4})(?: (\d+):(\d\d)(?::(\d\d))? (AM|PM))?", s):
        hour = None if m[4] is None else int(m[4]) % 12 + 12 * (m[7] == "PM")
        return moment(int(m[3]), MONTH[m[1].lower()], int(m[2]), hour, whole(m[5]), whole(m[6]), None, None, feed)
    if m := re.fullmatch(r"(\d\d)-(\w{3})-(\d{4})", s):
        return moment(int(m[3]), MONTH[m[2].lower()], int(m[1]), None, None, None, None, None, feed)
    if m := re.fullmatch(r"(\d\d)/(\d\d)/(\d{4})(?: (\d\d):(\d\d)(?::(\d\d))?)?", s):
        day, month = (int(m[1]), int(m[2])) if feed[3] else (int(m[2]), int(m[1]))
        return moment(int(m[3]), month, day, *map(whole, m.group(4, 5, 6)), None, None, feed)
    return None


def test_all_records_against_an_independent_parser(spark, tiny):
    if not Path(tiny).exists():
        pytest.skip("no test tables here")
    zones = {r[0]: r[1:] for r in oracle_rows("SELECT source, zone_name, std_abbrev, dst_abbrev, day_first FROM feed_zones", tiny)[1]}
    rows = oracle_rows("SELECT 'rss', record_id, published_date, source FROM rss_raw UNION ALL SELECT 'hackernews', id, CAST(timestamp AS VARCHAR), 'hackernews' FROM hn_raw UNION ALL SELECT 'yahoo', record_id, date, 'yahoo' FROM bars_raw", tiny)[1]
    first, last = (datetime(y, 1, 1, tzinfo=timezone.utc).timestamp() * 10**6 for y in (2020, 2030))
    want = set()
    for origin, key, text, source in rows:
        found = parse(text, zones[source], origin == "hackernews")
        if found is None:
            continue
        kind, value = found
        if origin == "yahoo":
            if kind == "day" or first <= value < last:
                day = value if kind == "day" else datetime.fromtimestamp(value / 1e6, ZoneInfo(zones[source][0]))
                want.add((origin, key, day.strftime("%Y-%m-%d")))
        elif kind == "instant" and first <= value < last:
            t = datetime.fromtimestamp(value // 10**6, timezone.utc)
            want.add((origin, key, t.strftime("%Y-%m-%dT%H:%M:%S") + f".{value % 10**6 // 1000:03d}Z"))
    assert {tuple(r) for r in p2_found(spark, tiny).collect()} == want
