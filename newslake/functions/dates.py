"""Date functions (I8, I9, B10, C6 helpers).

Date-math strings such as ``now-7d`` or ``now-1M/d`` are *parameters*, not
data: they are turned into Column arithmetic once, on the driver, and the
comparison itself runs in the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from newslake.functions._util import as_col

# Date-math units and the ISO-Z serialisation format.
_UNITS = {"y": "YEAR", "M": "MONTH", "w": "WEEK", "d": "DAY", "h": "HOUR", "H": "HOUR",
          "m": "MINUTE", "s": "SECOND"}
_ROUND = {"y": "year", "M": "month", "w": "week", "d": "day", "h": "hour", "H": "hour",
          "m": "minute", "s": "second"}
ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_STEP = re.compile(r"([+-])(\d+)([yMwdhHms])")


def date_math(expr: str, now) -> Column:
    """I8: ``now[(+|-)N unit]*[/unit]`` against the ``now`` Column; anything
    else is read as a literal timestamp."""
    expr = expr.strip()
    if not expr.startswith("now"):
        return F.to_timestamp_ntz(F.lit(expr))
    rest = expr[3:]
    rounding = None
    if "/" in rest:
        rest, rounding = rest.split("/", 1)
    out = as_col(now)
    pos = 0
    for m in _STEP.finditer(rest):
        if m.start() != pos:
            raise ValueError(f"bad date math: {expr!r}")
        pos = m.end()
        n = int(m.group(2)) * (1 if m.group(1) == "+" else -1)
        out = F.timestamp_add(_UNITS[m.group(3)], F.lit(n), out)
    if pos != len(rest):
        raise ValueError(f"bad date math: {expr!r}")
    if rounding:
        out = F.date_trunc(_ROUND[rounding], out)
    return out


def bound(expr: str, now) -> Column:
    """One date-math bound. ``now`` may be a Column, a ``datetime`` (folded to
    a literal) or a one-column DataFrame (a clock derived from data): then the
    whole bound is one scalar subquery, so the comparison still reaches the
    Parquet scan as a pushed filter (row groups skipped by their min/max)."""
    import datetime as _dt
    from pyspark.sql import DataFrame
    if isinstance(now, DataFrame):
        return now.select(date_math(expr, F.col(now.columns[0]))).scalar()
    if isinstance(now, _dt.datetime):
        return date_math(expr, F.lit(now).cast("timestamp_ntz"))
    return date_math(expr, now)


def in_range(ts, gte: str | None, lt: str | None, now) -> Column:
    """Half-open ``[gte, lt)`` on a timestamp column."""
    cond = F.lit(True)
    if gte is not None:
        cond = cond & (as_col(ts) >= bound(gte, now))
    if lt is not None:
        cond = cond & (as_col(ts) < bound(lt, now))
    return cond


def to_iso_z(ts) -> Column:
    """``%Y-%m-%dT%H:%M:%SZ``."""
    return F.date_format(as_col(ts), ISO_Z)


def parse_updated(c) -> Column:
    """First 19 characters as ISO date-time, timezone dropped; an array
    takes its first element."""
    return F.try_to_timestamp(F.substring(as_col(c), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


def from_asctime(c) -> Column:
    """B10 reverse: ``Mon Apr 11 16:15:48 2016`` style text."""
    # Day names are not parseable in Spark 3+ patterns: drop them first.
    body = F.regexp_replace(F.regexp_replace(as_col(c), r"\s+", " "), r"^[A-Za-z]{3} ", "")
    return F.try_to_timestamp(body, F.lit("MMM d HH:mm:ss yyyy")).cast("timestamp_ntz")


# Zone names of RFC 822 and the European ones seen in feeds: fixed values.
ZONE_OFFSETS = {"GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400",
                "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
                "WET": "+0000", "WEST": "+0100", "BST": "+0100", "CET": "+0100", "CEST": "+0200",
                "EET": "+0200", "EEST": "+0300"}


def from_rfc822(c) -> Column:
    """RSS ``pubDate``: ``Mon, 11 Apr 2016 16:15:48 +0200``. Day name, seconds
    and zone may be missing (no zone: UTC); the zone is an offset or a name of
    ``ZONE_OFFSETS``; years of two digits are 1970-2069. The result is the UTC
    time, whatever the session's time zone."""
    rx = (r"^\s*(?:[A-Za-z]+,?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
          r"(?:\.\d+)?\s*([A-Za-z]+|[+-]\d{2}:?\d{2})?\s*$")

    def part(i):
        return F.regexp_extract(as_col(c), rx, i)
    zone = part(7)
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONE_OFFSETS.items() for x in kv]), F.upper(zone))
    offset = F.when(zone == "", "+0000").when(zone.rlike(r"^[+-]"), F.replace(zone, F.lit(":"), F.lit(""))).otherwise(named)
    year = F.when(F.length(part(3)) == 4, part(3)).when(part(3) >= "70", F.concat(F.lit("19"), part(3))).otherwise(F.concat(F.lit("20"), part(3)))
    second = F.when(part(6) == "", "00").otherwise(part(6))
    local = F.try_to_timestamp(F.concat_ws(" ", part(1), F.initcap(part(2)), year, F.concat_ws(":", F.lpad(part(4), 2, "0"), part(5), second)),
                               F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz")
    minutes = F.substr(offset, F.lit(2), F.lit(2)).try_cast("int") * 60 + F.substr(offset, F.lit(4), F.lit(2)).try_cast("int")
    east = F.when(F.startswith(offset, F.lit("-")), -minutes).otherwise(minutes)
    return local - F.make_dt_interval(mins=east)
