"""Timestamps and calendar keys (P7, P8, P18-P20, P27, P28, P30). The session time zone must be UTC."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import coerce as c

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# Day index shared by all calendar arithmetic.
DAY_MS = 86_400_000
HOUR_MS = 3_600_000

# Named timeframes as days back from today, first and last.
TIMEFRAMES = {"today": (0, 0), "yesterday": (1, 1), "7d": (6, 0), "30d": (29, 0)}


def instant(text: Column) -> Column:
    """TIMESTAMP of an ISO-like text; bare times of day and other text give NULL."""
    return F.when(text.rlike(r"^\d{4}"), F.try_to_timestamp(text))


def epoch_ms(text: Column) -> Column:
    return F.unix_millis(instant(text))


def iso_from_ms(ms: Column) -> Column:
    usable = F.when(F.abs(ms) <= F.lit(8_640_000_000_000_000), ms)
    return F.date_format(F.timestamp_millis(usable.cast("bigint")), _ISO)


def iso_from_text(text: Column) -> Column:
    return F.date_format(instant(text), _ISO)


def iso(node: Column) -> Column:
    """ISO text of a date text or of an epoch in seconds (below 1e12) or milliseconds."""
    n = c.number(node)
    ms = F.when(n > 0, F.when(n < 1e12, n * 1000).otherwise(n))
    return F.coalesce(iso_from_text(c.string(node)), iso_from_ms(ms))


def real_date(text: Column) -> Column:
    """The ten-character date prefix when it names a day that exists."""
    prefix = F.substring(text, 1, 10)
    return F.when(prefix.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(prefix, "yyyy-MM-dd").isNotNull(), prefix)


def normalized(node: Column) -> Column:
    """ISO text of a date text or of an epoch (above 1e10 already milliseconds)."""
    n = c.natural(F.when(~c.is_string(node), node))
    ms = F.when(n > 10_000_000_000, n).otherwise(n * 1000)
    return F.coalesce(iso_from_text(c.trimmed(node)), iso_from_ms(ms))


def kept_or_normalized(node: Column) -> Column:
    """A text that starts with a real date is kept as written, else normalised."""
    raw = c.trimmed(node)
    return F.coalesce(F.when(real_date(raw).isNotNull(), raw), normalized(node))


def day_key(text: Column, zone: str | None = None) -> Column:
    """First ten characters of the text, or the calendar date in ``zone``."""
    if zone is None or zone.lower() == "utc":
        return F.substring(text, 1, 10)
    return F.date_format(F.from_utc_timestamp(instant(text), zone), "yyyy-MM-dd")


def week_key(day: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_format(F.date_trunc("week", F.try_to_date(day, "yyyy-MM-dd")), "yyyy-MM-dd")


def month_key(day: Column) -> Column:
    """P20: YYYY-MM."""
    return F.substring(day, 1, 7)


def bucket_key(day: Column, unit: str) -> Column:
    return {"day": day, "week": week_key(day), "month": month_key(day)}[unit]


def parse_date_arg(raw: str | None) -> str | None:
    """P20: YYYY-MM-DD or YYYYMMDD, by shape only."""
    hit = re.fullmatch(r"(\d{4})-?(\d{2})-?(\d{2})", (raw or "").strip())
    return "-".join(hit.groups()) if hit else None


def _day_before(now: dt.datetime, days: int) -> str:
    return (now - dt.timedelta(days=days)).strftime("%Y-%m-%d")


def timeframe_range(name: str | None, now: dt.datetime) -> tuple[str, str] | None:
    """Inclusive day bounds of a named timeframe; None or "all" means no bounds."""
    if name in (None, "all"):
        return None
    first, last = TIMEFRAMES[name]
    return _day_before(now, first), _day_before(now, last)


def resolve_range(now: dt.datetime, since: str | None = None, until: str | None = None,
                  days: int | None = None) -> tuple[str, str] | None:
    """Explicit bounds win and may be open; else the last ``days`` days; else no bounds."""
    lo, hi = parse_date_arg(since), parse_date_arg(until)
    if lo or hi:
        return lo or "0000-01-01", hi or "9999-12-31"
    if days and days > 0:
        return _day_before(now, days - 1), _day_before(now, 0)
    return None


def in_range(day: Column, bounds: tuple[str, str] | None) -> Column:
    return F.lit(True) if bounds is None else day.between(*bounds)


def round_half_up(x: Column) -> Column:
    """Rounding with halves toward plus infinity."""
    return F.floor(x + 0.5)


def duration_minutes(start: Column, end: Column) -> Column:
    """Whole minutes between two timestamp texts, NULL if one is missing."""
    return round_half_up((epoch_ms(end) - epoch_ms(start)) / 60_000)


def age_label(text: Column, now_ms: int) -> Column:
    """Today, yesterday, "Nd ago" below 30 days, else the date."""
    date = F.substring(text, 1, 10)
    days = F.floor((F.lit(now_ms) - epoch_ms(date)) / DAY_MS)
    return (
        F.when(days <= 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(date)
    )
