"""Numbers and times of the domain as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The allowed crawl intervals in seconds.
INTERVALS = [300, 900, 1800, 2700, 3600]


def count_metric(raw: Column) -> Column:
    """A non-negative whole number, or null where it is unknown."""
    n = raw.try_cast("double")
    return F.when(n >= 0, F.floor(n)).cast("long")


def to_utc(raw: Column) -> Column:
    """A UTC timestamp from a classic feed time, ISO with an offset, or epoch seconds or milliseconds (by magnitude); else null."""
    number = raw.try_cast("decimal(20,0)").cast("long")
    epoch = F.when(number >= 1_000_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    iso = F.when(raw.rlike(r"^\d{4}-\d\d-\d\dT.*(?:Z|[+-]\d\d:?\d\d)$"), raw.try_cast("timestamp"))
    # "Wed Oct 10 20:19:24 +0000 2018": month, day, time, zone, year, without the weekday, which says nothing new
    part = lambda i: F.regexp_extract(raw, r"^\w{3} (\w{3}) (\d\d) (\d\d:\d\d:\d\d) ([+-]\d{4}) (\d{4})$", i)
    classic = F.when(part(1) != "", F.try_to_timestamp(F.concat_ws(" ", part(5), part(1), part(2), part(3), part(4)), F.lit("yyyy MMM dd HH:mm:ss Z")))
    return F.when(raw.rlike(r"^\d{9,14}$"), epoch).otherwise(F.coalesce(iso, classic))


def first_time(*raw: Column) -> Column:
    """The first of several fields that holds a time, as ``to_utc`` reads it."""
    return F.coalesce(*[to_utc(r) for r in raw])


def backoff(interval: Column, failures: Column) -> Column:
    """Seconds to wait: doubled with each failure, four intervals at most."""
    return F.least(interval * F.pow(F.lit(2), failures - 1), interval * 4).cast("long")


def overlap(interval: Column) -> Column:
    return F.greatest(F.lit(60), F.floor(interval * 0.2 + 0.5)).cast("long")


def clamp_interval(seconds: Column) -> Column:
    """The least allowed interval that is no shorter; the longest beyond."""
    out = F.lit(INTERVALS[-1])
    for s in reversed(INTERVALS[:-1]):
        out = F.when(seconds <= s, s).otherwise(out)
    return out


def period_start(at: Column, zone: str, unit: str) -> Column:
    """The UTC time at which the day or month of a time zone began."""
    return F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(at, zone)), zone)


def compare_key(raw: Column) -> Column:
    """A sort key of ids: numbers by value, before other ids by code points."""
    digits = F.regexp_replace(raw, "^0+(?=.)", "")
    return F.when(raw.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(F.concat(F.lit("1"), raw))
