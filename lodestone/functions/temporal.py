"""Dates, times and intervals.  An interval is struct<months, days, micros>; 30 days count as a month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def interval(months=0, days=0, micros=0) -> Column:
    as_col = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return F.struct(as_col(months, "int").alias("months"), as_col(days, "int").alias("days"), as_col(micros, "long").alias("micros"))


def date_part(field: str, t: Column) -> Column:
    """extract(field FROM t), with the fields that Spark lacks or counts otherwise."""
    year = F.year(t)
    whole = {
        "century": F.when(year > 0, F.floor((year + 99) / 100)).otherwise(-F.floor((F.lit(100) - year) / 100)),
        "decade": F.floor(year / 10), "millennium": F.floor((year + 999) / 1000), "year": year, "isoyear": F.extract(F.lit("YEAROFWEEK"), t),
        "quarter": F.quarter(t), "month": F.month(t), "week": F.weekofyear(t), "day": F.dayofmonth(t), "doy": F.dayofyear(t),
        "dow": F.dayofweek(t) - 1, "isodow": F.weekday(t) + 1, "hour": F.hour(t), "minute": F.minute(t),
    }
    if field in whole:
        return whole[field].cast("double")
    micros = F.unix_micros(t.cast("timestamp"))
    in_minute = F.pmod(micros, F.lit(60_000_000))
    return {"second": in_minute / 1e6, "milliseconds": in_minute / 1e3, "microseconds": in_minute.cast("double"), "epoch": micros / 1e6}[field]


def date_trunc(field: str, t: Column) -> Column:
    years = {"decade": (10, 0), "century": (100, 1), "millennium": (1000, 1)}
    if field not in years:
        return F.date_trunc(field, t)
    n, first = years[field]
    return F.make_date((F.floor((F.year(t) - first) / n) * n + first).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")


def justify_days(i: Column) -> Column:
    carry = (i["days"] / 30).cast("int")
    return interval(i["months"] + carry, i["days"] - carry * 30, i["micros"])


def justify_hours(i: Column) -> Column:
    carry = (i["micros"] / MICROS_PER_DAY).cast("int")
    return interval(i["months"], i["days"] + carry, i["micros"] - carry.cast("long") * MICROS_PER_DAY)


def interval_micros(i: Column) -> Column:
    """For comparisons: months of 30 days, days of 24 hours."""
    return (i["months"].cast("decimal(38,0)") * 30 + i["days"]) * MICROS_PER_DAY + i["micros"]


def age(later: Column, earlier: Column) -> Column:
    """The symbolic difference in months, days and microseconds."""
    months = F.floor(F.months_between(later, earlier, False)).cast("int")
    base = F.add_months(earlier.cast("date"), months).cast("timestamp")
    at = F.unix_micros(earlier.cast("timestamp")) - F.unix_micros(F.date_trunc("day", earlier))
    rest = F.unix_micros(later.cast("timestamp")) - F.unix_micros(base) - at
    days = F.floor(rest / MICROS_PER_DAY).cast("int")
    return interval(months, days, rest - days.cast("long") * MICROS_PER_DAY)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """(s1, e1) OVERLAPS (s2, e2): half-open, either order of the ends; equal ends are a point."""
    a, b, c, d = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    return ((a < d) & (c < b)) | ((a == c) & ((a == b) | (c == d))) | ((a == b) & (a >= c) & (a < d)) | ((c == d) & (c >= a) & (c < b))


#: Template patterns of to_char and to_date, longest first, and Spark's letters for them.
TEMPLATES = {
    "YYYY": "yyyy", "Month": "MMMM", "HH24": "HH", "HH12": "hh", "DDD": "DDD", "Mon": "MMM", "MM": "MM", "DD": "dd",
    "HH": "hh", "MI": "mm", "SS": "ss", "US": "SSSSSS", "MS": "SSS", "YY": "yy", "Dy": "E", "Day": "EEEE", "AM": "a", "PM": "a", "Q": "q",
}


def template(pattern: str) -> str:
    out, k = [], 0
    while k < len(pattern):
        for a in sorted(TEMPLATES, key=len, reverse=True):
            if pattern.startswith(a, k):
                out.append(TEMPLATES[a])
                k += len(a)
                break
        else:
            c = pattern[k]
            out.append(f"'{c}'" if c.isalpha() else c)
            k += 1
    return "".join(out)


def to_char(t: Column, pattern: str) -> Column:
    return F.date_format(t, template(pattern))


def to_timestamp(text: Column, pattern: str) -> Column:
    return F.to_timestamp(text, template(pattern))


def make_time(hour: Column, minute: Column, second: Column) -> Column:
    """Microseconds of the day, or an error."""
    bad = ~(hour.between(0, 24) & minute.between(0, 59) & (second >= 0) & (second <= 60))
    value = ((hour * 60 + minute) * 60).cast("long") * 1_000_000 + F.round(second * 1_000_000).cast("long")
    return F.when(bad, F.raise_error(F.lit("time field value out of range")).cast("long")).otherwise(value)


def at_time_zone(t: Column, zone: str) -> Column:
    """timestamptz AT TIME ZONE zone: the local time there of an instant held in UTC."""
    return F.from_utc_timestamp(t, zone)


def from_time_zone(t: Column, zone: str) -> Column:
    """timestamp AT TIME ZONE zone: the instant, in UTC, of a local time there."""
    return F.to_utc_timestamp(t, zone)
