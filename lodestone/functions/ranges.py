"""Range values: struct<lower, upper, lower_inc, upper_inc, empty>; a NULL bound is infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_range(lower: Column, upper: Column, bounds: str = "[)", discrete: bool = False, step=1) -> Column:
    """A range in canonical form: discrete ones become ``[)``; lower above upper is an error."""
    lo_inc, hi_inc = F.lit(bounds[0] == "["), F.lit(bounds[1] == "]")
    lo, hi = lower, upper
    if discrete:
        if bounds[0] == "(":
            lo = lower + step
        if bounds[1] == "]":
            hi = upper + step
        lo_inc, hi_inc = F.lit(True), F.lit(False)
    wrong = F.coalesce(lower > upper, F.lit(False))
    lo_inc, hi_inc = lo_inc & lo.isNotNull(), hi_inc & hi.isNotNull()
    none = F.coalesce((lo > hi) | ((lo == hi) & ~(lo_inc & hi_inc)), F.lit(False))
    made = F.struct(
        F.when(~none, lo).alias("lower"), F.when(~none, hi).alias("upper"),
        (~none & lo.isNotNull() & lo_inc).alias("lower_inc"), (~none & hi.isNotNull() & hi_inc).alias("upper_inc"), none.alias("empty"),
    )
    checked = F.when(wrong, F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound")).cast("boolean")).otherwise(F.lit(True))
    return F.when(checked, made)


def isempty(r: Column) -> Column:
    return r["empty"]


def contains_element(r: Column, x: Column) -> Column:
    low = r["lower"].isNull() | (r["lower"] < x) | (r["lower_inc"] & (r["lower"] == x))
    high = r["upper"].isNull() | (r["upper"] > x) | (r["upper_inc"] & (r["upper"] == x))
    return ~r["empty"] & low & high


def _starts_before_end(a: Column, b: Column) -> Column:
    """The lower bound of a is not beyond the upper bound of b."""
    meet = (a["lower"] == b["upper"]) & a["lower_inc"] & b["upper_inc"]
    return a["lower"].isNull() | b["upper"].isNull() | (a["lower"] < b["upper"]) | meet


def overlaps(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & _starts_before_end(a, b) & _starts_before_end(b, a)


def _low_le(a: Column, b: Column) -> Column:
    """Lower bound of a at or before that of b."""
    return a["lower"].isNull() | F.coalesce((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"])), F.lit(False))


def _high_ge(a: Column, b: Column) -> Column:
    return a["upper"].isNull() | F.coalesce((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"])), F.lit(False))


def contains_range(a: Column, b: Column) -> Column:
    return b["empty"] | (~a["empty"] & _low_le(a, b) & _high_ge(a, b))


def before(a: Column, b: Column) -> Column:
    """a << b."""
    return ~a["empty"] & ~b["empty"] & F.coalesce(~_starts_before_end(b, a), F.lit(False))


def overleft(a: Column, b: Column) -> Column:
    """a &< b: a does not extend to the right of b."""
    return ~a["empty"] & ~b["empty"] & _high_ge(b, a)


def overright(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & _low_le(b, a)


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b."""
    touch = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def intersection(a: Column, b: Column) -> Column:
    low, high = F.when(_low_le(a, b), b).otherwise(a), F.when(_high_ge(a, b), b).otherwise(a)
    hit = overlaps(a, b)
    return F.struct(F.when(hit, low["lower"]).alias("lower"), F.when(hit, high["upper"]).alias("upper"), (hit & low["lower_inc"]).alias("lower_inc"), (hit & high["upper_inc"]).alias("upper_inc"), (~hit).alias("empty"))


def merge(a: Column, b: Column) -> Column:
    """range_merge(): the smallest range that holds both."""
    low, high = F.when(_low_le(a, b), a).otherwise(b), F.when(_high_ge(a, b), a).otherwise(b)
    both = F.struct(low["lower"].alias("lower"), high["upper"].alias("upper"), low["lower_inc"].alias("lower_inc"), high["upper_inc"].alias("upper_inc"), F.lit(False).alias("empty"))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(both)


def range_text(r: Column) -> Column:
    low, high = F.when(r["lower_inc"], "[").otherwise("("), F.when(r["upper_inc"], "]").otherwise(")")
    return F.when(r["empty"], "empty").otherwise(F.concat(low, F.coalesce(r["lower"].cast("string"), F.lit("")), F.lit(","), F.coalesce(r["upper"].cast("string"), F.lit("")), high))


def seg(text: Column) -> Column:
    """A segment of numbers from its text: a, a..b, a.., ..b, a(+-)d; certainty marks (< > ~) are dropped.  Open ends are infinite."""
    plain = F.regexp_replace(text, r"[<>~\s]", "")
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    around = F.regexp_extract_all(plain, F.lit(f"({number})"), F.lit(1))
    middle, off = F.get(around, F.lit(0)).cast("double"), F.get(around, F.lit(1)).try_cast("double")
    low, high = F.substring_index(plain, "..", 1), F.substring_index(plain, "..", -1)
    infinite = F.lit(float("inf"))
    given = F.contains(plain, F.lit("(+-)"))
    return F.struct(
        F.when(given, middle - F.abs(off)).when(low == "", -infinite).otherwise(low.try_cast("double")).alias("low"),
        F.when(given, middle + F.abs(off)).when(high == "", infinite).otherwise(high.try_cast("double")).alias("high"),
    )


def seg_overlaps(a: Column, b: Column) -> Column:
    return (a["low"] <= b["high"]) & (b["low"] <= a["high"])


def seg_contains(a: Column, b: Column) -> Column:
    return (a["low"] <= b["low"]) & (a["high"] >= b["high"])


def seg_left(a: Column, b: Column) -> Column:
    """a << b: a lies before b."""
    return a["high"] < b["low"]


def seg_over_left(a: Column, b: Column) -> Column:
    """a &< b: a does not reach beyond b."""
    return a["high"] <= b["high"]


def seg_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"))
