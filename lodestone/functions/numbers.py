"""Numeric functions: rounding, exact degrees, and errors where Spark gives NULL or NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded(value: Column, bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def sqrt(x: Column) -> Column:
    return guarded(F.sqrt(x), x < 0, "cannot take square root of a negative number")


def ln(x: Column) -> Column:
    return guarded(F.ln(x), x <= 0, "cannot take logarithm of zero or a negative number")


def power(x: Column, y: Column) -> Column:
    bad = ((x == 0) & (y < 0)) | ((x < 0) & (y != F.floor(y)))
    return guarded(F.pow(x, y), bad, "power is undefined for these arguments")


def to_int(x: Column, kind: str = "int") -> Column:
    """Doubles round half to even, as the cast of a float does."""
    return F.rint(x).cast(kind)


def decimal_to_int(x: Column, kind: str = "int") -> Column:
    """Decimals round half away from zero."""
    return F.round(x, 0).cast(kind)


def div(a: Column, b: Column) -> Column:
    """Integer quotient, cut toward zero."""
    return F.call_function("div", a, b)


def trunc(x: Column, digits: int = 0) -> Column:
    scale = F.lit(10.0**digits)
    y = x * scale
    return F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)).cast("double") / scale


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps over a bounded sequence: 64-bit numbers need at most 92."""
    pair = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(F.call_function("div", a.cast("long"), g) * b))


def num_nulls(*args: Column) -> Column:
    return reduce(lambda x, y: x + y, [a.isNull().cast("int") for a in args])


def num_nonnulls(*args: Column) -> Column:
    return reduce(lambda x, y: x + y, [a.isNotNull().cast("int") for a in args])


def _exact(x: Column, known: dict[float, float], value: Column, period: float = 360.0) -> Column:
    turn = F.pmod(x, F.lit(period))
    out = value
    for a, v in known.items():
        out = F.when(turn == a, F.lit(v)).otherwise(out)
    return out


def sind(x: Column) -> Column:
    """Sine of degrees, exact where the value is 0, 1/2 or 1."""
    return _exact(x, {0.0: 0.0, 30.0: 0.5, 90.0: 1.0, 150.0: 0.5, 180.0: 0.0, 210.0: -0.5, 270.0: -1.0, 330.0: -0.5}, F.sin(F.radians(x)))


def cosd(x: Column) -> Column:
    return sind(F.lit(90.0) - x)


def tand(x: Column) -> Column:
    return _exact(x, {0.0: 0.0, 45.0: 1.0, 135.0: -1.0}, F.tan(F.radians(x)), 180.0)


def cotd(x: Column) -> Column:
    return _exact(x, {45.0: 1.0, 90.0: 0.0, 135.0: -1.0}, 1 / F.tan(F.radians(x)), 180.0)


def asind(x: Column) -> Column:
    return F.when(x == 0.5, 30.0).when(x == -0.5, -30.0).when(F.abs(x) == 1, x * 90.0).otherwise(F.degrees(F.asin(x)))


def acosd(x: Column) -> Column:
    return F.when(x == 0.5, 60.0).when(x == -0.5, 120.0).otherwise(F.degrees(F.acos(x)))


def atand(x: Column) -> Column:
    return F.when(F.abs(x) == 1, x * 45.0).otherwise(F.degrees(F.atan(x)))


def width_bucket_of(x: Column, thresholds: Column) -> Column:
    """width_bucket(x, sorted thresholds)."""
    return F.size(F.filter(thresholds, lambda t: t <= x))


def isfinite(x: Column) -> Column:
    """Neither NaN nor an infinity."""
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def normal_rand(spark, n: int, mean: float, spread: float, seed: int):
    """normal_rand(n, mean, stddev): rows (number, value); the same for one seed and number of partitions."""
    return spark.range(n).select((F.col("id") + 1).alias("number"), (F.lit(mean) + F.lit(spread) * F.randn(seed)).alias("value"))
