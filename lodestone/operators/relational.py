"""Distinct-on, ties, series, sampling, pivots, changes to rows, and joins by range or time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _fresh(name: str, *frames: DataFrame) -> str:
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; NULL keys are equal.  Spell NULLS LAST in ``order`` where it matters."""
    n = _fresh("nth", df)
    return df.withColumn(n, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def with_ties(df: DataFrame, order: Sequence[str], n: int, ascending: Sequence[bool] | bool = True) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES: the first n rows and all peers of the last one; NULLs sort as the largest.

    The n-th place comes from a top-n; rows are then kept by comparison with it, so the
    table is never gathered in one task for a rank.
    """
    if n <= 0:
        return df.limit(0)
    up = [ascending] * len(order) if isinstance(ascending, bool) else list(ascending)
    sort = [F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_first() for c, a in zip(order, up, strict=True)]
    last = df.select(*order).orderBy(*sort).offset(n - 1).limit(1).collect()  # the n-th row alone
    if not last:
        return df
    before, same = F.lit(False), F.lit(True)
    for c, a, v in zip(order, up, last[0], strict=True):
        x, y = F.col(c), F.lit(v)
        ahead = x < y if v is not None else x.isNotNull()
        behind = (x > y) | x.isNull() if v is not None else F.lit(False)
        before = before | (same & F.coalesce(ahead if a else behind, F.lit(False)))
        same = same & x.eqNullSafe(y)
    return df.where(before | same)


def generate_series(spark: SparkSession, start, stop, step=1, name: str = "n") -> DataFrame:
    """start, start + step, ... up to stop; empty where the step leads away.  Integers stay distributed."""
    if all(isinstance(x, int) for x in (start, stop, step)):
        if step == 0:
            raise ValueError("step size cannot equal zero")
        return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", name)
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step) if not isinstance(step, Column) else step)).alias(name))


def lockstep(df: DataFrame, **series: Column) -> DataFrame:
    """Set-returning expressions of one target list: they advance together, short ones are padded with NULL."""
    zipped, cell = F.arrays_zip(*[c.alias(k) for k, c in series.items()]), _fresh("cell", df)
    out = df.withColumn(cell, F.explode(zipped))
    return out.select(*[c for c in df.columns], *[F.col(f"{cell}.{k}").alias(k) for k in series])


def rows_from(df: DataFrame, ordinality: str | None = None, **series: Column) -> DataFrame:
    """ROWS FROM (...) [WITH ORDINALITY] over array columns of each row."""
    zipped, cell, at = F.arrays_zip(*[c.alias(k) for k, c in series.items()]), _fresh("cell", df), _fresh("at", df)
    out = df.select("*", F.posexplode(zipped).alias(at, cell))
    extra = [(F.col(at) + 1).cast("long").alias(ordinality)] if ordinality else []
    return out.select(*df.columns, *[F.col(f"{cell}.{k}").alias(k) for k in series], *extra)


def bernoulli_sample(df: DataFrame, keys: Sequence[str], percent: float, seed: int) -> DataFrame:
    """TABLESAMPLE BERNOULLI (percent) REPEATABLE (seed): each row by a hash of its key, whatever the layout."""
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 32)) < F.lit(int(percent / 100 * (1 << 32))))


def system_sample(df: DataFrame, percent: float, seed: int, block_rows: int = 10_000) -> DataFrame:
    """TABLESAMPLE SYSTEM of a file scan: blocks of consecutive rows are kept or dropped whole."""
    block = F.xxhash64(F.col("_metadata.file_name"), F.floor(F.col("_metadata.row_index") / block_rows), F.lit(seed))
    return df.where(F.pmod(block, F.lit(1 << 32)) < F.lit(int(percent / 100 * (1 << 32))))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, or all: those that come first by a seeded hash (top-n, no full sort)."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def crosstab(df: DataFrame, row: str, category: str, value: str, names: Sequence[str]) -> DataFrame:
    """Pivots by position: the values of a row id fill the columns in category order, the rest is dropped or NULL."""
    nth = F.row_number().over(W.partitionBy(row).orderBy(F.col(category).asc_nulls_last(), F.col(value).asc_nulls_last()))
    placed = df.select(row, value, nth.alias("nth__"))
    return placed.groupBy(row).agg(*[F.max(F.when(F.col("nth__") == i + 1, F.col(value))).alias(n) for i, n in enumerate(names)])


def crosstab_by(df: DataFrame, row: str, category: str, value: str, categories: Sequence) -> DataFrame:
    """Pivots by category: one column for each listed category."""
    return df.groupBy(row).pivot(category, list(categories)).agg(F.first(value, ignorenulls=True))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], right_on: str | None = None) -> DataFrame:
    """Each left row with the last right row at or before it, by key; unmatched rows keep NULLs.

    Rows of both sides are sorted together once by (key, time): one shuffle, no pairs.
    """
    right_on = right_on or on
    payload = [c for c in right.columns if c not in by and c != right_on]
    side, when = _fresh("side", left, right), _fresh("when", left, right)
    kept = F.struct(*[F.col(c) for c in left.columns]).alias("l__")
    a = left.select(*by, F.col(on).alias(when), F.lit(1).alias(side), kept)
    b = right.select(*by, F.col(right_on).alias(when), F.lit(0).alias(side), F.struct(F.col(right_on).alias(f"{right_on}_right"), *payload).alias("r__"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(F.col(when), F.col(side)).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("r__", F.last("r__", ignorenulls=True).over(w)).where(F.col(side) == 1)
    return found.select("l__.*", "r__.*")


def interval_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """left.value BETWEEN right.low AND right.high by an equi-join on buckets of ``width``, then the exact test.

    A right row goes to each bucket that it touches; choose the width near the usual length.
    ``how``: inner, left, right or full.  Each side's rows are told apart by what they hold,
    and unmatched ones follow by an anti join, so a right row in many buckets comes once.
    """
    b = _fresh("bucket", left, right)
    a = left.withColumn(b, F.floor(F.col(value) / width))
    c = right.where(F.col(low) <= F.col(high)).withColumn(b, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    met = (a[b] == c[b]) & (left[value] >= right[low]) & (left[value] <= right[high])
    out = a.join(c, met).drop(a[b]).drop(c[b])
    nothing = lambda df: [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    if how in ("left", "full"):
        out = out.union(a.join(c, met, "left_anti").select(*[F.col(x) for x in left.columns], *nothing(right)))
    if how in ("right", "full"):
        row = _fresh("row", left, right)
        keyed = right.withColumn(row, F.xxhash64(F.struct(*right.columns)))
        many = keyed.where(F.col(low) <= F.col(high)).withColumn(b, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
        hit = many.join(a.select(F.col(value).alias(_fresh("v", left, right)), F.col(b)), b).where(F.col(_fresh("v", left, right)).between(F.col(low), F.col(high))).select(row).distinct()
        out = out.union(keyed.join(hit, row, "left_anti").select(*nothing(left), *[F.col(x) for x in right.columns]))
    return out


#: Buckets to a width in which the starts of ranges are searched for.
FINE = 8


def _starts_within(ranges: DataFrame, points: DataFrame, low: str, high: str, start: str, width: float) -> DataFrame:
    """Pairs with range.low <= point.start < range.high, by an equi-join on eighths of ``width``: a point lies in one bucket, so few candidates fail.

    Pairs may be far more than rows: rows are dealt by bucket to all shuffle partitions, which are not put
    together for being small, and no side is broadcast to the few tasks that read a small file.
    """
    b, n, fine = _fresh("bucket", ranges, points), int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), width / FINE
    spans = F.explode(F.sequence(F.floor(F.col(low) / fine), F.floor(F.col(high) / fine)))
    a = ranges.where(F.col(low) < F.col(high)).withColumn(b, spans).repartition(n, b)
    c = points.withColumn(b, F.floor(F.col(start) / fine)).repartition(n, b)
    met = (a[b] == c[b]) & (ranges[low] <= points[start]) & (points[start] < ranges[high])
    return a.join(c.hint("merge"), met).drop(a[b]).drop(c[b])


def overlap_join(left: DataFrame, right: DataFrame, l_low: str, l_high: str, r_low: str, r_high: str, width: float) -> DataFrame:
    """Pairs of half-open ranges [low, high) that overlap, each once: the range that starts later does so in the other.  Choose the width near the usual length."""
    later = _starts_within(left, right, l_low, l_high, r_low, width).where(left[l_low] < right[r_high])
    earlier = _starts_within(right, left, r_low, r_high, l_low, width).where((right[r_low] < left[l_low]) & (right[r_low] < left[l_high]))
    return later.union(earlier.select(*[left[c] for c in left.columns], *[right[c] for c in right.columns]))


def overlap_pairs(df: DataFrame, key: str, low: str, high: str, width: float) -> DataFrame:
    """a < b: keys of two rows whose ranges overlap, as ``overlap_join`` of ``df`` with itself gives them, each pair of rows in one order only."""
    a, b = df.select(key, low, high).toDF("a", "a_low", "a_high"), df.select(key, low, high).toDF("b", "b_low", "b_high")
    found = _starts_within(a, b, "a_low", "a_high", "b_low", width)
    # of two that start at one place, the one with the smaller key counts as the earlier one
    once = (F.col("a_low") < F.col("b_high")) & (F.col("a") != F.col("b")) & ((F.col("a_low") < F.col("b_low")) | (F.col("a") < F.col("b")))
    return found.where(once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: bool = True) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO UPDATE, or DO NOTHING: the new state of the table."""
    if update:
        return target.join(source.select(*keys).distinct(), list(keys), "left_anti").unionByName(source)
    return target.unionByName(source.join(target.select(*keys).distinct(), list(keys), "left_anti"))


def update_rows(df: DataFrame, condition: Column, **changes: Column) -> DataFrame:
    """UPDATE ... SET ... WHERE: a NULL condition changes nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])


def delete_rows(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """DELETE ... WHERE ... RETURNING *: what stays, and what went."""
    hit = F.coalesce(condition, F.lit(False))
    return df.where(~hit), df.where(hit)
