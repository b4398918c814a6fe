"""Aggregates that Spark has no syntax for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_array(value: str, *order: str, descending: bool = False) -> Column:
    """array_agg(value ORDER BY order): NULL values are kept, no rows give NULL."""
    sorted_ = F.array_sort(F.collect_list(F.struct(*[F.struct(F.col(o).isNull().alias("none"), F.col(o).alias("v")).alias(f"o{i}") for i, o in enumerate(order)], F.struct(F.col(value).alias("v")).alias("x"))))
    out = F.transform(F.reverse(sorted_) if descending else sorted_, lambda s: s["x"]["v"])
    return F.when(F.size(sorted_) > 0, out)


def ordered_string(value: str, delimiter: str, *order: str) -> Column:
    """string_agg(value, delimiter ORDER BY order): NULLs are skipped, nothing gives NULL."""
    x = F.filter(ordered_array(value, *order), lambda v: v.isNotNull())
    return F.when(F.size(x) > 0, F.array_join(x, delimiter))


def hypothetical_rank(value: Column, given: Column) -> Column:
    """rank(given) WITHIN GROUP (ORDER BY value); NULLs sort last."""
    return F.count_if(value < given) + 1


def hypothetical_dense_rank(value: Column, given: Column) -> Column:
    return F.count_distinct(F.when(value < given, value)) + 1


def hypothetical_percent_rank(value: Column, given: Column) -> Column:
    n = F.count(F.lit(1))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.count_if(value < given) / n)


def hypothetical_cume_dist(value: Column, given: Column) -> Column:
    return (F.count_if(value <= given) + 1) / (F.count(F.lit(1)) + 1)


def first_value_of_mode(value: str) -> Column:
    """mode() WITHIN GROUP (ORDER BY value): of equally frequent values the smallest."""
    return F.mode(value, deterministic=True)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """GROUPING SETS in one pass; ``()`` gives its row on empty input too, as the standard asks.

    Adds grouping_id over all columns that occur, in the order in which they do.
    """
    keys = list(dict.fromkeys(c for s in sets for c in s))
    if not keys:
        one = df.agg(*aggregates).withColumn("grouping_id", F.lit(0).cast("long"))
        for _ in sets[1:]:
            one = one.unionByName(one)
        return one
    full = [s for s in sets if s]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in full], *[F.col(c) for c in keys]).agg(F.grouping_id().alias("grouping_id"), *aggregates)
    out = grouped
    for _ in [s for s in sets if not s]:
        everything = df.agg(*aggregates)
        nulls = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in keys]
        out = out.unionByName(everything.select(*nulls, F.lit((1 << len(keys)) - 1).cast("long").alias("grouping_id"), "*"))
    return out


def bitwise(kind: str, value: str) -> Column:
    return {"and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor}[kind](value)


def max_enum(label: str, order: Sequence[str]) -> Column:
    """max() over an enum: by declaration, not by label."""
    return F.max_by(label, F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label)))


def by_key(df: DataFrame, keys: Sequence[str], dependent: Sequence[str], *aggregates: Column) -> DataFrame:
    """GROUP BY a primary key: columns that depend on it come along without being grouped by."""
    return df.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in dependent], *aggregates)
