"""Window frames that Spark has no syntax for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, aggregate: Column, partition: Sequence[str], order: Sequence[Column], start: int, end: int, name: str) -> DataFrame:
    """aggregate OVER (... GROUPS BETWEEN start AND end): offsets count peer groups."""
    group = f"{name}__group"
    ranked = df.withColumn(group, F.dense_rank().over(W.partitionBy(*partition).orderBy(*order)))
    return ranked.withColumn(name, aggregate.over(W.partitionBy(*partition).orderBy(group).rangeBetween(start, end))).drop(group)


def excluding(df: DataFrame, value: str, partition: Sequence[str], order: Sequence[Column], frame: Callable, exclude: str, name: str) -> DataFrame:
    """sum(value) OVER (... frame EXCLUDE CURRENT ROW | GROUP | TIES), NULL for an empty frame.

    ``frame`` takes an ordered window and bounds it; the frame must hold the current row's
    peers, as one that starts unbounded and ends unbounded or at the current group does.
    """
    full = frame(W.partitionBy(*partition).orderBy(*order))
    peers = W.partitionBy(*partition, f"{name}__group")
    ranked = df.withColumn(f"{name}__group", F.dense_rank().over(W.partitionBy(*partition).orderBy(*order)))
    own, one = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("long")
    total, n = F.coalesce(F.sum(value).over(full), F.lit(0)), F.count(value).over(full)
    group, n_group = F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)
    gone, n_gone = {"current row": (own, one), "group": (group, n_group), "ties": (group - own, n_group - one)}[exclude]
    return ranked.withColumn(name, F.when(n - n_gone > 0, total - gone)).drop(f"{name}__group")


def count_distinct_over(value: str, *partition: str) -> Column:
    """count(DISTINCT value) OVER (PARTITION BY ...): the highest dense rank of the values, without collecting a set."""
    own = W.partitionBy(*partition)
    ranks = F.dense_rank().over(own.orderBy(F.col(value).asc_nulls_last()))
    nulls = F.max(F.col(value).isNull().cast("int")).over(own)
    return (F.max(ranks).over(own) - nulls).cast("long")


def filtered(aggregate: Callable[[Column], Column], condition: Column, value: Column, window) -> Column:
    """aggregate(value) FILTER (WHERE condition) OVER window."""
    return aggregate(F.when(condition, value)).over(window)
