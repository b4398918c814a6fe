"""Recursive unions as DataFrame fixpoints, and tree walks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import new_folder

MOST_STEPS = 1000


def _table(spark: SparkSession, df: DataFrame, root: str, name: str) -> DataFrame:
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, most_steps: int = MOST_STEPS) -> DataFrame:
    """WITH RECURSIVE: ``seed`` UNION [ALL] what ``step`` makes of the rows of the last round, until that is nothing.

    With ``distinct``, rows seen before go (NULLs are equal), so cycles end.  Each round's
    rows are written to the shared folder: the lineage stays one round long.
    """
    spark, root = seed.sparkSession, new_folder(seed.sparkSession, "recursion")
    columns = seed.columns
    work = _table(spark, seed.distinct() if distinct else seed, root, "round0")
    rounds = [work]
    for k in range(1, most_steps + 1):
        new = step(work).select(*columns)
        if distinct:
            seen = rounds[0]
            for r in rounds[1:]:
                seen = seen.unionByName(r)
            new = new.distinct().join(seen.withColumn("seen__", F.lit(1)), [new[c].eqNullSafe(seen[c]) for c in columns], "left_anti")
        work = _table(spark, new, root, f"round{k}")
        if work.isEmpty():
            break
        rounds.append(work)
        if len(rounds) > 32:
            every = rounds[0]
            for r in rounds[1:]:
                every = every.unionByName(r)
            rounds = [_table(spark, every, root, f"all{k}")]
    else:
        raise RuntimeError(f"the recursion has not ended after {most_steps} rounds")
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def connectby(df: DataFrame, key: str, parent: str, start, max_depth: int = 0, delimiter: str = "~") -> DataFrame:
    """Walks the tree from ``start``: key, parent, level, branch; a cycle is an error.  ``max_depth`` 0: all."""
    edges = df.select(F.col(key).cast("string").alias("k"), F.col(parent).cast("string").alias("p"))
    seed = df.sparkSession.range(1).select(F.lit(str(start)).alias(key), F.lit(None).cast("string").alias(parent), F.lit(0).alias("level"), F.lit(str(start)).alias("branch"))

    def down(work: DataFrame) -> DataFrame:
        below = work.join(edges, F.col(key) == F.col("p"))
        if max_depth:
            below = below.where(F.col("level") < max_depth)
        cycle = F.array_contains(F.split("branch", delimiter), F.col("k"))
        named = F.when(cycle, F.raise_error(F.lit("infinite recursion detected"))).otherwise(F.col("k"))
        return below.select(named.alias(key), F.col("p").alias(parent), (F.col("level") + 1).alias("level"), F.concat_ws(delimiter, "branch", "k").alias("branch"))

    return recursive_union(seed, down, distinct=False)
