"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import new_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """A folder of intermediate Parquet tables of one operator's run.

    ``save`` runs a plan once and returns a frame that reads its rows, so a lost
    executor costs a re-read and not the whole lineage.  The shuffle files of that
    run are let go when the table stands.  ``codec``: what the tables are compressed with, where not as the session says.
    """

    def __init__(self, spark: SparkSession, name: str, codec: str | None = None):
        self.spark, self.codec = spark, codec
        self.root = new_folder(spark, name)
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``by``: a column that parts the table into folders, which ``part`` reads one by one."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path, partitionBy=by, compression=self.codec)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def part(self, df: DataFrame, name: str, by: str, value: int) -> DataFrame:
        """The rows of ``df``, saved as ``name``, in one folder; none where there is no such folder."""
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}").where(F.col(by) == value)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # at exit the JVM may be gone
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of known rows, as one JSON literal: no Python on the executors."""
    import json

    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def running_totals(ws: Workspace, df: DataFrame, by: list[str], order: list[str], value: str, total: str, rows: int, name: str) -> DataFrame:
    """Adds ``total``: the sum of ``value`` over the rows before this one in its ``by`` group.

    ``order[0]`` must be a uniform 64-bit hash.  Its range is cut into about
    ``rows / 1024`` buckets: sums per (group, bucket) are combined map-side, their
    running totals give each bucket's offset, and only rows of one bucket are sorted
    together.  So a group that holds most rows is still spread over all tasks.
    ``df`` must be stored: it is read twice.  ``by`` columns must not be null.
    """
    from pyspark.sql import Window as W

    buckets, b = max(1, rows // 1024), fresh(df, "bucket")
    # the hash order, cut evenly: the top 32 bits, shifted to start at 0
    top = F.shiftright(F.col(order[0]), 32) + F.lit(1 << 31)
    with_b = df.withColumn(b, F.shiftright(top * F.lit(buckets), 32))
    offsets = with_b.groupBy(*by, b).agg(F.sum(value).alias("part"))
    w = W.partitionBy(*by).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = ws.save(offsets.select(*by, b, F.coalesce(F.sum("part").over(w), F.lit(0)).alias("before")), name)
    inner = W.partitionBy(*by, b).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = with_b.join(offsets, [*by, b])
    return joined.withColumn(total, F.col("before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop(b, "before")
