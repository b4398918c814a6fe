"""Windows, deduplication, joins and upserts on streams, and change feeds applied to tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import new_folder


def event_stream(spark: SparkSession, path: str, max_files: int = 8) -> DataFrame:
    """The event files as a stream; new files are picked up in later triggers."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{path.rstrip('/')}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need instants


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than ``late`` are dropped in append and update mode."""
    return _windowed(events, F.window("ts", width), late)


def sliding(events: DataFrame, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    return _windowed(events, F.window("ts", width, slide), late)


def _windowed(events: DataFrame, window: Column, late: str) -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts of one user's events with no pause of ``gap``."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of(events: DataFrame, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """One event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of one key where the right event follows the left one within an interval."""
    a = left.withWatermark("ts", late).select(F.col(key).alias("l_key"), F.col("ts").alias("l_ts"), F.col("event_id").alias("l_id"))
    b = right.withWatermark("ts", late).select(F.col(key).alias("r_key"), F.col("ts").alias("r_ts"), F.col("event_id").alias("r_id"))
    return a.join(b, F.expr(f"l_key = r_key AND r_ts > l_ts AND r_ts <= l_ts + INTERVAL {within}"))


def run_complete(stream: DataFrame) -> DataFrame:
    """Runs an aggregation over what is there now; returns its final state as a table."""
    folder = new_folder(stream.sparkSession, "stream")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state")

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/state")


def run_append(stream: DataFrame) -> DataFrame:
    """Runs an appending query over what is there now into an exactly-once file sink; returns the rows."""
    folder = new_folder(stream.sparkSession, "stream")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def latest_changes(changes: DataFrame, keys: Sequence[str], order: str = "lsn") -> DataFrame:
    """The last change of each key: one aggregate, combined before the shuffle."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def apply_changes(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: str = "lsn", op: str = "op") -> DataFrame:
    """The table after its change feed: op is insert, update, delete or truncate; later changes win.

    A truncate ends all rows and all changes before it.
    """
    cut = changes.where(F.col(op) == "truncate").agg(F.max(order)).first()[0]
    if cut is not None:
        table, changes = table.limit(0), changes.where(F.col(order) > cut)
    last = latest_changes(changes.where(F.col(op) != "truncate"), keys, order)
    kept = table.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.where(F.col(op) != "delete").select(*table.columns))


def replicate(changes: DataFrame, keys: Sequence[str], load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str):
    """A subscription: every micro-batch of changes is applied to the stored table."""

    def step(batch: DataFrame, number: int) -> None:
        store(apply_changes(load(), batch, keys), number)

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
