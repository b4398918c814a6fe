"""COPY, file tables, stored query results and cursors, on Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Stands for a quoted empty field while a file is read.
_EMPTY = "\x01empty\x01"


def copy_from(spark: SparkSession, path: str, schema: str, *, form: str = "csv", header: bool = False, delimiter: str | None = None, quote: str = '"', escape: str | None = None, null: str | None = None, encoding: str = "UTF-8", force_not_null: Sequence[str] = (), force_null: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """COPY FROM, and file tables: a bad row is an error; ``where`` keeps rows as they come in.

    In CSV an unquoted empty field is NULL; ``force_not_null`` columns read it as an empty
    text, ``force_null`` ones read the null text as NULL even where it is quoted.
    """
    delimiter = delimiter or ("," if form == "csv" else "\t")
    reader = spark.read.schema(schema).option("sep", delimiter).option("header", header).option("encoding", encoding).option("mode", "FAILFAST")
    if form == "csv":
        reader = reader.option("quote", quote).option("escape", escape or quote).option("nullValue", null or "").option("emptyValue", _EMPTY)
    else:
        reader = reader.option("quote", "").option("nullValue", null if null is not None else "\\N")
    df = reader.csv(path)
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    if form == "csv":  # a quoted empty field is a text, not NULL
        df = df.select(*[F.when(F.col(c) == _EMPTY, "").otherwise(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns])
    for c in force_not_null:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(null or "")))
    for c in force_null:
        df = df.withColumn(c, F.when(F.col(c) != (null or ""), F.col(c)))
    return df.where(where) if where is not None else df


def copy_to(df: DataFrame, path: str, *, form: str = "csv", header: bool = False, delimiter: str | None = None, quote: str = '"', null: str | None = None, force_quote: bool = False) -> None:
    """COPY (query) TO."""
    writer = df.write.mode("overwrite").option("sep", delimiter or ("," if form == "csv" else "\t")).option("header", header)
    if form == "csv":
        writer = writer.option("quote", quote).option("escape", quote).option("nullValue", null or "").option("emptyValue", '""').option("quoteAll", force_quote)
    else:
        writer = writer.option("quote", "").option("nullValue", null if null is not None else "\\N")
    writer.csv(path)


def create_table_as(df: DataFrame, name: str, *, with_data: bool = True, if_not_exists: bool = False) -> None:
    """CREATE TABLE AS / SELECT INTO / materialised view."""
    (df if with_data else df.limit(0)).write.mode("ignore" if if_not_exists else "error").saveAsTable(name)


def refresh(spark: SparkSession, name: str, df: DataFrame, *, concurrently: bool = False) -> int | None:
    """REFRESH MATERIALIZED VIEW: replaces the stored rows; concurrently, only if any differ, and tells how many."""
    changed = None
    if concurrently:
        old = spark.table(name)
        changed = old.exceptAll(df).count() + df.exceptAll(old).count()
        if not changed:
            return 0
    df.write.mode("overwrite").saveAsTable(f"{name}__next")
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {name}__next RENAME TO {name}")
    return changed


class Cursor:
    """DECLARE CURSOR over an ordered result: rows come partition by partition, not all at once."""

    def __init__(self, df: DataFrame):
        self._rows: Iterator[Row] = df.toLocalIterator()

    def fetch(self, n: int = 1) -> list[Row]:
        return list(islice(self._rows, n))

    def move(self, n: int) -> int:
        return len(self.fetch(n))


def remote_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Any SQL on a remote server by JDBC; filters and limits on the result are pushed down."""
    return spark.read.format("jdbc").options(url=url, query=query, pushDownPredicate="true", pushDownLimit="true", **options).load()


def remote_table(spark: SparkSession, url: str, table: str, *, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A remote table, read in ranges of ``column`` by as many tasks."""
    ranged = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)} if column else {}
    return spark.read.format("jdbc").options(url=url, dbtable=table, pushDownAggregate="true", **ranged, **options).load()
