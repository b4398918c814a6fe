"""A small helper to register a query together with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """``t.lineitem`` reads that table of ``sf_dir``; ``t.sql`` runs SQL with the tables as views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, query: str, *names: str, **args) -> DataFrame:
        """Tables in braces, as in ``SELECT * FROM {orders}``, are read from the folder."""
        frames = {n: getattr(self, n) for n in TABLES if f"{{{n}}}" in query}
        return self.spark.sql(query, args=args or None, **frames)


class Pairs:
    """Queries and SQL by name."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(build: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if sql:
                self.oracle[name] = sql
            return build

        return keep

    def same(self, name: str, sql: str, oracle: str | None = None) -> None:
        """One SQL text for both engines: tables stand in braces.  ``oracle``: where the dialects differ."""
        self.queries[name] = lambda spark, sf_dir: Tables(spark, sf_dir).sql(sql)
        plain = oracle or sql
        for n in TABLES:
            plain = plain.replace(f"{{{n}}}", n)
        self.oracle[name] = plain
