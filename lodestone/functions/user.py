"""User-defined functions: scalar, aggregate and table functions, strictness, domains, and SQL routines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict(function: Callable[..., Column]) -> Callable[..., Column]:
    """STRICT: NULL if any argument is NULL."""

    def call(*args: Column) -> Column:
        none = F.lit(False)
        for a in args:
            none = none | a.isNull()
        return F.when(~none, function(*args))

    return call


def domain(value: Column, check: Column, name: str) -> Column:
    """A value of a domain: NULL passes a CHECK, false is an error."""
    return F.when(F.coalesce(check, F.lit(True)), value).otherwise(F.raise_error(F.lit(f"value for domain {name} violates check constraint")))


@F.pandas_udf(T.DoubleType())
def geometric_mean(v: pd.Series) -> float:
    """A user aggregate: the geometric mean of the positive values."""
    import numpy as np

    v = v[v > 0]
    return float(np.exp(np.log(v).mean())) if len(v) else float("nan")


@F.pandas_udf(T.StringType())
def normalised(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """normalize(text, NFC)."""
    import unicodedata

    for part in text:
        yield part.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.udtf(returnType=T.StructType([T.StructField("position", T.IntegerType()), T.StructField("word", T.StringType())]))
class Words:
    """A table function: the words of a text with their places."""

    def eval(self, text: str):
        for k, w in enumerate((text or "").split(), 1):
            yield k, w


def create_functions(spark: SparkSession) -> None:
    """Routines in SQL: a scalar function with a default, and a table function."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION price_with_tax(price DOUBLE, tax DOUBLE DEFAULT 0.1) RETURNS DOUBLE RETURN price * (1 + tax)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION squares(n INT) RETURNS TABLE (i INT, square INT) RETURN SELECT id, id * id FROM explode(sequence(1, n)) AS s(id)")


def sum_to(spark: SparkSession, n: int) -> int:
    """A block with a loop, as a script."""
    rows = spark.sql(f"BEGIN DECLARE i INT DEFAULT 0; DECLARE total INT DEFAULT 0; WHILE i < {int(n)} DO SET i = i + 1; SET total = total + i; END WHILE; SELECT total; END").collect()
    return rows[0][0]


def least_of(*values: Column) -> Column:
    """A VARIADIC, polymorphic function: the least of any number of values of one type; NULLs are skipped."""
    return F.least(*values) if len(values) > 1 else values[0]


def first_given(*values: Column) -> Column:
    """Polymorphic: the first value that is not NULL, of the type of its arguments."""
    return F.coalesce(*values)
