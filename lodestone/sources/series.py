"""A foreign table on the Python data source API: numbers of a range.

Its filters are pushed down where spark.sql.python.filterPushdown.enabled is set; the
reader then narrows the range before any partition is planned.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SeriesReader(DataSourceReader):
    def __init__(self, low: int, high: int, parts: int):
        self.low, self.high, self.parts = low, high, parts

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds on n narrow the range; other filters are left to Spark."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("n",):
                self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("n",):
                self.high = min(self.high, int(f.value) + isinstance(f, LessThanOrEqual))
            elif isinstance(f, EqualTo) and f.attribute == ("n",):
                self.low, self.high = max(self.low, int(f.value)), min(self.high, int(f.value) + 1)
            else:
                yield f

    def partitions(self) -> list[Range]:
        n = max(0, self.high - self.low)
        cuts = [self.low + n * k // self.parts for k in range(self.parts + 1)]
        return [Range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple[int]]:
        return ((n,) for n in range(partition.low, partition.high))


class Series(DataSource):
    """spark.dataSource.register(Series); spark.read.format("series").option("stop", 100).load()."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return "n bigint"

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(int(self.options.get("start", 0)), int(self.options["stop"]), int(self.options.get("parts", 4)))
