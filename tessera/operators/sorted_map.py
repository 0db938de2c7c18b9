"""A persistent sorted map: rows of unique keys, range-partitioned and sorted in Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SortedMap:
    def __init__(self, rows: DataFrame, key: str = "key"):
        self.rows, self.key = rows, key

    @classmethod
    def write(cls, rows: DataFrame, path: str, key: str = "key", files: int = 8) -> SortedMap:
        """Keys are ascending over the files and in each, so files and row groups are pruned by their bounds."""
        rows.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
        return cls.open(rows.sparkSession, path, key)

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str = "key") -> SortedMap:
        return cls(spark.read.parquet(path), key)

    def find(self, *keys) -> DataFrame:
        """The rows of some keys; a key that isn't there has none."""
        return self.rows.where(F.col(self.key).isin(*keys)) if keys else self.rows.where("false")

    def find_all(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in a table."""
        return self.rows.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def __contains__(self, key) -> bool:
        return not self.find(key).isEmpty()

    def ordered(self) -> DataFrame:
        return self.rows.orderBy(self.key)

    def size(self) -> int:
        return self.rows.count()

    @staticmethod
    def merge(maps: list[SortedMap], policy: dict[str, Callable[[Column], Column]]) -> SortedMap:
        """The union of maps; values of one key are put together by an aggregate for each column."""
        rows, key = maps[0].rows, maps[0].key
        for m in maps[1:]:
            rows = rows.unionByName(m.rows)
        return SortedMap(rows.groupBy(key).agg(*(f(F.col(c)).alias(c) for c, f in policy.items())), key)
