"""Named tables: DataFrames, Parquet folders, temporary views or JDBC."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..plans.text import QueryError


class Catalog:
    """Tables by name; a value is a DataFrame or a function that gives one when it is first asked for."""

    def __init__(self, spark: SparkSession | None, tables: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self.spark, self.tables = spark, dict(tables or {})

    @staticmethod
    def parquet(spark: SparkSession, folder: str, names: tuple[str, ...]) -> Catalog:
        return Catalog(spark, {n: (lambda n=n: spark.read.parquet(f"{folder}/{n}.parquet")) for n in names})

    @staticmethod
    def jdbc(spark: SparkSession, url: str, names: tuple[str, ...], partitions: Mapping[str, tuple[str, object, object, int]] | None = None, **options: str) -> Catalog:
        """Tables of a database. ``partitions`` has (column, lowest, highest, number) for tables that
        are read in several ranges of a column at once; others are read by one task."""

        def read(name: str) -> DataFrame:
            r = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
            if name in (partitions or {}):
                column, low, high, n = partitions[name]
                r = r.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
            return r.load()

        return Catalog(spark, {n: (lambda n=n: read(n)) for n in names})

    def table(self, name: str) -> DataFrame:
        found = self.tables.get(name)
        if found is None:
            if self.spark is None or not self.spark.catalog.tableExists(name):
                raise QueryError(f"unknown table {name!r}")
            found = self.spark.table(name)
        if not isinstance(found, DataFrame) and callable(found):
            found = found()
        self.tables[name] = found
        return found
