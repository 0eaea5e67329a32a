"""Databases, tables and stored Parquet tables over Spark's catalogue, with statistics by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import AlreadyExistsError, NotFoundError, StorageError
from ..plans.statistics import TableStats, profile


class Catalog:
    """Creating what exists and dropping what does not are errors, unless allowed."""

    def __init__(self, spark: SparkSession):
        self.spark, self._stats = spark, {}

    def create_database(self, name: str, if_not_exists: bool = False) -> None:
        if self.spark.catalog.databaseExists(name) and not if_not_exists:
            raise AlreadyExistsError(f"database {name} exists")
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")

    def drop_database(self, name: str, if_exists: bool = False) -> None:
        if not self.spark.catalog.databaseExists(name) and not if_exists:
            raise NotFoundError(f"database {name} does not exist")
        self.spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")

    def databases(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases())

    def tables(self, database: str = "default") -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(database))

    def table_sources(self, database: str = "default") -> dict[str, list[str]]:
        """The files that each table or view reads, by name; none for rows in memory."""
        return {name: sorted(self.spark.table(name).inputFiles()) for name in self.tables(database)}

    def create_table(self, name: str, schema: T.StructType, partition_keys: list[str] | None = None, if_not_exists: bool = False) -> None:
        """An empty stored Parquet table."""
        if self.spark.catalog.tableExists(name):
            if if_not_exists:
                return
            raise AlreadyExistsError(f"table {name} exists")
        writer = self.spark.createDataFrame([], schema).write.format("parquet")
        (writer.partitionBy(*partition_keys) if partition_keys else writer).saveAsTable(name)

    def write_table(self, name: str, rows: DataFrame, mode: str = "append") -> None:
        if not self.spark.catalog.tableExists(name):
            raise StorageError(f"table {name} does not exist")
        columns = self.spark.table(name).columns
        rows.select(*columns).write.mode(mode).insertInto(name, overwrite=mode == "overwrite")
        self._stats.pop(name, None)

    def read_table(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            raise StorageError(f"table {name} does not exist")
        return self.spark.table(name)

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        """Drops a table or temporary view with its statistics."""
        views = {t.name for t in self.spark.catalog.listTables() if t.isTemporary}
        if name in views:
            self.spark.catalog.dropTempView(name)
        elif self.spark.catalog.tableExists(name):
            self.spark.sql(f"DROP TABLE {name}")
        elif not if_exists:
            raise NotFoundError(f"table {name} does not exist")
        self._stats.pop(name, None)

    def schema(self, name: str) -> T.StructType:
        return self.read_table(name).schema

    def analyze(self, name: str) -> TableStats:
        """Collect statistics in one job; stored tables also get Spark's own, for its cost-based optimizer."""
        stats = profile(self.read_table(name))
        self._stats[name] = stats
        if any(t.name == name and not t.isTemporary for t in self.spark.catalog.listTables()):
            self.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
        return stats

    def stats(self, name: str) -> TableStats | None:
        return self._stats.get(name)
