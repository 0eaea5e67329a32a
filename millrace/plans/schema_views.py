"""information_schema: what the catalogue knows, as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NAMED = re.compile(r"('(?:[^'\\]|\\.|'')*')|\binformation_schema\s*\.\s*(schemata|tables|views|columns)\b", re.I)

COLUMNS = {
    "schemata": "catalog_name string, schema_name string",
    "tables": "table_catalog string, table_schema string, table_name string, table_type string",
    "views": "table_catalog string, table_schema string, table_name string",
    "columns": "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string",
}


def schema_view(spark: SparkSession, name: str) -> DataFrame:
    """One of the tables of information_schema; a row for each database, table, view or column of the current catalogue."""
    catalog = spark.catalog
    home = catalog.currentCatalog()
    if name == "schemata":
        return spark.createDataFrame([(home, d.name) for d in catalog.listDatabases()], COLUMNS[name])
    found = {}
    for database in catalog.listDatabases():
        for t in catalog.listTables(database.name):
            found[(t.namespace[0] if t.namespace else "", t.name)] = t
    rows = []
    for (database, table), t in sorted(found.items()):
        view = t.isTemporary or t.tableType == "VIEW"
        if name == "tables":
            rows.append((home, database, table, "VIEW" if view else "BASE TABLE"))
        elif name == "views" and view:
            rows.append((home, database, table))
        elif name == "columns":
            schema = spark.table(f"`{database}`.`{table}`" if database else f"`{table}`").schema
            rows += [(home, database, table, f.name, i, "YES" if f.nullable else "NO", f.dataType.simpleString()) for i, f in enumerate(schema.fields, 1)]
    return spark.createDataFrame(rows, COLUMNS[name])


def with_schema_views(spark: SparkSession, statement: str) -> str:
    """The statement with the tables of information_schema that it names registered under names that Spark resolves."""

    def put(m: re.Match) -> str:
        if m[1]:
            return m[1]
        name = m[2].lower()
        views[name] = f"information_schema_{name}"
        return views[name]

    views: dict[str, str] = {}
    out = _NAMED.sub(put, statement)
    made = {name: schema_view(spark, name) for name in views}  # before any of them is a table itself
    for name, df in made.items():
        df.createOrReplaceTempView(views[name])
    return out
