"""Queries of the statement layer: EXPLAIN and ANALYZE."""

from __future__ import annotations

import uuid

from ..registry import query
from ..sources.tables import table
from .statements import analyze, explain, run
from .statistics import profile


@query("explain_plan")
def explain_plan(spark, d):
    for name in ("nation", "region"):
        table(spark, d, name).createOrReplaceTempView(f"explain_plan_{name}")
    return explain(spark, "SELECT r_name, COUNT(*) AS n FROM explain_plan_nation JOIN explain_plan_region ON n_regionkey = r_regionkey GROUP BY r_name")


_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("analyze_table", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(DISTINCT {c}) AS n_distinct, COUNT(*) - COUNT({c}) AS n_null, CAST(MIN({c}) AS VARCHAR) AS least, CAST(MAX({c}) AS VARCHAR) AS greatest FROM customer"
    for c in _COLUMNS
))
def analyze_table(spark, d):
    table(spark, d, "customer").select(*_COLUMNS).createOrReplaceTempView("analyze_table_customer")
    return analyze(spark, "analyze_table_customer")


@query("show_databases", "SELECT 'default' AS namespace")
def show_databases(spark, d):
    return run(spark, "SHOW DATABASES LIKE 'default'")


@query("information_schema_columns", "SELECT column_name, ordinal_position FROM information_schema.columns WHERE table_name = 'customer'")
def information_schema_columns(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("information_schema_customer")
    return run(spark, 'SELECT column_name, ordinal_position FROM information_schema.columns WHERE "table_name" = \'information_schema_customer\'')


@query("create_insert_drop", "SELECT r_regionkey, r_name, n FROM (SELECT r_regionkey, r_name, COUNT(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name) t")
def create_insert_drop(spark, d):
    """A stored table made, filled and dropped by one text of statements; its few rows (one a region) are taken before."""
    name = f"made_{uuid.uuid4().hex}"
    for t in ("region", "nation"):
        table(spark, d, t).createOrReplaceTempView(f"create_{t}")
    run(spark, f"""CREATE TABLE {name} (r_regionkey BIGINT, r_name STRING, n BIGINT) USING parquet;
        INSERT INTO {name} SELECT r_regionkey, r_name, COUNT(*) FROM create_region JOIN create_nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
    rows = run(spark, f"SELECT * FROM {name}")
    out = spark.createDataFrame(rows.collect(), rows.schema)
    run(spark, f"DROP TABLE {name}")
    return out


_LINE_COLUMNS = ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate')


@query("profile_table", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(DISTINCT {c}) AS n_distinct, COUNT(*) - COUNT({c}) AS n_null FROM lineitem" for c in _LINE_COLUMNS
))
def profile_table(spark, d):
    """Statistics of all columns, in one aggregation."""
    stats = profile(table(spark, d, "lineitem"))
    rows = [(c, stats.rows, s.distinct, s.nulls) for c, s in stats.columns.items()]
    return spark.createDataFrame(rows, "column_name string, n_rows long, n_distinct long, n_null long")
