"""Catalogue, sources, statements and statistics."""

import pytest
from pyspark.sql import types as T

from millrace.errors import CatalogError, StatementError, StorageError
from millrace.plans import statements
from millrace.plans.statistics import equality_selectivity, join_rows, join_selectivity, profile, range_selectivity
from millrace.sources import tables
from millrace.sources.catalog import Catalog

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType())])
ROWS = [(1, "alice"), (2, "bob"), (3, "charlie"), (4, None), (5, "alice"), (6, "dave"), (7, "eve"), (8, None)]


def test_catalog_life_cycle(spark):
    c = Catalog(spark)
    c.create_table("life", SCHEMA)
    with pytest.raises(CatalogError):
        c.create_table("life", SCHEMA)
    c.create_table("life", SCHEMA, if_not_exists=True)
    assert "life" in c.tables() and c.read_table("life").count() == 0
    c.write_table("life", spark.createDataFrame(ROWS, SCHEMA))
    c.write_table("life", spark.createDataFrame([(9, "x")], SCHEMA))
    assert c.read_table("life").count() == 9
    c.write_table("life", spark.createDataFrame(ROWS, SCHEMA), mode="overwrite")
    assert c.analyze("life").rows == 8 and c.stats("life").columns["id"].distinct == 8
    assert "rowCount=8" in spark.sql("EXPLAIN COST SELECT * FROM life").first()[0]
    c.drop_table("life")
    assert c.stats("life") is None and "life" not in c.tables()
    with pytest.raises(CatalogError):
        c.drop_table("life")
    c.drop_table("life", if_exists=True)
    for call in (lambda: c.read_table("life"), lambda: c.write_table("life", spark.createDataFrame(ROWS, SCHEMA))):
        with pytest.raises(StorageError):
            call()


def test_partitioned_table_prunes(spark):
    c = Catalog(spark)
    c.create_table("parts", SCHEMA, partition_keys=["name"])
    c.write_table("parts", spark.createDataFrame(ROWS, SCHEMA))
    assert "PartitionFilters: [isnotnull(name" in statements.explain_plan(spark.table("parts").where("name = 'bob'"))
    assert spark.table("parts").where("name = 'alice'").count() == 2
    c.drop_table("parts")


def test_databases(spark):
    c = Catalog(spark)
    c.create_database("extra")
    with pytest.raises(CatalogError):
        c.create_database("extra")
    assert {"default", "extra"} <= set(c.databases())
    c.drop_database("extra")
    with pytest.raises(CatalogError):
        c.drop_database("extra")


def test_statistics(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    s = profile(df)
    assert (s.rows, s.columns["id"].distinct, s.columns["name"].distinct, s.columns["name"].nulls) == (8, 8, 5, 2)
    assert (s.columns["name"].least, s.columns["name"].greatest, s.columns["id"].greatest) == ("alice", "eve", 8)
    assert profile(df.where("id < 0")).rows == 0 and profile(df.where("id < 0")).columns == {}
    other = profile(spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 5] * 2], "customer_id long"))
    assert join_selectivity(s.columns["id"], other.columns["customer_id"]) == 0.125
    assert join_rows(s, other, "id", "customer_id") == 10
    assert equality_selectivity(s.columns["id"]) == 0.125 and range_selectivity(s.columns["id"], 1, 4.5) == 0.5
    numbers = profile(spark.createDataFrame([(10,), (9,)], "k long"))
    assert (numbers.columns["k"].least, numbers.columns["k"].greatest) == (9, 10)  # typed, not as text


def test_statements(spark):
    assert statements.split("SELECT ';' AS a; -- x;\nSELECT 2 /* ; */;") == ["SELECT ';' AS a", "SELECT 2"]
    assert statements.run(spark, "SELECT 1 AS a; SELECT 2 AS a").first().a == 2
    with pytest.raises(StatementError):
        statements.run(spark, " ; ")
    spark.createDataFrame(ROWS, SCHEMA).createOrReplaceTempView("people")
    got = {r.column_name: r for r in statements.run(spark, "ANALYZE TABLE people").collect()}
    assert got["name"].n_null == 2 and got["id"].n_distinct == 8
    plan = "\n".join(r.plan for r in statements.run(spark, "EXPLAIN SELECT name, COUNT(*) FROM people GROUP BY name").collect())
    assert "Aggregate" in plan and "Exchange" in plan
    assert statements.run(spark, "SHOW TABLES").where("tableName = 'people'").count() == 1
    statements.run(spark, "CREATE TABLE made (a INT) USING parquet; INSERT INTO made VALUES (1), (2); ")
    assert statements.run(spark, "SELECT SUM(a) AS s FROM made").first().s == 3
    statements.run(spark, "DROP TABLE IF EXISTS made")


def test_sources(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "region.csv").write_text("r_regionkey,r_name,r_comment\n0,AFRICA,x\n1,ASIA,\n")
    (tmp_path / "nation.dat").write_text("n_nationkey,n_name\n0,A\n")
    assert tables.load_directory(spark, str(tmp_path), ["region", "nation", "store"]) == ["region", "nation"]
    assert spark.table("region").count() == 2
    typed = tables.read_csv(spark, str(tmp_path / "region.csv"), tables.TPCH_SCHEMAS["region"])
    assert typed.dtypes[0] == ("r_regionkey", "bigint") and typed.count() == 2
    for i in range(2):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"p{i}.csv").write_text(f"a|b\n{i}|x\n")
    assert tables.register_csv(spark, "many", str(tmp_path / "many"), delimiter="|").count() == 2
    data = pa.table({"id": [1, 2]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema) as w:
        w.write_table(data)
    assert tables.register_arrow(spark, "from_ipc", sink.getvalue().to_pybytes()).count() == 2
    assert tables.register_arrow(spark, "from_ipc", pa.table({"id": [1]})).count() == 1 == spark.table("from_ipc").count()
    data_path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(data_path)
    assert tables.register_parquet(spark, "p3", data_path).count() == 3


def test_error_kinds(spark):
    from millrace import errors as e

    for kind, sql in ((e.ParseError, "SELEC 1"), (e.NotFoundError, "SELECT * FROM not_there"), (e.PlanningError, "SELECT nope FROM (SELECT 1 AS a)"), (e.SourceError, "SELECT * FROM parquet.`/not/there`")):
        with pytest.raises(kind):
            statements.run(spark, sql)
    statements.run(spark, "CREATE TABLE twice_made (a INT) USING parquet")
    with pytest.raises(e.AlreadyExistsError):
        statements.run(spark, "CREATE TABLE twice_made (a INT) USING parquet")
    statements.run(spark, "DROP TABLE twice_made")


def test_quoted_names_and_schema_views(spark):
    assert statements.run(spark, """SELECT 1 AS "a b", 'it''s "x"' AS "c""d" """).columns == ["a b", 'c"d']
    assert statements.run(spark, """SELECT 'it is "x"' AS c""").first().c == 'it is "x"'
    spark.createDataFrame(ROWS, SCHEMA).createOrReplaceTempView("schema_people")
    got = statements.run(spark, "SELECT column_name, is_nullable, data_type FROM information_schema.columns WHERE table_name = 'schema_people' ORDER BY ordinal_position")
    assert [tuple(r) for r in got.collect()] == [("id", "NO", "bigint"), ("name", "YES", "string")]
    assert statements.run(spark, "SELECT table_type FROM Information_Schema.tables WHERE table_name = 'schema_people'").first()[0] == "VIEW"
    assert statements.run(spark, "SELECT 'information_schema.tables' AS t").first().t == "information_schema.tables"
    assert "default" in {r.schema_name for r in statements.run(spark, "SELECT * FROM information_schema.schemata").collect()}


def test_configuration(tmp_path):
    from millrace.config import Config
    from millrace.errors import ConfigError

    path = tmp_path / "m.toml"
    config = Config(master="local[2]", data_dir='C:\\x "y"', csv={"a b": "p"}, settings={"spark.x": "1"})
    config.save(path)
    assert Config.load(path) == config and config.spark_settings()["spark.x"] == "1"
    for text in ("nope = 1", "app = 3", "app = ", "csv = 'x'"):
        path.write_text(text)
        with pytest.raises(ConfigError):
            Config.load(path)


def test_prompt(spark, capsys):
    from millrace.__main__ import prompt

    assert prompt(spark, "csv", ["SELECT 1 AS a,", "2 AS b;", "SELEC;", "SELECT 3 AS c;", "exit", "SELECT 4 AS d;"]) == 0
    out = capsys.readouterr()
    assert out.out.split() == ["a,b", "1,2", "c", "3"] and out.err.startswith("ParseError")


def test_sources_and_estimates(spark, small):
    from millrace.plans.statistics import group_rows

    tables.register_parquet(spark, "source_region", f"{small}/region.parquet")
    assert Catalog(spark).table_sources()["source_region"][0].endswith("region.parquet")
    s = profile(spark.createDataFrame(ROWS, SCHEMA))
    assert group_rows(s, []) == 1 and group_rows(s, ["name"]) == 6 and group_rows(s, ["id", "name"]) == 8


def test_asof_join(spark):
    from millrace.operators.relational import asof_join

    left = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 5, "z"), (None, 5, "n"), ("a", 5, "y")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 6, 60), ("a", 3, None), (None, 1, 7)], "k string, t int, w int")
    got = sorted((r.k or "", r.t, r.v, r.w) for r in asof_join(left, right, ["k"], "t", ["w"]).collect())
    assert got == [("", 5, "n", None), ("a", 1, "x", None), ("a", 5, "y", 50), ("a", 5, "y", 50), ("b", 5, "z", None)]


def test_settings_and_current_database(spark):
    assert statements.run(spark, "SET spark.millrace.probe = 1; USE default; SELECT current_database() AS d").first().d == "default"
    assert statements.run(spark, "SET spark.millrace.probe").first().value == "1"
    assert statements.run(spark, "SHOW DATABASES").where("namespace = 'default'").count() == 1
