"""Aggregation, grouping sets and distinct."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import money
from ..registry import query
from ..sources.tables import table


@query("agg_count", "SELECT COUNT(*) AS n, COUNT(k) AS some FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 1 END AS k FROM orders) t")
def agg_count(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", None).otherwise(1)).alias("some"))


@query(
    "agg_basic",
    """SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o_totalprice), 4) AS a,
    MIN(o_totalprice) AS lo, MAX(o_orderpriority) AS hi, CAST(SUM(o_custkey) AS BIGINT) AS i FROM orders""",
)
def agg_basic(spark, d):
    total = F.sum(money("o_totalprice")).cast("double")
    return table(spark, d, "orders").agg(
        total.alias("s"), F.round(total / F.count("o_totalprice"), 4).alias("a"), F.min("o_totalprice").alias("lo"), F.max("o_orderpriority").alias("hi"), F.sum("o_custkey").alias("i")
    )


@query("agg_avg", "SELECT o_orderstatus, AVG(o_custkey) AS a FROM orders GROUP BY o_orderstatus")
def agg_avg(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.avg("o_custkey").alias("a"))


@query("agg_count_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, COUNT(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
def agg_count_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n"), F.countDistinct("o_orderpriority").alias("p"))


@query("agg_sum_distinct", "SELECT l_returnflag, CAST(SUM(DISTINCT l_suppkey) AS BIGINT) AS s, AVG(DISTINCT l_suppkey) AS a FROM lineitem GROUP BY l_returnflag")
def agg_sum_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum_distinct("l_suppkey").alias("s"), F.expr("avg(DISTINCT l_suppkey)").alias("a"))


@query("agg_stddev", "SELECT c_mktsegment, ROUND(STDDEV_SAMP(c_nationkey), 6) AS s, ROUND(STDDEV_SAMP(c_nationkey) / AVG(c_nationkey), 6) AS cv FROM customer GROUP BY c_mktsegment")
def agg_stddev(spark, d):
    s = F.stddev_samp("c_nationkey")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(s, 6).alias("s"), F.round(s / F.avg("c_nationkey"), 6).alias("cv"))


@query("agg_global", "SELECT COUNT(*) AS n, MIN(c_custkey) AS lo, MAX(c_custkey) AS hi FROM customer WHERE c_custkey < 0")
def agg_global(spark, d):
    """Without keys there is one row, also over no rows."""
    return table(spark, d, "customer").where("c_custkey < 0").agg(F.count("*").alias("n"), F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))


@query("agg_grouped", "SELECT n_regionkey, COUNT(*) AS n, MIN(n_name) AS lo, MAX(n_name) AS hi FROM nation GROUP BY n_regionkey")
def agg_grouped(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("n_name").alias("lo"), F.max("n_name").alias("hi"))


@query("agg_group_alias", "SELECT substr(c_mktsegment, 1, 1) AS letter, COUNT(*) AS n FROM customer GROUP BY letter")
def agg_group_alias(spark, d):
    return table(spark, d, "customer").groupBy(F.substring("c_mktsegment", 1, 1).alias("letter")).agg(F.count("*").alias("n"))


@query("agg_group_expr", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey % 3 AS k, COUNT(*) AS n FROM orders GROUP BY year(o_orderdate), o_custkey % 3")
def agg_group_expr(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 3).alias("k")).agg(F.count("*").alias("n"))


@query("agg_group_noagg", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
def agg_group_noagg(spark, d):
    return spark.sql("SELECT o_orderstatus, o_orderpriority FROM {o} GROUP BY o_orderstatus, o_orderpriority", o=table(spark, d, "orders"))


@query(
    "agg_expr",
    """SELECT l_returnflag, ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE), 2) AS net,
    ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 4) AS unit FROM lineitem GROUP BY l_returnflag""",
)
def agg_expr(spark, d):
    price, off = money("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum(price * (1 - off)).cast("double"), 2).alias("net"),
        F.round(F.sum(price).cast("double") / F.sum(money("l_quantity")).cast("double"), 4).alias("unit"),
    )


@query(
    "agg_conditional",
    """SELECT o_orderpriority, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, COUNT(*) FILTER (WHERE o_totalprice > 200000) AS high,
    CAST(SUM(CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 0 END) AS BIGINT) AS first_half FROM orders GROUP BY o_orderpriority""",
)
def agg_conditional(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f"), F.count_if(F.col("o_totalprice") > 200000).alias("high"),
        F.sum(F.when(F.month("o_orderdate") <= 6, 1).otherwise(0)).alias("first_half"),
    )


@query("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 400000")
def agg_having(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return rows.where("n > 12 AND top > 400000").select("o_custkey", "n")


@query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


def _by_region(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


_FROM = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _aggs():
    return [F.count("*").alias("n"), F.grouping("r_name").cast("int").alias("g1"), F.grouping("c_mktsegment").cast("int").alias("g2")]


_SELECT = f"SELECT r_name, c_mktsegment, COUNT(*) AS n, CAST(GROUPING(r_name) AS INTEGER) AS g1, CAST(GROUPING(c_mktsegment) AS INTEGER) AS g2 {_FROM}"


@query("agg_rollup", f"{_SELECT} GROUP BY ROLLUP (r_name, c_mktsegment)")
def agg_rollup(spark, d):
    return _by_region(spark, d).rollup("r_name", "c_mktsegment").agg(*_aggs())


@query("agg_cube", f"{_SELECT} GROUP BY CUBE (r_name, c_mktsegment)")
def agg_cube(spark, d):
    return _by_region(spark, d).cube("r_name", "c_mktsegment").agg(*_aggs())


@query("agg_grouping_sets", f"{_SELECT} GROUP BY GROUPING SETS ((r_name), (c_mktsegment), ())")
def agg_grouping_sets(spark, d):
    keys = [F.col("r_name"), F.col("c_mktsegment")]
    return _by_region(spark, d).groupingSets([[keys[0]], [keys[1]], []], *keys).agg(*_aggs())
