"""Sorts, limits, set operations and window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import asc_last, desc_last, money
from ..registry import query
from ..sources.tables import table
from .relational import top_k, top_k_per_group


@query("sort_multi", "SELECT c_mktsegment AS segment, c_custkey FROM customer ORDER BY segment, c_custkey")
def sort_multi(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey").orderBy(asc_last("segment"), asc_last("c_custkey"))


_K = "SELECT CASE WHEN o_orderkey % 5 > 0 THEN NULL ELSE o_orderkey END AS k, o_orderkey FROM orders"


def _keys(spark, d):
    k = F.when(F.col("o_orderkey") % 5 > 0, F.lit(None)).otherwise(F.col("o_orderkey"))
    return table(spark, d, "orders").select(k.alias("k"), "o_orderkey")


@query("sort_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_desc(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(desc_last("o_totalprice"), asc_last("o_orderkey"))


@query("sort_nulls", f"SELECT k, o_orderkey FROM ({_K}) t ORDER BY k NULLS FIRST, o_orderkey DESC")
def sort_nulls(spark, d):
    return _keys(spark, d).orderBy(F.col("k").asc_nulls_first(), desc_last("o_orderkey"))


@query("sort_nulls_last", f"SELECT k, o_orderkey FROM ({_K}) t ORDER BY k NULLS LAST, o_orderkey")
def sort_nulls_last(spark, d):
    return _keys(spark, d).orderBy(asc_last("k"), asc_last("o_orderkey"))


@query("sort_expr", "SELECT n_name, n_regionkey FROM nation ORDER BY CASE WHEN n_regionkey = 2 THEN 0 ELSE 1 END, abs(n_nationkey - 12), n_name")
def sort_expr(spark, d):
    first = F.when(F.col("n_regionkey") == 2, 0).otherwise(1)
    return table(spark, d, "nation").orderBy(first, F.abs(F.col("n_nationkey") - 12), "n_name").select("n_name", "n_regionkey")


@query("sort_ordinal", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1")
def sort_ordinal(spark, d):
    return spark.sql("SELECT c_mktsegment, COUNT(*) AS n FROM {c} GROUP BY 1 ORDER BY 2 DESC, 1", c=table(spark, d, "customer"))


@query("limit_offset", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
def limit_offset(spark, d):
    return top_k(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [asc_last("o_orderkey")], 10, 25)


@query("topk", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def topk(spark, d):
    return top_k(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [desc_last("c_acctbal"), asc_last("c_custkey")], 10)


_A = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0"
_B = "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 20"


def _sides(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    return a, table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").alias("k"))


@query("union_all", f"{_A} UNION ALL {_B}")
def union_all(spark, d):
    a, b = _sides(spark, d)
    return a.unionAll(b)


@query("union_distinct", f"{_A} UNION {_B}")
def union_distinct(spark, d):
    a, b = _sides(spark, d)
    return a.union(b).distinct()


@query("intersect", f"{_A} INTERSECT {_B}")
def intersect(spark, d):
    a, b = _sides(spark, d)
    return a.intersect(b)


@query("except", f"{_A} EXCEPT {_B}")
def except_(spark, d):
    a, b = _sides(spark, d)
    return a.subtract(b)


@query("intersect_all", f"{_A} INTERSECT ALL {_B}")
def intersect_all(spark, d):
    a, b = _sides(spark, d)
    return a.intersectAll(b)


@query("except_all", f"{_A} EXCEPT ALL {_B}")
def except_all(spark, d):
    a, b = _sides(spark, d)
    return a.exceptAll(b)


_SALES = """(SELECT p_type, p_brand, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sales
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type, p_brand)"""


def _sales(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return l.join(p, l.l_partkey == p.p_partkey).groupBy("p_type", "p_brand").agg(F.sum(money("l_extendedprice")).cast("double").alias("sales"))


@query("window_rank", f"SELECT p_type, p_brand, CAST(RANK() OVER (PARTITION BY p_type ORDER BY sales DESC) AS INTEGER) AS r FROM {_SALES} t")
def window_rank(spark, d):
    return _sales(spark, d).select("p_type", "p_brand", F.rank().over(Window.partitionBy("p_type").orderBy(desc_last("sales"))).alias("r"))


@query("window_rank_global", f"SELECT p_type, p_brand, CAST(RANK() OVER (ORDER BY sales DESC) AS INTEGER) AS r FROM {_SALES} t")
def window_rank_global(spark, d):
    """Ranks over the aggregate, a row per type and brand, so the one partition stays small at any scale."""
    return _sales(spark, d).select("p_type", "p_brand", F.rank().over(Window.orderBy(desc_last("sales"))).alias("r"))


@query("window_ratio", f"SELECT p_type, p_brand, ROUND(sales * 100 / NULLIF(CAST(SUM(CAST(sales AS DECIMAL(18,2))) OVER (PARTITION BY p_type) AS DOUBLE), 0), 4) AS share FROM {_SALES} t")
def window_ratio(spark, d):
    total = F.sum(money("sales")).over(Window.partitionBy("p_type")).cast("double")
    return _sales(spark, d).select("p_type", "p_brand", F.round(F.col("sales") * 100 / F.nullif(total, F.lit(0.0)), 4).alias("share"))


@query(
    "window_avg",
    f"""SELECT p_type, p_brand, ROUND(sales - CAST(SUM(CAST(sales AS DECIMAL(18,2))) OVER (PARTITION BY p_type) AS DOUBLE) / COUNT(*) OVER (PARTITION BY p_type), 2) AS above FROM {_SALES} t""",
)
def window_avg(spark, d):
    w = Window.partitionBy("p_type")
    mean = F.sum(money("sales")).over(w).cast("double") / F.count("*").over(w)
    return _sales(spark, d).select("p_type", "p_brand", F.round(F.col("sales") - mean, 2).alias("above"))


_DAYS = """(SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS price FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE))"""


def _days(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(money("o_totalprice")).alias("price"))


_ROWS = "PARTITION BY o_custkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _running():
    return Window.partitionBy("o_custkey").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)


@query("window_running_sum", f"SELECT o_custkey, day, CAST(SUM(price) OVER ({_ROWS}) AS DOUBLE) AS total FROM {_DAYS} t")
def window_running_sum(spark, d):
    return _days(spark, d).select("o_custkey", "day", F.sum("price").over(_running()).cast("double").alias("total"))


@query("window_running_max", f"SELECT o_custkey, day, CAST(MAX(price) OVER ({_ROWS}) AS DOUBLE) AS top FROM {_DAYS} t")
def window_running_max(spark, d):
    return _days(spark, d).select("o_custkey", "day", F.max("price").over(_running()).cast("double").alias("top"))


@query("window_lag_lead", f"SELECT o_custkey, day, CAST(LAG(price) OVER w AS DOUBLE) AS before, CAST(LEAD(price, 2) OVER w AS DOUBLE) AS after FROM {_DAYS} t WINDOW w AS (PARTITION BY o_custkey ORDER BY day)")
def window_lag_lead(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("day")
    return _days(spark, d).select("o_custkey", "day", F.lag("price").over(w).cast("double").alias("before"), F.lead("price", 2).over(w).cast("double").alias("after"))


@query(
    "window_row_number",
    """SELECT c_custkey, CAST(ROW_NUMBER() OVER w AS INTEGER) AS rn, CAST(DENSE_RANK() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS INTEGER) AS dr,
    CAST(NTILE(4) OVER w AS INTEGER) AS quarter FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey)""",
)
def window_row_number(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy("c_custkey")
    dense = F.dense_rank().over(Window.partitionBy("c_mktsegment").orderBy("c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(w).alias("rn"), dense.alias("dr"), F.ntile(4).over(w).alias("quarter"))


@query("window_topn", "SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2")
def window_topn(spark, d):
    return top_k_per_group(table(spark, d, "orders"), ["o_custkey"], [desc_last("o_totalprice"), asc_last("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rn")


_MONTHS = "(SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, COUNT(*) AS n FROM orders GROUP BY 1, 2)"


@query(
    "window_neighbours",
    f"""WITH r AS (SELECT p, m, n, RANK() OVER (PARTITION BY p ORDER BY m) AS k FROM {_MONTHS} t)
    SELECT a.p, a.m, a.n, b.n AS before, c.n AS after FROM r a JOIN r b ON a.p = b.p AND a.k = b.k + 1 JOIN r c ON a.p = c.p AND a.k = c.k - 1""",
)
def window_neighbours(spark, d):
    """Neighbouring rows by lag and lead, in one pass instead of two self-joins."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderdate").cast("date").alias("x").substr(1, 7).alias("ym")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("p").orderBy("ym")
    out = rows.select("p", F.to_date(F.concat("ym", F.lit("-01"))).alias("m"), "n", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"))
    return out.where("before IS NOT NULL AND after IS NOT NULL")


@query(
    "window_rollup_rank",
    """SELECT r_name, n_name, n, g, CAST(RANK() OVER (PARTITION BY g, CASE WHEN g < 2 THEN r_name END ORDER BY n DESC, n_name, r_name) AS INTEGER) AS r FROM
    (SELECT r_name, n_name, COUNT(*) AS n, CAST(GROUPING(r_name) + GROUPING(n_name) AS INTEGER) AS g FROM customer JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)) t""",
)
def window_rollup_rank(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name")
    rows = rows.agg(F.count("*").alias("n"), (F.grouping("r_name") + F.grouping("n_name")).cast("int").alias("g"))
    w = Window.partitionBy("g", F.when(F.col("g") < 2, F.col("r_name"))).orderBy(desc_last("n"), asc_last("n_name"), asc_last("r_name"))
    return rows.select("r_name", "n_name", "n", "g", F.rank().over(w).alias("r"))
