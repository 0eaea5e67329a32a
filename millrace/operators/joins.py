"""Joins of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table
from .relational import asof_join, right_anti, right_semi


def _tables(spark, d, *names):
    return [table(spark, d, n) for n in names]


@query("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark, d):
    n, r = _tables(spark, d, "nation", "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("join_implicit", "SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 0")
def join_implicit(spark, d):
    s, n = _tables(spark, d, "supplier", "nation")
    return s.crossJoin(n).where((s.s_nationkey == n.n_nationkey) & (s.s_acctbal > 0)).select("s_suppkey", "n_name")


@query("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def join_theta(spark, d):
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    on = (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_nationkey") > F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


_SOME = "(SELECT * FROM orders WHERE o_totalprice > 400000)"


def _customers_orders(spark, d, how):
    c, o = _tables(spark, d, "customer", "orders")
    return c.join(o.where("o_totalprice > 400000"), c.c_custkey == o.o_custkey, how)


@query("join_left", f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {_SOME} o ON c_custkey = o_custkey")
def join_left(spark, d):
    return _customers_orders(spark, d, "left").select("c_custkey", "o_orderkey")


@query("join_right", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN {_SOME} o ON c_custkey = o_custkey")
def join_right(spark, d):
    c, o = _tables(spark, d, "customer", "orders")
    return c.where("c_acctbal > 5000").join(o.where("o_totalprice > 400000"), c.c_custkey == o.o_custkey, "right").select("c_custkey", "o_orderkey")


@query("join_full", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c FULL JOIN {_SOME} o ON c_custkey = o_custkey")
def join_full(spark, d):
    c, o = _tables(spark, d, "customer", "orders")
    return c.where("c_acctbal > 5000").join(o.where("o_totalprice > 400000"), c.c_custkey == o.o_custkey, "full").select("c_custkey", "o_orderkey")


@query("join_left_null", "SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def join_left_null(spark, d):
    c, o = _tables(spark, d, "customer", "orders")
    return c.join(o.where("o_totalprice > 300000"), c.c_custkey == o.o_custkey, "left").where("o_orderkey IS NULL").select("c_custkey")


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    r, n = _tables(spark, d, "region", "nation")
    return r.crossJoin(n).select("r_name", "n_name")


@query("join_semi", f"SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM {_SOME} o WHERE o_custkey = c_custkey)")
def join_semi(spark, d):
    return _customers_orders(spark, d, "left_semi").select("c_custkey", "c_name")


@query("join_anti", f"SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_SOME} o WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return _customers_orders(spark, d, "left_anti").select("c_custkey", "c_name")


@query("join_right_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 9000)")
def join_right_semi(spark, d):
    c, o = _tables(spark, d, "customer", "orders")
    return right_semi(c.where("c_acctbal > 9000"), o, c.c_custkey == o.o_custkey).select("o_orderkey", "o_custkey")


@query("join_right_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 1000)")
def join_right_anti(spark, d):
    c, o = _tables(spark, d, "customer", "orders")
    return right_anti(c.where("c_acctbal > 1000"), o, c.c_custkey == o.o_custkey).select("o_orderkey", "o_custkey")


@query(
    "join_using",
    "SELECT k, c_name, n FROM (SELECT c_custkey AS k, c_name FROM customer) c JOIN (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) o USING (k)",
)
def join_using(spark, d):
    c, o = _tables(spark, d, "customer", "orders")
    return c.select(F.col("c_custkey").alias("k"), "c_name").join(o.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")), ["k"])


@query("join_natural", "SELECT n_regionkey, n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r")
def join_natural(spark, d):
    n, r = _tables(spark, d, "nation", "region")
    sql = "SELECT n_regionkey, n_name, r_name FROM {n} NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM {r})"
    return spark.sql(sql, n=n, r=r)


@query(
    "join_nested",
    "SELECT c_custkey, n_name, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey WHERE r_name = 'EUROPE'",
)
def join_nested(spark, d):
    c, n, r = _tables(spark, d, "customer", "nation", "region")
    inner = n.join(r.where("r_name = 'EUROPE'"), n.n_regionkey == r.r_regionkey)
    return c.join(inner, c.c_nationkey == inner.n_nationkey).select("c_custkey", "n_name", "r_name")


@query(
    "join_multiway",
    """SELECT r_name, COUNT(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey
    GROUP BY r_name""",
)
def join_multiway(spark, d):
    l, o, c, n, r, s, p = _tables(spark, d, "lineitem", "orders", "customer", "nation", "region", "supplier", "part")
    rows = (
        l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey).join(s, l.l_suppkey == s.s_suppkey, "left").join(p, l.l_partkey == p.p_partkey, "left")
    )
    return rows.groupBy("r_name").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"))


@query(
    "join_self",
    """SELECT a.o_custkey AS cust, a.o_orderkey AS first, b.o_orderkey AS second FROM orders a JOIN orders b
    ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderpriority <> b.o_orderpriority WHERE a.o_totalprice > 300000 AND b.o_totalprice > 300000""",
)
def join_self(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000")
    a, b = o.alias("a"), o.alias("b")
    on = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & (F.col("a.o_orderpriority") != F.col("b.o_orderpriority"))
    return a.join(b, on).select(F.col("a.o_custkey").alias("cust"), F.col("a.o_orderkey").alias("first"), F.col("b.o_orderkey").alias("second"))


@query(
    "join_or_factor",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#1' AND l_quantity < 10)
    OR (p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20)""",
)
def join_or_factor(spark, d):
    l, p = _tables(spark, d, "lineitem", "part")
    key = p.p_partkey == l.l_partkey
    on = (key & (p.p_brand == "Brand#1") & (l.l_quantity < 10)) | (key & (p.p_brand == "Brand#2") & l.l_quantity.between(10, 20))
    return l.join(p, on).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand")


def _hinted(hint):
    def run(spark, d):
        o, c = _tables(spark, d, "orders", "customer")
        return o.join(c.hint(hint), o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"))

    return run


for _name, _hint in (("hash", "shuffle_hash"), ("merge", "merge")):
    query(f"join_hint_{_name}", "SELECT c_mktsegment, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")(_hinted(_hint))


@query("join_hint_broadcast", "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_hint_broadcast(spark, d):
    """Nations are a fixed list, so their broadcast has a fixed size."""
    c, n = _tables(spark, d, "customer", "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"))


@query(
    "join_asof",
    """SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def join_asof(spark, d):
    """Each purchase with the user's last view before it."""
    (e,) = _tables(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof_join(bought, seen, ["user_id"], "ts", ["view_id", "view_value"]).drop("ts")
