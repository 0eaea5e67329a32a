"""Queries given as SQL text: CTEs, subqueries, adapted TPC-H and TPC-DS patterns.

One text serves Spark and DuckDB; tables are written in braces.
"""

from __future__ import annotations

import re

from ..registry import query
from ..sources.tables import table


def text(key: str, sql: str, duck: str | None = None, own: str | None = None) -> None:
    """Register a SQL text; ``duck`` where the other engine's dialect differs, ``own`` where ours is to be planned in another way."""
    own = own or sql
    names = sorted(set(re.findall(r"\{(\w+)\}", own)))

    def run(spark, d):
        return spark.sql(own, **{n: table(spark, d, n) for n in names})

    run.__name__ = key
    query(key, re.sub(r"\{(\w+)\}", r"\1", duck or sql))(run)


def not_in(value: str, key: str, rows: str) -> str:
    """``value NOT IN (SELECT key FROM rows)`` by an ordinary anti join.

    As NOT IN it would be a null-aware join, for which the whole subquery is
    broadcast, whatever its size.  One aggregate tells whether it is empty or
    holds a null.
    """
    least = f"(SELECT COUNT(*) FROM {rows} n) = 0 OR {value} IS NOT NULL AND (SELECT COUNT(*) - COUNT({key}) FROM {rows} n) = 0"
    return f"NOT EXISTS (SELECT 1 FROM {rows} n WHERE n.{key} = {value}) AND ({least})"


M = "CAST({} AS DECIMAL(18,2))".format  # amounts: decimal sums do not depend on their order
NET = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"

text("cte_basic", "WITH rich AS (SELECT c_custkey, c_nationkey FROM {customer} WHERE c_acctbal > 8000) SELECT n_name, COUNT(*) AS n FROM rich JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
text("cte_chain", """WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS customers FROM a GROUP BY n),
    c AS (SELECT x.n, x.customers FROM (WITH inside AS (SELECT * FROM b WHERE customers > 1) SELECT * FROM inside) x) SELECT n, customers FROM c""")
text("cte_reuse", f"""WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS yr, SUM({M('o_totalprice')}) AS s FROM {{orders}} GROUP BY 1, 2)
    SELECT a.k, CAST(a.s AS DOUBLE) AS s96, CAST(b.s AS DOUBLE) AS s97, CAST(c.s AS DOUBLE) AS s98 FROM y a JOIN y b ON a.k = b.k AND b.yr = 1997 JOIN y c ON a.k = c.k AND c.yr = 1998
    WHERE a.yr = 1996 AND b.s > a.s""")
text("derived_table", "SELECT k, n FROM (SELECT o_custkey, COUNT(*) FROM {orders} GROUP BY o_custkey) AS t(k, n) WHERE n > 14")
text("subq_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 400000)")
text("subq_not_in", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)",
    own="SELECT c_custkey FROM {customer} c WHERE " + not_in("c.c_custkey", "o_custkey", "(SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)"))
text("subq_not_in_null", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END FROM {orders})",
    own="SELECT c_custkey FROM {customer} c WHERE " + not_in("c.c_custkey", "k", "(SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS k FROM {orders})"))
text("subq_exists", "SELECT o_orderpriority, COUNT(*) AS n FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY o_orderpriority")
text("subq_not_exists", "SELECT COUNT(*) AS n FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount > 0.05)")
text("subq_exists_or", """SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)
    OR EXISTS (SELECT 1 FROM {events} e WHERE e.user_id = c.c_custkey AND e.event_type = 'purchase')""")
text("subq_exists_neq", """SELECT l1.l_orderkey, l1.l_linenumber, l1.l_suppkey, l1.l_partkey FROM {lineitem} l1 WHERE l1.l_quantity > 49
    AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)""")
text("subq_scalar", "SELECT c_custkey FROM {customer} WHERE c_acctbal > (SELECT MAX(c_acctbal) - 200 FROM {customer})")
text("subq_scalar_corr", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice >= (SELECT MAX(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
text("subq_corr_or", "SELECT p_partkey FROM {part} p WHERE (SELECT COUNT(*) FROM {part} q WHERE (q.p_brand = p.p_brand AND q.p_size < 5) OR (q.p_brand = p.p_brand AND q.p_type = 'PROMO')) > 3 AND p_size = 7")
text("subq_in_or", "SELECT c_custkey FROM {customer} WHERE c_acctbal < -900 OR c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 480000)")
text("subq_in_nested", "SELECT c_custkey FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey IN (SELECT r_regionkey FROM {region} WHERE r_name IN ('ASIA', 'EUROPE')))")
text("subq_having", "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > (SELECT 1.5 * COUNT(*) / COUNT(DISTINCT o_custkey) FROM {orders})")
text("subq_between", "SELECT p_partkey FROM {part} WHERE p_retailprice BETWEEN (SELECT MIN(p_retailprice) + 20 FROM {part}) AND (SELECT MAX(p_retailprice) - 50 FROM {part})")
text("subq_case", """SELECT CASE WHEN (SELECT COUNT(*) FROM {lineitem} WHERE l_quantity BETWEEN 1 AND 20) > 1000 THEN (SELECT MIN(l_extendedprice) FROM {lineitem} WHERE l_quantity BETWEEN 1 AND 20)
    ELSE (SELECT MAX(l_extendedprice) FROM {lineitem} WHERE l_quantity BETWEEN 1 AND 20) END AS bucket1,
    CASE WHEN (SELECT COUNT(*) FROM {lineitem} WHERE l_quantity > 20) < 1000 THEN 1.5 ELSE 2.5 END * CAST(1 AS DOUBLE) AS bucket2""")
text("stats_profile", """SELECT COUNT(*) AS n_rows, COUNT(DISTINCT o_custkey) AS n_distinct, COUNT(*) - COUNT(o_custkey) AS n_null, MIN(o_custkey) AS least, MAX(o_custkey) AS greatest FROM {orders}""")

# -- TPC-H over the driver's tables; partsupp is derived from lineitem --------
PS = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS ps_availqty, MIN(CAST(l_extendedprice AS DECIMAL(18,2))) AS ps_supplycost FROM {lineitem} GROUP BY l_partkey, l_suppkey)"
text("tpch_q01", f"""SELECT l_returnflag, l_linestatus, CAST(SUM({M('l_quantity')}) AS DOUBLE) AS sum_qty, CAST(SUM({M('l_extendedprice')}) AS DOUBLE) AS sum_base_price,
    ROUND(CAST(SUM({NET}) AS DOUBLE), 2) AS sum_disc_price, ROUND(CAST(SUM({NET} * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS DOUBLE), 2) AS sum_charge,
    ROUND(CAST(SUM({M('l_quantity')}) AS DOUBLE) / COUNT(*), 4) AS avg_qty, ROUND(CAST(SUM({M('l_extendedprice')}) AS DOUBLE) / COUNT(*), 4) AS avg_price,
    ROUND(CAST(SUM(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / COUNT(*), 6) AS avg_disc, COUNT(*) AS count_order
    FROM {{lineitem}} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
text("tpch_q02", f"""SELECT s_acctbal, s_name, n_name, p_partkey FROM {{part}}, {{supplier}}, {PS} ps, {{nation}}, {{region}}
    WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
    AND ps_supplycost = (SELECT MIN(q.ps_supplycost) FROM {PS} q, {{supplier}}, {{nation}}, {{region}} WHERE p_partkey = q.ps_partkey AND s_suppkey = q.ps_suppkey AND s_nationkey = n_nationkey
    AND n_regionkey = r_regionkey AND r_name = 'EUROPE') ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    own=f"""WITH ps AS (SELECT p_partkey, s_suppkey, s_acctbal, s_name, n_name, MIN({M('l_extendedprice')}) AS cost FROM {{lineitem}}, {{part}}, {{supplier}}, {{nation}}, {{region}}
    WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
    GROUP BY p_partkey, s_suppkey, s_acctbal, s_name, n_name)
    SELECT s_acctbal, s_name, n_name, p_partkey FROM (SELECT *, MIN(cost) OVER (PARTITION BY p_partkey) AS least FROM ps) t WHERE cost = least
    ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
text("tpch_q03", f"""SELECT l_orderkey, ROUND(CAST(SUM({NET}) AS DOUBLE), 2) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate FROM {{customer}}, {{orders}}, {{lineitem}}
    WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
text("tpch_q04", """SELECT o_orderpriority, COUNT(*) AS order_count FROM {orders} WHERE o_orderdate >= DATE '1995-07-01' AND o_orderdate < DATE '1995-10-01'
    AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority""")
text("tpch_q05", f"""SELECT n_name, ROUND(CAST(SUM({NET}) AS DOUBLE), 2) AS revenue FROM {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}}
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
    AND r_name = 'ASIA' AND o_orderdate >= DATE '1994-01-01' AND o_orderdate < DATE '1996-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name""")
text("tpch_q06", f"""SELECT ROUND(CAST(SUM({M('l_extendedprice')} * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE), 2) AS revenue FROM {{lineitem}}
    WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND CAST(l_discount AS DECIMAL(4,2)) BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
text("tpch_q07", f"""SELECT supp_nation, cust_nation, l_year, ROUND(CAST(SUM(volume) AS DOUBLE), 2) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year,
    {NET} AS volume FROM {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey
    AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))
    ) shipping GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""")
text("tpch_q08", f"""SELECT o_year, ROUND(CAST(SUM(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) AS DOUBLE) / NULLIF(CAST(SUM(volume) AS DOUBLE), 0), 4) AS mkt_share FROM (
    SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, {NET} AS volume, n2.n_name AS nation FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2, {{region}}
    WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
    AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'STANDARD') all_nations GROUP BY o_year ORDER BY o_year""")
# the parts are few: their lines are aggregated, not all
RED = PS.replace("GROUP BY", "WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_name LIKE '%red%') GROUP BY")
text("tpch_q09", f"""SELECT nation, o_year, ROUND(CAST(SUM(amount) AS DOUBLE), 2) AS sum_profit FROM (SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year,
    {NET} - CAST(ps_supplycost * 0.1 AS DECIMAL(18,4)) AS amount FROM {{part}}, {{supplier}}, {{lineitem}}, {PS} ps, {{orders}}, {{nation}} WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey
    AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%') profit GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    own=f"""SELECT nation, o_year, ROUND(CAST(SUM(amount) AS DOUBLE), 2) AS sum_profit FROM (SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year,
    {NET} - CAST(ps_supplycost * 0.1 AS DECIMAL(18,4)) AS amount FROM {{part}}, {{supplier}}, {{lineitem}}, {RED} ps, {{orders}}, {{nation}} WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey
    AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%') profit GROUP BY nation, o_year ORDER BY nation, o_year DESC""")
text("tpch_q10", f"""SELECT c_custkey, c_name, ROUND(CAST(SUM({NET}) AS DOUBLE), 2) AS revenue, c_acctbal, n_name FROM {{customer}}, {{orders}}, {{lineitem}}, {{nation}}
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1995-10-01' AND o_orderdate < DATE '1996-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
text("tpch_q11", f"""WITH v AS (SELECT ps_partkey, SUM(ps_supplycost) AS value FROM {PS} ps, {{supplier}}, {{nation}} WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY ps_partkey)
    SELECT ps_partkey, CAST(value AS DOUBLE) AS value FROM v WHERE value > (SELECT SUM(value) * 0.001 FROM v) ORDER BY value DESC, ps_partkey""")
text("tpch_q12", """SELECT o_orderpriority, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
    CAST(SUM(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM {orders}, {lineitem}
    WHERE o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY o_orderpriority ORDER BY o_orderpriority""")
text("tpch_q13", """SELECT c_count, COUNT(*) AS custdist FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice < 400000 GROUP BY c_custkey) t
    GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")
text("tpch_q14", f"""SELECT ROUND(100.0 * CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN {NET} ELSE 0 END) AS DOUBLE) / NULLIF(CAST(SUM({NET}) AS DOUBLE), 0), 4) AS promo_revenue
    FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1995-10-01'""")
text("tpch_q15", f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, SUM({NET}) AS total FROM {{lineitem}} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, ROUND(CAST(total AS DOUBLE), 2) AS total_revenue FROM {{supplier}}, revenue WHERE s_suppkey = supplier_no AND total = (SELECT MAX(total) FROM revenue) ORDER BY s_suppkey""")
text("tpch_q16", f"""SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM {PS} ps, {{part}} WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'PROMO%'
    AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND ps_suppkey NOT IN (SELECT s_suppkey FROM {{supplier}} WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    own=f"""SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM {PS} ps, {{part}} WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'PROMO%'
    AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND {not_in('ps_suppkey', 's_suppkey', '(SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0)')} GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""")
text("tpch_q17", f"""SELECT ROUND(CAST(SUM({M('l_extendedprice')}) AS DOUBLE) / 7.0, 2) AS avg_yearly FROM {{lineitem}}, {{part}} WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND p_size < 30
    AND l_quantity < (SELECT 0.4 * AVG(i.l_quantity) FROM {{lineitem}} i WHERE i.l_partkey = p_partkey)""")
text("tpch_q18", f"""SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, CAST(SUM({M('l_quantity')}) AS DOUBLE) AS qty FROM {{customer}}, {{orders}}, {{lineitem}}
    WHERE o_orderkey IN (SELECT l_orderkey FROM {{lineitem}} GROUP BY l_orderkey HAVING SUM({M('l_quantity')}) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
    GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
text("tpch_q19", f"""SELECT ROUND(CAST(SUM({NET}) AS DOUBLE), 2) AS revenue FROM {{lineitem}}, {{part}} WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND p_size BETWEEN 1 AND 25 AND l_quantity BETWEEN 1 AND 21)
    OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 30 AND l_quantity BETWEEN 10 AND 30) OR (p_partkey = l_partkey AND p_brand = 'Brand#4' AND p_size BETWEEN 1 AND 45 AND l_quantity BETWEEN 20 AND 40)""")
text("tpch_q20", f"""SELECT s_suppkey, s_name FROM {{supplier}}, {{nation}} WHERE s_suppkey IN (SELECT ps_suppkey FROM {PS} ps WHERE ps_partkey IN (SELECT p_partkey FROM {{part}} WHERE p_name LIKE 'red%')
    AND ps_availqty > (SELECT 0.5 * SUM({M('l_quantity')}) FROM {{lineitem}} WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1999-01-01'))
    AND s_nationkey = n_nationkey AND n_nationkey < 15 ORDER BY s_suppkey""")
text("tpch_q21", """SELECT s_name, s_suppkey, COUNT(*) AS numwait FROM {supplier}, {lineitem} l1, {orders}, {nation} WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
    AND l1.l_shipdate > o_orderdate AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
    AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > l1.l_shipdate)
    AND s_nationkey = n_nationkey AND n_regionkey = 1 GROUP BY s_name, s_suppkey ORDER BY numwait DESC, s_name LIMIT 100""")
text("tpch_q22", f"""SELECT c_nationkey, COUNT(*) AS numcust, CAST(SUM({M('c_acctbal')}) AS DOUBLE) AS totacctbal FROM {{customer}} WHERE c_nationkey IN (1, 3, 5, 7, 11, 13)
    AND c_acctbal > (SELECT AVG(c_acctbal) FROM {{customer}} WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM {{orders}} WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1998-01-01')
    GROUP BY c_nationkey ORDER BY c_nationkey""")

# -- patterns of the TPC-DS corpus over the same star --------------------------
SALE = f"SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mo, o_custkey, p_brand, p_type, {NET} AS net, {M('l_quantity')} AS qty FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey"
text("star_brand_month", f"SELECT yr, mo, p_brand, ROUND(CAST(SUM(net) AS DOUBLE), 2) AS sales FROM ({SALE}) s WHERE mo = 11 GROUP BY yr, mo, p_brand ORDER BY yr, sales DESC, p_brand LIMIT 100")
text("star_demographics", f"""SELECT p_brand, ROUND(CAST(SUM(qty) AS DOUBLE) / COUNT(*), 4) AS a1, ROUND(CAST(SUM(net) AS DOUBLE) / COUNT(*), 4) AS a2, COUNT(*) AS n FROM ({SALE}) s
    JOIN {{customer}} ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE' AND yr = 1997 GROUP BY p_brand ORDER BY p_brand LIMIT 100""")
text("star_rollup_rank", f"""SELECT r_name, n_name, g, CAST(total AS DOUBLE) AS total, CAST(RANK() OVER (PARTITION BY g, CASE WHEN g = 0 THEN r_name END ORDER BY total DESC) AS INTEGER) AS rank_within FROM (
    SELECT r_name, n_name, CAST(GROUPING(r_name) + GROUPING(n_name) AS INTEGER) AS g, SUM({M('o_totalprice')}) AS total FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
    JOIN {{region}} ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)) t""")
text("star_month_vs_average", f"""WITH m AS (SELECT p_brand, yr, mo, SUM(net) AS s FROM ({SALE}) x GROUP BY p_brand, yr, mo), a AS (SELECT *, SUM(s) OVER (PARTITION BY p_brand, yr) AS ys, COUNT(*) OVER (PARTITION BY p_brand, yr) AS n FROM m)
    SELECT p_brand, yr, mo, ROUND(CAST(s AS DOUBLE), 2) AS s FROM a WHERE yr = 1996 AND abs(CAST(s AS DOUBLE) - CAST(ys AS DOUBLE) / n) / NULLIF(CAST(ys AS DOUBLE) / n, 0) > 0.5 ORDER BY p_brand, mo""")
text("star_running_full", f"""WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, COUNT(*) AS n FROM {{orders}} GROUP BY 1), l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, COUNT(*) AS n FROM {{lineitem}} GROUP BY 1),
    j AS (SELECT COALESCE(o.m, l.m) AS m, o.n AS orders_n, l.n AS lines_n FROM o FULL OUTER JOIN l ON o.m = l.m)
    SELECT m, CAST(SUM(orders_n) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) AS BIGINT) AS orders_total, CAST(SUM(lines_n) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lines_total FROM j""")
text("star_exists_mix", """SELECT c_mktsegment, COUNT(*) AS n FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND year(o_orderdate) = 1995)
    AND NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND year(o_orderdate) = 1997 AND o_totalprice > 400000) GROUP BY c_mktsegment ORDER BY c_mktsegment""")
text("star_set_years", """SELECT COUNT(*) AS n FROM ((SELECT o_custkey FROM {orders} WHERE year(o_orderdate) = 1995 INTERSECT SELECT o_custkey FROM {orders} WHERE year(o_orderdate) = 1996)
    EXCEPT SELECT o_custkey FROM {orders} WHERE year(o_orderdate) = 1998) t""")
text("star_best_customers", f"""WITH s AS (SELECT o_custkey, SUM({M('o_totalprice')}) AS total FROM {{orders}} GROUP BY o_custkey), m AS (SELECT MAX(total) AS top FROM s)
    SELECT o_custkey, CAST(total AS DOUBLE) AS total FROM s WHERE CAST(total AS DOUBLE) > 0.8 * (SELECT CAST(top AS DOUBLE) FROM m)""")
text("star_weekly_pivot", f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, {', '.join(f"CAST(SUM(CASE WHEN CAST(month(o_orderdate) AS INTEGER) = {m} THEN {M('o_totalprice')} END) AS DOUBLE) AS m{m}" for m in range(1, 13))} FROM {{orders}} GROUP BY 1 ORDER BY 1""")
text("star_channels", f"""SELECT channel, k, CAST(SUM(v) AS DOUBLE) AS v, COUNT(*) AS n FROM (SELECT 'orders' AS channel, o_orderpriority AS k, {M('o_totalprice')} AS v FROM {{orders}} UNION ALL SELECT 'lines', l_returnflag, {M('l_extendedprice')} FROM {{lineitem}}
    UNION ALL SELECT 'events', event_type, {M('value')} FROM {{events}}) t GROUP BY channel, k ORDER BY channel, k LIMIT 100""")
text("star_variation", """SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS mo, ROUND(STDDEV_SAMP(o_custkey) / NULLIF(AVG(o_custkey), 0), 4) AS cv FROM {orders} GROUP BY 1, 2 HAVING COUNT(*) > 1""")
text("star_left_coalesce", f"""SELECT o_orderpriority, CAST(SUM(COALESCE(l.net, CAST(0 AS DECIMAL(28,4)))) AS DOUBLE) AS net, CAST(SUM(CASE WHEN l.l_orderkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_lines FROM {{orders}}
    LEFT JOIN (SELECT l_orderkey, CAST(SUM({NET}) AS DECIMAL(28,4)) AS net FROM {{lineitem}} WHERE l_returnflag = 'R' GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey GROUP BY o_orderpriority""")
text("star_time_buckets", """SELECT h8, h12, h16 FROM (SELECT COUNT(*) AS h8 FROM {events} WHERE hour(ts) = 8) a CROSS JOIN (SELECT COUNT(*) AS h12 FROM {events} WHERE hour(ts) = 12 AND event_type = 'view') b
    CROSS JOIN (SELECT COUNT(*) AS h16 FROM {events} WHERE hour(ts) = 16 AND value > 10) c""")
text("star_share_of_class", f"""SELECT p_type, p_brand, CAST(s AS DOUBLE) AS s, ROUND(CAST(s AS DOUBLE) * 100 / NULLIF(CAST(SUM(s) OVER (PARTITION BY p_type) AS DOUBLE), 0), 4) AS share
    FROM (SELECT p_type, p_brand, SUM(net) AS s FROM ({SALE}) x WHERE yr IN (1996, 1997) GROUP BY p_type, p_brand) t""")
text("ext_tumbling", f"""SELECT date_trunc('hour', ts) AS hour_begin, event_type, COUNT(*) AS n, CAST(SUM({M('value')}) AS DOUBLE) AS total FROM {{events}} GROUP BY 1, 2""")

# -- further patterns of the corpus ---------------------------------------------
text("star_year_growth", f"""WITH y AS (SELECT o_custkey, yr, SUM(net) AS s FROM ({SALE}) x GROUP BY o_custkey, yr)
    SELECT a.o_custkey AS cust, ROUND(CAST(a.s AS DOUBLE), 2) AS s1, ROUND(CAST(b.s AS DOUBLE), 2) AS s2 FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND b.yr = a.yr + 1
    WHERE a.yr = 1996 AND a.s > 0 AND CASE WHEN a.s > 0 THEN CAST(b.s AS DOUBLE) / CAST(a.s AS DOUBLE) ELSE NULL END > 1.5 ORDER BY cust LIMIT 100""")
text("star_channel_rollup", f"""WITH all_rows AS (SELECT 'orders' AS channel, concat('o', CAST(o_orderpriority AS VARCHAR(20))) AS id, {M('o_totalprice')} AS sales, CAST(0 AS DECIMAL(18,2)) AS returns_ FROM {{orders}}
    UNION ALL SELECT 'lines', concat('l', CAST(l_returnflag AS VARCHAR(20))), {M('l_extendedprice')}, CASE WHEN l_returnflag = 'R' THEN {M('l_extendedprice')} ELSE CAST(0 AS DECIMAL(18,2)) END FROM {{lineitem}})
    SELECT channel, id, CAST(SUM(sales) AS DOUBLE) AS sales, CAST(SUM(returns_) AS DOUBLE) AS returns_, CAST(GROUPING(channel) + GROUPING(id) AS INTEGER) AS level FROM all_rows GROUP BY ROLLUP (channel, id)""")
text("star_pivot_weekday", """SELECT c_mktsegment, CAST(SUM(CASE WHEN dayofweek(o_orderdate) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS sun, CAST(SUM(CASE WHEN dayofweek(o_orderdate) = 4 THEN 1 ELSE 0 END) AS BIGINT) AS wed,
    COUNT(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    """SELECT c_mktsegment, CAST(SUM(CASE WHEN dayofweek(o_orderdate) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS sun, CAST(SUM(CASE WHEN dayofweek(o_orderdate) = 3 THEN 1 ELSE 0 END) AS BIGINT) AS wed,
    COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
text("star_cumulative_cross", """WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id % 5 AS g, COUNT(*) AS n FROM {events} GROUP BY 1, 2)
    SELECT day, g, CAST(SUM(n) OVER (PARTITION BY g ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running, MAX(n) OVER (PARTITION BY g ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM d""")
text("star_best_worst", """WITH r AS (SELECT p_brand, AVG(l_suppkey) AS a FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand),
    u AS (SELECT p_brand, CAST(RANK() OVER (ORDER BY a, p_brand) AS INTEGER) AS k FROM r), w AS (SELECT p_brand, CAST(RANK() OVER (ORDER BY a DESC, p_brand) AS INTEGER) AS k FROM r)
    SELECT u.k, u.p_brand AS best, w.p_brand AS worst FROM u JOIN w ON u.k = w.k WHERE u.k < 11 ORDER BY u.k""")
text("star_days_late", """SELECT n_name, CAST(SUM(CASE WHEN datediff(l_shipdate, o_orderdate) <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS d30, CAST(SUM(CASE WHEN datediff(l_shipdate, o_orderdate) > 30 AND datediff(l_shipdate, o_orderdate) <= 400 THEN 1 ELSE 0 END) AS BIGINT) AS d400,
    CAST(SUM(CASE WHEN datediff(l_shipdate, o_orderdate) > 400 THEN 1 ELSE 0 END) AS BIGINT) AS more FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name""",
    """SELECT n_name, CAST(SUM(CASE WHEN x <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS d30, CAST(SUM(CASE WHEN x > 30 AND x <= 400 THEN 1 ELSE 0 END) AS BIGINT) AS d400, CAST(SUM(CASE WHEN x > 400 THEN 1 ELSE 0 END) AS BIGINT) AS more
    FROM (SELECT n_name, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) t GROUP BY n_name""")
text("star_interval_join", """SELECT COUNT(*) AS n FROM {orders} a JOIN {orders} b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate + INTERVAL 5 DAY AND b.o_orderdate <= a.o_orderdate + INTERVAL 60 DAY""")
text("star_both_channels", """SELECT CAST(SUM(CASE WHEN a.k IS NOT NULL AND b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS a_only, CAST(SUM(CASE WHEN a.k IS NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS b_only,
    CAST(SUM(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both_ FROM (SELECT o_custkey AS k FROM {orders} WHERE year(o_orderdate) = 1995 GROUP BY o_custkey) a
    FULL OUTER JOIN (SELECT user_id AS k FROM {events} WHERE event_type = 'purchase' GROUP BY user_id) b ON a.k = b.k""")
text("star_top_in_rollup", f"""SELECT p_type, p_brand, yr, CAST(s AS DOUBLE) AS s, rk FROM (SELECT p_type, p_brand, yr, s, CAST(RANK() OVER (PARTITION BY p_type ORDER BY s DESC) AS INTEGER) AS rk FROM
    (SELECT p_type, p_brand, yr, SUM(COALESCE(qty, CAST(0 AS DECIMAL(18,2)))) AS s FROM ({SALE}) x GROUP BY ROLLUP (p_type, p_brand, yr)) a) b WHERE rk <= 3""")
text("star_zip_intersect", """SELECT n_name, COUNT(*) AS n FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE substr(s_name, 19, 1) IN (SELECT k FROM (SELECT substr(c_name, 19, 1) AS k FROM {customer} WHERE c_acctbal > 0
    INTERSECT SELECT k FROM (SELECT substr(c_name, 19, 1) AS k, COUNT(*) AS cnt FROM {customer} WHERE c_mktsegment = 'BUILDING' GROUP BY substr(c_name, 19, 1) HAVING COUNT(*) > 2) a) b) GROUP BY n_name""")
text("star_bucket_stats", f"""SELECT b1.n AS n1, b1.d AS d1, b1.s AS s1, b2.n AS n2, b2.d AS d2, b2.s AS s2 FROM
    (SELECT COUNT(l_quantity) AS n, COUNT(DISTINCT l_quantity) AS d, CAST(SUM({M('l_extendedprice')}) AS DOUBLE) AS s FROM {{lineitem}} WHERE l_quantity BETWEEN 0 AND 5 AND (l_discount BETWEEN 0.02 AND 0.05 OR l_tax > 0.06)) b1
    CROSS JOIN (SELECT COUNT(l_quantity) AS n, COUNT(DISTINCT l_quantity) AS d, CAST(SUM({M('l_extendedprice')}) AS DOUBLE) AS s FROM {{lineitem}} WHERE l_quantity BETWEEN 6 AND 10) b2""")
text("star_ticket_counts", """SELECT c_name, c_mktsegment, cnt FROM (SELECT o_custkey, o_orderpriority, COUNT(*) AS cnt FROM {orders} WHERE day(o_orderdate) BETWEEN 1 AND 15 GROUP BY o_custkey, o_orderpriority) dn
    JOIN {customer} ON o_custkey = c_custkey WHERE cnt BETWEEN 3 AND 5 ORDER BY cnt DESC, c_name, o_orderpriority""")
text("star_month_pivot_ratio", f"""SELECT s_suppkey, CAST(jan AS DOUBLE) AS jan, CAST(jul AS DOUBLE) AS jul, ROUND(CAST(jul AS DOUBLE) / NULLIF(CAST(jan AS DOUBLE), 0), 4) AS ratio FROM (SELECT l_suppkey,
    SUM(CASE WHEN month(l_shipdate) = 1 THEN {M('l_extendedprice')} ELSE CAST(0 AS DECIMAL(18,2)) END) AS jan, SUM(CASE WHEN month(l_shipdate) = 7 THEN {M('l_extendedprice')} ELSE CAST(0 AS DECIMAL(18,2)) END) AS jul
    FROM {{lineitem}} WHERE year(l_shipdate) = 1997 GROUP BY l_suppkey) t JOIN {{supplier}} ON l_suppkey = s_suppkey""")
text("star_or_blocks", f"""SELECT COUNT(*) AS n, CAST(SUM({M('l_extendedprice')}) AS DOUBLE) AS s FROM {{lineitem}}, {{orders}}, {{customer}} WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND
    ((c_mktsegment = 'MACHINERY' AND c_acctbal BETWEEN 0 AND 5000 AND l_quantity BETWEEN 10 AND 30) OR (c_mktsegment = 'FURNITURE' AND c_acctbal > 1000 AND l_quantity < 20) OR (c_nationkey IN (1, 5, 9) AND l_discount > 0.08))""")
text("star_cross_year_stores", f"""WITH w AS (SELECT o_orderpriority AS p, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, SUM({M('o_totalprice')}) AS s FROM {{orders}} GROUP BY 1, 2, 3)
    SELECT a.p, a.m, ROUND(CAST(a.s AS DOUBLE) / NULLIF(CAST(b.s AS DOUBLE), 0), 4) AS r FROM (SELECT * FROM w WHERE y = 1996) a JOIN (SELECT * FROM w WHERE y = 1997) b ON a.p = b.p AND a.m = b.m ORDER BY a.p, a.m""")
text("star_manufacturers", """SELECT DISTINCT p_name FROM {part} p1 WHERE p_size BETWEEN 10 AND 40 AND (SELECT COUNT(*) FROM {part} p2 WHERE (p2.p_type = p1.p_type AND p2.p_brand = 'Brand#7' AND p2.p_size < 10)
    OR (p2.p_type = p1.p_type AND p2.p_brand = 'Brand#9' AND p2.p_size > 45)) > 0 ORDER BY p_name LIMIT 100""")
text("star_promotion_share", f"""SELECT CAST(promo AS DOUBLE) AS promo, CAST(total AS DOUBLE) AS total, ROUND(CAST(promo AS DOUBLE) / NULLIF(CAST(total AS DOUBLE), 0) * 100, 4) AS pct FROM
    (SELECT SUM({M('l_extendedprice')}) AS promo FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey AND p_type LIKE 'PROMO%') a CROSS JOIN (SELECT SUM({M('l_extendedprice')}) AS total FROM {{lineitem}}) b""")
text("star_min_of_groups", f"""WITH r AS (SELECT l_suppkey AS k, l_partkey AS p, SUM({M('l_extendedprice')}) AS rev FROM {{lineitem}} GROUP BY 1, 2), a AS (SELECT k, SUM(rev) AS s, COUNT(*) AS n FROM r GROUP BY k)
    SELECT r.k, r.p, CAST(r.rev AS DOUBLE) AS rev FROM r JOIN a ON r.k = a.k WHERE CAST(r.rev AS DOUBLE) <= 0.1 * CAST(a.s AS DOUBLE) / a.n ORDER BY r.k, r.p LIMIT 100""")
text("star_exists_after", """SELECT c_nationkey, c_mktsegment, COUNT(*) AS cnt1, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi, COUNT(DISTINCT c_custkey) AS cnt2 FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} WHERE c.c_custkey = o_custkey AND year(o_orderdate) = 1996)
    AND (EXISTS (SELECT 1 FROM {events} WHERE c.c_custkey = user_id AND event_type = 'view') OR EXISTS (SELECT 1 FROM {orders} WHERE c.c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 450000))
    GROUP BY c_nationkey, c_mktsegment ORDER BY c_nationkey, c_mktsegment LIMIT 100""")

# -- further constructs: names with spaces, orders by what is not selected, many relations, windows of time ----------
_SHIPPED = "SELECT o_orderpriority, SUM(CASE WHEN l_shipdate <= o_orderdate + INTERVAL 30 DAY THEN 1 ELSE 0 END) AS {q}30 days{q}, SUM(CASE WHEN l_shipdate > o_orderdate + INTERVAL 30 DAY THEN 1 ELSE 0 END) AS {q}over 30 days{q}, " \
    "COUNT(DISTINCT l_orderkey) AS {q}order count{q} FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY o_orderpriority"
text("quoted_alias", _SHIPPED.format(q="`"), _SHIPPED.format(q='"').replace("SUM(CASE", "(SUM(CASE").replace("ELSE 0 END)", "ELSE 0 END))::BIGINT").replace("o_orderdate +", "o_orderdate::TIMESTAMP +"))
text("sort_unselected_aggregate", "SELECT o_orderpriority FROM {orders} GROUP BY o_orderpriority ORDER BY SUM(CAST(o_totalprice AS DECIMAL(18,2))) DESC, COUNT(*), o_orderpriority")
text("join_18_relations", f"""WITH per_order AS (SELECT l_orderkey AS k, COUNT(*) AS lines_n FROM {{lineitem}} GROUP BY l_orderkey), per_customer AS (SELECT o_custkey AS k, COUNT(*) AS orders_n FROM {{orders}} GROUP BY o_custkey),
    first_order AS (SELECT o_custkey AS k, MIN(o_orderdate) AS day1 FROM {{orders}} GROUP BY o_custkey), last_order AS (SELECT o_custkey AS k, MAX(o_orderdate) AS day2 FROM {{orders}} GROUP BY o_custkey),
    per_supplier AS (SELECT l_suppkey AS k, COUNT(*) AS supplied_n FROM {{lineitem}} GROUP BY l_suppkey), per_part AS (SELECT l_partkey AS k, COUNT(*) AS sold_n FROM {{lineitem}} GROUP BY l_partkey),
    per_brand AS (SELECT p_brand AS k, COUNT(*) AS parts_n FROM {{part}} GROUP BY p_brand), per_segment AS (SELECT c_mktsegment AS k, COUNT(*) AS customers_n FROM {{customer}} GROUP BY c_mktsegment),
    per_nation AS (SELECT s_nationkey AS k, COUNT(*) AS suppliers_n FROM {{supplier}} GROUP BY s_nationkey)
    SELECT cr.r_name AS customer_region, sr.r_name AS supplier_region, COUNT(*) AS n, CAST(SUM({M('l_extendedprice')}) AS DOUBLE) AS price, CAST(SUM(lines_n + orders_n + supplied_n + sold_n) AS BIGINT) AS around,
        CAST(SUM(parts_n + customers_n + suppliers_n) AS BIGINT) AS beside, MIN(CAST(day1 AS DATE)) AS day1, MAX(CAST(day2 AS DATE)) AS day2
    FROM {{lineitem}} l, {{orders}} o, {{customer}} c, {{part}} p, {{supplier}} s, {{nation}} cn, {{nation}} sn, {{region}} cr, {{region}} sr,
        per_order, per_customer, first_order, last_order, per_supplier, per_part, per_brand, per_segment, per_nation
    WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = cn.n_nationkey AND s.s_nationkey = sn.n_nationkey
        AND cn.n_regionkey = cr.r_regionkey AND sn.n_regionkey = sr.r_regionkey AND per_order.k = o.o_orderkey AND per_customer.k = c.c_custkey AND first_order.k = c.c_custkey AND last_order.k = c.c_custkey
        AND per_supplier.k = s.s_suppkey AND per_part.k = p.p_partkey AND per_brand.k = p.p_brand AND per_segment.k = c.c_mktsegment AND per_nation.k = sn.n_nationkey AND p.p_size BETWEEN 5 AND 30
    GROUP BY cr.r_name, sr.r_name""")
text("ext_sliding", "SELECT date_format(window.start, 'yyyy-MM-dd HH:mm') AS window_begin, event_type, COUNT(*) AS n FROM {events} GROUP BY window(ts, '2 hours', '1 hour'), event_type",
    """SELECT strftime(window_begin, '%Y-%m-%d %H:%M') AS window_begin, event_type, COUNT(*) AS n
    FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_begin, event_type FROM events) t GROUP BY 1, 2""")
text("ext_session", "SELECT user_id, date_format(session_window.start, 'yyyy-MM-dd HH:mm:ss') AS session_begin, COUNT(*) AS n FROM {events} GROUP BY user_id, session_window(ts, '6 hours')",
    """SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS session_begin, COUNT(*) AS n FROM (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM
    (SELECT user_id, ts, event_id, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, k""")
