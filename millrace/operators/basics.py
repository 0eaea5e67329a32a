"""Scans, projections, predicates and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table


@query("scan_project", "SELECT n_nationkey, n_name AS nation FROM nation")
def scan_project(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))


@query("select_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def select_star(spark, d):
    n, r = table(spark, d, "nation").alias("n"), table(spark, d, "region").alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("n.*", "r.r_name")


@query("select_const", "SELECT 1 AS i, CAST(2.5 AS DOUBLE) AS f, 'text' AS s, TRUE AS b, CAST(NULL AS INTEGER) AS n")
def select_const(spark, d):
    return spark.range(1).select(F.lit(1).alias("i"), F.lit(2.5).alias("f"), F.lit("text").alias("s"), F.lit(True).alias("b"), F.lit(None).cast("int").alias("n"))


@query(
    "filter_compare",
    """SELECT c_custkey, c_acctbal FROM customer
    WHERE c_acctbal > -500 AND c_acctbal <= 9000 AND c_nationkey >= 2 AND c_nationkey < 20 AND c_nationkey <> 7 AND c_mktsegment = 'BUILDING'""",
)
def filter_compare(spark, d):
    bal, nation = F.col("c_acctbal"), F.col("c_nationkey")
    keep = (bal > -500) & (bal <= 9000) & (nation >= 2) & (nation < 20) & (nation != 7) & (F.col("c_mktsegment") == "BUILDING")
    return table(spark, d, "customer").where(keep).select("c_custkey", "c_acctbal")


@query(
    "filter_bool",
    "SELECT o_orderkey, -o_totalprice AS minus FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < +100000) AND (o_orderpriority = '1-URGENT' OR o_totalprice > 300000)",
)
def filter_bool(spark, d):
    price = F.col("o_totalprice")
    keep = ~((F.col("o_orderstatus") == "F") | (price < 100000)) & ((F.col("o_orderpriority") == "1-URGENT") | (price > 300000))
    return table(spark, d, "orders").where(keep).select("o_orderkey", (-price).alias("minus"))


@query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_name NOT LIKE 'red_%' AND p_brand LIKE 'Brand#_'")
def filter_like(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").where(name.like("%ring") & ~name.like("red_%") & F.col("p_brand").like("Brand#_")).select("p_partkey", "p_name")


@query("filter_between", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND o_totalprice NOT BETWEEN 100000 AND 200000")
def filter_between(spark, d):
    year = F.col("o_orderdate").between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return table(spark, d, "orders").where(year & ~F.col("o_totalprice").between(100000, 200000)).select("o_orderkey")


@query("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def filter_in_list(spark, d):
    keep = F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)
    return table(spark, d, "customer").where(keep).select("c_custkey", "c_mktsegment")


@query(
    "filter_null",
    """SELECT o_orderkey, k IS NULL AS missing FROM
    (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS k FROM orders) t WHERE k IS NULL OR (k IS NOT NULL AND k < 100)""",
)
def filter_null(spark, d):
    k = F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.col("o_custkey"))
    rows = table(spark, d, "orders").select("o_orderkey", k.alias("k"))
    return rows.where(F.col("k").isNull() | (F.col("k").isNotNull() & (F.col("k") < 100))).select("o_orderkey", F.col("k").isNull().alias("missing"))


@query("filter_string_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= CAST('1997-06-01' AS TIMESTAMP) AND o_orderdate < CAST('1997-07-01' AS TIMESTAMP)")
def filter_string_date(spark, d):
    when = F.col("o_orderdate")
    return table(spark, d, "orders").where((when >= "1997-06-01") & (when < "1997-07-01")).select("o_orderkey")


@query(
    "expr_arith",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + 1 AS plus, l_quantity - 1 AS minus, l_quantity * 2 AS times,
    l_quantity / 4 AS divided, CAST(l_orderkey % 7 AS BIGINT) AS rest, l_orderkey / 2 AS half, CAST(l_orderkey // 2 AS BIGINT) AS whole FROM lineitem""",
)
def expr_arith(spark, d):
    q, k = F.col("l_quantity"), F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (q + 1).alias("plus"), (q - 1).alias("minus"), (q * 2).alias("times"), (q / 4).alias("divided"),
        (k % 7).alias("rest"), (k / 2).alias("half"), F.expr("l_orderkey div 2").alias("whole"),
    )


@query(
    "expr_case",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status,
    CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS class FROM orders""",
)
def expr_case(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(s == "F", "finished").when(s == "O", "open").alias("status"),
        F.when(p > 300000, "high").when(p > 100000, "middle").otherwise("low").alias("class"),
    )


@query(
    "expr_cast",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS text, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
    CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS back, CAST(o_totalprice AS FLOAT) AS single FROM orders""",
)
def expr_cast(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", key.cast("string").alias("text"), F.col("o_orderdate").cast("date").alias("day"),
        price.cast("decimal(18,2)").cast("double").alias("price"), key.cast("string").cast("long").alias("back"), price.cast("float").alias("single"),
    )


@query(
    "expr_ratio",
    """SELECT l_returnflag, ROUND(CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0), 4) AS ratio,
    CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(COUNT(*), 0) AS share FROM lineitem GROUP BY l_returnflag""",
)
def expr_ratio(spark, d):
    n = F.count("*")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.nullif(n.cast("double"), F.lit(0.0)), 4).alias("ratio"),
        (F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).cast("double") / F.nullif(n, F.lit(0))).alias("share"),
    )


@query(
    "mem_table",
    "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2::BIGINT, 'b'), (3::BIGINT, NULL)) t(id, name)",
)
def mem_table(spark, d):
    import pyarrow as pa

    from ..sources.tables import register_arrow

    return register_arrow(spark, "mem_table_rows", pa.table({"id": pa.array([1, 2, 3], pa.int64()), "name": ["a", "b", None]}))


def _csv(spark, d, schema, columns: str, source: str):
    """A table written as CSV part files in a shared folder, and read again."""
    import atexit
    import shutil
    import tempfile
    import uuid

    from ..sources.tables import read_csv

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-csv-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
    path = f"{base.rstrip('/')}/millrace-csv-{uuid.uuid4().hex}"
    table(spark, d, source).selectExpr(*columns.split(", ")).write.option("header", True).csv(path)
    return read_csv(spark, path, schema)


@query("scan_csv_roundtrip", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation")
def scan_csv_roundtrip(spark, d):
    return _csv(spark, d, None, "n_nationkey, n_name, n_regionkey", "nation")


@query("scan_csv_schema", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_csv_schema(spark, d):
    return _csv(spark, d, "c_custkey long, c_name string, c_acctbal double", "c_custkey, c_name, c_acctbal", "customer")


@query("view_query", "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def view_query(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("view_query_nation")
    table(spark, d, "region").createOrReplaceTempView("view_query_region")
    spark.sql("CREATE OR REPLACE TEMP VIEW view_query_asia AS SELECT r_name, n_name FROM view_query_nation JOIN view_query_region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
    return spark.table("view_query_asia")


@query("show_tables")
def show_tables(spark, d):
    from ..sources.tables import register

    register(spark, d)
    return spark.sql("SHOW TABLES")


@query("repartition_hash", "SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey")
def repartition_hash(spark, d):
    return table(spark, d, "lineitem").repartition("l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "fn_string",
    """SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, substr(c_name, 1, 8) AS head, length(c_name) AS n, trim('  x ') AS t,
    concat(c_name, '/', c_mktsegment) AS both, c_name || '!' AS piped, replace(c_name, '#', '-') AS swapped, CAST(strpos(c_name, '#') AS INTEGER) AS at, left(c_name, 3) AS l3, right(c_name, 2) AS r2,
    lpad(c_mktsegment, 12, '.') AS padded, reverse(c_mktsegment) AS back FROM customer""",
)
def fn_string(spark, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", F.upper(m).alias("up"), F.lower(n).alias("low"), F.substring(n, 1, 8).alias("head"), F.length(n).cast("long").alias("n"), F.trim(F.lit("  x ")).alias("t"),
        F.concat(n, F.lit("/"), m).alias("both"), F.concat(n, F.lit("!")).alias("piped"), F.replace(n, F.lit("#"), F.lit("-")).alias("swapped"),
        F.instr(n, "#").alias("at"), F.left(n, F.lit(3)).alias("l3"), F.right(n, F.lit(2)).alias("r2"), F.lpad(m, 12, ".").alias("padded"), F.reverse(m).alias("back"),
    )


@query(
    "fn_math",
    """SELECT s_suppkey, abs(s_acctbal) AS a, round(s_acctbal, 1) AS r1, floor(s_acctbal)::BIGINT AS f, ceil(s_acctbal)::BIGINT AS c, sqrt(abs(s_acctbal)) AS q,
    CAST(sign(s_acctbal) AS DOUBLE) AS s, greatest(s_acctbal, 0.0::DOUBLE) AS g, least(s_acctbal, 0.0::DOUBLE) AS l FROM supplier""",
)
def fn_math(spark, d):
    b = F.col("s_acctbal")
    return table(spark, d, "supplier").select(
        "s_suppkey", F.abs(b).alias("a"), F.round(b, 1).alias("r1"), F.floor(b).alias("f"), F.ceil(b).alias("c"), F.sqrt(F.abs(b)).alias("q"),
        F.signum(b).alias("s"), F.greatest(b, F.lit(0.0)).alias("g"), F.least(b, F.lit(0.0)).alias("l"),
    )


@query(
    "fn_null",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END, 'none') AS status, nullif(o_orderpriority, '5-LOW') AS priority,
    coalesce(NULL, NULL, o_custkey) AS cust FROM orders""",
)
def fn_null(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        "o_orderkey", F.coalesce(F.when(s == "F", F.lit(None)).otherwise(s), F.lit("none")).alias("status"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"), F.coalesce(F.lit(None), F.lit(None), "o_custkey").alias("cust"),
    )


@query(
    "fn_date",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS later, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS before,
    CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS dd, CAST(EXTRACT(quarter FROM o_orderdate) AS INTEGER) AS q,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month_begin, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders""",
)
def fn_date(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_add(day, 30).alias("later"), F.add_months(day, -3).alias("before"), F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("dd"),
        F.quarter(day).alias("q"), F.trunc(day, "month").alias("month_begin"), F.datediff(day, F.lit("1992-01-01").cast("date")).alias("days"),
    )
