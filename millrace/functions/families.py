"""One query for each further family of scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table


@query(
    "fn_string2",
    """SELECT p_partkey, lower(p_brand) AS low, trim('  ' || p_name || ' ') AS t, ltrim('xxa', 'x') AS lt, rtrim('axx', 'x') AS rt, length(p_name) AS n, replace(p_name, ' ', '_') AS swapped,
    lpad(p_type, 12, '*') AS lp, rpad(p_type, 12, '*') AS rp, split_part(p_name, ' ', 2) AS word, CAST(strpos(p_name, 'ring') AS INTEGER) AS at, repeat('ab', 3) AS rep,
    starts_with(p_name, 'red') AS red, concat_ws('-', p_brand, p_type) AS joined, translate(p_brand, '#', '/') AS tr, ascii(p_name) AS first, chr(65) AS letter FROM part""",
)
def fn_string2(spark, d):
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(spark, d, "part").select(
        "p_partkey", F.lower(b).alias("low"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"), F.expr("trim(LEADING 'x' FROM 'xxa')").alias("lt"), F.expr("trim(TRAILING 'x' FROM 'axx')").alias("rt"),
        F.length(n).cast("long").alias("n"), F.replace(n, F.lit(" "), F.lit("_")).alias("swapped"), F.lpad(t, 12, "*").alias("lp"), F.rpad(t, 12, "*").alias("rp"),
        F.split_part(n, F.lit(" "), F.lit(2)).alias("word"), F.instr(n, "ring").alias("at"), F.repeat(F.lit("ab"), 3).alias("rep"), F.startswith(n, F.lit("red")).alias("red"),
        F.concat_ws("-", b, t).alias("joined"), F.translate(b, "#", "/").alias("tr"), F.ascii(n).alias("first"), F.char(F.lit(65)).alias("letter"),
    )


@query(
    "fn_math2",
    """SELECT p_partkey, ceil(p_retailprice / 7)::BIGINT AS c, floor(p_retailprice / 7)::BIGINT AS f, sqrt(CAST(p_size AS DOUBLE)) AS q, ROUND(power(CAST(p_size AS DOUBLE), 2), 6) AS p2, ROUND(exp(CAST(p_size AS DOUBLE) / 50), 9) AS e,
    ROUND(ln(CAST(p_size AS DOUBLE)), 9) AS l, ROUND(log10(CAST(p_size AS DOUBLE)), 9) AS l10, CAST(sign(p_size - 25) AS DOUBLE) AS s, ROUND(sin(CAST(p_size AS DOUBLE)), 9) AS sine, CAST(p_size % 7 AS INTEGER) AS m,
    ROUND(pi(), 9) AS pi, trunc(p_retailprice / 7)::BIGINT AS tr, CAST(gcd(p_size, 12) AS BIGINT) AS g FROM part WHERE p_size > 0""",
)
def fn_math2(spark, d):
    z, price = F.col("p_size").cast("double"), F.col("p_retailprice") / 7
    a, b = F.col("p_size"), F.lit(12)
    gcd = F.array_max(F.filter(F.sequence(F.lit(1), b), lambda k: (a % k == 0) & (b % k == 0)))
    return table(spark, d, "part").where("p_size > 0").select(
        "p_partkey", F.ceil(price).alias("c"), F.floor(price).alias("f"), F.sqrt(z).alias("q"), F.round(F.pow(z, 2), 6).alias("p2"), F.round(F.exp(z / 50), 9).alias("e"), F.round(F.log(z), 9).alias("l"),
        F.round(F.log10(z), 9).alias("l10"), F.signum(F.col("p_size") - 25).alias("s"), F.round(F.sin(z), 9).alias("sine"), (F.col("p_size") % 7).alias("m"), F.round(F.pi(), 9).alias("pi"),
        price.cast("long").alias("tr"), gcd.cast("long").alias("g"),
    )


@query(
    "fn_date2",
    """SELECT event_id, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(date_part('hour', ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(isodow(ts) AS INTEGER) AS dow,
    CAST(week(ts) AS INTEGER) AS w, strftime(ts, '%Y-%m-%d %H:%M') AS text, CAST(last_day(CAST(ts AS DATE)) AS DATE) AS month_end, CAST(make_date(2024, 2, 29) AS DATE) AS leap FROM events""",
)
def fn_date2(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", ts.cast("date").alias("day"), F.hour(ts).alias("h"), F.minute(ts).alias("mi"), F.dayofyear(ts).alias("doy"), (F.weekday(ts) + 1).alias("dow"), F.weekofyear(ts).alias("w"),
        F.date_format(ts, "yyyy-MM-dd HH:mm").alias("text"), F.last_day(ts).alias("month_end"), F.make_date(F.lit(2024), F.lit(2), F.lit(29)).alias("leap"),
    )


@query(
    "fn_regex",
    r"""SELECT c_custkey, regexp_replace(c_name, '0+', '0', 'g') AS short, regexp_matches(c_name, '#0*[1-5]$') AS hit, regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2) AS digits FROM customer""",
)
def fn_regex(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select(
        "c_custkey", F.regexp_replace(n, "0+", "0").alias("short"), n.rlike("#0*[1-5]$").alias("hit"), F.regexp_extract(n, "([A-Za-z]+)#0*([0-9]+)", 2).alias("digits")
    )


@query(
    "fn_null2",
    """SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, greatest(o_custkey, 500) AS g, least(o_custkey, 500) AS l, coalesce(nullif(o_orderstatus, 'F'), 'F') AS back,
    CASE WHEN nullif(o_orderstatus, 'F') IS NULL THEN 1 ELSE 2 END AS two, ifnull(nullif(o_orderpriority, '5-LOW'), 'none') AS p FROM orders""",
)
def fn_null2(spark, d):
    s = F.nullif(F.col("o_orderstatus"), F.lit("F"))
    k = F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", s.alias("s"), F.greatest(k, F.lit(500).cast("long")).alias("g"), F.least(k, F.lit(500).cast("long")).alias("l"), F.coalesce(s, F.lit("F")).alias("back"),
        F.nvl2(s, F.lit(2), F.lit(1)).alias("two"), F.ifnull(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("none")).alias("p"),
    )


@query("fn_hash", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def fn_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.md5(F.col("c_name").cast("binary")).alias("m"), F.sha2(F.col("c_name").cast("binary"), 256).alias("s"))


@query(
    "fn_array",
    """SELECT vec_id, len(embedding) AS n, embedding[1] AS first, list_contains([label, 1], 2) AS has, len(list_filter(embedding, lambda x: x > 0)) AS positive,
    list_max(embedding) AS top, list_sort([label, 1, 7])[3] AS third FROM embeddings""",
)
def fn_array(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.size(e).cast("long").alias("n"), F.element_at(e, 1).alias("first"), F.array_contains(F.array("label", F.lit(1)), 2).alias("has"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), F.array_max(e).alias("top"), F.element_at(F.array_sort(F.array("label", F.lit(1), F.lit(7))), 3).alias("third"),
    )


@query("fn_map_struct", "SELECT event_id, event_type AS kind, value + 1 AS more FROM events")
def fn_map_struct(spark, d):
    rows = table(spark, d, "events").select("event_id", F.struct("event_type", "value").alias("s"), F.create_map(F.lit("more"), F.col("value") + 1).alias("m"))
    return rows.select("event_id", F.col("s.event_type").alias("kind"), F.element_at("m", "more").alias("more"))


@query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fn_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("fn_udf", "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def fn_udf(spark, d):
    """A vectorised user function over Arrow batches; built-in expressions are the rule."""
    @F.pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    return table(spark, d, "customer").select("c_custkey", twice("c_acctbal").alias("twice"))


@query("fn_udaf", "SELECT o_custkey, MAX(o_totalprice) - MIN(o_totalprice) AS spread, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def fn_udaf(spark, d):
    """A user's aggregate function over Arrow; it sees a whole group, here the orders of one customer."""
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    @F.pandas_udf("long")
    def size(x: pd.Series) -> int:
        return len(x)

    return table(spark, d, "orders").groupBy("o_custkey").agg(spread("o_totalprice").alias("spread"), size("o_totalprice").alias("n"))


@query("fn_udtf", "SELECT p_partkey, CAST(generate_subscripts(string_split(p_name, ' '), 1) - 1 AS INTEGER) AS at, unnest(string_split(p_name, ' ')) AS word FROM part")
def fn_udtf(spark, d):
    """A user's table function, joined laterally."""
    @F.udtf(returnType="at int, word string")
    class Words:
        def eval(self, text: str):
            yield from enumerate(text.split(" "))

    spark.udtf.register("millrace_words", Words)
    return spark.sql("SELECT p_partkey, w.at, w.word FROM {part}, LATERAL millrace_words(p_name) w", part=table(spark, d, "part"))
