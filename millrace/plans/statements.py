"""Running SQL text: queries, EXPLAIN, ANALYZE and the catalogue statements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..errors import StatementError, told_apart
from .schema_views import with_schema_views
from .statistics import profile

_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;/-]+|.", re.S)


def split(text: str) -> list[str]:
    """Statements of a text, parted by semicolons outside quotes and comments."""
    out, now = [], []
    for m in _TOKEN.finditer(text):
        if m[0] == ";":
            out.append("".join(now).strip())
            now = []
        elif not m[0].startswith(("--", "/*")):
            now.append(m[0])
    out.append("".join(now).strip())
    return [s for s in out if s]


def names_in_backticks(text: str) -> str:
    """Standard SQL names in double quotes, as Spark's dialect writes names; strings stay."""
    return "".join("`" + m[0][1:-1].replace('""', '"').replace("`", "``") + "`" if m[0].startswith('"') and len(m[0]) > 1 else m[0] for m in _TOKEN.finditer(text))


def run(spark: SparkSession, text: str) -> DataFrame:
    """Run all statements; returns the last one's result.

    Names may stand in double quotes, and ``information_schema`` has the
    tables schemata, tables, views and columns.
    """
    statements = split(names_in_backticks(text))
    if not statements:
        raise StatementError("no statement")
    result = None
    for s in statements:
        s = with_schema_views(spark, s)
        if m := re.fullmatch(r"ANALYZE\s+(?:TABLE\s+)?([\w.`]+)", s, re.I):
            result = analyze(spark, m[1])
        elif m := re.match(r"EXPLAIN\s+(?!EXTENDED|CODEGEN|COST|FORMATTED)", s, re.I):
            result = explain(spark, s[m.end() :])
        else:
            with told_apart():
                result = spark.sql(s)
    return result


def analyze(spark: SparkSession, name: str) -> DataFrame:
    """One row per column of a table or view: column_name, n_rows, n_distinct, n_null, least and greatest as text."""
    stats = profile(spark.table(name))
    rows = [(c, stats.rows, s.distinct, s.nulls, _text(s.least), _text(s.greatest)) for c, s in stats.columns.items()]
    return spark.createDataFrame(rows, "column_name string, n_rows long, n_distinct long, n_null long, least string, greatest string")


def _text(x) -> str | None:
    return None if x is None else str(x)


def explain(spark: SparkSession, text: str) -> DataFrame:
    """The optimized plan with estimates and the physical plan, a row per line, column ``plan``."""
    with told_apart():
        plan = spark.sql(f"EXPLAIN COST {text}").first()[0]
    return spark.createDataFrame([(line,) for line in plan.splitlines() if line.strip()], "plan string")


def explain_plan(df: DataFrame) -> str:
    """The physical plan of a DataFrame as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
