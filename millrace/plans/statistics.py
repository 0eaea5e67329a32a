"""Table and column statistics, and the estimates that follow from them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnStats:
    distinct: int
    nulls: int
    least: Any
    greatest: Any
    mean_bytes: float


@dataclass(frozen=True)
class TableStats:
    rows: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)


def profile(df: DataFrame, approximate: bool = False) -> TableStats:
    """Rows, and per column distinct values, nulls, typed extremes and mean size, in one aggregation.

    Exact distinct counts expand each row once per column; ``approximate``
    takes sketches of fixed size instead, for very large tables.
    """
    plain = [f for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    count = F.approx_count_distinct if approximate else F.count_distinct
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(plain):
        c = F.col(f"`{f.name}`")
        size = F.octet_length(c.cast("string")) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(f.dataType.jsonValue() and _WIDTH.get(type(f.dataType), 8))
        parts += [count(c).alias(f"d{i}"), F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"z{i}"), F.avg(F.when(c.isNotNull(), size)).alias(f"s{i}")]
    row = df.agg(*parts).first()
    rows = int(row["rows"])
    if not rows:
        return TableStats(0)
    return TableStats(rows, {
        f.name: ColumnStats(int(row[f"d{i}"]), rows - int(row[f"n{i}"]), row[f"a{i}"], row[f"z{i}"], float(row[f"s{i}"] or 0)) for i, f in enumerate(plain)
    })


_WIDTH = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def equality_selectivity(column: ColumnStats | None) -> float:
    return 1.0 / column.distinct if column and column.distinct else 0.1


def range_selectivity(column: ColumnStats | None, low: float | None, high: float | None) -> float:
    """Share of rows between two bounds if values were spread evenly."""
    if column is None or not isinstance(column.least, (int, float)) or column.greatest == column.least:
        return 1 / 3
    a = column.least if low is None else max(low, column.least)
    z = column.greatest if high is None else min(high, column.greatest)
    return min(1.0, max(0.0, (z - a) / (column.greatest - column.least)))


def join_selectivity(left: ColumnStats | None, right: ColumnStats | None) -> float:
    """1 / max of the distinct counts, as for a foreign key."""
    most = max(left.distinct if left else 0, right.distinct if right else 0)
    return 1.0 / most if most else 0.1


def join_rows(left: TableStats, right: TableStats, left_key: str, right_key: str) -> float:
    return left.rows * right.rows * join_selectivity(left.columns.get(left_key), right.columns.get(right_key))


def group_rows(table: TableStats, keys: list[str]) -> float:
    """Groups of an aggregate: the product of the keys' distinct values (nulls being one more), at most the rows; one without keys."""
    out = 1.0
    for k in keys:
        c = table.columns.get(k)
        out *= c.distinct + (c.nulls > 0) if c else table.rows**0.5
    return min(out, float(table.rows)) if keys else 1.0
