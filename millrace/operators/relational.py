"""Relational operators that Spark lacks or that need a fixed meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def right_semi(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of ``right`` with a partner in ``left``."""
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of ``right`` without a partner in ``left``."""
    return right.join(left, on, "left_anti")


def top_k(df: DataFrame, order: list[Column], k: int, offset: int = 0) -> DataFrame:
    """The first rows of an order; each task keeps ``k + offset`` rows at most."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(k)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group; the limit is pushed below the exchange as a window-group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` that has its keys and is not later by ``at``; nulls where none is.

    Both sides go through one shuffle on the keys and one sort, as a running
    last value; rows of ``right`` come before those of ``left`` of the same
    time.  Of several right rows of one time one is taken.  Null keys match
    nothing.  No pair is made.
    """
    right = right.dropna(subset=[*keys, at])
    own = [c for c in left.columns if c not in (*keys, at)]
    rows = left.select(*keys, at, F.lit(1).alias("__side"), F.struct(*own).alias("__left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__right"))
    rows = rows.union(right.select(*keys, at, F.lit(0), F.lit(None).cast(rows.schema["__left"].dataType), F.struct(*values)))
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__last", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    return rows.select(*keys, at, *[F.col(f"__left.{c}").alias(c) for c in own], *[F.col(f"__last.{c}").alias(c) for c in values])
