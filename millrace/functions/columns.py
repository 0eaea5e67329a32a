"""Column helpers that fix what differs between SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: str | Column) -> Column:
    """An amount as a decimal, whose sums do not depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def as_double(c: Column, name: str) -> Column:
    return c.cast("double").alias(name)


def day(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("date")


def asc_last(c: str) -> Column:
    """Ascending with nulls last, the order of standard SQL clients; Spark's own puts them first."""
    return F.col(c).asc_nulls_last()


def desc_last(c: str) -> Column:
    return F.col(c).desc_nulls_last()
