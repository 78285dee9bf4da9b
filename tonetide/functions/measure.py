"""Aggregate helpers whose results do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(decimal_column: Column | str) -> Column:
    """Mean of a DECIMAL column as DOUBLE: exact sum first, one division last."""
    return F.sum(decimal_column).cast("double") / F.count(decimal_column)


def as_double(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("double")


def rounded_stddev(column: Column | str, digits: int = 6) -> Column:
    """Sample deviation; NULL for a single row."""
    return F.round(F.stddev_samp(as_double(column)), digits)


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))
