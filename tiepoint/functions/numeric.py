"""Numeric column helpers with the null, NaN and rounding rules that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True for a number that is neither NaN nor infinite; false for null."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def nan_last_desc(c: Column) -> list[Column]:
    """Sort keys: descending, with NaN after all numbers (Spark's own descending order puts it first)."""
    return [F.isnan(c).asc(), c.desc()]


def rmse(c: Column) -> Column:
    return F.sqrt(F.avg(c * c))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is above 0, else null."""
    return F.when(b > 0, a / b)


def grid_cell(at: Column, cells: int, size) -> Column:
    """Index of the grid cell along one axis; the last cell takes what rounding puts beyond it."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.least((at * cells / size).cast("int"), F.lit(cells - 1))
