"""Arithmetic on array columns: signatures and value windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block(values: Column, index: Column | int, length: int) -> Column:
    """The ``index``-th (from 0) block of ``length`` entries."""
    return F.slice(values, F.lit(1) + F.lit(length) * index, F.lit(length))


def equal_share(left: Column, right: Column) -> Column:
    """Share of positions at which two arrays of one length agree."""
    hits = F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda same: same)
    return F.try_divide(F.size(hits).cast("double"), F.size(left))


def relative(values: Column, base: Column | None = None) -> Column:
    """``v / base - 1`` for each entry; the base is the first entry unless given."""
    start = F.get(values, F.lit(0)) if base is None else base
    return F.transform(values, lambda v: F.try_divide(v, start) - 1)


def absolute(values: Column, base: Column) -> Column:
    """Inverse of :func:`relative`."""
    return F.transform(values, lambda v: (v + 1) * base)
