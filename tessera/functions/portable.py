"""Pseudo-random numbers that any SQL engine with md5 can repeat: they depend on the given values alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws(":", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts]).cast("binary"))


def uniform_key(*parts: Column | str | int) -> Column:
    """A text that orders rows in a pseudo-random way."""
    return _digest(*parts)


def uniform_int(n: Column | int, *parts: Column | str | int) -> Column:
    """A whole number from 0 to n - 1."""
    return F.pmod(F.conv(F.substring(_digest(*parts), 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))
