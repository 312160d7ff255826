"""Numeric expressions: grouped-number parsing, half-even rounding, floors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_grouped_number(text) -> Column:
    """``"1,963"`` → 1963.0; anything unparseable → null."""
    return F.replace(_c(text), F.lit(","), F.lit("")).try_cast("double")


def round_half_even(x, scale: int = 0) -> Column:
    """Round half to even (2.5 → 2, 3.5 → 4), as pandas/numpy ``round`` does."""
    return F.bround(_c(x).cast("double"), scale)


def floor_zero(x) -> Column:
    """Clip below at 0 and keep nulls null (``greatest`` alone would turn null into 0)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
