"""Movable days of the year as column expressions (Gregorian calendar, years from 1583)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def easter_sunday(year) -> Column:
    """Easter Sunday of the western churches; null for a null year or one before 1583."""
    y = F.col(year) if isinstance(year, str) else year
    golden = y % 19
    century, in_century = _div(y, 100), y % 100
    lunar_shift = _div(century - _div(century + 8, 25) + 1, 3)
    epact = (golden * 19 + century - _div(century, 4) - lunar_shift + 15) % 30
    to_sunday = ((century % 4) * 2 + _div(in_century, 4) * 2 + 32 - epact - in_century % 4) % 7
    late = _div(golden + epact * 11 + to_sunday * 22, 451)
    # days after March 22: the paschal full moon's place, then the way to the next Sunday
    return F.when(y >= 1583, F.date_add(F.make_date(y, F.lit(3), F.lit(22)), epact + to_sunday - late * 7))


def nth_weekday(year, month: int, weekday: int, n: int) -> Column:
    """The n-th ``weekday`` (Monday 0) of a month; n = -1 is the last one. Null where there is none."""
    y = F.col(year) if isinstance(year, str) else year
    first = F.make_date(y, F.lit(month), F.lit(1))
    if n < 0:
        last = F.last_day(first)
        day = F.date_sub(last, (F.weekday(last) - weekday + 7) % 7 + (-n - 1) * 7)
    else:
        day = F.date_add(first, (F.lit(weekday + 7) - F.weekday(first)) % 7 + (n - 1) * 7)
    return F.when(F.month(day) == month, day)
