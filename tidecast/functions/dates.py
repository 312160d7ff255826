"""Date expressions: calendar, weekday, bucket labels, text dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday0(ds) -> Column:
    """Weekday with Monday = 0 … Sunday = 6 (``dayofweek`` would give Sunday = 1)."""
    return F.weekday(_c(ds))


def day_of_year(ds) -> Column:
    return F.dayofyear(_c(ds))


def weekday_name(ds) -> Column:
    return F.date_format(_c(ds), "EEEE")


def week_end_sunday(ds) -> Column:
    """Label of a week that ends on Sunday (the ``W`` bucket)."""
    ds = _c(ds)
    return F.date_add(ds, F.lit(6) - F.weekday(ds))


def week_end_monday(ds) -> Column:
    """Label of a week that ends on Monday (the ``W-MON`` bucket)."""
    ds = _c(ds)
    return F.date_add(ds, (F.lit(7) - F.weekday(ds)) % 7)


def month_end(ds) -> Column:
    """Label of a calendar month (the ``M`` bucket)."""
    return F.last_day(_c(ds))


BUCKETS = {"W": week_end_sunday, "W-MON": week_end_monday, "M": month_end}


def bucket_label(ds, freq: str) -> Column:
    if freq == "D":
        return _c(ds)
    if freq not in BUCKETS:
        raise ValueError(f"unsupported frequency {freq!r}; use D, W, W-MON or M")
    return BUCKETS[freq](ds)


def date_from_text(text, fmt: str = "yyyy-MM-dd") -> Column:
    """First 10 characters of a text timestamp parsed with ``fmt``; bad text gives null."""
    return F.try_to_date(F.substring(_c(text), 1, 10), fmt)


def day_first_date(text) -> Column:
    """Day-first text date such as ``7/1/2022``; bad text gives null."""
    return F.try_to_date(F.trim(_c(text)), "d/M/yyyy")


def date_range(start, end) -> Column:
    """Array of every day from ``start`` to ``end`` inclusive (explode it to rows)."""
    return F.sequence(_c(start), _c(end))

