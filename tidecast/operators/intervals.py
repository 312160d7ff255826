"""Join of days with the intervals that hold them, as an equi-join on coarse day buckets.

An interval is exploded to the buckets of days it touches, a row has the bucket of its day, and
the exact bounds are checked on the rows that meet in a bucket. Nothing is assumed about the
number of intervals: the join is hashed or broadcast by measured size like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lit_date

#: Days of a bucket: long enough that an interval of months has a few, short enough to be selective.
BUCKET_DAYS = 64
_BUCKET = "_day_bucket"


def _bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, lit_date("1970-01-01")) / BUCKET_DAYS).cast("int")


def interval_join(df: DataFrame, intervals: DataFrame, spans: list[tuple[str, str]], day: str = "ds", how: str = "inner") -> DataFrame:
    """``df`` joined with every row of ``intervals`` that holds its ``day`` in one of its ``spans``
    (pairs of column names, first and last day included), once per such row.

    A span with a null end or with its ends in reverse holds no day; a null day lies in none.
    ``how``: inner, or left to keep the rows in no interval.
    """
    none = F.array().cast("array<int>")

    def touched(lo: str, hi: str) -> Column:
        return F.when(F.col(lo) <= F.col(hi), F.sequence(_bucket(F.col(lo)), _bucket(F.col(hi)))).otherwise(none)

    keys = F.array_distinct(F.flatten(F.array(*[touched(lo, hi) for lo, hi in spans])))
    right = intervals.withColumn(f"{_BUCKET}_r", F.explode(keys))
    left = df.withColumn(_BUCKET, _bucket(F.col(day)))
    inside = F.lit(False)
    for lo, hi in spans:
        inside = inside | F.coalesce(left[day].between(right[lo], right[hi]), F.lit(False))
    return left.join(right, (left[_BUCKET] == right[f"{_BUCKET}_r"]) & inside, how).drop(_BUCKET, f"{_BUCKET}_r")
