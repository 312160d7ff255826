"""Calendar, holiday and lag features on daily series.

Holiday tables are built by rule from the years a series covers, so their size is bounded by
(years × rules) and they may be broadcast. Lags are row lags over a dense daily series (run
``densify_zero`` or ``interpolate`` first); all of them share one window spec, so one sort per
series serves every lag.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_of_year, weekday0, weekday_name
from ..functions.holidays import clean_holiday_name, holiday_code
from .common import SERIES, series_window

# Fixed-date holiday rules for the driver tables (our choice): (month, day, name).
FIXED_HOLIDAYS = (
    (1, 1, "New Year's Day"),
    (5, 1, "Labour Day"),
    (8, 9, "National Day"),
    (12, 25, "Christmas Day"),
)


def holiday_calendar(series_df: DataFrame, rules=FIXED_HOLIDAYS, years_ahead: int = 1) -> DataFrame:
    """Raw holiday table ``ds, holiday, is_ph`` for every year the data covers (+ ``years_ahead``).

    A holiday on a Sunday adds the Monday after it as "<name> (Observed)", so the table holds
    observed names, consecutive holidays and two names on one date (clean and reduce it with
    ``holiday_dim``).
    """
    years = series_df.agg(F.year(F.min("ds")).alias("y0"), (F.year(F.max("ds")) + years_ahead).alias("y1"))
    years = years.select(F.explode(F.sequence("y0", "y1")).alias("year"))
    rule_arr = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("name")) for m, d, n in rules])
    days = years.select(F.explode(rule_arr).alias("r"), "year").select(
        F.make_date("year", F.col("r.m"), F.col("r.d")).alias("ds"), F.col("r.name").alias("holiday"))
    observed = days.where(F.weekday("ds") == 6).select(
        F.date_add("ds", 1).alias("ds"), F.concat(F.col("holiday"), F.lit(" (Observed)")).alias("holiday"))
    return days.unionByName(observed).withColumn("is_ph", F.lit(1))


def holiday_dim(raw: DataFrame) -> DataFrame:
    """Clean names and keep one row per date (the smallest name), so joins never multiply."""
    cleaned = raw.withColumn("holiday", clean_holiday_name("holiday"))
    return cleaned.groupBy("ds").agg(F.min("holiday").alias("holiday"), F.lit(1).alias("is_ph"))


def holiday_join(df: DataFrame, hol: DataFrame) -> DataFrame:
    """Left join the holiday dimension on the day; ``is_ph`` 0 where no holiday."""
    # One row per calendar day (holiday_dim groups by day): bounded by the days of the range.
    out = df.join(hol.select("ds", "holiday", "is_ph"), "ds", "left")
    return out.withColumn("is_ph", F.coalesce(F.col("is_ph"), F.lit(0)))


def holiday_range(bounds: DataFrame, hol: DataFrame, series: str = SERIES) -> DataFrame:
    """Calendar days of each series that are holidays, with the holiday's name."""
    from .series import calendar
    return calendar(bounds, series).join(hol.select("ds", "holiday"), "ds", "inner")


def calendar_features(df: DataFrame) -> DataFrame:
    """Weekday (Monday 0), weekday name, day of year, weekend flag."""
    wd = weekday0("ds")
    return df.withColumns({
        "wday": wd,
        "weekday_name": weekday_name("ds"),
        "yearday": day_of_year("ds"),
        "is_weekend": F.when(wd.isin(5, 6), F.lit(1)).otherwise(F.lit(0)),
    })


def holiday_flags(df: DataFrame, hol: DataFrame, series: str = SERIES) -> DataFrame:
    """``is_ph``, ``is_ph_lag1`` (day after a holiday, moved to Monday after a Friday/Saturday
    holiday, never on weekends or holidays), ``wday`` and ``helper``."""
    w = series_window(series)
    x = holiday_join(df, hol).withColumn("wday", weekday0("ds"))
    ph = F.col("is_ph")
    helper = F.when((F.col("wday") == 0) & ((F.lag(ph, 3, 0).over(w) == 1) | (F.lag(ph, 2, 0).over(w) == 1))
                    & (ph != 1), F.lit(1)).otherwise(F.lit(0))
    x = x.withColumns({"helper": helper, "_lag1": F.lag(ph, 1, 0).over(w)})
    lag1 = (F.when(ph == 1, F.lit(0)).when(F.col("wday").isin(5, 6), F.lit(0))
             .when(F.col("helper") == 1, F.lit(1)).otherwise(F.col("_lag1")))
    return x.withColumn("is_ph_lag1", lag1).drop("_lag1")


def lag_flag(df: DataFrame, col: str = "is_ph", k: int = 1, series: str = SERIES) -> DataFrame:
    return df.withColumn(f"{col}_lag{k}", F.lag(col, k, 0).over(series_window(series)))


def lag_features(df: DataFrame, col: str = "y", n: int = 14, prefix: str = "count_lag",
                 series: str = SERIES) -> DataFrame:
    """``prefix1 … prefixN``: value 1…N rows earlier, 0 before the series starts."""
    w = series_window(series)
    return df.withColumns({f"{prefix}{k}": F.lag(col, k, 0).over(w) for k in range(1, n + 1)})


FEATURE_COLUMNS = (["holiday_code", "is_ph", "is_ph_lag1", "wday", "helper", "is_weekend"]
                   + [f"count_lag{k}" for k in range(1, 15)])


def feature_frame(df: DataFrame, hol: DataFrame, series: str = SERIES) -> DataFrame:
    """Holiday flags + weekend flag + 14 lags, all from one window spec (one sort)."""
    x = holiday_flags(df, hol, series)
    x = x.withColumn("is_weekend", F.when(F.col("wday").isin(5, 6), F.lit(1)).otherwise(F.lit(0)))
    x = lag_features(x, "y", 14, "count_lag", series)
    return x.withColumn("holiday_code", holiday_code("holiday"))


def fourier_features(df: DataFrame, period: float, order: int, name: str, digits: int | None = None) -> DataFrame:
    """``{name}_sin{k}``, ``{name}_cos{k}`` for k = 1…order on t = days since 1970-01-01."""
    t = F.datediff(F.col("ds"), F.lit("1970-01-01").cast("date")).cast("double")
    cols = {}
    for k in range(1, order + 1):
        arg = t * (2.0 * math.pi * k / period)
        s, c = F.sin(arg), F.cos(arg)
        if digits is not None:
            s, c = F.round(s, digits), F.round(c, digits)
        cols[f"{name}_sin{k}"] = s
        cols[f"{name}_cos{k}"] = c
    return df.withColumns(cols)


def yearend_window(series_df: DataFrame, lower: int = -14, upper: int = 31, month: int = 12, day: int = 10,
                   years_ahead: int = 3, name: str = "year_end_spike", series: str = SERIES) -> DataFrame:
    """Per series: an anchor on ``month/day`` of every year from the first year to the last
    + ``years_ahead``, exploded to the days ``lower … upper`` around it."""
    yrs = series_df.groupBy(series).agg(F.year(F.min("ds")).alias("y0"), (F.year(F.max("ds")) + years_ahead).alias("y1"))
    yrs = yrs.select(series, F.explode(F.sequence("y0", "y1")).alias("year"))
    anchors = yrs.select(series, F.make_date("year", F.lit(month), F.lit(day)).alias("anchor"))
    days = anchors.select(series, "anchor", F.explode(F.sequence(F.lit(lower), F.lit(upper))).alias("offset"))
    return days.select(series, F.lit(name).alias("holiday"), "anchor", "offset",
                       F.date_add("anchor", F.col("offset")).alias("ds"))


def holiday_window(hol: DataFrame, lower: int = 0, upper: int = 1) -> DataFrame:
    """Each holiday date widened to ``lower … upper`` days: ``ds, holiday, offset``."""
    x = hol.select(F.col("ds").alias("anchor"), "holiday",
                   F.explode(F.sequence(F.lit(lower), F.lit(upper))).alias("offset"))
    return x.select(F.date_add("anchor", F.col("offset")).alias("ds"), "holiday", "offset", "anchor")
