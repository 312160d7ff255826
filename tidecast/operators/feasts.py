"""Holiday calendars by rule: fixed days, days that move with Easter, n-th weekdays, and days
that only a table can give; a day that falls on a Sunday is observed on the next free day.

A calendar has (years x rules) rows, whatever the size of the series, so it is built once and
joined on the day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.feasts import easter_sunday, nth_weekday
from .common import SERIES

#: A feast on a Sunday is observed within this many days; more feasts in a row than that cannot follow one another.
OBSERVED_WITHIN = 7


@dataclass(frozen=True)
class Feast:
    """One rule: ``month`` and ``day``, or ``easter`` (days after Easter Sunday), or ``month``,
    ``weekday`` (Monday 0) and ``nth`` (-1: the last)."""

    name: str
    month: int | None = None
    day: int | None = None
    easter: int | None = None
    weekday: int | None = None
    nth: int | None = None

    def of(self, year: str) -> Column:
        fixed, moving, counted = self.day is not None, self.easter is not None, self.nth is not None
        if fixed + moving + counted != 1 or (moving != (self.month is None)) or counted != (self.weekday is not None):
            raise ValueError(f"{self.name}: state month and day, or easter, or month, weekday and nth")
        if moving:
            return F.date_add(easter_sunday(year), self.easter)
        if counted:
            return nth_weekday(year, self.month, self.weekday, self.nth)
        # a day that a year does not have (29 February) is null and left out
        first = F.make_date(F.col(year), F.lit(self.month), F.lit(1))
        ds = F.date_add(first, self.day - 1)
        return F.when(F.month(ds) == self.month, ds)


FEASTS = (
    Feast("New Year's Day", 1, 1),
    Feast("Good Friday", easter=-2),
    Feast("Easter Monday", easter=1),
    Feast("Labour Day", 5, 1),
    Feast("Whit Monday", easter=50),
    Feast("National Day", 8, 9),
    Feast("Harvest Day", 11, weekday=3, nth=4),
    Feast("Christmas Day", 12, 25),
    Feast("Boxing Day", 12, 26),
)


def feast_calendar(series_df: DataFrame, rules: tuple[Feast, ...] = FEASTS, stated: DataFrame | None = None, years_ahead: int = 1) -> DataFrame:
    """``ds, holiday, rule_ds, observed`` for every year of ``series_df`` and ``years_ahead`` more.

    ``stated`` (ds, holiday) adds days that no rule gives, such as lunar ones, inside those years.
    A day on a Sunday stays (observed false) and gains a row on the first later day that is no
    holiday (observed true). Two names on one day are two rows; repeated rows are one. No days
    in ``series_df``: no rows.
    """
    years = series_df.agg(F.year(F.min("ds")).alias("y0"), (F.year(F.max("ds")) + years_ahead).alias("y1"))
    years = years.where("y0 is not null")
    by_rule = F.array(*[F.struct(r.of("year").alias("ds"), F.lit(r.name).alias("holiday")) for r in rules])
    years = years.select(F.explode(F.sequence("y0", "y1")).alias("year"))
    days = years.select(F.inline(by_rule)).where("ds is not null")
    if stated is not None:
        own = stated.select("ds", "holiday", F.year("ds").alias("year")).join(years, "year", "left_semi").select("ds", "holiday")
        days = days.unionByName(own)
    days = days.distinct()
    free = days.where(F.weekday("ds") == 6).select(
        "holiday", F.col("ds").alias("rule_ds"), F.explode(F.sequence(F.date_add("ds", 1), F.date_add("ds", OBSERVED_WITHIN))).alias("ds"))
    free = free.join(days.select("ds"), "ds", "left_anti")
    moved = free.groupBy("holiday", "rule_ds").agg(F.min("ds").alias("ds"))
    kept = days.select("ds", "holiday", F.col("ds").alias("rule_ds"), F.lit(False).alias("observed"))
    return kept.unionByName(moved.select("ds", "holiday", "rule_ds", F.lit(True).alias("observed")))


def feast_effect(series_df: DataFrame, feasts: DataFrame, series: str = SERIES, digits: int = 6) -> DataFrame:
    """Per series and holiday: days, mean value, and the mean value of the series' other days of
    the same weekdays (weighted as the holiday's own days are).

    A day with two names counts for both. Null values are no days. Means are null where the
    series has no other day of those weekdays.
    """
    rows = series_df.where(F.col("y").isNotNull()).select(series, "ds", F.col("y").cast("double").alias("y"), F.weekday("ds").alias("wday"))
    one = feasts.groupBy("ds").agg(F.collect_set("holiday").alias("names"))  # names of one day: at most the rules
    tagged = rows.join(one, "ds", "left")
    # one pass over the days: sums per series, weekday and name, where no name stands for a plain day
    sums = tagged.select(series, "wday", "y", F.explode_outer("names").alias("holiday"))
    sums = sums.groupBy(series, "wday", "holiday").agg(F.count("*").alias("n"), F.sum("y").alias("total"))
    plain = sums.where("holiday is null").select(series, "wday", (F.col("total") / F.col("n")).alias("usual"))
    out = sums.where("holiday is not null").join(plain, [series, "wday"], "left").groupBy(series, "holiday").agg(
        F.sum("n").alias("n_days"),
        F.round(F.sum("total") / F.sum("n"), digits).alias("mean_y"),
        F.round(F.sum(F.col("usual") * F.col("n")) / F.sum(F.when(F.col("usual").isNotNull(), F.col("n"))), digits).alias("mean_plain"))
    return out
