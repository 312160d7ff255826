"""Daily-series operators: calendar, densify, combine, patches, interpolation, trims, resampling.

A series frame is ``series_id, ds (date), y``. Every window partitions by ``series_id``; a
series is at most one row per day, so a window partition stays small even when one series
holds most of the raw cases (those were folded by the counting aggregate before this point).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bucket_label, date_range
from ..functions.numeric import parse_grouped_number
from ..functions.dates import day_first_date
from .common import SERIES
from .intervals import interval_join


# ---------------------------------------------------------------- calendar and densify --

def calendar(bounds: DataFrame, series: str = SERIES) -> DataFrame:
    """Every day from ``start`` to ``end`` for each series row of ``bounds``."""
    return bounds.select(series, F.explode(date_range("start", "end")).alias("ds"))


def missing_days(counts: DataFrame, bounds: DataFrame, series: str = SERIES) -> DataFrame:
    """Calendar days that have no count row (left-anti join on series and day)."""
    return calendar(bounds, series).join(counts.select(series, "ds"), [series, "ds"], "left_anti")


def densify_zero(counts: DataFrame, bounds: DataFrame, series: str = SERIES) -> DataFrame:
    """Counts plus a 0 row for every missing calendar day.

    Same rows as counts ∪ (calendar ⋉̸ counts with 0), stated as one full outer join so the
    counts are read once (the anti-join-plus-union form uses them twice and re-runs the
    case scan, filter and aggregate behind them).
    """
    c = counts.select(series, "ds", F.col("y").cast("bigint").alias("y"))
    out = c.join(calendar(bounds, series), [series, "ds"], "full")
    return out.select(series, "ds", F.coalesce(F.col("y"), F.lit(0).cast("bigint")).alias("y"))


def combine_sources(a: DataFrame, b: DataFrame, series: str = SERIES) -> DataFrame:
    """Union of two daily series, summed per (series, day) so a shared day appears once."""
    both = a.select(series, "ds", "y").unionByName(b.select(series, "ds", "y"))
    return both.groupBy(series, "ds").agg(F.sum("y").alias("y"))


# ---------------------------------------------------------------------------- patches --

def patch_values(df: DataFrame, patch: DataFrame, series: str = SERIES) -> DataFrame:
    """Overlay known values: ``y = coalesce(patch.y, y)`` on (series, day).

    The patch table is reduced to one row per key first so the left join cannot multiply
    rows, and broadcast only behind a size check.
    """
    dim = patch.groupBy(series, "ds").agg(F.max("y").alias("_patched"))
    out = df.join(dim, [series, "ds"], "left")
    return out.withColumn("y", F.coalesce(F.col("_patched"), F.col("y")).cast(df.schema["y"].dataType)).drop("_patched")


def _rules_frame(spark, rules):
    rows = [(i, t0, t1, s0, s1) for i, (t0, t1, s0, s1) in enumerate(rules, 1)]
    r = spark.createDataFrame(rows, "rule int, t0 string, t1 string, s0 string, s1 string")
    return r.select("rule", *[F.col(c).cast("date").alias(c) for c in ("t0", "t1", "s0", "s1")])


def _independent(rules) -> bool:
    """True when no rule reads days an earlier rule rewrites (then one pass is exact)."""
    for j, (_, _, s0, s1) in enumerate(rules):
        for t0, t1, _, _ in rules[:j]:
            if s0 <= t1 and t0 <= s1:
                return False
    return True


def _copy_pass(df: DataFrame, rules_df: DataFrame, series: str) -> DataFrame:
    """One read of ``df``: tag rows with the rule windows they fall in (interval join by day
    buckets, rows in none keep a null rule), rank each side by day with running
    counts, pair a target with the source of the same rank by a lag over (rank, side), then
    one aggregate per (series, day) keeps the last rule's value or the original."""
    in_t = F.col("ds").between(F.col("t0"), F.col("t1"))
    in_s = F.col("ds").between(F.col("s0"), F.col("s1"))
    x = interval_join(df.select(series, "ds", "y"), rules_df, [("t0", "t1"), ("s0", "s1")], how="left")
    sides = F.filter(F.array(F.when(in_s, F.lit(0)), F.when(in_t, F.lit(1))), lambda v: v.isNotNull())
    x = x.withColumn("side", F.explode_outer(sides))  # 0 = source, 1 = target
    by_day = Window.partitionBy(series, "rule").orderBy("ds", "side").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("rank", F.when(F.col("side") == 1, F.count_if(F.col("side") == 1).over(by_day))
                     .otherwise(F.count_if(F.col("side") == 0).over(by_day)))
    by_rank = Window.partitionBy(series, "rule").orderBy("rank", "side")
    paired = ((F.col("side") == 1) & (F.lag("side").over(by_rank) == 0)
              & (F.lag("rank").over(by_rank) == F.col("rank")))
    x = x.withColumn("_src_y", F.when(paired, F.lag("y").over(by_rank)))
    # When targets overlap, the later rule wins (it would have been applied last).
    out = x.groupBy(series, "ds").agg(
        F.first("y").alias("y"),
        F.max_by("_src_y", F.when(F.col("_src_y").isNotNull(), F.col("rule"))).alias("_src_y"))
    y_type = df.schema["y"].dataType
    return out.select(series, "ds", F.coalesce(F.col("_src_y"), F.col("y")).cast(y_type).alias("y"))


def patch_copy(df: DataFrame, rules: list[tuple[str, str, str, str]], series: str = SERIES) -> DataFrame:
    """Copy source-window values onto target-window days, paired by rank inside each window.

    ``rules`` are ``(target_start, target_end, source_start, source_end)`` ISO dates, applied
    in order. Target days without a partner (a longer target window) keep their value. When
    no rule reads what an earlier one wrote, all rules run in one pass; otherwise one pass
    per rule, in order.
    """
    if not rules:
        return df
    spark = df.sparkSession
    if _independent(rules):
        return _copy_pass(df, _rules_frame(spark, rules), series)
    out = df
    for rule in rules:
        out = _copy_pass(out, _rules_frame(spark, [rule]), series)
    return out


# ---------------------------------------------------------------------- text series --

def detect_separator(spark, path: str, candidates: tuple[str, ...] = ("\t", ",", ";", "|")) -> str:
    """The separator of delimited text: the candidate whose count per line, outside quotes, is the
    same non-zero number on the most lines of the whole files (ties: the larger number, then the
    order of ``candidates``; the first candidate where none occurs). The driver gets one row each."""
    bare = F.regexp_replace("value", '"[^"]*"', "")
    lines = spark.read.text(path).where(F.trim("value") != "").select(bare.alias("bare"))
    each = [F.struct(F.lit(i).alias("i"), (F.length("bare") - F.length(F.replace("bare", F.lit(c)))).alias("n")) for i, c in enumerate(candidates)]
    counts = lines.select(F.inline(F.array(*each))).where("n > 0").groupBy("i", "n").agg(F.count(F.lit(1)).alias("lines"))
    best = counts.groupBy("i").agg(F.max(F.struct("lines", "n")).alias("best")).collect()
    return candidates[min(best, key=lambda r: (-r.best.lines, -r.best.n, r.i)).i] if best else candidates[0]


def read_series_text(spark, path: str, sep: str | None = None) -> DataFrame:
    """Delimited text with a header, every column read as text, header names trimmed; without
    ``sep`` the separator is detected."""
    sep = detect_separator(spark, path) if sep is None else sep
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def parse_series_text(df: DataFrame, date_col: str = "Date", value_col: str = "Open Balances",
                      series: str = SERIES) -> DataFrame:
    """Day-first date and comma-grouped number → ``series_id, ds, y``; bad text → null."""
    sid = F.col(series) if series in df.columns else F.lit("all")
    return df.select(sid.alias(SERIES), day_first_date(date_col).alias("ds"),
                     parse_grouped_number(value_col).alias("y"))


# ------------------------------------------------------------------ clean and fill gaps --

def trim_plateau(df: DataFrame, tail: int = 120, min_len: int = 30, series: str = SERIES) -> DataFrame:
    """Cut a constant tail: if the last ``tail`` rows (at least ``min_len``) hold one value,
    drop every day after the last day whose value differs from it.

    All windows share the series partitioning, so this is one exchange.
    """
    whole = Window.partitionBy(series)
    rn = F.row_number().over(Window.partitionBy(series).orderBy(F.col("ds").desc()))
    x = df.withColumn("_tail", rn <= tail)
    ty = F.when(F.col("_tail"), F.col("y"))
    x = (x.withColumn("_n", F.count(ty).over(whole))
          .withColumn("_lo", F.min(ty).over(whole))
          .withColumn("_hi", F.max(ty).over(whole)))
    x = x.withColumn("_last_real", F.max(F.when(F.col("y") != F.col("_lo"), F.col("ds"))).over(whole))
    fire = (F.col("_n") >= min_len) & (F.col("_lo") == F.col("_hi")) & F.col("_last_real").isNotNull()
    keep = ~fire | (F.col("ds") <= F.col("_last_real"))
    return x.where(keep).drop("_tail", "_n", "_lo", "_hi", "_last_real")


def interpolate(df: DataFrame, series: str = SERIES) -> DataFrame:
    """Daily grid from the first to the last day of each series; gaps and null values filled
    linearly in day distance, edges with the nearest value."""
    bounds = df.groupBy(series).agg(F.min("ds").alias("start"), F.max("ds").alias("end"))
    grid = calendar(bounds, series).join(df.select(series, "ds", "y"), [series, "ds"], "left")
    known = F.when(F.col("y").isNotNull(), F.struct(F.col("ds").alias("d"), F.col("y").cast("double").alias("v")))
    w = Window.partitionBy(series).orderBy("ds")
    prev = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    g = grid.withColumn("_p", prev).withColumn("_n", nxt)
    span = F.datediff(F.col("_n.d"), F.col("_p.d"))
    linear = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.datediff(F.col("ds"), F.col("_p.d")) / span
    filled = (F.when(F.col("y").isNotNull(), F.col("y").cast("double"))
               .when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), linear)
               .otherwise(F.coalesce(F.col("_p.v"), F.col("_n.v"))))
    return g.select(series, "ds", filled.alias("y"))


def clean_series(lines: DataFrame, date_col: str = "Date", value_col: str = "Open Balances",
                 tail: int = 120, min_len: int = 30) -> DataFrame:
    """Parse → drop bad rows → trim a constant tail → daily grid → interpolate."""
    parsed = parse_series_text(lines, date_col, value_col).na.drop(subset=["ds", "y"])
    return interpolate(trim_plateau(parsed, tail, min_len))


# ------------------------------------------------------------------------- resample --

AGGS = ("mean", "median", "last")


def resample(df: DataFrame, freq: str = "W", agg: str = "mean", series: str = SERIES) -> DataFrame:
    """Aggregate a daily series to week (``W`` ends Sunday, ``W-MON`` ends Monday) or month
    (``M``) buckets labelled by their last day; empty buckets are dropped."""
    if agg not in AGGS:
        raise ValueError("Unsupported 'agg'. Use 'mean'|'median'|'last'.")
    if freq == "D":
        return df.select(series, "ds", "y")
    y = F.col("y")
    fn = {"mean": F.avg(y), "median": F.median(y),
          "last": F.max_by(y, F.when(y.isNotNull(), F.col("ds")))}[agg]
    out = df.groupBy(series, bucket_label("ds", freq).alias("ds")).agg(fn.cast("double").alias("y"))
    return out.where(F.col("y").isNotNull())


def resample_all(df: DataFrame, freq: str, series: str = SERIES, digits: int = 6) -> DataFrame:
    """Mean, median and last of each bucket in one aggregate (mean and median rounded to
    ``digits`` so sums in any order agree)."""
    y = F.col("y")
    return df.groupBy(series, bucket_label("ds", freq).alias("ds")).agg(
        F.round(F.avg(y), digits).alias("y_mean"), F.round(F.median(y).cast("double"), digits).alias("y_median"),
        F.max_by(y, F.when(y.isNotNull(), F.col("ds"))).cast("double").alias("y_last"),
        F.count(y).alias("n_days"),
    ).where(F.col("y_mean").isNotNull())


def resample_split(df: DataFrame, days: int, freq: str = "W", agg: str = "mean", series: str = SERIES) -> DataFrame:
    """Tail split on the daily series, then each side resampled on its own; a validation
    bucket whose label also labels a training bucket (a cutoff inside a week or month) is
    dropped, so no label sits on both sides. Output adds ``split``."""
    from .filters import split_tail
    x = split_tail(df, days, series)
    tr = resample(x.where(F.col("split") == "train"), freq, agg, series).withColumn("split", F.lit("train"))
    va = resample(x.where(F.col("split") == "valid"), freq, agg, series).withColumn("split", F.lit("valid"))
    va = va.join(tr.select(series, "ds"), [series, "ds"], "left_anti")
    return tr.unionByName(va)


# --------------------------------------------------------------------------- horizon --

HORIZON_BY_FREQ = {"D": 90, "W": 26, "M": 12}


def default_horizon(freq: str) -> int:
    return HORIZON_BY_FREQ.get(freq.split("-")[0], 26)


def future_day(last, k, freq: str):
    """The k-th label after ``last`` at ``freq``."""
    if freq == "D":
        return F.date_add(last, k)
    if freq.startswith("W"):
        return F.date_add(last, k * 7)
    if freq == "M":
        return F.last_day(F.add_months(last, k))
    raise ValueError(f"unsupported frequency {freq!r}")


def extend_horizon(df: DataFrame, horizon: int, freq: str = "D", series: str = SERIES) -> DataFrame:
    """History plus ``horizon`` future labels per series (future ``y`` is null), starting
    after the last observed day."""
    last = df.groupBy(series).agg(F.max("ds").alias("_last"))
    future = last.select(series, "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_k"))
    future = future.select(series, future_day(F.col("_last"), F.col("_k"), freq).alias("ds"),
                           F.lit(None).cast(df.schema["y"].dataType).alias("y"))
    return df.select(series, "ds", "y").unionByName(future)


def horizon_only(df: DataFrame, history: DataFrame, series: str = SERIES) -> DataFrame:
    """Rows after the last history day of their series (the next-horizon sink)."""
    last = history.groupBy(series).agg(F.max("ds").alias("_last"))
    return df.join(last, series, "inner").where(F.col("ds") > F.col("_last")).drop("_last")

