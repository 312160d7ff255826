"""Linear trend × weekday factor: the trend-and-weekly part of the structural model, in SQL.

Fit per key (series, or series and fold) from plain sums, so it runs as two aggregates and
gives the same numbers in any SQL engine:

    t = days since the key's first training day
    slope = (n·Σty − Σt·Σy) / (n·Σt² − (Σt)²),  intercept = (Σy − slope·Σt) / n
    multiplicative: factor_w = Σy_w / (n_w·intercept + slope·Σt_w)   (weekday w)
    additive:       offset_w = (Σy_w − n_w·intercept − slope·Σt_w) / n_w

Forecast = trend(t) · factor_w  (or trend(t) + offset_w); band = ± z₈₀ · in-sample RMSE.
The forecast is left unrounded: with integer counts every sum above is exact, so it is the
same double in any engine. The band (from a sum of residuals) is rounded to ``digits``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------
Z80 = 1.2815515655446004  # two-sided 80 % normal band
# -------------------------------------------------------------------------------------------

MODES = ("mul", "add")


def _fit(train: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    origin = train.groupBy(*keys).agg(F.min("ds").alias("origin"))
    x = train.join(origin, keys).withColumns({
        "_t": F.datediff("ds", "origin").cast("double"),
        "_y": F.col("y").cast("double"),
        "_w": F.weekday("ds"),
    })
    lin = x.groupBy(*keys, "origin").agg(
        F.count("_y").cast("double").alias("n"), F.sum(F.when(F.col("_y").isNotNull(), F.col("_t"))).alias("st"),
        F.sum("_y").alias("sy"), F.sum(F.when(F.col("_y").isNotNull(), F.col("_t") * F.col("_t"))).alias("stt"),
        F.sum(F.col("_t") * F.col("_y")).alias("sty"),
    )
    den = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    slope = F.coalesce((F.col("n") * F.col("sty") - F.col("st") * F.col("sy")) / F.nullif(den, F.lit(0.0)), F.lit(0.0))
    lin = lin.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("st")) / F.col("n"))
    lin = lin.select(*keys, "origin", "slope", "intercept")
    wk = x.where(F.col("_y").isNotNull()).groupBy(*keys, "_w").agg(
        F.count("_y").cast("double").alias("nw"), F.sum("_t").alias("stw"), F.sum("_y").alias("syw"))
    wk = wk.join(lin, keys)
    tw = F.col("nw") * F.col("intercept") + F.col("slope") * F.col("stw")
    wk = wk.select(*keys, F.col("_w").alias("wday"),
                   (F.col("syw") / F.nullif(tw, F.lit(0.0))).alias("factor"),
                   ((F.col("syw") - tw) / F.col("nw")).alias("offset"))
    return lin, wk


def _apply(df: DataFrame, lin: DataFrame, wk: DataFrame, keys: list[str]) -> DataFrame:
    """Both forecasts from one fit: ``fc_mul`` and ``fc_add``."""
    x = df.join(lin, keys).withColumn("wday", F.weekday("ds")).join(wk, keys + ["wday"], "left")
    trend = F.col("intercept") + F.col("slope") * F.datediff("ds", "origin").cast("double")
    return x.withColumns({"fc_mul": trend * F.coalesce(F.col("factor"), F.lit(1.0)),
                         "fc_add": trend + F.coalesce(F.col("offset"), F.lit(0.0))})


def trend_weekday(train: DataFrame, predict: DataFrame, keys: list[str], mode: str = "mul",
                  digits: int = 6) -> DataFrame:
    """Fit on ``train`` per ``keys``, forecast the ``predict`` rows.

    ``mode`` is ``mul``, ``add`` or ``both`` (both share one fit: same sums, same passes).
    Output: ``keys…, ds, actual, fcst, lo, hi, model``.
    """
    modes = list(MODES) if mode == "both" else [mode]
    if any(m not in MODES for m in modes):
        raise ValueError(f"mode must be one of {MODES} or 'both'")
    lin, wk = _fit(train, keys)
    y = F.col("y").cast("double")
    spread = _apply(train, lin, wk, keys).groupBy(*keys).agg(
        *[F.sqrt(F.avg(F.pow(y - F.col(f"fc_{m}"), 2))).alias(f"rmse_{m}") for m in modes])
    out = _apply(predict, lin, wk, keys).join(spread, keys, "left")
    parts = []
    for m in modes:
        fc = F.col(f"fc_{m}")
        half = F.lit(Z80) * F.coalesce(F.col(f"rmse_{m}"), F.lit(0.0))
        parts.append(F.struct(fc.alias("fcst"), F.round(fc - half, digits).alias("lo"),
                              F.round(fc + half, digits).alias("hi"), F.lit(f"trend_weekday_{m}").alias("model")))
    one = parts[0] if len(parts) == 1 else None
    x = out.select(*keys, "ds", y.alias("actual"), (one if one is not None else F.explode(F.array(*parts))).alias("_m"))
    return x.select(*keys, "ds", "actual", "_m.fcst", "_m.lo", "_m.hi", "_m.model")


def trend_weekday_rows(rows: DataFrame, keys: list[str], mode: str = "both", digits: int = 6) -> DataFrame:
    """Same model when train and test rows share one frame (``role`` = train/test), as fold
    expansions produce: every sum is a window aggregate over the group keys (weekday sums over
    keys + weekday, which the keys partitioning already satisfies), so fit and forecast run
    after a single exchange, with no joins. Same formulas, same numbers as ``trend_weekday``.

    Output: test rows as ``keys…, ds, actual, fcst, lo, hi, model``.
    """
    modes = list(MODES) if mode == "both" else [mode]
    if any(m not in MODES for m in modes):
        raise ValueError(f"mode must be one of {MODES} or 'both'")
    k = Window.partitionBy(*keys)
    kw = Window.partitionBy(*keys, "wday")
    is_train = F.col("role") == "train"
    y = F.col("y").cast("double")
    x = rows.repartition(*keys).withColumn("wday", F.weekday("ds"))
    x = x.withColumn("origin", F.min(F.when(is_train, F.col("ds"))).over(k))
    x = x.withColumns({"_t": F.datediff("ds", "origin").cast("double"), "_y": F.when(is_train, y)})
    has = F.col("_y").isNotNull()
    t, yy = F.col("_t"), F.col("_y")
    x = x.withColumns({
        "n": F.count(yy).over(k).cast("double"), "st": F.sum(F.when(has, t)).over(k), "sy": F.sum(yy).over(k),
        "stt": F.sum(F.when(has, t * t)).over(k), "sty": F.sum(t * yy).over(k),
        "nw": F.count(yy).over(kw).cast("double"), "stw": F.sum(F.when(has, t)).over(kw), "syw": F.sum(yy).over(kw),
    })
    den = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    x = x.withColumn("slope", F.coalesce((F.col("n") * F.col("sty") - F.col("st") * F.col("sy"))
                                         / F.nullif(den, F.lit(0.0)), F.lit(0.0)))
    x = x.withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("st")) / F.nullif(F.col("n"), F.lit(0.0)))
    tw = F.col("nw") * F.col("intercept") + F.col("slope") * F.col("stw")
    x = x.withColumns({"factor": F.col("syw") / F.nullif(tw, F.lit(0.0)),
                       "offset": (F.col("syw") - tw) / F.nullif(F.col("nw"), F.lit(0.0))})
    trend = F.col("intercept") + F.col("slope") * t
    x = x.withColumns({"fc_mul": trend * F.coalesce(F.col("factor"), F.lit(1.0)),
                       "fc_add": trend + F.coalesce(F.col("offset"), F.lit(0.0))})
    x = x.withColumns({f"rmse_{m}": F.sqrt(F.avg(F.when(is_train, F.pow(y - F.col(f"fc_{m}"), 2))).over(k))
                       for m in modes})
    parts = []
    for m in modes:
        fc = F.col(f"fc_{m}")
        half = F.lit(Z80) * F.coalesce(F.col(f"rmse_{m}"), F.lit(0.0))
        parts.append(F.struct(fc.alias("fcst"), F.round(fc - half, digits).alias("lo"),
                              F.round(fc + half, digits).alias("hi"), F.lit(f"trend_weekday_{m}").alias("model")))
    picked = parts[0] if len(parts) == 1 else F.explode(F.array(*parts))
    out = x.where(F.col("role") == "test").select(*keys, "ds", y.alias("actual"), picked.alias("_m"))
    return out.select(*keys, "ds", "actual", "_m.fcst", "_m.lo", "_m.hi", "_m.model")
