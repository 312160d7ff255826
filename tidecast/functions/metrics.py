"""Error measures as aggregate expressions (use inside ``groupBy(...).agg``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the original program's) -----------------------------------
# Offset added to the actual before dividing in the percentage KPI.
KPI_OFFSET = 0.1
# -----------------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pair(actual, fcst):
    """Rows where both sides are present (SQL ``avg`` skips the rest)."""
    a, f = _c(actual), _c(fcst)
    both = a.isNotNull() & f.isNotNull()
    return F.when(both, a), F.when(both, f)


def mae(actual, fcst) -> Column:
    a, f = _pair(actual, fcst)
    return F.avg(F.abs(a - f))


def rmse(actual, fcst) -> Column:
    a, f = _pair(actual, fcst)
    return F.sqrt(F.avg(F.pow(a - f, 2)))


def mape(actual, fcst) -> Column:
    """Mean absolute % error; rows with a zero actual are skipped."""
    a, f = _pair(actual, fcst)
    return F.avg(F.abs((a - f) / F.nullif(a, F.lit(0.0)))) * 100.0


def kpi(actual, fcst) -> Column:
    """Plain offset % error: 100 · mean(|a − f| / (a + 0.1))."""
    a, f = _pair(actual, fcst)
    return F.avg(F.abs((a - f) / (a + KPI_OFFSET))) * 100.0


def weighted_kpi(actual, fcst) -> Column:
    """Offset % error weighted by the actual: 100 · Σ(|a − f| / (a + 0.1) · a) / Σa; Σa = 0 → null."""
    a, f = _pair(actual, fcst)
    return F.sum(F.abs((a - f) / (a + KPI_OFFSET)) * a) * 100.0 / F.nullif(F.sum(a), F.lit(0.0))


def matched(actual, fcst) -> Column:
    """Rows that entered the measures."""
    a, f = _c(actual), _c(fcst)
    return F.count_if(a.isNotNull() & f.isNotNull())


def all_measures(actual="actual", fcst="fcst", digits: int | None = 6) -> list[Column]:
    out = {
        "mae": mae(actual, fcst),
        "rmse": rmse(actual, fcst),
        "mape": mape(actual, fcst),
        "kpi": kpi(actual, fcst),
        "wkpi": weighted_kpi(actual, fcst),
    }
    cols = [(F.round(v, digits) if digits is not None else v).alias(k) for k, v in out.items()]
    return cols + [matched(actual, fcst).alias("n_matched")]
