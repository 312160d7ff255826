"""Holiday-name expressions: clean a name, map a name to a model code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the original program's) -----------------------------------
# Suffixes removed from holiday names, as regular expressions, in this order.
OBSERVED_SUFFIX = r"\(Observed\)"
ESTIMATED_SUFFIX = r"\* \(\*estimated\)"
# Holiday name -> integer code fed to the tree model; "nan" stands for "no holiday".
HOLIDAY_CODES = {
    "nan": 0,
    "Deepavali": 1,
    "Christmas Day": 2,
    "New Year's Day": 3,
    "Chinese New Year": 4,
    "Good Friday": 5,
    "Labour Day": 6,
    "Hari Raya Puasa": 7,
    "Vesak Day": 8,
    "Hari Raya Haji": 9,
    "National Day": 10,
}
# -----------------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_holiday_name(name) -> Column:
    """Drop the "(Observed)" and "* (*estimated)" markers, then trim both ends."""
    name = _c(name)
    name = F.regexp_replace(name, OBSERVED_SUFFIX, "")
    name = F.regexp_replace(name, ESTIMATED_SUFFIX, "")
    return F.trim(name)


def holiday_code(name, codes: dict[str, int] | None = None) -> Column:
    """Name → code; null name → code of "nan" (0); a name not in the map → null."""
    codes = HOLIDAY_CODES if codes is None else codes
    lookup = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in codes.items()))
    return F.try_element_at(lookup, F.coalesce(_c(name), F.lit("nan")))
