"""Column -> Column scalar functions (all built-in, JVM side, codegen'd).

Each helper mirrors one cleaning/calendar rule of the warehouse models.  None
of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """``trim``: strips blanks on both ends (spaces only, like the warehouse)."""
    return F.trim(_c(c))


def clean_lower(c) -> Column:
    return F.lower(F.trim(_c(c)))


def normalize_category(c, allowed: Iterable[str], other: str = "unknown") -> Column:
    """Known value (after lower+trim) passes through, anything else -> ``other``.

    NULL input also maps to ``other`` (a CASE without a matching branch).
    """
    v = clean_lower(c)
    allowed = list(allowed)
    return F.when(v.isin(allowed), v).otherwise(F.lit(other))


def to_money(c, precision: int = 18, scale: int = 2) -> Column:
    return _c(c).cast(f"decimal({precision},{scale})")


def to_business_date(c, tz: str | None = None) -> Column:
    """Calendar date of a timestamp in the business time zone.

    ``tz=None`` treats the value as wall-clock time (zone-less data).  With a
    zone, an instant (TIMESTAMP) is first shifted from UTC to ``tz``.
    """
    col = _c(c)
    if tz:
        col = F.from_utc_timestamp(col.cast(TimestampType()), tz)
    return F.to_date(col)


def month_start(c) -> Column:
    """First day of the month as DATE (``date_trunc`` would give a TIMESTAMP)."""
    return F.trunc(F.to_date(_c(c)), "month")


def week_start(c) -> Column:
    """Monday of the ISO week as DATE."""
    return F.trunc(F.to_date(_c(c)), "week")


def quarter_start(c) -> Column:
    return F.trunc(F.to_date(_c(c)), "quarter")


def year_start(c) -> Column:
    return F.trunc(F.to_date(_c(c)), "year")


def year_of(c) -> Column:
    return F.year(_c(c)).cast("int")


def iso_weekday(c) -> Column:
    """1 = Monday .. 7 = Sunday (``dayofweek`` would give Sunday = 1)."""
    return (F.weekday(_c(c)) + 1).cast("int")


def day_of_month(c) -> Column:
    return F.dayofmonth(_c(c)).cast("int")


def yyyymm(c) -> Column:
    col = _c(c)
    return (F.year(col) * 100 + F.month(col)).cast("int")


def flag(c, value) -> Column:
    """1 when ``c = value``, else 0 (NULL -> 0)."""
    return F.when(_c(c) == F.lit(value), 1).otherwise(0).cast("int")


def now_ts() -> Column:
    return F.current_timestamp()


def fmt_date(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


def round_half_even(c, digits: int = 2) -> Column:
    """Scale, round to the nearest integer (ties to even), unscale: the one
    rounding rule of doubles here (0.575 is just below its decimal: 0.57)."""
    f = float(10 ** digits)
    return F.rint(_c(c) * F.lit(f)) / F.lit(f)


def args_json(df: DataFrame, name: str) -> Column:
    """JSON text of a struct, map or array column; strings pass through unchanged."""
    return F.col(name) if isinstance(df.schema[name].dataType, StringType) else F.to_json(name)


def truncate_to(c, granularity: str) -> Column:
    """Truncate a date/timestamp to ``granularity`` and return a DATE."""
    g = granularity.lower()
    if g == "day":
        return F.to_date(_c(c))
    if g in ("week", "month", "quarter", "year"):
        return F.trunc(F.to_date(_c(c)), g)
    raise ValueError(f"unsupported granularity {granularity!r}")


# Granularities that nest: a rollup at key can answer any value coarser.
# week does not nest in month/quarter/year (weeks straddle month ends).
GRANULARITY_PARENTS = {
    "day": {"day", "week", "month", "quarter", "year"},
    "week": {"week"},
    "month": {"month", "quarter", "year"},
    "quarter": {"quarter", "year"},
    "year": {"year"},
}
