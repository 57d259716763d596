"""Column expressions with the null and rounding rules the analytics rely on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

EARTH_RADIUS_KM = 6371.0  # fixed value

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole days from start to end, rounded down: one hour early is -1, 23 hours late is 0.

    Works on the interval between the two, so no time zone takes part.
    """
    gap = _col(end) - _col(start)
    whole = F.extract(F.lit("DAY"), gap)
    return whole.cast("bigint") - (gap < F.make_dt_interval(whole)).cast("bigint")


def is_late(delay_days: ColumnOrName) -> Column:
    """True when the delay is a day or more; an undelivered order is not late."""
    return F.coalesce(_col(delay_days) > 0, F.lit(False))


def sum_or_zero(c: ColumnOrName) -> Column:
    """Sum in which a group without values counts 0."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def ratio(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """Quotient as double; null when the denominator is 0 or missing."""
    return _col(numerator).cast("double") / F.nullif(_col(denominator).cast("double"), F.lit(0.0))


def freight_ratio(freight: ColumnOrName, revenue: ColumnOrName) -> Column:
    return ratio(freight, revenue)


def late_share(flag: ColumnOrName = "is_late") -> Column:
    """Mean of a boolean."""
    return F.avg(_col(flag).cast("int"))


def all_present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose grouping keys are all present; grouping drops the others."""
    if not keys:
        return df
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def great_circle_km(
    lat1: ColumnOrName, lng1: ColumnOrName, lat2: ColumnOrName, lng2: ColumnOrName
) -> Column:
    """Great-circle distance of two points in degrees; a missing coordinate counts as 0."""
    phi1, lam1, phi2, lam2 = (
        F.radians(F.coalesce(_col(c), F.lit(0.0))) for c in (lat1, lng1, lat2, lng2)
    )

    def half_sine_squared(angle: Column) -> Column:
        return F.pow(F.sin(angle / 2), 2)

    chord = half_sine_squared(phi2 - phi1) + F.cos(phi1) * F.cos(phi2) * half_sine_squared(
        lam2 - lam1
    )
    return F.asin(F.least(F.sqrt(chord), F.lit(1.0))) * (2 * EARTH_RADIUS_KM)


def sorted_distinct_list(c: ColumnOrName, separator: str = ",") -> Column:
    """Aggregate: the distinct values in order, joined; '' when all are null."""
    return F.array_join(F.array_sort(F.collect_set(_col(c))), separator)


def first_token(c: ColumnOrName, separator: str = ",") -> Column:
    return F.substring_index(_col(c), separator, 1)


def _as_text(c: ColumnOrName, pattern: str) -> Column:
    return F.call_function("format_number", _col(c), F.lit(pattern))


# Display formats of the headline figures.
def amount_text(c: ColumnOrName) -> Column:
    return _as_text(c, "#,##0.00")


def money_text(c: ColumnOrName) -> Column:
    return F.concat(F.lit("R$ "), amount_text(c))


def days_text(c: ColumnOrName) -> Column:
    return F.concat(_as_text(c, "0.0"), F.lit(" dias"))


def percent_text(c: ColumnOrName) -> Column:
    return F.concat(_as_text(_col(c) * 100, "0.00"), F.lit("%"))


def plain_text(c: ColumnOrName, digits: int) -> Column:
    return _as_text(c, "0." + "0" * digits)
