"""Column expressions on dates, numbers and texts. All stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stand-in for a missing booking date, reference year for birth years,
# first value taken to be a birth year, and the plausible age range.
NO_BOOKING_DATE = "2016-01-01"
REFERENCE_YEAR = 2014
FIRST_BIRTH_YEAR = 1924
AGE_RANGE = (15, 104)
AGE_BIN_RANGE = (15, 105)
AGE_BIN_WIDTH = 5


def compact_timestamp_date(column: Column) -> Column:
    """Date of a ``yyyyMMddHHmmss`` text."""
    return F.try_to_date(column, "yyyyMMddHHmmss")


def day_gap(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def month_name(date: Column) -> Column:
    return F.date_format(date, "MMMM")


def season(date: Column) -> Column:
    month = F.month(date)
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "autumn")
    )


def year_text(date: Column) -> Column:
    return F.date_format(date, "yyyy")


def cyclic_month(date: Column) -> tuple[Column, Column]:
    """Sine and cosine of the position of a day inside its month."""
    angle = F.lit(2 * math.pi) * (F.dayofmonth(date) - 1) / F.dayofmonth(F.last_day(date))
    return F.sin(angle), F.cos(angle)


def booking_or_sentinel(date: Column) -> Column:
    return F.coalesce(date, F.lit(NO_BOOKING_DATE).cast("date"))


def repair_birth_year(age: Column) -> Column:
    return F.when(age >= FIRST_BIRTH_YEAR, F.lit(REFERENCE_YEAR) - age).otherwise(age)


def plausible(value: Column, low: float = AGE_RANGE[0], high: float = AGE_RANGE[1]) -> Column:
    return F.when(value.between(low, high), value)


def half_open_bin(
    value: Column,
    low: int = AGE_BIN_RANGE[0],
    high: int = AGE_BIN_RANGE[1],
    width: int = AGE_BIN_WIDTH,
    missing: str = "unknown",
) -> Column:
    """Label ``[a,b)`` of the bin holding ``value``; anything outside becomes ``missing``."""
    # The value is used once, so that filters on the label stay small when Spark inlines it.
    labels = F.array(*[F.lit(f"[{a},{a + width})") for a in range(low, high, width)])
    return F.coalesce(F.get(labels, F.floor((value - low) / width).cast("int")), F.lit(missing))


def bin_index(value: Column, low: int = AGE_BIN_RANGE[0], high: int = AGE_BIN_RANGE[1], width: int = AGE_BIN_WIDTH) -> Column:
    """Zero-based position of the bin, for sorting labels."""
    return F.when((value >= low) & (value < high), F.floor((value - low) / width).cast("int"))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def branch(condition: Column, yes: Column | str, no: Column | str) -> Column:
    """Two-way conditional that stays null when its condition is null."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(condition, lift(yes)).when(~condition, lift(no))


def cases(*branches: tuple[Column, Column | float | str]) -> Column:
    """First branch whose condition holds, null if none does."""
    out = None
    for condition, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def extract_or_null(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def without(value: Column, members: list) -> Column:
    """Not a member of the list; a null value counts as not a member."""
    return ~F.coalesce(value.isin(*members), F.lit(False))
