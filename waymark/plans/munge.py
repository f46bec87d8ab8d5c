"""User table cleaning and feature derivation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.features.levels import kept_top, lump
from waymark.functions import labels as L
from waymark.functions import scalars as S
from waymark.operators.columns import apply_across
from waymark.operators.rows import natural_join, stack_tables
from waymark.plans.sessions import users_with_sessions

# Columns whose levels are reduced, with and without session columns.
REDUCED_COLUMNS = (
    "gender",
    "signup_method",
    "signup_flow",
    "language",
    "affiliate_channel",
    "affiliate_provider",
    "first_affiliate_tracked",
    "signup_app",
    "first_device_type",
    "first_browser",
    "book_season",
    "signup_season",
    "top_device",
)


def clean_users(users: DataFrame) -> DataFrame:
    """Levels, ages, dates and the booking flag, as two narrow projections."""
    levels = {
        "gender": L.relabel(F.lower("gender"), "-unknown-", "unknown"),
        "first_affiliate_tracked": L.null_to(F.col("first_affiliate_tracked")),
        "first_browser": L.relabel(F.col("first_browser"), "-unknown-", "unknown"),
        "age": S.plausible(S.repair_birth_year(F.col("age"))),
        "date_first_booking": S.booking_or_sentinel(F.col("date_first_booking")),
    }
    created, booked = F.col("date_account_created"), F.col("date_first_booking")
    derived = {
        "age_range": S.half_open_bin(F.col("age")),
        "days_book_signup": S.day_gap(booked, created),
        "book_month": S.month_name(booked),
        "book_season": S.season(booked),
        "signup_month": S.month_name(created),
        "signup_season": S.season(created),
        "made_booking": L.yes_no(F.col("country_destination") != "NDF"),
    }
    return users.withColumns(levels).withColumns(derived).drop("timestamp_first_active", "date_account_created", "date_first_booking")


def munge(train: DataFrame, test: DataFrame, sessions: DataFrame, countries: DataFrame, ties: str = "keep") -> DataFrame:
    """Train and test users, cleaned, with session and destination features."""
    both = clean_users(stack_tables(train, test))
    joined = natural_join(users_with_sessions(both, sessions, ties), countries, "left")
    return joined.withColumn("destination_language", L.null_to(F.col("destination_language"), "-unknown-"))


def reduce_levels(df: DataFrame, columns: Sequence[str] = REDUCED_COLUMNS, n: int = 5) -> DataFrame:
    """Keep the n most frequent levels of each column. One counting pass for all columns."""
    present = [c for c in columns if c in df.columns]
    return lump(df, present, kept_top(df, present, n), "other", null_is_level=True)


def encode_cyclic_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace date columns by the sine and cosine of their place in the month."""
    parts = {}
    for c in columns:
        sine, cosine = S.cyclic_month(F.col(c))
        parts |= {f"{c}_month_sin": sine, f"{c}_month_cos": cosine}
    return df.withColumns(parts).drop(*columns)


def round_all(df: DataFrame, columns: Sequence[str], places: int = 2) -> DataFrame:
    return apply_across(df, columns, lambda c: F.round(c, places))
