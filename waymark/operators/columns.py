"""Column selection, renaming and roles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that give the label away or that test rows do not have.
LEAKING_COLUMNS = ("date_first_booking", "days_book_signup", "book_month", "book_season", "made_booking")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def nominal_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def named(
    df: DataFrame,
    starts: str | None = None,
    ends: str | None = None,
    contains: str | None = None,
    matches: str | None = None,
) -> list[str]:
    """Column names that meet every given rule."""
    keep = []
    for name in df.columns:
        if starts is not None and not name.startswith(starts):
            continue
        if ends is not None and not name.endswith(ends):
            continue
        if contains is not None and contains not in name:
            continue
        if matches is not None and not re.search(matches, name):
            continue
        keep.append(name)
    return keep


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """All columns from ``first`` to ``last`` in table order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def rename_by_rule(df: DataFrame, rule: Callable[[str], str], columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: rule(c) for c in columns})


def apply_across(df: DataFrame, columns: Sequence[str], change: Callable[[Column], Column]) -> DataFrame:
    """One projection that changes every listed column."""
    return df.withColumns({c: change(F.col(c)) for c in columns})


def attach_by_id(df: DataFrame, other: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Add the columns of ``other`` to ``df`` by row id. Row position is never used."""
    return df.join(other, list(id_columns), "left")


@dataclass(frozen=True)
class Roles:
    """Which columns are ids and which one is the label; the rest are predictors."""

    ids: tuple[str, ...] = ("id",)
    label: str = "country_destination"

    @property
    def reserved(self) -> tuple[str, ...]:
        return (*self.ids, self.label)

    def numeric(self, df: DataFrame) -> list[str]:
        return numeric_columns(df, self.reserved)

    def nominal(self, df: DataFrame) -> list[str]:
        return nominal_columns(df, self.reserved)

    def predictors(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in self.reserved]


def extract_dataset(df: DataFrame, name: str, drop: Sequence[str] = LEAKING_COLUMNS, tag: str = "dataset") -> DataFrame:
    """Rows of one dataset without its tag and without leaking columns."""
    return df.where(F.col(tag) == name).drop(tag, *drop)
