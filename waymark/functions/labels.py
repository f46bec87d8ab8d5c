"""Column expressions on categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Destination class to region.
DESTINATION_REGIONS = {
    "NDF": "NDF",
    "US": "US",
    "other": "other",
    "FR": "EUR",
    "CA": "AUCA",
    "GB": "GB",
    "ES": "EUR",
    "IT": "EUR",
    "PT": "EUR",
    "NL": "EUR",
    "DE": "EUR",
    "AU": "AUCA",
}


def relabel(column: Column, old: str, new: str) -> Column:
    return F.when(column == old, F.lit(new)).otherwise(column)


def null_to(column: Column, label: str = "unknown") -> Column:
    return F.coalesce(column, F.lit(label))


def to_null(column: Column, label: str = "-unknown-") -> Column:
    return F.nullif(column, F.lit(label))


def remap(column: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values; others stay. For mappings of a handful of entries."""
    out = column
    for old, new in mapping.items():
        out = F.when(column == old, F.lit(new)).otherwise(out)
    return out


def collapse(column: Column, groups: Mapping[str, Sequence[str]], rest: str | None = None) -> Column:
    """Name of the group a value belongs to. Values in no group become ``rest`` or stay."""
    out = None
    for name, members in groups.items():
        hit = column.isin(*members)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    fallback = F.when(column.isNotNull(), F.lit(rest)) if rest is not None else column
    return out.otherwise(fallback)


def yes_no(condition: Column) -> Column:
    """YES or NO; null stays null."""
    return F.when(condition, "YES").when(~condition, "NO")


def to_code(column: Column, levels: Sequence[str]) -> Column:
    """Zero-based position of a value in its declared level list; null if absent."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), column)
    return F.when(position > 0, (position - 1).cast("int"))


def from_code(code: Column, levels: Sequence[str]) -> Column:
    """Level at a zero-based position; null if there is none."""
    return F.try_element_at(F.array(*[F.lit(v) for v in levels]), code.cast("int") + 1)
