"""Long and wide forms."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.cluster import bounded_rows
from waymark.operators.columns import numeric_columns


def column_name(prefix: str, value: str | None) -> str:
    """A plain column name from a data value; a missing value is named ``NA``."""
    return f"{prefix}_{re.sub(r'[^0-9A-Za-z]+', '_', 'NA' if value is None else value).strip('_')}"


def column_names(prefix: str, values: Sequence[str | None]) -> list[str]:
    """One name per value. Values with the same plain name are told apart by a number, in the
    order given, whatever the case of their letters."""
    used: set[str] = set()
    names = []
    for value in values:
        plain = name = column_name(prefix, value)
        number = 1
        while name.lower() in used:
            number += 1
            name = f"{plain}_{number}"
        used.add(name.lower())
        names.append(name)
    return names


def key_values(df: DataFrame, *keys: str) -> dict[str, list[str | None]]:
    """Distinct values of pivot keys, read in one pass; a missing value comes first. They become
    columns, so a key with more values than a lookup may have is refused: see ``key_counts``."""
    cells = df.select(*[F.col(k).cast("string").alias(k) for k in keys])
    rows = bounded_rows(cells.unpivot([], list(keys), "key", "value").distinct())
    if rows is None:
        raise ValueError(f"{', '.join(keys)}: too many values for one column per value; use the long form of key_counts")
    values = lambda k: [r["value"] for r in rows if r["key"] == k]
    return {k: sorted(values(k), key=lambda v: (v is not None, v or "")) for k in keys}


def count_columns(key: str, values: Sequence[str | None]) -> list[Column]:
    """One conditional count per key value, to be used inside a single aggregate."""
    cell = F.col(key).cast("string")
    named = zip(values, column_names(key, values), strict=True)
    return [F.count_if(cell.eqNullSafe(F.lit(v).cast("string"))).alias(name) for v, name in named]


def key_counts(df: DataFrame, id_column: str, key: str) -> DataFrame:
    """Rows per id and key value in long form, ``id, key, n``: what ``spread_counts`` holds, for
    any number of values, without the zeros."""
    return df.groupBy(id_column, F.col(key).cast("string").alias(key)).agg(F.count(F.lit(1)).alias("n"))


def spread_counts(df: DataFrame, id_column: str, key: str, values: Sequence[str] | None = None) -> DataFrame:
    """Rows per id and key value, one column per value, zero where there are none."""
    values = key_values(df, key)[key] if values is None else values
    return df.groupBy(id_column).agg(*count_columns(key, values))


def gather(df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(columns), key, value)


def gather_numeric(df: DataFrame, ids: Sequence[str], key: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long over all numeric columns, as doubles."""
    columns = numeric_columns(df, ids)
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(ids), columns, key, value)


def widen(
    df: DataFrame, ids: Sequence[str], key: str, values: Sequence[str], measures: Sequence[str], prefix: str | None = None
) -> DataFrame:
    """Long to wide. Columns are ``<prefix or measure>_<value>``."""
    cells = []
    for measure in measures:
        for value, name in zip(values, column_names(prefix if prefix else measure, values), strict=True):
            cells.append(F.first(F.when(F.col(key) == value, F.col(measure)), ignorenulls=True).alias(name))
    return df.groupBy(*ids).agg(*cells)
