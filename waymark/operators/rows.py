"""Row filters, joins, unions and ordering."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.cluster import as_lookup, bounded_rows, checkpointed
from waymark.operators.windows import running_totals


def overwrite_where(df: DataFrame, column: str, condition: Column, value) -> DataFrame:
    """Replace a column's value where the condition holds; a null condition changes nothing."""
    value = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def rows_at_maximum(df: DataFrame, column: str) -> DataFrame:
    """Every row that holds the column's maximum, ties kept."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def not_all_null(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def left_join_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on differently named keys; the right key does not survive."""
    if right_key == left_key:
        return left.join(right, left_key, "left")
    return left.join(right, left[left_key] == right[right_key], "left").drop(right[right_key])


def inner_join_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    if right_key == left_key:
        return left.join(right, left_key, "inner")
    return left.join(right, left[left_key] == right[right_key], "inner").drop(right[right_key])


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every shared column name."""
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("the tables share no column name")
    return left.join(right, shared, how)


# Rows of a grid that one task makes.
GRID_ROWS = 100_000


def numbered_levels(df: DataFrame, column: str, number: str, **limits) -> tuple[DataFrame, int]:
    """The distinct values of a column, numbered in their order from zero, and how many there
    are; missing values are left out. A short list becomes a broadcast table."""
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    rows = bounded_rows(levels, **limits)
    if rows is not None:
        schema = T.StructType([T.StructField(number, T.LongType()), df.schema[column]])
        values = sorted(r[0] for r in rows)
        return F.broadcast(df.sparkSession.createDataFrame(list(enumerate(values)), schema)), len(values)
    placed = checkpointed(running_totals(levels, [], [F.col(column)], {"__place": F.lit(1)}).select((F.col("__place") - 1).alias(number), column))
    return placed, placed.count()


def level_grid(df: DataFrame, columns: Sequence[str], **limits) -> DataFrame:
    """Every combination of the distinct values of the columns.

    The grid is a range of numbers. A number holds one place in the list of each column's
    values, and the values are joined to it by their place, so no list is ever in one row.
    """
    places = [f"__place_{i}" for i in range(len(columns))]
    levels = [numbered_levels(df, c, p, **limits) for c, p in zip(columns, places, strict=True)]
    size = math.prod(n for _, n in levels)
    stride, out = 1, df.sparkSession.range(0, size, 1, max(1, math.ceil(size / GRID_ROWS))).withColumnRenamed("id", "__number")
    for place, (_, n) in zip(places, levels, strict=True):
        out = out.withColumn(place, F.expr(f"(__number div {stride}) % {max(n, 1)}"))
        stride *= max(n, 1)
    for place, (table, _) in zip(places, levels, strict=True):
        out = out.join(table, place)
    return out.select(*columns)


def lookup_replace(df: DataFrame, column: str, mapping: DataFrame | Mapping[str, str], old: str = "old", new: str = "new") -> DataFrame:
    """Replace values through a mapping table; values it does not list stay.

    A mapping within the lookup bound is broadcast, a larger one is joined by shuffle.
    """
    if not isinstance(mapping, DataFrame):
        mapping = df.sparkSession.createDataFrame(list(mapping.items()), f"{old} string, {new} string")
    table = as_lookup(mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new")))
    joined = df.join(table, df[column] == F.col("__old"), "left")
    return joined.withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def members(df: DataFrame, values: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """Rows whose value is (or is not) in a computed one-column set. Null matches null."""
    kept = as_lookup(values.select(F.col(values.columns[0]).alias("__member")).distinct())
    return df.join(kept, df[column].eqNullSafe(F.col("__member")), "left_semi" if inside else "left_anti")


def stack_tables(*tables: DataFrame) -> DataFrame:
    """Union by column name; columns a table lacks are null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def stack_tagged(tables: Mapping[str, DataFrame], tag: str = "data_set") -> DataFrame:
    return stack_tables(*[t.withColumn(tag, F.lit(name)) for name, t in tables.items()])


def split_by(df: DataFrame, column: str, values: Sequence) -> dict:
    """One filtered table per value."""
    return {v: df.where(F.col(column) == v).drop(column) for v in values}


def sort_nulls_last(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Sort by (column, descending) pairs with nulls at the end either way."""
    return df.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys])
