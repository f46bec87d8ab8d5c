"""Queries by id, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def tidied(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(run(spark, folder))

        REGISTRY[name] = Query(tidied, sql)
        return run

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output types: doubles to six places, integers as BIGINT, dates and
    booleans as text."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DateType, T.BooleanType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def sql(body: str, *tables: str) -> str:
    """A query text with the adapter tables it needs in front."""
    return ("WITH " + ",\n".join(tables) + "\n" if tables else "") + body.strip()
