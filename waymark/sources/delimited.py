"""Typed CSV scan and CSV sink.

Cells are read as text and typed afterwards with ``try_`` expressions, so that one bad cell
becomes null and never fails the job. Column pruning still reaches the scan: a skipped or
unused column is not converted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that stand for a missing value.
NULL_TOKENS = ("null", "empty")

# Destination classes in their declared order.
DESTINATIONS = ("NDF", "US", "other", "FR", "CA", "GB", "ES", "IT", "PT", "NL", "DE", "AU")

# Column kinds: id, text, date, number (lenient), double (strict), skip.
USER_COLUMNS = {
    "id": "id",
    "date_account_created": "date",
    "timestamp_first_active": "text",
    "date_first_booking": "date",
    "gender": "text",
    "age": "number",
    "signup_method": "text",
    "signup_flow": "text",
    "language": "text",
    "affiliate_channel": "text",
    "affiliate_provider": "text",
    "first_affiliate_tracked": "text",
    "signup_app": "text",
    "first_device_type": "text",
    "first_browser": "text",
}
LABELLED_USER_COLUMNS = {**USER_COLUMNS, "country_destination": "text"}
SESSION_COLUMNS = {
    "user_id": "id",
    "action": "text",
    "action_type": "text",
    "action_detail": "text",
    "device_type": "text",
    "secs_elapsed": "double",
}
COUNTRY_COLUMNS = {
    "country_destination": "text",
    "lat_destination": "double",
    "lng_destination": "double",
    "distance_km": "double",
    "destination_km2": "double",
    "destination_language": "text",
    "language_levenshtein_distance": "double",
}
AGE_BUCKET_COLUMNS = {
    "age_bucket": "text",
    "country_destination": "text",
    "gender": "text",
    "population_in_thousands": "number",
    "year": "skip",
}


def lenient_number(column: Column) -> Column:
    """First number in a text, ignoring grouping marks and surrounding text. The whole part
    may be missing (``.5``)."""
    digits = F.regexp_extract(F.translate(column, ",", ""), r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    return F.nullif(digits, F.lit("")).try_cast("double")


def date_by_pattern(column: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(column, pattern)


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Turn every listed text into null, in all text columns, in one projection."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in text})


def within_levels(column: Column, levels: Sequence[str]) -> Column:
    """Keep a value only if it is a declared level."""
    return F.when(column.isin(*levels), column)


_TYPED = {
    "id": lambda c: F.coalesce(c, F.lit("")),
    "text": lambda c: c,
    "date": date_by_pattern,
    "number": lenient_number,
    "double": lambda c: c.try_cast("double"),
}


def read_declared(
    spark: SparkSession,
    path: str | list[str],
    columns: dict[str, str],
    tokens: Sequence[str] = NULL_TOKENS,
    line_breaks: bool = False,
) -> DataFrame:
    """Scan a CSV with declared columns; see ``_TYPED`` for the column kinds.

    Quotes inside a quoted cell are doubled. Cells with line breaks need ``line_breaks``, which
    reads each file in one task.

    An unquoted empty cell is null. A quoted empty cell stays an empty text because
    ``nullValue`` is set to a token; id columns keep empty cells as empty texts.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("multiLine", line_breaks)
        .option("nullValue", tokens[0] if tokens else "null")
        .csv(path)
    )
    cleaned = null_tokens(raw, tokens) if tokens else raw
    return cleaned.select(*[_TYPED[kind](F.col(c)).alias(c) for c, kind in columns.items() if kind != "skip"])


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Scan a small CSV letting Spark infer its types (an extra pass over the file)."""
    return spark.read.option("header", True).option("escape", '"').option("inferSchema", True).csv(path)


def write_delimited(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """Write a folder of CSV parts, one per partition; quotes inside a cell are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", quote_all).csv(path)


def tagged(df: DataFrame, name: str, column: str = "dataset") -> DataFrame:
    """Mark every row with the dataset it came from."""
    return df.withColumn(column, F.lit(name))


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
