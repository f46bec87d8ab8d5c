"""Chi-squared statistics of two categories, and z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.profile import contingency


def expected_cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """Observed and expected counts of every cell, with the Pearson residual."""
    cells = contingency(df, row, column)
    rows = cells.groupBy(row).agg(F.sum("n").alias("__row"))
    columns = cells.groupBy(column).agg(F.sum("n").alias("__column"))
    expected = F.col("__row") * F.col("__column") / cells.agg(F.sum("n")).scalar()
    return (
        cells.join(rows, row)
        .join(columns, column)
        .withColumn("expected", expected)
        .withColumn("residual", (F.col("n") - F.col("expected")) / F.sqrt("expected"))
        .drop("__row", "__column")
    )


def independence(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-squared statistic, degrees of freedom and Cramer's V."""
    stats = expected_cells(df, row, column).agg(
        F.sum(F.pow("residual", 2)).alias("statistic"),
        F.sum("n").alias("n"),
        F.countDistinct(row).alias("r"),
        F.countDistinct(column).alias("c"),
    )
    return stats.select(
        "statistic",
        ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"),
        F.sqrt(F.try_divide(F.col("statistic"), F.col("n") * (F.least("r", "c") - 1))).alias("cramers_v"),
    )


def independence_p_value(df: DataFrame, row: str, column: str) -> DataFrame:
    """``independence`` with its p-value."""
    coded = StringIndexer(inputCols=[row, column], outputCols=["__r", "__c"], handleInvalid="skip")
    clean = df.select(F.col(row).cast("string").alias(row), F.col(column).cast("string").alias(column)).dropna()
    indexed = coded.fit(clean).transform(clean)
    vector = VectorAssembler(inputCols=["__r"], outputCol="__v").transform(indexed)
    tested = ChiSquareTest.test(vector, "__v", "__c", flatten=True)
    return tested.select(F.col("statistic"), F.col("degreesOfFreedom").alias("df"), F.col("pValue").alias("p_value"))


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centered and scaled copies ``z_<column>``, by the sample standard deviation."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns])
    one = stats.select(F.struct(*columns).alias("s")).scalar()
    return df.withColumns({f"z_{c}": F.try_divide(F.col(c) - one[c]["m"], one[c]["s"]) for c in columns})
