"""Counts, summaries, quantiles, histograms and missing-value patterns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.cluster import checkpointed
from waymark.operators.columns import nominal_columns, numeric_columns
from waymark.operators.rows import level_grid
from waymark.operators.windows import running_totals, share_of_total, share_within


def counts(df: DataFrame, *keys: str, sort: bool = False) -> DataFrame:
    """Rows per group; a missing key is its own group."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), *keys) if sort else out


def value_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sum and row count per key. The sum of no values is 0, their mean is null."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"),
        F.count(F.lit(1)).alias("n"),
    )


def spread_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def distinct_values(column: str) -> Column:
    """Number of distinct values, a missing value counting as one."""
    return F.countDistinct(column) + F.max(F.col(column).isNull().cast("int"))


def distinct_values_estimate(column: str, error: float = 0.01) -> Column:
    return F.approx_count_distinct(column, error) + F.max(F.col(column).isNull().cast("int"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_null)`` from one pass."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "n_null")


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Dense two-way counts in long form, zeros included, missing values left out.

    The grouped counts are written to the checkpoint folder, so the levels, the cells and
    every statistic on them read the grouped table and the source is read once.
    """
    seen = checkpointed(counts(df, row, column)).where(F.col(row).isNotNull() & F.col(column).isNotNull())
    return level_grid(seen, [row, column]).join(seen, [row, column], "left").fillna(0, ["n"])


def class_shares(df: DataFrame, column: str) -> DataFrame:
    return share_of_total(counts(df, column))


def category_shares(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Share of each inner category inside each outer one."""
    out = counts(df, outer, inner)
    return share_within(out, [outer], "n", "share")


# Order statistics


def order_statistics(df: DataFrame, columns: Sequence[str], places: Callable[[Column], dict[str, Column]], **limits) -> DataFrame:
    """Exact interpolated order statistics of several columns at once.

    ``places`` maps the number of values to zero-based fractional places. Values are
    grouped first, so the order runs over distinct values, in bounded ranges.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return long_order_statistics(doubles.unpivot([], list(columns), "column", "value"), places, **limits)


def long_order_statistics(long: DataFrame, places: Callable[[Column], dict[str, Column]], **limits) -> DataFrame:
    """``order_statistics`` of the values of each ``column`` in a table ``column, value``."""
    grouped = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    ordered = running_totals(grouped, ["column"], [F.col("value")], {"upto": F.col("cnt")}, **limits)
    sizes = ordered.groupBy("column").agg(F.sum("cnt").alias("__n"))
    located = ordered.join(F.broadcast(sizes), "column")  # one row per listed column
    wanted = places(F.col("__n"))
    holds = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("cnt") <= place), F.col("value")))
    picks = []
    for name, place in wanted.items():
        picks += [holds(F.floor(place)).alias(f"__lo_{name}"), holds(F.ceil(place)).alias(f"__hi_{name}"), F.max(place).alias(f"__at_{name}")]
    found = located.groupBy("column").agg(*picks)
    between = lambda k: F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * (F.col(f"__at_{k}") - F.floor(f"__at_{k}"))
    return found.select("column", *[between(k).alias(k) for k in wanted])


def quantile_name(prob: float) -> str:
    return "p" + f"{prob * 100:g}".replace(".", "_")


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], **limits) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per column."""
    return order_statistics(df, columns, lambda n: {quantile_name(p): (n - 1) * F.lit(float(p)) for p in probs}, **limits)


def quantile_estimates(df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles in one pass with small mergeable sketches."""
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy).alias(c) for c in columns])
    long = row.unpivot([], list(columns), "column", "__q")
    return long.select("column", *[F.col("__q")[i].alias(quantile_name(p)) for i, p in enumerate(probs)])


def five_numbers(df: DataFrame, columns: Sequence[str], **limits) -> DataFrame:
    """Minimum, lower hinge, median, upper hinge and maximum."""

    def places(n: Column) -> dict[str, Column]:
        hinge = F.floor((n + 3) / 2) / 2 - 1
        return {
            "minimum": n * 0.0,
            "lower_hinge": hinge,
            "median": (n - 1) / 2,
            "upper_hinge": (n - 1) - hinge,
            "maximum": (n - 1) * 1.0,
        }

    return order_statistics(df, columns, places, **limits)


def column_summary(df: DataFrame, columns: Sequence[str] | None = None, **limits) -> DataFrame:
    """Profile of numeric columns: nulls, completeness, mean, sd and quartiles."""
    columns = list(columns or numeric_columns(df))
    parts = [F.count(F.lit(1)).alias("__rows")]
    for c in columns:
        parts += [F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(c)]
    moments = (
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        .agg(*parts)
        .unpivot(["__rows"], columns, "column", "m")
        .select(
            "column",
            (F.col("__rows") - F.col("m.n")).alias("n_missing"),
            (F.col("m.n") / F.col("__rows")).alias("complete_rate"),
            F.col("m.mean").alias("mean"),
            F.col("m.sd").alias("sd"),
        )
    )
    marks = quantiles(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0], **limits).withColumnsRenamed(
        {"p0": "min", "p25": "q1", "p50": "median", "p75": "q3", "p100": "max"}
    )
    return moments.join(F.broadcast(marks), "column", "left")  # one row per column on both sides


def level_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, level, n)`` of all text columns in one pass."""
    columns = list(columns or nominal_columns(df))
    return df.select(*columns).unpivot([], columns, "column", "level").groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


# Histograms


def binned(df: DataFrame, column: str, width: float, origin: float = 0.0, limits: tuple[float, float] | None = None) -> DataFrame:
    """Add ``bin`` (left edge), dropping missing values and values outside ``limits``."""
    value = F.col(column).cast("double")
    kept = df.where(value.isNotNull())
    if limits is not None:
        kept = kept.where(value.between(*limits))
    return kept.withColumn("bin", F.floor((value - origin) / width) * F.lit(float(width)) + origin)


def histogram(df: DataFrame, column: str, width: float, origin: float = 0.0, limits: tuple[float, float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    return binned(df, column, width, origin, limits).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, column: str, width: float, origin: float = 0.0, limits: tuple[float, float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Histogram scaled to unit area, per group if there are groups."""
    out = histogram(df, column, width, origin, limits, by)
    shares = share_within(out, by, "n", "__share") if by else share_of_total(out, out="__share", scale=1.0)
    return shares.withColumn("density", F.col("__share") / width).drop("__share")


def equal_bins(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in a fixed number of equal bins over the column's range. Needs the range first."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.limit(0).select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n"))
    low, high = float(low), float(high)
    high = high if high > low else low + 1.0
    slot = F.least(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return df.where(F.col(column).isNotNull()).groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_histogram(df: DataFrame, column: str, width: float, base: float = 10.0, by: Sequence[str] = ()) -> DataFrame:
    """Histogram of logarithms; non-positive values are dropped."""
    positive = df.where(F.col(column) > 0)
    logs = F.log10(column) if base == 10.0 else F.ln(column)
    return histogram(positive.withColumn("__log", logs), "__log", width, by=by)


def stacked_histogram(df: DataFrame, column: str, fill: str, width: float, origin: float = 0.0) -> DataFrame:
    """Share of each category inside each bin."""
    return share_within(histogram(df, column, width, origin, by=[fill]), ["bin"], "n", "share")


def kernel_density(df: DataFrame, column: str, points: int = 512, bins: int = 2048) -> DataFrame:
    """Gaussian density on an even grid, from values binned to a fine fixed number of bins.

    The bandwidth is the usual rule of thumb, 0.9 min(sd, IQR/1.34) n^(-1/5). Work after the
    first aggregate is bounded by bins times grid points, whatever the input size.
    """
    values = df.select(F.col(column).cast("double").alias("value")).where(F.col("value").isNotNull())
    stats = values.agg(F.count("value"), F.min("value"), F.max("value"), F.stddev_samp("value")).first()
    n, low, high, sd = stats
    if not n or n < 2 or high == low:
        raise ValueError("a density needs at least two different values")
    quartiles = quantiles(values, ["value"], [0.25, 0.75]).first()
    spread = min(sd, (quartiles["p75"] - quartiles["p25"]) / 1.34) or sd
    width = 0.9 * spread * n ** (-0.2)
    start, stop = low - 3 * width, high + 3 * width
    step = (stop - start) / (points - 1)
    cell = (high - low) / bins
    slot = F.least(F.floor((F.col("value") - low) / cell), F.lit(bins - 1))
    cells = values.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mid"))
    grid = cells.select("n", "mid", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = F.lit(start) + F.col("i") * step
    kernel = F.exp(-F.pow((at - F.col("mid")) / width, 2) / 2) / math.sqrt(2 * math.pi)
    return grid.groupBy("i").agg((F.sum(F.col("n") * kernel) / (n * width)).alias("density")).select(at.alias("x"), "density")


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each pattern of missing cells (1 = missing) with its row count."""
    columns = list(columns or df.columns)
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return df.groupBy(mask.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
