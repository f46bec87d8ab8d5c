"""Fitted feature preparation: imputation, filters, coding, scaling and projection.

Every fit is one or two aggregates over the training table; every transform is a single
projection. Fitted values are plain numbers and texts.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.cluster import as_lookup, bounded_rows
from waymark.features.base import FittedStep, FixedStep, Step
from waymark.features.sketch import TensorSketch
from waymark.functions.scalars import cyclic_month
from waymark.operators.profile import quantiles
from waymark.operators.reshape import column_names


def _moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample standard deviation of each column, in one pass."""
    if not columns:
        return {}
    row = df.agg(*[F.struct(F.avg(c), F.stddev_samp(c)).alias(c) for c in columns]).first()
    return {c: (row[c][0], row[c][1]) for c in columns}


# Imputation


class FilledValues(FittedStep):
    def _transform(self, df):
        fills = {c: v for c, v in self.values["fills"].items() if v is not None}
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in fills.items()})


class MeanImpute(Step):
    def _fit(self, df):
        return FilledValues(fills={c: m for c, (m, _) in _moments(df, self.numeric(df)).items()})


class MedianImpute(Step):
    """Exact medians of all numeric columns at once."""

    def _fit(self, df):
        columns = self.numeric(df)
        rows = quantiles(df, columns, [0.5]).collect() if columns else []  # one row per column
        return FilledValues(fills={r["column"]: r["p50"] for r in rows})


class OmitIncomplete(Step):
    """Drop incomplete rows while fitting, keep them when applied."""

    def _fit(self, df):
        return FittedOmit(columns=self.predictors(df))


class FittedOmit(FittedStep):
    def training_rows(self, df: DataFrame) -> DataFrame:
        return df.dropna("any", subset=self.values["columns"])

    def omitted_rows(self, df: DataFrame) -> DataFrame:
        """The rows left out of the fit, ids included."""
        return df.where(_any_null(self.values["columns"]))

    def _transform(self, df):
        return df


def _any_null(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


# Filters


class ConstantColumns(Step):
    """Drop predictors with fewer than two different values."""

    def _fit(self, df):
        columns = self.predictors(df)
        row = df.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in columns]).first() if columns else {}
        return DroppedColumns(columns=[c for c in columns if row[c]])


class NearConstantColumns(Step):
    """Drop predictors dominated by one value that also have few distinct values."""

    def __init__(self, columns=None, ratio=95 / 5, distinct_percent=10.0, **roles):
        super().__init__(columns, ratio=ratio, distinct_percent=distinct_percent, **roles)

    def _fit(self, df):
        flagged = near_constant(df, self.predictors(df), self.values["ratio"], self.values["distinct_percent"]).where("near_constant")
        return DroppedColumns(columns=sorted(r["column"] for r in flagged.collect()))  # one row per column


def near_constant(df: DataFrame, columns: Sequence[str], ratio: float = 95 / 5, distinct_percent: float = 10.0) -> DataFrame:
    """Frequency ratio of the two commonest values and share of distinct values, per column."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    seen = texts.unpivot([], list(columns), "column", "v").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    sizes = seen.groupBy("column").agg(F.sum("n").alias("rows"), F.count("v").alias("levels"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "v")
    top = (
        seen.where(F.col("v").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where("place <= 2")
        .groupBy("column")
        .agg(F.max(F.when(F.col("place") == 1, F.col("n"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("n"))).alias("second"))
    )
    joined = sizes.join(F.broadcast(top), "column", "left")  # one row per column on both sides
    measured = joined.select(
        "column",
        F.try_divide("first", "second").alias("freq_ratio"),
        (F.col("levels") / F.col("rows") * 100).alias("percent_unique"),
    )
    constant = F.col("freq_ratio").isNull()
    return measured.withColumn("near_constant", constant | ((F.col("freq_ratio") > ratio) & (F.col("percent_unique") <= distinct_percent)))


class DroppedColumns(FittedStep):
    def _transform(self, df):
        return df.drop(*self.values["columns"])


# Category coding


def _level_lists(df: DataFrame, columns: Sequence[str], reference: str) -> dict[str, list[str]]:
    """Levels per column, the reference level first if it occurs."""
    if not columns:
        return {}
    rows = bounded_rows(df.select(*columns).unpivot([], list(columns), "c", "v").where(F.col("v").isNotNull()).distinct())
    if rows is None:
        raise ValueError("too many levels for one column per level; lump rare levels first")
    return {c: sorted((r["v"] for r in rows if r["c"] == c), key=lambda v: (v != reference, v)) for c in columns}


class Dummies(Step):
    """0/1 columns ``var_level``. The first level has no column unless ``full`` says so:
    ``all`` keeps every level, ``first`` keeps every level of the first column only."""

    def __init__(self, columns=None, reference="unknown", full="none", **roles):
        super().__init__(columns, reference=reference, full=full, **roles)

    def _fit(self, df):
        columns = self.nominal(df)
        full = self.values["full"]
        levels = _level_lists(df, columns, self.values["reference"])
        kept = {c: v if full == "all" or (full == "first" and i == 0) else v[1:] for i, (c, v) in enumerate(levels.items())}
        return FittedDummies(levels=kept)


class FittedDummies(FittedStep):
    def _transform(self, df):
        levels = self.values["levels"]
        named = [(c, v, name) for c, values in levels.items() for v, name in zip(values, column_names(c, values), strict=True)]
        coded = [(F.col(c) == v).cast("double").alias(name) for c, v, name in named]
        return df.select(*[c for c in df.columns if c not in levels], *coded)


def sparse_one_hot(columns: Sequence[str], output: str = "one_hot") -> list:
    """Pipeline stages that turn categories into one sparse vector with all levels."""
    index = [f"{c}_index" for c in columns]
    hot = [f"{c}_hot" for c in columns]
    return [
        StringIndexer(inputCols=list(columns), outputCols=index, handleInvalid="keep", stringOrderType="frequencyDesc"),
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False, handleInvalid="keep"),
        VectorAssembler(inputCols=hot, outputCol=output),
    ]


class CyclicDates(FixedStep):
    """Date columns as sine and cosine of the place in the month."""

    def __init__(self, *columns, **state):
        super().__init__(columns=list(columns) or state.get("columns", []))

    def _transform(self, df):
        parts = {}
        for c in self.values["columns"]:
            sine, cosine = cyclic_month(F.col(c))
            parts |= {f"{c}_month_sin": sine, f"{c}_month_cos": cosine}
        return df.withColumns(parts).drop(*self.values["columns"])


# Scaling


class Scaled(FittedStep):
    def _transform(self, df):
        shift, factor = self.values["shift"], self.values["factor"]
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(shift[c])) / F.lit(factor[c]) for c in shift})


class _Scaler(Step):
    center = True
    scale = True

    def _fit(self, df):
        moments = {c: v for c, v in _moments(df, self.numeric(df)).items() if v[0] is not None}
        return Scaled(
            shift={c: float(m) if self.center else 0.0 for c, (m, _) in moments.items()},
            factor={c: float(s) if self.scale and s else 1.0 for c, (_, s) in moments.items()},
        )


class Center(_Scaler):
    scale = False


class Scale(_Scaler):
    center = False


class Normalize(_Scaler):
    """Center, then divide by the sample standard deviation."""


class BoxCox(Step):
    """Power transform of strictly positive columns.

    The power with the best profile likelihood is found on a coarse grid, then on two finer
    ones around it. Each grid is a single aggregate over all columns and powers.
    """

    def __init__(self, columns=None, low=-2.0, high=2.0, **roles):
        super().__init__(columns, low=low, high=high, **roles)

    def _fit(self, df):
        columns = self.numeric(df)
        lows = df.agg(*[F.min(c).alias(c) for c in columns]).first() if columns else {}
        positive = [c for c in columns if lows[c] is not None and lows[c] > 0]
        low, high = self.values["low"], self.values["high"]
        best = _best_powers(df, {c: np.linspace(low, high, 9).tolist() for c in positive})
        for width in ((high - low) / 8, (high - low) / 80):
            best = _best_powers(df, {c: np.linspace(b - width, b + width, 21).tolist() for c, b in best.items()})
        return FittedBoxCox(powers={c: round(b, 6) for c, b in best.items()})


def power_transform(column: Column, power: float) -> Column:
    if abs(power) < 1e-9:
        return F.ln(column)
    return (F.pow(column, F.lit(float(power))) - 1) / F.lit(float(power))


def _best_powers(df: DataFrame, grids: dict[str, list[float]]) -> dict[str, float]:
    """Power with the largest profile likelihood, per column: one aggregate with a variance per
    column and power, so no row is repeated."""
    if not grids:
        return {}
    logs = df.select(*[F.ln(F.col(c).cast("double")).alias(c) for c in grids])

    def measured(c: str, grid: list[float]) -> Column:
        moved = [F.col(c) if abs(p) < 1e-9 else (F.exp(F.col(c) * F.lit(p)) - 1) / F.lit(p) for p in grid]
        return F.struct(F.count(c).alias("n"), F.sum(c).alias("logs"), F.array(*[F.var_pop(m) for m in moved]).alias("spread")).alias(c)

    stats = logs.agg(*[measured(c, grid) for c, grid in grids.items()]).first()
    best = {}
    for c, grid in grids.items():
        fits = [-stats[c]["n"] / 2 * math.log(v) + (p - 1) * stats[c]["logs"] if v and v > 0 else -math.inf for p, v in zip(grid, stats[c]["spread"], strict=True)]
        best[c] = max(zip(fits, grid, strict=True))[1]
    return best


class FittedBoxCox(FittedStep):
    def _transform(self, df):
        powers = self.values["powers"]
        return df.withColumns({c: F.when(F.col(c) > 0, power_transform(F.col(c).cast("double"), p)) for c, p in powers.items()})


# Projection


def _weighted(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum as plain arithmetic, so that it is compiled."""
    out = F.lit(0.0)
    for column, weight in zip(columns, weights):
        out = out + column * F.lit(float(weight))
    return out


def _features(spec: dict):
    """Random cosine or sketched features of a matrix of rows."""
    if spec["kind"] == "waves":
        weights, shifts = np.array(spec["weights"]), np.array(spec["shifts"])
        return lambda x: np.sqrt(2.0 / len(shifts)) * np.cos(x @ weights.T + shifts)
    return TensorSketch(**{k: v for k, v in spec.items() if k != "kind"})


def _batch_projection(spec: dict, means: list, weights: list, names: Sequence[str]):
    """Projection of the random features of a batch of rows, given as a struct of numbers."""
    features = _features(spec)

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def projected(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({n: np.zeros(0) for n in names})
        z = (features(rows.to_numpy(dtype=float)) - np.array(means)) @ np.array(weights).T
        return pd.DataFrame(z, columns=list(names))

    return projected


def _batch_moments(rows: DataFrame, spec: dict) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and covariances of the random features of ``rows``.

    The features never leave the tasks: a task adds up their sums and products, and the tasks'
    sums meet by matrix row. Sums are taken around the mean of a few rows, which keeps
    their digits and changes nothing else.
    """
    features, names = _features(spec), rows.columns
    few = np.array([list(r) for r in rows.limit(1000).collect()], dtype=float).reshape(-1, len(names))
    if not len(few):
        return 0, np.zeros(0), np.zeros(0)
    around = features(few).mean(axis=0)
    width = len(around)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                z = features(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])) - around
                n, total = n + len(z), total + z.sum(axis=0)
                products += z.T @ z
        if n:
            values = pa.array(np.concatenate([[float(n)], total, products.ravel()]))
            ends = np.concatenate([[0], 1 + width + width * np.arange(width + 1)])  # the first list: count and sums
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["part", "sums"])

    def added(found: pa.Table) -> pa.Table:
        # Sorted first, so that the sum does not depend on the order of the tasks.
        total = np.sort(np.stack(found["sums"].to_numpy()), axis=0).sum(axis=0)
        return pa.table({"part": found["part"].slice(0, 1), "sums": [total.tolist()]})

    schema = "part int, sums array<double>"
    found = {r["part"]: np.array(r["sums"]) for r in rows.mapInArrow(sums, schema).groupBy("part").applyInArrow(added, schema).collect()}
    n, shift = int(found[0][0]), found[0][1:] / found[0][0]
    products = np.stack([found[i + 1] for i in range(width)])
    return n, around + shift, (products - n * np.outer(shift, shift)) / max(n - 1, 1)


def _square_map(x: Sequence[Column]) -> list[Column]:
    """Features whose inner products equal (x.y + 1)^2 up to a constant."""
    root = F.lit(math.sqrt(2.0))
    pairs = [a * b if i == j else a * b * root for (i, a), (j, b) in itertools.combinations_with_replacement(enumerate(x), 2)]
    return [a * root for a in x] + pairs


_IN_BATCHES = ("waves", "sketch")


class _Projection(Step):
    """Principal components of a fixed map of the numeric columns. Rows with gaps are left
    out of the fit and get missing components."""

    prefix = "PC"

    def __init__(self, columns=None, k=5, variance=None, **settings):
        super().__init__(columns, k=k, variance=variance, **settings)

    def _map(self, columns: Sequence[str]) -> dict:
        return {"kind": "linear"}

    def _fit(self, df):
        columns = self.numeric(df)
        spec = self._map(columns)
        complete = df.select(*columns).dropna("any")
        if spec["kind"] in _IN_BATCHES:
            return self._fit_batches(complete, columns, spec)
        vectors = complete.select(array_to_vector(_mapped(columns, spec)).alias("v"))
        mean = vectors.agg(Summarizer.mean(F.col("v")).alias("m")).first()["m"]
        if mean is None or len(mean) == 0:
            raise ValueError("no complete row to fit the projection on")
        means = mean.toArray().tolist()
        k = min(self.values["k"], len(means)) if self.values["variance"] is None else len(means)
        model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
        return self._fitted(columns, spec, means, model.pc.toArray(), model.explainedVariance.toArray())

    def _fit_batches(self, complete, columns, spec):
        n, means, covariance = _batch_moments(complete.select(*[F.col(c).cast("double").alias(c) for c in columns]), spec)
        if not n:
            raise ValueError("no complete row to fit the projection on")
        if n < 2:
            raise ValueError("no covariance of a single complete row")
        axes, variances, _ = np.linalg.svd(covariance)
        k = min(self.values["k"], len(means)) if self.values["variance"] is None else len(means)
        return self._fitted(columns, spec, means.tolist(), axes[:, :k], (variances / (variances.sum() or 1.0))[:k])

    def _fitted(self, columns, spec, means, weights, explained):
        if self.values["variance"] is not None:
            weights = weights[:, : int(np.searchsorted(np.cumsum(explained), self.values["variance"])) + 1]
        return FittedProjection(columns=columns, map=spec, means=means, weights=weights.T.tolist(), prefix=self.prefix, explained=explained.tolist())


def _mapped(columns: Sequence[str], spec: dict) -> Column:
    x = [F.col(c).cast("double") for c in columns]
    return F.array(*(_square_map(x) if spec["kind"] == "square" else x))


class FittedProjection(FittedStep):
    def _transform(self, df):
        v = self.values
        kept = [c for c in df.columns if c not in v["columns"]]
        names = [f"{v['prefix']}{i + 1}" for i in range(len(v["weights"]))]
        x = [F.col(c).cast("double") for c in v["columns"]]
        if v["map"]["kind"] in _IN_BATCHES:
            complete = ~functools.reduce(operator.or_, [c.isNull() for c in x])
            filled = F.struct(*[F.coalesce(c, F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(x)])
            run = _batch_projection(v["map"], v["means"], v["weights"], names)
            out = df.withColumn("__p", F.when(complete, run(filled)))
            return out.select(*kept, *[F.col("__p")[n].alias(n) for n in names])
        cells = _square_map(x) if v["map"]["kind"] == "square" else x
        parts = []
        for name, weights in zip(names, v["weights"]):
            shift = float(np.dot(v["means"], weights))
            parts.append((_weighted(cells, weights) - F.lit(shift)).alias(name))
        return df.select(*kept, *parts)


class PrincipalComponents(_Projection):
    """``k`` components, or as many as reach a share of the variance."""


class QuadraticComponents(_Projection):
    """Components of the degree-2 polynomial kernel, through its explicit feature map."""

    def _map(self, columns):
        return {"kind": "square"}


class RadialComponents(_Projection):
    """Components of the radial kernel exp(-sigma |x-y|^2), through random cosine features."""

    def __init__(self, columns=None, k=5, sigma=0.2, features=128, seed=945, **settings):
        super().__init__(columns, k=k, sigma=sigma, features=features, seed=seed, **settings)

    def _map(self, columns):
        v = self.values
        draw = np.random.default_rng(v["seed"])
        weights = draw.normal(scale=math.sqrt(2 * v["sigma"]), size=(v["features"], len(columns)))
        return {"kind": "waves", "weights": weights.tolist(), "shifts": draw.uniform(0, 2 * math.pi, v["features"]).tolist()}


class SketchedComponents(_Projection):
    """Components of the polynomial kernel (scale x.y + offset)^degree, through a tensor sketch
    of fixed width: their cost does not grow with p^degree."""

    def __init__(self, columns=None, k=5, degree=2, width=256, scale=1.0, offset=1.0, seed=945, **settings):
        super().__init__(columns, k=k, degree=degree, width=width, scale=scale, offset=offset, seed=seed, **settings)

    def _map(self, columns):
        return {"kind": "sketch", "size": len(columns), **{c: self.values[c] for c in ("degree", "width", "scale", "offset", "seed")}}


# Labels and weights


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, weight)`` with weight sqrt(largest class / class)."""
    seen = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return seen.select(label, F.sqrt(seen.agg(F.max("n")).scalar() / F.col("n")).alias("weight"))


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    return df.join(as_lookup(class_weights(df, label)), label, "left")


def assembled(df: DataFrame, ids: Sequence[str], label: str, features: Sequence[str] | None = None) -> DataFrame:
    """Ids, label and one feature vector. A missing feature is NaN inside the vector, so
    that no row is lost; ``boost`` gives it a bin of its own, MLlib's models refuse it."""
    names = [c for c in (features or df.columns) if c not in {*ids, label}]
    kept = [c for c in (*ids, label) if c in df.columns]
    numeric = df.select(*kept, *[F.col(c).cast("double").alias(c) for c in names])
    out = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(numeric)
    return out.select(*kept, "features")


def importance_table(model, assembled_frame: DataFrame, vector: str = "features") -> DataFrame:
    """``(feature, importance)`` of a fitted tree model, largest first."""
    names = _attribute_names(assembled_frame.schema[vector])
    values = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]  # one row per feature column
    spark = assembled_frame.sparkSession
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _attribute_names(field: T.StructField) -> list[str]:
    groups = field.metadata["ml_attr"]["attrs"].values()
    return [a["name"] for a in sorted((a for g in groups for a in g), key=lambda a: a["idx"])]


def grouped_importance(importances: DataFrame, pattern: str = "^(.*)_[^_]*$") -> DataFrame:
    """Importances summed by name prefix."""
    prefix = F.coalesce(F.nullif(F.regexp_extract("feature", pattern, 1), F.lit("")), F.col("feature"))
    return importances.groupBy(prefix.alias("feature")).agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"), "feature")
