"""Importance of features for models with and without trees.

``roc_importance`` needs no model: for each feature and pair of classes it takes the area under
the ROC curve of the feature's values as a score, folded to at least one half. A class gets the
best area of its pairs, a feature the best of its classes. All features and pairs come out of
one running total over distinct values with a count per class.

``model_importance`` reads fitted models: trees by their impurity gain, boosted runs by their
cuts, linear models by their coefficients times the feature's standard deviation, ensembles by
weighted sums of their members.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.features.prepare import _attribute_names
from waymark.functions.labels import to_code
from waymark.models.boosting import Boosted
from waymark.models.classify import FittedClassifier, VoteTotals, labels_of
from waymark.models.penalty_path import Path
from waymark.operators.windows import running_totals


def class_areas(df: DataFrame, label: str, features: Sequence[str], declared: Sequence[str] | None = None, **limits) -> DataFrame:
    """``feature, class, area``: the best folded area of the class against another one. A gap
    in a feature takes no part in it; a class without values has no area."""
    labels = labels_of(df, label, declared)
    coded = df.where(F.col(label).isin(*labels)).select(
        to_code(F.col(label).cast("string"), labels).cast("int").alias("__class"), *[F.col(c).cast("double").alias(c) for c in features]
    )
    cells = coded.unpivot(["__class"], list(features), "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    held = [F.count_if(F.col("__class") == k).alias(f"n{k}") for k in range(len(labels))]
    grouped = cells.groupBy("feature", "value").agg(*held)
    upto = running_totals(grouped, ["feature"], [F.col("value")], {f"u{k}": F.col(f"n{k}") for k in range(len(labels))}, **limits)
    pairs = list(itertools.combinations(range(len(labels)), 2))
    # Values of class j below those of class i, ties for one half.
    wins = [F.sum(F.col(f"n{i}") * (F.col(f"u{j}") - F.col(f"n{j}") / 2)).alias(f"w{i}_{j}") for i, j in pairs]
    sums = upto.groupBy("feature").agg(*wins, *[F.sum(f"n{k}").alias(f"s{k}") for k in range(len(labels))])

    def folded(i: int, j: int):
        i, j = min(i, j), max(i, j)
        area = F.try_divide(F.col(f"w{i}_{j}"), F.col(f"s{i}").cast("double") * F.col(f"s{j}"))
        return F.greatest(area, 1 - area)

    def best(k: int):
        return F.array_max(F.array(*[folded(k, j) for j in range(len(labels)) if j != k]))

    rows = F.array(*[F.struct(F.lit(c).alias("class"), best(k).alias("area")) for k, c in enumerate(labels)])
    return sums.select("feature", F.explode(rows).alias("r")).select("feature", "r.*")


def roc_importance(df: DataFrame, label: str, features: Sequence[str], declared: Sequence[str] | None = None, **limits) -> DataFrame:
    """``feature, importance``, largest first: the best area of any class."""
    areas = class_areas(df, label, features, declared, **limits)
    return areas.groupBy("feature").agg(F.max("area").alias("importance")).orderBy(F.desc_nulls_last("importance"), "feature")


def _deviations(frame: DataFrame, vector: str, width: int) -> np.ndarray:
    cells = frame.select(F.posexplode(vector_to_array(vector)).alias("j", "x")).where(~F.isnan("x"))
    out = np.zeros(width)
    for r in cells.groupBy("j").agg(F.stddev_samp("x").alias("s")).collect():  # one row per feature
        out[r["j"]] = r["s"] or 0.0
    return out


def _values(model, spread) -> np.ndarray:
    if isinstance(model, Boosted):
        return model.importance().astype(float)
    if isinstance(model, Path):
        return np.abs(model.coefficients).sum(axis=(0, 1)) * model.deviations
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).sum(axis=0) * spread()
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray()) * spread()
    raise TypeError(f"{type(model).__name__} has no importance of its own; use roc_importance")


def model_importance(fitted, frame: DataFrame, vector: str = "features") -> DataFrame:
    """``feature, importance`` of a fitted model or classifier, largest first, summing to one.

    ``frame`` is a table it was fitted on, whose ``vector`` names the features. The members of
    an ensemble count by its weights; the linear models of an expanded vector are told apart by
    the cells of that vector.
    """
    model, weights = fitted, None
    if isinstance(fitted, FittedClassifier):
        model = fitted.model
        votes = [s for s in fitted.stages.stages if isinstance(s, VoteTotals)]
        weights = votes[0].values["weights"] if votes else None
        if not isinstance(model, (Boosted, Path)) and hasattr(first := model[0] if isinstance(model, list) else model, "getFeaturesCol") and first.getFeaturesCol() != vector:
            vector = first.getFeaturesCol()
            for stage in fitted.stages.stages:
                if stage.hasParam("outputCol") and stage.getOutputCol() == vector:
                    frame = stage.transform(frame)
                elif getattr(stage, "values", {}).get("out") == vector:
                    frame = stage.transform(frame)
    members = model if isinstance(model, list) else [model]
    weights = weights or [1.0] * len(members)
    held: list[np.ndarray] = []

    def spread() -> np.ndarray:
        if not held:
            width = frame.select(F.size(vector_to_array(vector)).alias("n")).first()["n"]
            held.append(_deviations(frame, vector, width))
        return held[0]

    total = sum(w * _values(m, spread) for m, w in zip(members, weights, strict=True))
    names = _attribute_names(frame.schema[vector]) if "ml_attr" in (frame.schema[vector].metadata or {}) and "attrs" in frame.schema[vector].metadata["ml_attr"] else []
    names = names if len(names) == len(total) else [f"{vector}_{j}" for j in range(len(total))]
    scale = float(total.sum()) or 1.0
    rows = [(n, float(x) / scale) for n, x in zip(names, total, strict=True)]
    return frame.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
