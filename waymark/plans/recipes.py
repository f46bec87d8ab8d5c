"""Catalogue of feature preparations, and fitting and scoring with them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.cluster import checkpointed
from waymark.features import levels as V
from waymark.features import prepare as M
from waymark.features.prepare import assembled
from waymark.features.resample import rose, stratified_split
from waymark.models.classify import FittedClassifier
from waymark.operators.columns import numeric_columns
from waymark.operators.metrics import confusion, score_bundle


@dataclass
class Prepared:
    """A fitted preparation and the training rows after it, balanced if it balances."""

    model: PipelineModel
    train: DataFrame


@dataclass
class Recipe:
    """Steps fitted on training rows. Balancing touches training rows only."""

    name: str
    steps: list
    ids: tuple[str, ...]
    label: str
    balance: Callable[[DataFrame, tuple[str, ...], str], DataFrame] | None = None

    def fit(self, train: DataFrame) -> Prepared:
        rows = train
        first = self.steps[0] if self.steps else None
        if isinstance(first, M.OmitIncomplete):
            rows = first.fit(train).training_rows(train)
        # Every step reads the training rows, and so does what is made of them: computed once.
        rows = checkpointed(rows)
        model = Pipeline(stages=self.steps).fit(rows)
        out = model.transform(rows)
        if self.balance is not None:
            out = self.balance(out, self.ids, self.label)
        return Prepared(model, out)


def _no_missing(df: DataFrame, columns: Sequence[str]) -> None:
    gaps = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in columns]).first() if columns else {}
    bad = [c for c in columns if gaps[c]]
    if bad:
        raise ValueError(f"synthetic rows need complete columns, missing values in {bad}")


def _smote(df, ids, label):
    from waymark.features.neighbours import smote

    numeric = numeric_columns(df, (*ids, label))
    _no_missing(df, numeric)
    return smote(df, label, ids, numeric, seed=945)


def _adasyn(df, ids, label):
    from waymark.features.neighbours import adasyn

    numeric = numeric_columns(df, (*ids, label))
    _no_missing(df, numeric)
    return adasyn(df, label, ids, numeric, seed=945)


def _rose(df, ids, label):
    return rose(df, label, ids, numeric_columns(df, (*ids, label)), seed=945)


def recipe(name: str, ids: Sequence[str] = ("id",), label: str = "country_destination", drop: Sequence[str] = ("date_first_booking",), power_columns: Sequence[str] = ()) -> Recipe:
    """One entry of the catalogue; see ``NAMES``."""
    roles = {"ids": tuple(ids), "label": label}
    rm = [V.DropColumns(*drop)]
    unknown = [V.Unknown(**roles), V.CommonLevels(**roles)]
    mean, median = [M.MeanImpute(**roles)], [M.MedianImpute(**roles)]
    zv, dummies, plain = [M.ConstantColumns(**roles)], [M.Dummies(**roles)], [M.Dummies(reference="", **roles)]
    center, scale, normal = [M.Center(**roles)], [M.Scale(**roles)], [M.Normalize(**roles)]

    def knn():
        from waymark.features.neighbours import NeighbourImpute

        return [NeighbourImpute(**roles)]

    catalogue: dict[str, Callable[[], tuple[list, Callable | None]]] = {
        "std_median": lambda: (rm + median + unknown + dummies + zv + center + scale, None),
        "std_mean": lambda: (rm + mean + unknown + dummies + zv + center + scale, None),
        "std_mean_late_dummies": lambda: (rm + mean + unknown + zv + normal + dummies, None),
        "std_knn": lambda: (rm + knn() + unknown + dummies + zv + center + scale, None),
        "pca_mean": lambda: (rm + mean + unknown + zv + normal + [M.PrincipalComponents(**roles)] + dummies, None),
        "radial_pca_mean": lambda: (rm + mean + unknown + zv + normal + [M.RadialComponents(**roles)] + dummies, None),
        "quadratic_pca_mean": lambda: (rm + mean + unknown + zv + normal + [M.QuadraticComponents(**roles)] + dummies, None),
        "semi_minimal_smote": lambda: (rm + mean + unknown + zv + dummies, _smote),
        "std_smote": lambda: (rm + mean + unknown + zv + dummies + normal, _smote),
        "semi_minimal_rose": lambda: (rm + mean + unknown + zv + dummies, _rose),
        "semi_minimal": lambda: (rm + mean + unknown + zv + dummies, None),
        "minimal": lambda: (rm + unknown + zv + dummies, None),
        "minimal_smote": lambda: (rm + unknown + zv + dummies, _smote),
        "extra_minimal": lambda: (rm + unknown + zv, None),
        "extra_minimal_smote": lambda: (rm + unknown + zv, _smote),
        "complete_rows_only": lambda: ([M.OmitIncomplete(**roles)] + unknown + dummies + zv + center + scale, None),
        "std_median_no_dummies": lambda: (rm + median + unknown + zv + center + scale, None),
        "box_cox": lambda: (rm + mean + unknown + [M.BoxCox(list(power_columns), **roles)] + zv, None),
        "adasyn": lambda: (rm + median + unknown + plain + zv + center + scale, _adasyn),
        "plain_boosted": lambda: (rm + mean + unknown + dummies + zv, None),
        "median_plain_reference": lambda: (rm + median + unknown + plain + zv + center + scale, None),
    }
    steps, balance = catalogue[name]()
    return Recipe(name, steps, tuple(ids), label, balance)


NAMES = (
    "std_median", "std_mean", "std_mean_late_dummies", "std_knn", "pca_mean", "radial_pca_mean", "quadratic_pca_mean",
    "semi_minimal_smote", "std_smote", "semi_minimal_rose", "semi_minimal", "minimal", "minimal_smote", "extra_minimal",
    "extra_minimal_smote", "complete_rows_only", "std_median_no_dummies", "box_cox", "adasyn", "plain_boosted", "median_plain_reference",
)


@dataclass
class FitRecord:
    """Everything one fit gives: scores, confusion counts, predictions and the fitted parts."""

    metrics: DataFrame
    confusion: DataFrame
    predictions: DataFrame
    preparation: PipelineModel
    classifier: FittedClassifier


def fit_and_score(
    data: DataFrame,
    preparation: Recipe,
    fit: Callable[[DataFrame, str], FittedClassifier],
    seed: int = 945,
    p: float = 0.8,
) -> FitRecord:
    """Split by class, prepare, fit on the training rows, and score both parts.

    Rows of the test part never influence the preparation or the model.
    """
    ids, label = preparation.ids, preparation.label
    # The split, the fit and the scores read the rows many times; they are computed once.
    train, test = stratified_split(checkpointed(data), [label], ids, p, seed)
    prepared = preparation.fit(train)
    names = [c for c in prepared.train.columns if c not in {*ids, label, "copy"}]
    known = checkpointed(assembled(prepared.train, ids, label, names))
    classifier = fit(known, label)
    parts = {"train": prepared.model.transform(train), "test": prepared.model.transform(test)}
    scored = None
    for tag, part in parts.items():
        rows = classifier.predictions(assembled(part, ids, label, names), label, ids).withColumn("dataset", F.lit(tag))
        scored = rows if scored is None else scored.unionByName(rows)
    held_out = scored.where("dataset = 'test'")
    return FitRecord(score_bundle(scored), confusion(held_out, label, "predicted", classifier.labels), scored, prepared.model, classifier)
