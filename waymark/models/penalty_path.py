"""Elastic-net logistic regression at many penalties in the passes of one fit.

For all penalties at once, a pass over the rows adds up the gradient of the log-likelihood and
the Gram matrices of the features weighted by the curvature of each pair of classes. The driver
then solves each penalty's quadratic problem by coordinate descent on these small matrices,
from large penalties to small ones. At the first pass, where all coefficients are zero, the
penalties share one matrix and each starts from the solution of the one before it; later each
goes on from its own coefficients. A step that does not lower the penalised loss is halved.

Features are scaled by their standard deviation inside, as the penalty is on scaled
coefficients; the coefficients that come out are on the original scale. The penalised loss is
the mean log loss plus ``penalty * (mixture * sum |b| + (1 - mixture) / 2 * sum b^2)``; intercepts
are free. Two classes have one set of coefficients, more classes one set each, with the
softmax. A missing number counts as the feature's mean.

Tasks and the driver hold one matrix of (classes x (features + 1))^2 cells per penalty, which
does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.cluster import checkpointed
from waymark.features.base import FixedStep
from waymark.functions.labels import to_code
from waymark.models.boosting import probabilities
from waymark.models.classify import FittedClassifier, labels_of

TOLERANCE, MOST_PASSES, BATCH_ROWS = 1e-7, 100, 8192


class LinearScores(FixedStep):
    """``prob`` from one set of coefficients per class (or one for two classes)."""

    def _transform(self, df):
        v = self.values
        weights, base = np.array(v["coefficients"], float), np.array(v["intercepts"], float)
        means = np.array(v["means"], float)

        @F.pandas_udf("array<double>")
        def prob(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x = np.stack(features.to_numpy())
            return pd.Series(list(probabilities(np.where(np.isnan(x), means, x) @ weights.T + base)))

        return df.withColumn("prob", prob(vector_to_array("features")))


@dataclass
class Path:
    """Coefficients by (penalty, class, feature) and intercepts by (penalty, class) on the
    original scale; ``passes`` counts the passes over the rows."""

    labels: list[str]
    penalties: list[float]
    coefficients: np.ndarray
    intercepts: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    losses: np.ndarray
    passes: int

    def classifier(self, i: int) -> FittedClassifier:
        state = {"coefficients": self.coefficients[i].tolist(), "intercepts": self.intercepts[i].tolist(), "means": self.means.tolist()}
        return FittedClassifier(list(self.labels), PipelineModel([LinearScores(**state)]), self)

    def table(self, spark, names: Sequence[str] | None = None) -> DataFrame:
        """``penalty, class, feature, coefficient``; the intercept is a feature of that name.
        The coefficients of two classes are those of the second."""
        outputs, width = self.coefficients.shape[1:]
        names = list(names) if names else [f"x{j}" for j in range(width)]
        classes = self.labels[1:] if outputs == 1 else self.labels
        rows = []
        for i, penalty in enumerate(self.penalties):
            for k, label in enumerate(classes):
                rows.append((penalty, label, "(intercept)", float(self.intercepts[i, k])))
                rows += [(penalty, label, n, float(b)) for n, b in zip(names, self.coefficients[i, k], strict=True)]
        return spark.createDataFrame(rows, "penalty double, class string, feature string, coefficient double")


def _moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    cells = rows.select(F.posexplode("features").alias("j", "x")).where(~F.isnan("x"))
    means, deviations = np.zeros(width), np.ones(width)
    for r in cells.groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect():
        means[r["j"]], deviations[r["j"]] = r["m"], r["s"] or 1.0
    return means, deviations


def _sums(sent, outputs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per penalty: the loss, the gradient and the weighted Gram matrices of all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, deviations, points = sent.value  # points: coefficients by (class, intercept and features)
        width = len(means) + 1
        held = {i: [0.0, np.zeros((outputs, width)), np.zeros((outputs, width, outputs, width))] for i, _ in points}
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                x = np.asarray(batch["features"].flatten()).reshape(batch.num_rows, width - 1)
                x = (np.where(np.isnan(x), means, x) - means) / deviations
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                y = batch["label"].to_numpy()
                for i, b in points:
                    p = probabilities(x @ b.T)
                    held[i][0] += -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
                    own = p[:, 1:] if outputs == 1 else p
                    truth = (y[:, None] == np.arange(p.shape[1])[None, p.shape[1] - outputs :]).astype(float)
                    held[i][1] += (own - truth).T @ x
                    for k in range(outputs):
                        for m in range(k, outputs):
                            curve = own[:, k] * ((k == m) - own[:, m])
                            part = (x * curve[:, None]).T @ x
                            held[i][2][k, :, m] += part
                            if m > k:
                                held[i][2][m, :, k] += part
        flat = [np.concatenate([[loss], gradient.ravel(), gram.ravel()]) for loss, gradient, gram in held.values()]
        yield _as_rows(list(held), flat)

    return run


def _as_rows(names: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32))
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values)))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), lists], ["i", "sums"])


def _added(rows: pa.Table) -> pa.Table:
    total = np.sum(np.stack(rows["sums"].to_numpy()), axis=0)
    return pa.Table.from_batches([_as_rows([rows["i"][0].as_py()], [total])])


def descend(gradient: np.ndarray, gram: np.ndarray, at: np.ndarray, start: np.ndarray, penalty: float, mixture: float, free: np.ndarray) -> np.ndarray:
    """Minimise the quadratic model around ``at`` plus the penalty by coordinate descent;
    coordinates marked ``free`` are not penalised."""
    b = start.copy()
    slope = gradient + gram @ (b - at)
    curve = np.maximum(np.diag(gram), 1e-9)
    lasso, ridge = np.where(free, 0.0, penalty * mixture), np.where(free, 0.0, penalty * (1 - mixture))
    for _ in range(1000):
        moved = 0.0
        for j in range(len(b)):
            wish = curve[j] * b[j] - slope[j]
            new = np.sign(wish) * max(abs(wish) - lasso[j], 0.0) / (curve[j] + ridge[j])
            if new != b[j]:
                slope += gram[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]))
                b[j] = new
        if moved < TOLERANCE / 100:
            break
    return b


def logistic_path(df: DataFrame, label: str, penalties: Sequence[float], mixture: float = 1.0, declared: Sequence[str] | None = None) -> Path:
    """Fit all ``penalties`` on ``features`` and a text label."""
    spark, labels = df.sparkSession, labels_of(df, label, declared)
    if len(labels) < 2:
        raise ValueError("a logistic regression needs at least two classes")
    penalties = sorted(penalties, reverse=True)
    outputs = 1 if len(labels) == 2 else len(labels)
    coded = df.where(F.col(label).isin(*labels)).select(to_code(F.col(label).cast("string"), labels).cast("int").alias("label"), vector_to_array("features").alias("features"))
    rows = checkpointed(coded)
    n, width = rows.agg(F.count("*"), F.max(F.size("features"))).first()
    means, deviations = _moments(rows, width)
    shape = (outputs, width + 1)
    free = np.zeros(shape, bool)
    free[:, 0] = True
    now = [np.zeros(shape) for _ in penalties]
    tried = [np.zeros(shape) for _ in penalties]  # where the next pass measures
    best = [np.inf] * len(penalties)
    active, passes = set(range(len(penalties))), 0
    cost = lambda b, penalty: penalty * (mixture * np.abs(b[:, 1:]).sum() + (1 - mixture) / 2 * (b[:, 1:] ** 2).sum())
    while active and passes < MOST_PASSES:
        first = passes == 0
        points = [(i, tried[i]) for i in sorted(active)][: 1 if first else None]
        sent = spark.sparkContext.broadcast((means, deviations, points))
        sums = rows.mapInArrow(_sums(sent, outputs), "i int, sums array<double>").groupBy("i").applyInArrow(_added, "i int, sums array<double>")
        found = {r["i"]: np.array(r["sums"]) / n for r in sums.collect()}
        sent.unpersist()
        passes += 1
        warm = np.zeros(shape)
        for i in sorted(active):
            parts = found[0 if first else i]
            gradient, gram = parts[1 : 1 + free.size], parts[1 + free.size :].reshape(free.size, free.size)
            loss = parts[0] + cost(tried[i], penalties[i])
            if loss > best[i] + 1e-12:
                tried[i] = (tried[i] + now[i]) / 2
                if np.abs(tried[i] - now[i]).max() < TOLERANCE:
                    active.discard(i)
                continue
            best[i], now[i] = loss, tried[i]
            start = warm if first else now[i]
            new = descend(gradient, gram, now[i].ravel(), start.ravel(), penalties[i], mixture, free.ravel()).reshape(shape)
            if outputs > 1:
                new[:, 0] -= new[:, 0].mean()  # only differences of intercepts matter
            warm = new
            if np.abs(new - now[i]).max() < TOLERANCE:
                active.discard(i)
            tried[i] = new
    scaled = np.stack(now)
    coefficients = scaled[:, :, 1:] / deviations
    intercepts = scaled[:, :, 0] - coefficients @ means
    return Path(labels, list(penalties), coefficients, intercepts, means, deviations, np.array(best), passes)
