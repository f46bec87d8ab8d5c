"""Classifiers with class probabilities, on MLlib.

All of them take a table with ids, a text label and a ``features`` vector, and give back a
``FittedClassifier`` that keeps ids through scoring.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from waymark.cluster import checkpointed
from waymark.features.base import FixedStep
from waymark.features.resample import class_sizes
from waymark.features.sketch import SketchedVector
from waymark.functions.labels import from_code, to_code
from waymark.operators.windows import likeliest_class


class ProbabilityArray(FixedStep):
    """``prob``: class probabilities as an array, from one model's output or from one
    score column per class, and the model columns dropped."""

    def __init__(self, source="probability", scores=(), drop=(), **state):
        super().__init__(source=source, scores=list(state.get("scores", scores)), drop=list(state.get("drop", drop)))

    def _transform(self, df):
        v = self.values
        if not v["scores"]:
            prob = vector_to_array(F.col(v["source"]))
            return df.withColumn("prob", prob).drop(*v["drop"])
        raw = F.array(*[F.col(c) for c in v["scores"]])
        total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
        even = F.lit([1.0 / len(v["scores"])] * len(v["scores"]))
        return df.withColumn("prob", F.when(total > 0, F.transform(raw, lambda x: x / total)).otherwise(even)).drop(*v["drop"])


class PositiveScore(FixedStep):
    """Probability of the second class of a two-class model as a plain column."""

    def __init__(self, source="probability", out="score", squash=False, drop=(), **state):
        super().__init__(source=source, out=out, squash=squash, drop=list(state.get("drop", drop)))

    def _transform(self, df):
        v = self.values
        second = vector_to_array(F.col(v["source"]))[1]
        score = 1.0 / (1.0 + F.exp(-second)) if v["squash"] else second
        return df.withColumn(v["out"], score).drop(*v["drop"])


class VoteTotals(FixedStep):
    """Weighted votes of several tree models, one ``vote_<class>`` column per class."""

    def __init__(self, votes=(), weights=(), classes=0, **state):
        super().__init__(votes=list(state.get("votes", votes)), weights=list(state.get("weights", weights)), classes=classes)

    def _transform(self, df):
        v = self.values
        totals = {}
        for c in range(v["classes"]):
            total = F.lit(0.0)
            for name, weight in zip(v["votes"], v["weights"]):
                total = total + F.when(F.col(name) == c, F.lit(float(weight))).otherwise(0.0)
            totals[f"vote_{c}"] = total
        return df.withColumns(totals).drop(*v["votes"])


@dataclass
class FittedClassifier:
    """Stages that add ``prob`` to a feature table, and the labels in probability order."""

    labels: list[str]
    stages: PipelineModel
    model: object = None

    def scored(self, df: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
        """Ids, probability array and most likely label."""
        out = self.stages.transform(df)
        return out.select(*keep, "prob", from_code(likeliest_class(F.col("prob")), self.labels).alias("predicted"))

    def predictions(self, df: DataFrame, label: str, keep: Sequence[str] = ("id",)) -> DataFrame:
        """A prediction table: ``scored`` plus the zero-based true class."""
        return self.scored(df, (*keep, label)).withColumn("truth", to_code(F.col(label), self.labels))


def labels_of(df: DataFrame, label: str, declared: Sequence[str] | None = None) -> list[str]:
    """Class labels in declared order, or sorted; only labels that occur."""
    seen = class_sizes(df, label)
    if declared is None:
        return sorted(seen)
    return [c for c in declared if c in seen] + sorted(set(seen) - set(declared))


def _coded(df: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    return df.where(F.col(label).isin(*labels)).withColumn("label", to_code(F.col(label).cast("string"), labels).cast("double"))


def _single(df: DataFrame, label: str, learner, declared) -> FittedClassifier:
    labels = labels_of(df, label, declared)
    model = learner.fit(_coded(df, label, labels))
    return FittedClassifier(labels, PipelineModel([model, ProbabilityArray(drop=["rawPrediction", "probability", "prediction"])]), model)


def forest(df: DataFrame, label: str, trees: int = 100, depth: int = 8, seed: int = 1, weight: str | None = None, declared=None, **settings) -> FittedClassifier:
    """Random forest with gini importance. The node of every row is kept between the levels, so
    that a level does not walk all trees from their roots."""
    learner = RandomForestClassifier(**{"numTrees": trees, "maxDepth": depth, "seed": seed, "cacheNodeIds": True, **settings})
    if weight:
        learner = learner.setWeightCol(weight)
    return _single(df, label, learner, declared)


def logistic(df: DataFrame, label: str, penalty: float = 0.0, mixture: float = 0.0, steps: int = 100, declared=None, **settings) -> FittedClassifier:
    """Multinomial or binomial regression with elastic net."""
    learner = LogisticRegression(regParam=penalty, elasticNetParam=mixture, maxIter=steps, family="auto", **settings)
    return _single(df, label, learner, declared)


def naive_bayes(df: DataFrame, label: str, kind: str = "gaussian", laplace: float = 1.0, declared=None) -> FittedClassifier:
    return _single(df, label, NaiveBayes(modelType=kind, smoothing=laplace), declared)


def boosted_binary(df: DataFrame, label: str, rounds: int = 20, depth: int = 5, rate: float = 0.1, sample: float = 1.0, seed: int = 1, declared=None, **settings) -> FittedClassifier:
    """Gradient boosted trees for two classes."""
    labels = labels_of(df, label, declared)
    if len(labels) != 2:
        raise ValueError("boosted_binary needs exactly two classes")
    learner = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=sample, seed=seed, **settings)
    model = learner.fit(_coded(df, label, labels))
    return FittedClassifier(labels, PipelineModel([model, ProbabilityArray(drop=["rawPrediction", "probability", "prediction"])]), model)


# Largest size of a partition of a wide feature table. An executor holds some partitions at once,
# and a table cached as a whole besides.
PARTITION_BYTES = 64 << 20


def _in_small_partitions(df: DataFrame, width: int) -> DataFrame:
    """``df`` dealt out so that about ``PARTITION_BYTES`` come to a partition once its rows have
    ``width`` numbers; left as it is where no partition has more."""
    sizes = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    rows, most, parts = sizes.agg(F.sum("n"), F.max("n"), F.count("n")).first()
    if (most or 0) * width * 8 <= PARTITION_BYTES:
        return df
    return df.repartition(max(parts, math.ceil(rows * width * 8 / PARTITION_BYTES)))


def _one_against_rest(
    df: DataFrame, label: str, declared, fit_one: Callable[[DataFrame], object], source: str, squash: bool, before: Sequence = (), width: int | None = None
) -> FittedClassifier:
    """One two-class model per class; scores are normalized to sum to one.

    The feature table is kept in executor memory (spilling to disk) across the fits. It is kept
    as it comes: what the stages of ``before`` make of it may be many times its size, and a
    learner that goes over its rows often has a cache of its own. Where the rows become ``width``
    numbers, partitions are cut for that.
    """
    labels = labels_of(df, label, declared)
    coded = _coded(df, label, labels)
    if width is not None:
        coded = _in_small_partitions(coded, width)
    coded = coded.persist(StorageLevel.MEMORY_AND_DISK)
    wide = coded
    for stage in before:
        wide = stage.transform(wide)
    stages, models = list(before), []
    try:
        for i in range(len(labels)):
            own = wide.withColumn("label", (F.col("label") == i).cast("double"))
            model = fit_one(own)
            names = [f"raw_{i}", f"probability_{i}", f"prediction_{i}"]
            model.setRawPredictionCol(names[0]).setPredictionCol(names[2])
            if model.hasParam("probabilityCol"):
                model.setProbabilityCol(names[1])
            models.append(model)
            stages += [model, PositiveScore(source=names[1] if source == "probability" else names[0], out=f"score_{i}", squash=squash, drop=names)]
    finally:
        coded.unpersist()
    scores = [f"score_{i}" for i in range(len(labels))]
    return FittedClassifier(labels, PipelineModel([*stages, ProbabilityArray(scores=scores, drop=scores)]), models)


def boosted(df: DataFrame, label: str, rounds: int = 20, depth: int = 5, rate: float = 0.1, sample: float = 1.0, seed: int = 1, declared=None, **settings) -> FittedClassifier:
    """Gradient boosted trees for any number of classes, one ensemble per class."""
    learner = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=sample, seed=seed, **settings)
    return _one_against_rest(df, label, declared, learner.fit, "probability", squash=False)


def polynomial_svm(df: DataFrame, label: str, degree: int = 2, cost: float = 1.0, steps: int = 50, declared=None) -> FittedClassifier:
    """Linear support vector machines on expanded polynomial features, one per class.

    Probabilities are squashed margins, normalized over the classes.
    """
    expand = PolynomialExpansion(degree=degree, inputCol="features", outputCol="expanded")
    learner = LinearSVC(featuresCol="expanded", regParam=1.0 / max(cost, 1e-9) / 100, maxIter=steps)
    return _one_against_rest(df, label, declared, learner.fit, "raw", squash=True, before=[expand])


def sketched_svm(
    df: DataFrame, label: str, degree: int = 2, width: int = 256, scale: float = 1.0, offset: float = 1.0, cost: float = 1.0, steps: int = 50, seed: int = 1, declared=None
) -> FittedClassifier:
    """Polynomial support vector machines on a tensor sketch of the features, one per class.

    The kernel is (scale x.y + offset)^degree; the sketch has ``width`` features whatever the
    degree and the number of features are.
    """
    first = df.select(F.size(vector_to_array("features")).alias("n")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    expand = SketchedVector(size=first["n"], degree=degree, width=width, scale=scale, offset=offset, seed=seed)
    learner = LinearSVC(featuresCol="expanded", regParam=1.0 / max(cost, 1e-9) / 100, maxIter=steps)
    return _one_against_rest(df, label, declared, learner.fit, "raw", squash=True, before=[expand], width=width)


def boosted_trees_m1(
    df: DataFrame, label: str, rounds: int = 10, depth: int = 4, impurity: str = "gini", ids: Sequence[str] = ("id",), declared=None, cut_every: int = 5
) -> FittedClassifier:
    """Adaptive boosting of weighted classification trees (M1).

    A round fits one tree on the weighted rows, then raises the weights of its mistakes.
    Every few rounds the weighted table is written to the checkpoint folder, so that
    neither the plan nor the work after a lost executor keeps growing.
    """
    labels = labels_of(df, label, declared)
    rows = checkpointed(_coded(df, label, labels).select(*ids, "features", "label").withColumn("weight", F.lit(1.0)))
    models, weights = [], []
    for i in range(rounds):
        model = DecisionTreeClassifier(maxDepth=depth, impurity=impurity, weightCol="weight", seed=i).fit(rows)
        missed = (F.col("prediction") != F.col("label")).cast("double")
        judged = model.transform(rows)
        total, wrong = judged.agg(F.sum("weight"), F.sum(F.col("weight") * missed)).first()
        error = wrong / total
        if error >= 0.5 and models:
            break
        step = 0.5 * math.log((1 - error) / max(error, 1e-10)) if error < 0.5 else 1e-3
        model.setPredictionCol(f"tree_{i}").setRawPredictionCol("").setProbabilityCol("")
        models.append(model)
        weights.append(step)
        if error <= 1e-10:
            break
        # Dividing by the new total keeps the mean weight at one.
        grown = wrong * math.exp(step) + (total - wrong)
        changed = F.col("weight") * F.when(missed == 1, math.exp(step)).otherwise(1.0) * (total / grown)
        rows = judged.withColumn("weight", changed).select(*ids, "features", "label", "weight")
        if (i + 1) % cut_every == 0:
            rows = checkpointed(rows)
    votes = [m.getPredictionCol() for m in models]
    totals = [f"vote_{c}" for c in range(len(labels))]
    stages = [*models, VoteTotals(votes=votes, weights=weights, classes=len(labels)), ProbabilityArray(scores=totals, drop=totals)]
    return FittedClassifier(labels, PipelineModel(stages), models)


def forest_regression(df: DataFrame, target: str, trees: int = 100, depth: int = 6, seed: int = 1) -> object:
    return RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(df)


def error_by_round(model, df: DataFrame, label: str, labels: Sequence[str], rounds: int) -> DataFrame:
    """Misclassification rate of a two-class boosted model after 1..rounds trees, in one pass."""
    coded = _coded(df, label, labels)
    trees, weights = model.trees[:rounds], model.treeWeights[:rounds]
    scored = coded
    names = []
    for i, tree in enumerate(trees):
        names.append(f"__t{i}")
        scored = tree.setPredictionCol(names[-1]).transform(scored)
    margin, cells = F.lit(0.0), []
    for i, (name, weight) in enumerate(zip(names, weights)):
        margin = margin + F.col(name) * float(weight)
        wrong = ((margin > 0).cast("double") != F.col("label")).cast("double")
        cells.append(F.struct(F.lit(i + 1).alias("round"), F.avg(wrong).alias("error")))
    return scored.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


# Output of predictions


def wide_probabilities(scored: DataFrame, labels: Sequence[str], keep: Sequence[str] = ("id",), prefix: str = "pred_") -> DataFrame:
    return scored.select(*keep, *[F.col("prob")[i].alias(f"{prefix}{c}") for i, c in enumerate(labels)])


def top_classes(scored: DataFrame, labels: Sequence[str], n: int = 5, keep: Sequence[str] = ("id",), out: str = "country") -> DataFrame:
    """The n likeliest classes of every row, best first, ties at the last place kept.

    Works inside the probability array, so no row is shuffled.
    """
    floor = F.element_at(F.sort_array("prob", asc=False), F.least(F.lit(n), F.size("prob")))
    pairs = F.transform(F.col("prob"), lambda p, i: F.struct((-p).alias("m"), i.alias("i")))
    best = F.filter(F.array_sort(pairs), lambda s: -s["m"] >= floor)
    placed = scored.select(*keep, F.posexplode(best).alias("__pos", "__s"))
    return placed.select(*keep, (F.col("__pos") + 1).alias("place"), from_code(F.col("__s.i"), labels).alias(out))


def submission(scored: DataFrame, labels: Sequence[str], path: str, n: int = 5) -> None:
    """Write ``id,country`` with the best class first. Rows of one id stay in one part, in order."""
    from waymark.sources.delimited import write_delimited

    write_delimited(top_classes(scored, labels, n).select("id", "country"), path)

