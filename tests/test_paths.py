"""Penalty paths, sketches, importance without trees, replicates by weight, sweeps that resume."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from waymark.features import prepare as M
from waymark.features import resample as B
from waymark.features import sketch as S
from waymark.features.sketch import SketchedVector, TensorSketch
from waymark.models import boosting as X
from waymark.models import classify as L
from waymark.models import importance as I
from waymark.models import tuning as G
from waymark.models.penalty_path import descend, logistic_path


def vectors(spark, n=300, classes=2, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * np.array([1, 5, 0.2, 1, 1, 3]) + np.array([0, 10, 0, 1, 0, 0])
    odds = np.stack([np.zeros(n), x[:, 0] + 0.3 * (x[:, 1] - 10), 2 * x[:, 3] - x[:, 0]], axis=1)[:, :classes]
    y = (odds + rng.gumbel(size=odds.shape)).argmax(axis=1)
    rows = [(f"u{i:03d}", f"c{c}", Vectors.dense(v), *v) for i, (c, v) in enumerate(zip(y.tolist(), x.tolist(), strict=True))]
    return spark.createDataFrame(rows, ["id", "y", "features", *[f"f{j}" for j in range(6)]]).repartition(3)


# Penalty path.


@pytest.mark.parametrize("classes", [2, 3])
def test_path_equals_separate_fits(spark, classes):
    df = vectors(spark, classes=classes)
    penalties = [0.3 * 0.5**i for i in range(10)]
    path = logistic_path(df, "y", penalties, mixture=0.5)
    # MLlib scales by another deviation, so it gets scaled columns and leaves them as they are.
    scale = np.array([r.features.toArray() for r in df.collect()]).std(axis=0)
    cells = F.array(*[F.col(f"f{j}") / F.lit(float(s)) for j, s in enumerate(scale)])
    coded = df.withColumn("label", F.substring("y", 2, 1).cast("double")).withColumn("features", array_to_vector(cells))
    assert path.passes < 20
    for i, penalty in enumerate(path.penalties):
        if classes == 2 or i % 3 == 0:
            own = LogisticRegression(regParam=penalty, elasticNetParam=0.5, maxIter=500, tol=1e-12, standardization=False).fit(coded)
            expected = own.coefficientMatrix.toArray() / scale
            assert np.allclose(path.coefficients[i], expected, atol=2e-4)
            intercepts = own.interceptVector.toArray()
            assert np.allclose(path.intercepts[i] - path.intercepts[i].mean() * (classes > 2), intercepts - intercepts.mean() * (classes > 2), atol=2e-3)
    alone = logistic_path(df.repartition(5), "y", [penalties[6]], mixture=0.5)
    assert np.allclose(alone.coefficients[0], path.coefficients[6], atol=1e-5)
    table = path.table(spark, [f"f{j}" for j in range(6)])
    assert table.count() == 10 * (classes if classes > 2 else 1) * 7
    found = path.classifier(9).predictions(df, "y").agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]
    assert found > 0.6


def test_large_penalties_keep_the_intercept_only(spark):
    df = vectors(spark, 100)
    path = logistic_path(df, "y", [100.0], mixture=1.0)
    share = df.where("y = 'c1'").count() / 100
    assert (path.coefficients == 0).all() and math.isclose(path.intercepts[0, 0], math.log(share / (1 - share)), abs_tol=1e-4)


def test_coordinate_descent_solves_the_quadratic_problem():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(20, 5))
    gram, gradient = a.T @ a, rng.normal(size=5)
    b = descend(gradient, gram, np.zeros(5), np.zeros(5), 0.5, 0.7, np.arange(5) == 0)
    slope = gradient + gram @ b
    assert abs(slope[0]) < 1e-6
    for j in range(1, 5):
        ridge = slope[j] + 0.5 * 0.3 * b[j]
        assert abs(ridge + 0.35 * np.sign(b[j])) < 1e-6 if b[j] else abs(ridge) <= 0.35 + 1e-6


# Sketches.


@pytest.mark.parametrize(("degree", "scale", "offset"), [(1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.5, 2.0)])
def test_sketches_estimate_the_kernel(degree, scale, offset):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 5))
    kernel = (scale * x @ x.T + offset) ** degree
    estimates = []
    for seed in range(60):
        z = TensorSketch(5, degree, 256, scale, offset, seed)(x)
        estimates.append(z @ z.T)
    norms = (scale * (x**2).sum(axis=1) + offset) ** degree
    bound = np.sqrt((3**degree - 1) / 256 * np.outer(norms, norms))  # the stated deviation of one estimate
    gaps = np.array(estimates) - kernel
    assert (np.sqrt((gaps**2).mean(axis=0)) < 1.5 * bound).all()  # sixty draws
    assert (np.abs(gaps.mean(axis=0)) < 5 * bound / math.sqrt(60)).all()


def test_sketched_columns(spark):
    df = vectors(spark, 60)
    x = np.array([r.features.toArray() for r in df.orderBy("id").collect()])
    step = SketchedVector(size=6, degree=2, width=64, seed=9)
    found = np.array([r.expanded.toArray() for r in step.transform(df).orderBy("id").collect()])
    assert np.allclose(found, TensorSketch(6, 2, 64, seed=9)(x))
    columns = [f"f{j}" for j in range(6)]
    parts = df.select("id", "y", *columns)
    fitted = M.SketchedComponents(columns, k=3, degree=2, width=48, scale=0.1, ids=("id",), label="y").fit(parts)
    out = fitted.transform(parts).orderBy("id").collect()
    z = TensorSketch(6, 2, 48, 0.1, 1.0, 945)(x)
    centred = z - z.mean(axis=0)
    scores = np.linalg.svd(centred, full_matrices=False)
    expected = np.abs(scores[0][:, :3] * scores[1][:3])
    assert np.allclose(np.abs([[r.PC1, r.PC2, r.PC3] for r in out]), expected, atol=1e-6)


def test_sketched_svm_has_a_fixed_width(spark):
    df = vectors(spark, 120)
    fitted = L.sketched_svm(df, "y", degree=3, width=32, scale=0.1, steps=10)
    assert fitted.model[0].numFeatures == 32
    assert all(math.isclose(sum(r.prob), 1.0) for r in fitted.scored(df).collect())


def test_sketched_rows_come_in_slices(monkeypatch):
    x = np.random.default_rng(5).normal(size=(3000, 6))
    x[7, 2] = np.nan
    rows = pa.array(list(x), pa.list_(pa.float64()))
    sketch = TensorSketch(6, 3, 256)
    parts = list(S._in_slices(iter([rows[:2500], rows[2500:2500], rows[2500:]]), sketch, 6))
    assert max(map(len, parts)) * 256 * 8 <= S.SLICE_BYTES
    found = np.concatenate([p.flatten().to_numpy().reshape(-1, 256) for p in parts])
    assert np.allclose(found, sketch(np.nan_to_num(x)))
    monkeypatch.setattr(S, "SLICE_BYTES", 1)  # a row at a time
    assert [len(p) for p in S._in_slices(iter([rows[5:8]]), sketch, 6)] == [1, 1, 1]
    for bad in ([[1.0] * 6, [1.0] * 5], [[1.0] * 6, None], [[1.0] * 7, [1.0] * 5]):
        with pytest.raises(ValueError):
            list(S._in_slices(iter([pa.array(bad, pa.list_(pa.float64()))]), sketch, 6))


@pytest.mark.parametrize("fit", [lambda df: L.sketched_svm(df, "y", degree=3, width=32, scale=0.1, steps=10), lambda df: L.polynomial_svm(df, "y", steps=10)])
def test_wide_rows_are_not_cached_beside_the_learner(spark, monkeypatch, fit):
    cached = []

    class Seen(LinearSVC):
        def fit(self, df, params=None):
            plan = df._jdf.queryExecution().withCachedData().toString()
            cached.append(re.findall(r"InMemoryRelation \[([^]]*)\]", plan))
            return super().fit(df, params)

    monkeypatch.setattr(L, "LinearSVC", Seen)
    fit(vectors(spark, 120))
    assert len(cached) == 2 and all(len(c) == 1 and "features" in c[0] and "expanded" not in c[0] for c in cached)


def test_partitions_of_wide_rows_are_small(spark, monkeypatch):
    sizes = []

    class Seen(LinearSVC):
        def fit(self, df, params=None):
            sizes.append([r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
            return super().fit(df, params)

    monkeypatch.setattr(L, "LinearSVC", Seen)
    df = vectors(spark, 120).repartitionByRange(3, F.col("id") > "u100")  # most rows in one partition
    whole = L.sketched_svm(df, "y", degree=3, width=32, scale=0.1, steps=10)
    assert max(sizes[0]) > 80  # small enough: not dealt out
    monkeypatch.setattr(L, "PARTITION_BYTES", 20 * 32 * 8, raising=False)
    parts = L.sketched_svm(df, "y", degree=3, width=32, scale=0.1, steps=10)
    assert all(max(n) < 30 and sum(n) == 120 for n in sizes[2:])
    for a, b in zip(whole.model, parts.model, strict=True):
        assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=1e-6)


# Importance.


def area_by_force(a, b):
    wins = sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b)) / (len(a) * len(b))
    return max(wins, 1 - wins)


def test_class_areas_match_all_pairs(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), float(rng.randrange(6)), None if rng.random() < 0.3 else rng.random(), float("nan")) for _ in range(150)]
    df = spark.createDataFrame(rows, "y string, f double, g double, h double")
    found = {(r.feature, r["class"]): r.area for r in I.class_areas(df, "y", ["f", "g", "h"], range_rows=20).collect()}
    for j, feature in ((1, "f"), (2, "g")):
        values = {c: [r[j] for r in rows if r[0] == c and r[j] is not None] for c in "abc"}
        for c in "abc":
            assert math.isclose(found[feature, c], max(area_by_force(values[c], values[d]) for d in "abc" if d != c))
    assert not any(f == "h" for f, _ in found)
    table = I.roc_importance(df, "y", ["f", "g"]).collect()
    assert [r.importance for r in table] == sorted((max(found[f, c] for c in "abc") for f in "fg"), reverse=True)


def test_every_model_tells_its_importance(spark):
    df = M.assembled(vectors(spark, 200).drop("features"), ["id"], "y")
    models = [
        L.forest(df, "y", trees=4, depth=3),
        L.boosted_binary(df, "y", rounds=2, depth=2),
        L.boosted(df, "y", rounds=2, depth=2),
        L.boosted_trees_m1(df, "y", rounds=3, depth=2),
        L.logistic(df, "y"),
        L.polynomial_svm(df, "y", steps=3),
        L.sketched_svm(df, "y", width=16, steps=3),
        X.boost(df, "y", X.Settings(rounds=3, depth=2)).classifier(),
        logistic_path(df, "y", [0.01]).classifier(0),
    ]
    for fitted in models:
        table = I.model_importance(fitted, df).collect()
        assert math.isclose(sum(r.importance for r in table), 1.0) and all(r.importance >= 0 for r in table)
        if len(table) == 6:
            assert {r.feature for r in table} == {f"f{j}" for j in range(6)} and table[0].feature in ("f0", "f1", "f3")
    linear = L.logistic(df, "y")
    slopes = np.abs(linear.model.coefficientMatrix.toArray()[0])
    spread = np.array([r.features.toArray() for r in df.collect()]).std(axis=0, ddof=1)
    expected = slopes * spread / (slopes * spread).sum()
    found = {r.feature: r.importance for r in I.model_importance(linear, df).collect()}
    assert np.allclose([found[f"f{j}"] for j in range(6)], expected)
    with pytest.raises(TypeError):
        I.model_importance(L.naive_bayes(df, "y"), df)


# Replicates and sweeps.


def test_replicates_by_weight_match_the_bootstrap_table(spark):
    df = vectors(spark, 90).select("id", "y", "features")
    drawn = {}
    for r in B.bootstrap(df.select("id"), ["id"], 3, 7).collect():
        drawn.setdefault(r.replicate, {})[r.id] = r.weight

    def fit(settings, train, weight):
        assert "copy" not in train.columns
        return {r.id: r[weight] for r in train.collect()}, settings

    def score(fitted, test):
        weights, settings = fitted
        out = {r.id for r in test.collect()}
        replicate = next(k for k, v in drawn.items() if {i: w for i, w in v.items() if w} == weights)
        assert out == {i for i, w in drawn[replicate].items() if w == 0}
        return {"rows": len(out) + settings["a"]}

    found = G.evaluate_replicates(df, ["id"], [{"a": 0}, {"a": 1}], fit, score, times=3, seed=7)
    assert Counter(r.metric for r in found.collect()) == {"rows": 6} and found.where("error IS NOT NULL").count() == 0


def test_a_stopped_sweep_goes_on(spark, tmp_path):
    df = B.stratified_folds(vectors(spark, 60).select("id", "y", "features"), ["y"], ["id"], 3, 1)
    store = G.ResultStore(spark, str(tmp_path / "results"))
    grid, fits = [{"a": 1}, {"a": 2}], []

    class Stopped(BaseException):
        pass

    def fit(settings, train):
        if len(fits) == limit:
            raise Stopped
        fits.append((settings["a"], train.count()))
        if settings["a"] == 2:
            raise ValueError("poor setting")
        return settings

    run = lambda g=grid, name="r": G.evaluate_grid(df, 3, g, fit, lambda m, test: {"n": test.count(), "a": m["a"]}, 1, store=store, recipe=name)
    limit = 3
    with pytest.raises(Stopped):
        run()
    assert len(fits) == 3
    limit = 99
    first = sorted(map(str, run().collect()))
    assert len(fits) == 6 and Counter(a for a, _ in fits) == {1: 3, 2: 3}
    assert sorted(map(str, run().collect())) == first and len(fits) == 6
    turned = run(grid[::-1]).collect()
    assert len(fits) == 6 and {(r.config, r.metric) for r in turned} == {(1, "n"), (1, "a"), (0, "failed")}
    run(name="another")
    assert len(fits) == 12
    small = store.compact(str(tmp_path / "small"))
    assert small.table().count() == store.table().count() == 18
    assert G.fingerprint(df) == G.fingerprint(df.repartition(5)) != G.fingerprint(df.where("id <> 'u001'"))

