"""Projections, transforms, densities, models and grids against independent results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.features import prepare as M
from waymark.models import classify as L
from waymark.models import tuning as G
from waymark.operators.profile import kernel_density


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(120, 3)) @ np.array([[2.0, 0.3, 0.1], [0.0, 1.0, 0.4], [0.0, 0.0, 0.5]])
    rows = [(f"p{i}", *map(float, r), "a" if r[0] + 0.2 * r[1] > 0 else "b", "abc"[i % 3]) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id string, u double, v double, w double, y string, country_destination string")


def components(df, k):
    rows = sorted(df.collect(), key=lambda r: int(r["id"][1:]))
    return np.array([[r[f"PC{i + 1}"] for i in range(k)] for r in rows])


def test_principal_components(points):
    x, df = points
    only = df.select("id", "u", "v", "w")
    got = components(M.PrincipalComponents(k=2).fit(only).transform(only), 2)
    centered = x - x.mean(axis=0)
    left, singular, _ = np.linalg.svd(centered, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(left[:, :2] * singular[:2]))


def test_components_by_variance(points):
    _, df = points
    only = df.select("id", "u", "v", "w")
    few = M.PrincipalComponents(variance=0.6).fit(only)
    assert len(few.values["weights"]) < 3


def test_quadratic_components_are_kernel_components(points):
    x, df = points
    only = df.select("id", "u", "v", "w")
    got = components(M.QuadraticComponents(k=2).fit(only).transform(only), 2)
    kernel = (x @ x.T + 1) ** 2
    centre = np.eye(len(x)) - 1 / len(x)
    values, vectors = np.linalg.eigh(centre @ kernel @ centre)
    expected = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    assert np.allclose(np.abs(got), np.abs(expected), atol=1e-6)


def test_radial_features_approach_the_kernel(points):
    x, df = points
    spec = M.RadialComponents(features=4000, sigma=0.2, seed=3)._map(["u", "v", "w"])
    weights, shifts = np.array(spec["weights"]), np.array(spec["shifts"])
    z = np.sqrt(2 / len(shifts)) * np.cos(x @ weights.T + shifts)
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-0.2 * gap)).max() < 0.1
    only = df.select("id", "u", "v", "w")
    assert components(M.RadialComponents(k=2, features=16).fit(only).transform(only), 2).shape == (120, 2)


def test_missing_cells_give_missing_components(spark, points):
    _, df = points
    fitted = M.RadialComponents(k=1, features=8).fit(df.select("id", "u", "v"))
    gap = spark.createDataFrame([("q", 1.0, None)], "id string, u double, v double")
    assert fitted.transform(gap).first()["PC1"] is None


def test_box_cox_finds_log_and_identity(spark):
    draw = np.random.default_rng(4)
    rows = [(float(a), float(b), -1.0) for a, b in zip(np.exp(draw.normal(size=3000)), 10 + draw.normal(size=3000))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    powers = M.BoxCox(["a", "b", "c"]).fit(df).values["powers"]
    assert set(powers) == {"a", "b"} and abs(powers["a"]) < 0.06
    x = np.array([r[1] for r in rows])
    fit = lambda p: -len(x) / 2 * math.log(np.var((x**p - 1) / p if p else np.log(x))) + (p - 1) * np.log(x).sum()
    assert fit(powers["b"]) >= max(fit(p) for p in np.linspace(-2, 2, 41)) - 1e-6


def test_near_constant(spark):
    df = spark.createDataFrame([("a" if i else "b", str(i), None) for i in range(60)], "rare string, many string, nothing string")
    flagged = {r["column"]: r["near_constant"] for r in M.near_constant(df, ["rare", "many", "nothing"]).collect()}
    assert flagged == {"rare": True, "many": False, "nothing": True}


def test_kernel_density(spark):
    draw = np.random.default_rng(9)
    x = draw.gamma(3.0, size=400)
    rows = sorted((r["x"], r["density"]) for r in kernel_density(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", points=64).collect())
    grid, got = np.array(rows).T
    quartiles = np.percentile(x, [25, 75])
    width = 0.9 * min(x.std(ddof=1), (quartiles[1] - quartiles[0]) / 1.34) * len(x) ** -0.2
    exact = np.exp(-(((grid[:, None] - x[None]) / width) ** 2) / 2).sum(axis=1) / (len(x) * width * math.sqrt(2 * math.pi))
    assert np.allclose(got, exact, atol=1e-3)
    assert abs(np.trapezoid(got, grid) - 1) < 0.01


@pytest.mark.parametrize(
    "fit",
    [
        lambda df: L.boosted_binary(df, "y", rounds=5, depth=3),
        lambda df: L.boosted(df, "y", rounds=3, depth=3),
        lambda df: L.forest(df, "y", trees=5, depth=4),
        lambda df: L.logistic(df, "y", steps=30),
        lambda df: L.naive_bayes(df, "y"),
        lambda df: L.polynomial_svm(df, "y", steps=20),
        lambda df: L.boosted_trees_m1(df, "y", rounds=4, depth=2),
        lambda df: L.boosted_trees_m1(df, "y", rounds=4, depth=2, impurity="entropy"),
    ],
)
def test_classifiers_learn_an_easy_label(points, fit):
    _, df = points
    frame = M.assembled(df.drop("country_destination"), ["id"], "y")
    fitted = fit(frame)
    rows = fitted.predictions(frame, "y").collect()
    assert len(rows) == 120 and {r["id"] for r in rows} == {f"p{i}" for i in range(120)}
    assert all(abs(sum(r["prob"]) - 1) < 1e-6 and min(r["prob"]) >= 0 for r in rows)
    assert np.mean([r["predicted"] == r["y"] for r in rows]) > 0.85


def test_error_by_round_ends_at_the_model(points):
    _, df = points
    frame = M.assembled(df.drop("country_destination"), ["id"], "y")
    fitted = L.boosted_binary(frame, "y", rounds=4, depth=2)
    errors = {r["round"]: r["error"] for r in L.error_by_round(fitted.model, frame, "y", fitted.labels, 4).collect()}
    final = fitted.predictions(frame, "y").agg(F.avg((F.col("predicted") != F.col("y")).cast("double"))).first()[0]
    assert len(errors) == 4 and errors[4] == final


def test_importances_sum_to_one(points):
    _, df = points
    frame = M.assembled(df.drop("country_destination"), ["id"], "y")
    table = M.importance_table(L.forest(frame, "y", trees=5, depth=3).model, frame).collect()
    assert {r["feature"] for r in table} == {"u", "v", "w"} and abs(sum(r["importance"] for r in table) - 1) < 1e-9
    assert table[0]["feature"] == "u"


def test_grids():
    assert len(G.full_grid({"a": [1, 2], "b": [3, 4, 5]})) == 6
    assert G.regular_grid({"a": (1, 3)}, 3) == [{"a": 1}, {"a": 2}, {"a": 3}]
    drawn = G.random_grid({"a": (0.0, 1.0), "b": ["x", "y"]}, 8, 3)
    assert drawn == G.random_grid({"a": (0.0, 1.0), "b": ["x", "y"]}, 8, 3) and all(0 <= g["a"] <= 1 for g in drawn)
    filled = G.space_filling_grid({"a": (0.0, 1.0), "b": (0.0, 10.0)}, 10, 3)
    assert sorted(int(g["a"] * 10) for g in filled) == list(range(10))
    assert sorted(int(g["b"]) for g in filled) == list(range(10))


def test_failed_fits_are_listed(spark):
    def broken():
        raise RuntimeError("no")

    rows = {r["spec"]: r for r in G.evaluate_specs(spark, {"good": lambda: {"auc": 0.5}, "bad": broken}).collect()}
    assert rows["good"]["value"] == 0.5 and rows["bad"]["metric"] == "failed" and "no" in rows["bad"]["error"]


def test_grid_over_folds(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "id int, fold int, x double")

    def fit(settings, train):
        if settings["k"] == 9:
            raise ValueError("bad setting")
        return settings["k"] + train.count()

    out = G.evaluate_grid(df, 3, [{"k": 1}, {"k": 9}], fit, lambda model, test: {"size": model + test.count()})
    good = [r["value"] for r in out.where("config = 0").collect()]
    assert good == [31.0] * 3
    assert out.where("config = 1 AND metric = 'failed'").count() == 3
    assert G.best_settings(out, [{"k": 1}, {"k": 9}], "size") == {"k": 1}


def test_random_features_stay_in_the_tasks(spark, monkeypatch):
    """Components of random features equal those of the whole feature matrix, which no task sends."""
    draw = np.random.default_rng(4)
    values = draw.normal(size=(300, 3)) + 5
    df = spark.createDataFrame([(f"r{i}", *map(float, v)) for i, v in enumerate(values)], "id string, u double, v double, w double").repartition(5)

    def refused(*a, **k):
        raise AssertionError("features were sent")

    monkeypatch.setattr(M, "array_to_vector", refused)
    for step in (M.RadialComponents(["u", "v", "w"], k=2, features=24), M.SketchedComponents(["u", "v", "w"], k=2, degree=2, width=32, scale=0.1)):
        fitted = step.fit(df)
        z = M._features(fitted.values["map"])(values)
        assert np.allclose(fitted.values["means"], z.mean(axis=0), atol=1e-9)
        axes, variances, _ = np.linalg.svd(np.cov(z.T))
        assert np.allclose(fitted.values["explained"], (variances / variances.sum())[:2], atol=1e-9)
        out = {r["id"]: r for r in fitted.transform(df).collect()}
        expected = (z - z.mean(axis=0)) @ axes[:, :2]
        got = np.array([[out[f"r{i}"][f"{fitted.values['prefix']}{j}"] for j in (1, 2)] for i in range(300)])
        assert np.allclose(np.abs(got), np.abs(expected), atol=1e-7)
        gap = fitted.transform(df.limit(1).withColumn("u", F.lit(None).cast("double"))).first()
        assert gap[f"{fitted.values['prefix']}1"] is None


def test_forest_keeps_the_nodes_of_rows_between_levels(spark):
    draw = np.random.default_rng(7)
    rows = [(f"r{i}", "ab"[int(x > 0)], float(x), float(y)) for i, (x, y) in enumerate(draw.normal(size=(200, 2)))]
    frame = M.assembled(spark.createDataFrame(rows, "id string, y string, u double, v double"), ["id"], "y")
    kept = L.forest(frame, "y", trees=5, depth=4, seed=3)
    assert kept.model.getCacheNodeIds()
    walked = L.forest(frame, "y", trees=5, depth=4, seed=3, cacheNodeIds=False)
    assert kept.model.toDebugString.split("\n")[1:] == walked.model.toDebugString.split("\n")[1:]


def test_fit_and_score_reads_its_source_once(spark, tmp_path):
    from waymark.plans.recipes import fit_and_score, recipe

    draw = np.random.default_rng(8)
    rows = [(f"r{i}", "ab"[int(x > 0)], float(x), "xyz"[i % 3]) for i, x in enumerate(draw.normal(size=120))]
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        reads.add(1)
        return x

    df = spark.createDataFrame(rows, "id string, y string, u double, c string").withColumn("u", counted.asNondeterministic()("u"))
    done = fit_and_score(df, recipe("semi_minimal", label="y", drop=()), lambda d, label: L.forest(d, label, trees=3, depth=2, seed=1))
    assert done.metrics.count() >= 1 and done.confusion.count() == 4
    assert reads.value == 120
