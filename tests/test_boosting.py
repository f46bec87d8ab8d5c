"""Joint boosting against a plain loop, refits, and one-against-rest."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from waymark.features import prepare as M
from waymark.models import boosting as X
from waymark.models import classify as L


def table(spark, n=240, classes=4, seed=1, folds=3, gaps=0.05):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, 5)).round(1)
    values[:, 3] = rng.integers(0, 3, n)
    values[rng.random((n, 5)) < gaps] = np.nan
    filled = np.nan_to_num(values)
    truth = ((filled[:, 0] > 0).astype(int) + 2 * (filled[:, 1] + filled[:, 3] > 1)) % classes
    truth = np.where(rng.random(n) < 0.1, rng.integers(0, classes, n), truth)
    rows = [(f"u{i:04d}", f"c{t}", Vectors.dense(v), i % folds) for i, (v, t) in enumerate(zip(values.tolist(), truth.tolist(), strict=True))]
    return spark.createDataFrame(rows, ["id", "y", "features", "fold"]).repartition(4)


def plain(values, truth, weight, classes, edges, s):
    """One variant in plain loops: scores after every round."""
    n = len(values)
    bins = [[0 if math.isnan(x) else 1 + sum(e < x for e in edges[j]) for j, x in enumerate(row)] for row in values]
    outputs = 1 if classes == 2 else classes
    scores, out = [[0.0] * outputs for _ in range(n)], []
    for _ in range(s.rounds):
        probs = [X.probabilities(np.array(r)).tolist() for r in scores]
        for k in range(outputs):
            c = 1 if outputs == 1 else k
            g = [round((p[c] - (t == c)) * X.UNIT) for p, t in zip(probs, truth, strict=True)]
            h = [round(max(p[c] * (1 - p[c]), 1e-6) * X.UNIT) for p in probs]
            value = lambda a: -s.rate * sum(g[i] * weight[i] for i in a) / (sum(h[i] * weight[i] for i in a) + s.l2 * X.UNIT)  # noqa: E731, B023
            part = lambda a: sum(g[i] * weight[i] for i in a) ** 2 / (sum(h[i] * weight[i] for i in a) + s.l2 * X.UNIT)  # noqa: E731, B023

            def add(rows, depth, leaf):
                used = [i for i in rows if weight[i]]
                best = None
                if depth < s.depth and used:
                    for j in range(len(edges)):
                        for cut in range(s.bins):
                            left, right = [i for i in used if bins[i][j] <= cut], [i for i in used if bins[i][j] > cut]
                            if left and right and min(sum(weight[i] for i in left), sum(weight[i] for i in right)) >= s.min_rows:
                                gain = round((part(left) + part(right) - part(used)) / X.UNIT, 9)
                                if best is None or gain > best[0]:
                                    best = gain, j, cut, value(left), value(right)
                if best and best[0] > s.min_gain:
                    _, j, cut, low, high = best
                    add([i for i in rows if bins[i][j] <= cut], depth + 1, low)
                    add([i for i in rows if bins[i][j] > cut], depth + 1, high)
                else:
                    for i in rows:
                        scores[i][k] += leaf

            add(range(n), 0, value([i for i in range(n) if weight[i]]))
        out.append([X.probabilities(np.array(r)).tolist() for r in scores])
    return out


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_matches_plain_loops(spark, classes):
    s = X.Settings(rounds=3, depth=2, bins=5, min_rows=4)
    df = table(spark, 90, classes).withColumn("w", (F.col("fold") + 1) % 3)
    run = X.boost(df, "y", s, ["w"])
    rows = sorted(df.collect(), key=lambda r: r.id)
    expected = plain([r.features.toArray().tolist() for r in rows], [int(r.y[1:]) for r in rows], [r.w for r in rows], classes, run.edges, s)
    for rounds in (1, 3):
        found = {r.id: r.prob for r in run.classifier(rounds=rounds).scored(df).collect()}
        assert np.allclose([found[r.id] for r in rows], expected[rounds - 1], atol=1e-9)
    held = [i for i, r in enumerate(rows) if r.w == 0]
    for h in run.history:
        p = expected[h["round"] - 1]
        wrong = np.mean([int(np.argmax(p[i])) != int(rows[i].y[1:]) for i in held])
        loss = np.mean([-math.log(p[i][int(rows[i].y[1:])]) for i in held])
        assert math.isclose(h["test_error"], wrong) and math.isclose(h["test_loss"], loss, abs_tol=1e-5)


def test_folds_at_once_equal_refits_and_any_partitioning(spark):
    s = X.Settings(rounds=4, depth=3, bins=8)
    df, names = X.fold_weights(table(spark), 3)
    run = X.boost(df, "y", s, names)
    again = X.boost(df.repartition(7), "y", s, names)
    assert run.history == again.history and len(run.history) == 12
    for k in range(3):
        alone = X.boost(df, "y", s, [names[k]])
        assert [h["test_error"] for h in alone.history] == [h["test_error"] for h in run.history if h["variant"] == k]
        for rounds in (1, 2, 4):  # refitted with fewer rounds
            model = X.boost(df, "y", X.Settings(rounds=rounds, depth=3, bins=8), [names[k]]).classifier(rounds=rounds)
            held = model.predictions(df.where(F.col("fold") == k), "y")
            error = held.agg(F.avg((F.col("predicted") != F.col("y")).cast("double"))).first()[0]
            assert math.isclose(error, next(h["test_error"] for h in run.history if h["variant"] == k and h["round"] == rounds))
    summary = {r["round"]: r for r in X.error_by_round(run, spark).collect()}
    own = [h["test_error"] for h in run.history if h["round"] == 2]
    assert math.isclose(summary[2].test_mean, np.mean(own)) and math.isclose(summary[2].test_sd, np.std(own, ddof=1))


def test_stops_early_at_the_best_round(spark, monkeypatch):
    monkeypatch.setattr(X, "CUT_EVERY", 3)
    df, names = X.fold_weights(table(spark, 150), 3)
    s = X.Settings(rounds=14, depth=3, rate=1.0, bins=8, patience=3)
    run = X.boost(df, "y", s, names[:2])
    full = X.boost(df, "y", X.Settings(rounds=14, depth=3, rate=1.0, bins=8), names[:2])
    assert len(run.forests) < 14 == len(full.forests)
    for v in range(2):
        losses = {h["round"]: h["test_loss"] for h in full.history if h["variant"] == v}
        reached = max(h["round"] for h in run.history)
        first = {r: x for r, x in losses.items() if r <= reached}
        assert run.best[v] == min(first, key=first.get)
        stages = run.classifier(v).stages.stages[0].values["trees"]
        assert len(stages) == run.best[v]


def test_joint_classes_beat_one_against_rest(spark):
    df = table(spark, 600, 4, seed=5, gaps=0.0)
    train, test = df.where("fold > 0"), df.where("fold = 0")
    joint = X.boost(train, "y", X.Settings(rounds=8, depth=3, rate=0.3)).classifier()
    rest = L.boosted(train, "y", rounds=8, depth=3, rate=0.3)
    assert sum(len(t[0]) for t in joint.stages.stages[0].values["trees"]) == 32  # as many trees as the other

    def loss(model):
        p = model.predictions(test, "y")
        return p.agg(F.avg(-F.ln(F.greatest(F.get("prob", F.col("truth")), F.lit(1e-9))))).first()[0]

    assert loss(joint) < loss(rest)


def test_model_is_saved_and_needs_two_classes(spark, tmp_path):
    from waymark.sources.snapshots import load_pipeline, save_pipeline

    df = table(spark, 80, 2)
    run = X.boost(df, "y", X.Settings(rounds=2, depth=2, bins=4))
    model = run.classifier()
    assert run.best == [2] and run.history[0]["test_loss"] is None and run.importance().sum() > 0
    save_pipeline(model.stages, str(tmp_path / "m"))
    again = L.FittedClassifier(model.labels, load_pipeline(str(tmp_path / "m")))
    assert sorted(map(str, again.scored(df).collect())) == sorted(map(str, model.scored(df).collect()))
    with pytest.raises(ValueError):
        X.boost(df.where("y = 'c0'"), "y")
    assert again.scored(df.limit(0)).collect() == []


def test_a_pass_walks_few_finished_trees(spark, monkeypatch):
    walked, plain = [], X._Pass.__init__

    def noted(self, *a, **k):
        plain(self, *a, **k)
        walked.append(len(self.done))

    monkeypatch.setattr(X._Pass, "__init__", noted)
    draw = np.random.default_rng(5)
    rows = [(f"r{i}", "abc"[i % 3], float(x) + i % 3) for i, x in enumerate(draw.normal(size=90))]
    frame = M.assembled(spark.createDataFrame(rows, "id string, y string, u double"), ["id"], "y")
    run = X.boost(frame, "y", X.Settings(rounds=6, depth=2))
    assert len(run.history) == 6 and max(walked) <= 2
