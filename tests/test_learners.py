"""Kernel naive Bayes and Gower neighbours against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.features.gower import UNIT, GowerImpute, gower_nearest, gower_spec
from waymark.models.kernel_bayes import kernel_bayes

# Kernel naive Bayes.


def people(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choice("aab")
        x = rng.gauss(2.0 if y == "a" else 5.0, 1.0) if rng.random() > 0.1 else None
        z = float(rng.randrange(4)) if rng.random() > 0.1 else float("nan")
        level = rng.choice("pq" if y == "a" else "qr") if rng.random() > 0.1 else None
        rows.append((f"u{i}", y, x, z, level))
    return rows, spark.createDataFrame(rows, "id string, y string, x double, z double, level string").repartition(3)


def test_kernel_bayes_approaches_the_exact_kernel_sum(spark):
    rows, df = people(spark)
    for smoothness in (1.0, 2.5):
        model = kernel_bayes(df, "y", ["x"], smoothness=smoothness, grid=2048)
        found = {r.id: r.prob for r in model.scored(df).collect()}
        own = {c: np.array([x for _, y, x, *_ in rows if y == c and x is not None]) for c in "ab"}
        prior = Counter(y for _, y, *_ in rows)
        band = {}
        for c, values in own.items():
            q1, q3 = np.quantile(values, [0.25, 0.75])
            band[c] = 0.9 * min(values.std(ddof=1), (q3 - q1) / 1.34) * len(values) ** -0.2 * smoothness
        for i, _, x, *_ in rows[:60]:
            score = []
            for c in "ab":
                d = 1.0 if x is None else np.exp(-0.5 * ((x - own[c]) / band[c]) ** 2).mean() / band[c] / math.sqrt(2 * math.pi)
                score.append(prior[c] * max(d, 1e-9))
            assert np.allclose(found[i], np.array(score) / sum(score), atol=5e-3)


def test_levels_are_smoothed_and_gaps_say_nothing(spark):
    rows, df = people(spark)
    model = kernel_bayes(df, "y", [], ["level"], laplace=2.0)
    found = {r.id: r.prob for r in model.scored(df).collect()}
    counts = Counter((y, v) for _, y, _, _, v in rows if v)
    seen, prior = Counter(y for _, y, _, _, v in rows if v), Counter(y for _, y, *_ in rows)
    for i, _, _, _, v in rows:
        score = [prior[c] * ((counts[c, v] + 2) / (seen[c] + 6) if v else 1.0) for c in "ab"]
        assert np.allclose(found[i], np.array(score) / sum(score))
    new = spark.createDataFrame([("n", "a", None, None, "unheard")], df.schema)
    total = prior["a"] + prior["b"]
    assert np.allclose(model.scored(new).first().prob, [prior["a"] / total, prior["b"] / total])


def test_kernel_bayes_edge_columns(spark):
    _, df = people(spark, 40)
    odd = df.withColumns({"none": F.lit(None).cast("double"), "same": F.lit(3.0), "blank": F.lit(None).cast("string")})
    plain = {r.id: r.prob for r in kernel_bayes(df, "y", ["x", "z"], ["level"], laplace=1.0).scored(df).collect()}
    both = {r.id: r.prob for r in kernel_bayes(odd, "y", ["x", "z", "none", "same"], ["level", "blank"], laplace=1.0).scored(odd).collect()}
    assert all(math.isclose(sum(p), 1.0) and len(p) == 2 for p in both.values())
    # A constant column has a bandwidth from its size and n, so it only moves the odds a little.
    assert max(abs(a[0] - b[0]) for a, b in zip(plain.values(), (both[i] for i in plain))) < 0.3
    far = df.limit(1).withColumn("x", F.lit(1e9))
    assert math.isclose(sum(kernel_bayes(df, "y", ["x"]).scored(far).first().prob), 1.0)


# Gower neighbours.


def mixed_rows(seed, n):
    rng = random.Random(seed)
    gap = lambda v, p=0.25: None if rng.random() < p else v
    return [
        (f"k{i:03d}", gap(float(rng.randrange(20))), gap(round(rng.random() * 7, 2)), gap(rng.choice("abc")), gap(rng.choice(["x", "y"])), gap(float(rng.randrange(50)), 0.3))
        for i in range(n)
    ]


def near_by_force(asked, donors, k, ranges):
    grid = lambda j, x: math.floor((x - ranges[j][0]) / (ranges[j][1] - ranges[j][0]) * UNIT + 0.5)
    out = {}
    for a in asked:
        found = []
        for b in donors:
            total, shared = 0, 0
            for j in (1, 2, 3, 4):
                if a[j] is not None and b[j] is not None:
                    shared += 1
                    total += abs(grid(j, a[j]) - grid(j, b[j])) if j < 3 else UNIT * (a[j] != b[j])
            if shared:
                found.append((total / UNIT / shared, b[0]))
        out[a[0]] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("pivots", [None, 4])
def test_gower_neighbours_match_all_pairs(spark, pivots):
    rows = mixed_rows(3, 220)
    schema = "id string, n double, m double, c string, d string, t double"
    df = spark.createDataFrame(rows, schema).repartition(3)
    spec = gower_spec(df, ["n", "m"], ["c", "d"])
    ranges = {j: spec["ranges"][c] for j, c in ((1, "n"), (2, "m"))}
    found = gower_nearest(df.where("t IS NULL"), df.where("t IS NOT NULL"), 4, ["n", "m", "c", "d"], spec, pivots=pivots, tile=(16, 32))
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        got.setdefault(r.id, []).append((r.distance, r.neighbour))
    expected = near_by_force([r for r in rows if r[5] is None], [r for r in rows if r[5] is not None], 4, ranges)
    assert got == {i: v for i, v in expected.items() if v}


def test_gower_imputation_fills_numbers_and_levels(spark, tmp_path):
    from waymark.sources.snapshots import load_pipeline, save_pipeline
    from pyspark.ml import PipelineModel

    rows = mixed_rows(4, 120)
    df = spark.createDataFrame(rows, "id string, n double, m double, c string, d string, t double")
    step = GowerImpute(["t", "c"], k=3, ids=("id",), label="none").fit(df)
    filled = {r.id: r for r in step.transform(df).collect()}
    assert len(filled) == 120
    spec = gower_spec(df, ["n", "m"], ["c", "d"])
    expected = near_by_force([r for r in rows if r[5] is None], [r for r in rows if r[5] is not None], 3, {1: spec["ranges"]["n"], 2: spec["ranges"]["m"]})
    value = {r[0]: r[5] for r in rows}
    for r in rows:
        if r[5] is not None:
            assert filled[r[0]].t == r[5]
        elif expected[r[0]]:
            assert math.isclose(filled[r[0]].t, np.mean([value[i] for _, i in expected[r[0]]]))
        else:
            assert filled[r[0]].t is None
        assert r[3] is None or filled[r[0]].c == r[3]
    save_pipeline(PipelineModel([step]), str(tmp_path / "g"))
    again = load_pipeline(str(tmp_path / "g")).transform(df)
    assert sorted(map(str, again.collect())) == sorted(map(str, filled.values()))
    new = spark.createDataFrame([("new", None, None, None, "unheard", None), ("lost", None, None, None, None, None)], df.schema)
    out = {r.id: r for r in step.transform(new).collect()}
    assert out["lost"].t is None and out["new"].t is not None and out["new"].c in "abc"
