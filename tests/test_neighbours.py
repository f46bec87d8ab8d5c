"""Neighbour search and its users against brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.features.neighbours import NeighbourImpute, adasyn, nearest, smote


def brute(points, k, groups=None):
    out = {}
    for i, p in points.items():
        others = [j for j in points if j != i and (groups is None or groups[i] == groups[j])]
        others.sort(key=lambda j: (np.sqrt(((np.array(points[j]) - np.array(p)) ** 2).sum()), j))
        out[i] = others[:k]
    return out


def cloud(n, seed, copies=0):
    draw = np.random.default_rng(seed)
    rows = {f"r{i:03d}": draw.normal(size=3).round(3).tolist() for i in range(n)}
    rows |= {f"z{i:03d}": [0.5, 0.5, 0.5] for i in range(copies)}
    return rows


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], {})[r["place"]] = r["neighbour"]
    return {i: [v[p] for p in sorted(v)] for i, v in out.items()}


@pytest.mark.parametrize("pivots,tile", [(4, (7, 11)), (16, (1000, 1000)), (1, (5, 5))])
def test_exact_with_copies(spark, pivots, tile):
    points = cloud(60, 3, copies=30)  # a third of all rows is one point
    df = spark.createDataFrame(list(points.items()), "id string, vector array<double>").repartition(5)
    assert found(nearest(df, df, 4, pivots=pivots, tile=tile)) == brute(points, 4)


def test_exact_within_class(spark):
    points = cloud(50, 5)
    groups = {i: "ab"[int(i[1:]) % 5 == 0] for i in points}
    rows = [(i, groups[i], v) for i, v in points.items()]
    df = spark.createDataFrame(rows, "id string, c string, vector array<double>")
    assert found(nearest(df, df, 3, within="c", pivots=6, tile=(8, 8))) == brute(points, 3, groups)


def test_fewer_candidates_than_wanted(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [5.0])], "id string, vector array<double>")
    assert found(nearest(df, df, 5)) == {"a": ["b", "c"], "b": ["a", "c"], "c": ["b", "a"]}


def test_impute_is_mean_of_nearest(spark):
    rows = [("a", 0.0, 10.0), ("b", 1.0, 20.0), ("c", 2.0, 30.0), ("d", 50.0, 900.0), ("e", 0.9, None)]
    df = spark.createDataFrame(rows, "id string, x double, y double").withColumn("country_destination", F.lit("US"))
    out = {r["id"]: r["y"] for r in NeighbourImpute(k=3).fit(df).transform(df).collect()}
    assert out == {"a": 10.0, "b": 20.0, "c": 30.0, "d": 900.0, "e": 20.0}


@pytest.fixture()
def labelled(spark):
    draw = np.random.default_rng(8)
    rows = [(f"m{i}", "big", *map(float, draw.normal(size=2))) for i in range(40)] + [(f"s{i}", "small", *map(float, draw.normal(3, 1, size=2))) for i in range(9)]
    return spark.createDataFrame(rows, "id string, y string, a double, b double")


def test_smote_balances_between_neighbours(spark, labelled):
    out = smote(labelled, "y", ["id"], ["a", "b"], seed=4)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"big": 40, "small": 40}
    real = np.array([[r["a"], r["b"]] for r in labelled.where("y = 'small'").collect()])
    for r in out.where("copy > 0").collect():
        point = np.array([r["a"], r["b"]])
        between = [
            abs(np.linalg.norm(p - point) + np.linalg.norm(q - point) - np.linalg.norm(p - q)) for p in real for q in real
        ]
        assert min(between) < 1e-9
    again = smote(labelled.repartition(7), "y", ["id"], ["a", "b"], seed=4)
    key = lambda df: sorted((r["id"], r["copy"], r["a"], r["b"]) for r in df.collect())
    assert key(out) == key(again)


def test_adasyn_keeps_rows_and_favours_the_border(spark, labelled):
    out = adasyn(labelled, "y", ["id"], ["a", "b"], seed=4)
    assert out.where("copy = 0").count() == 49
    assert out.where("y = 'big' AND copy > 0").count() == 0
    assert abs(out.where("copy > 0").count() - 31) <= 9


def test_chained_matching_uses_observed_values(spark):
    from waymark.features.impute import chained_matching

    draw = np.random.default_rng(2)
    rows = []
    for i in range(80):
        x = float(draw.normal())
        rows.append((f"r{i}", x if i % 7 else None, 3 * x + 1 if i % 5 else None, "hi" if x > 0 else "lo"))
    rows = [(a, b, c, d if i % 11 else None) for i, (a, b, c, d) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id string, x double, y double, side string")
    out = {r["id"]: r for r in chained_matching(df, ["id"], ["x", "y", "side"], sweeps=2, seed=3, range_rows=20).collect()}
    assert len(out) == 80
    seen = {c: {r[c] for r in df.collect() if r[c] is not None} for c in ("x", "y", "side")}
    for r in df.collect():
        for c in ("x", "y", "side"):
            assert out[r["id"]][c] == r[c] if r[c] is not None else out[r["id"]][c] in seen[c]


def test_a_tile_compares_only_near_boxes(spark, monkeypatch):
    from waymark.features import neighbours as N

    draw = np.random.default_rng(11)
    points = np.concatenate([draw.normal(size=(3000, 2)), draw.integers(0, 3, (200, 2)).astype(float)])
    ids = [f"r{i:05d}" for i in draw.permutation(len(points))]
    left = pd.DataFrame({"grp": "", "key": ids, "vector": list(points), "far": np.inf})
    right = pd.DataFrame({"nid": ids, "nkey": ids, "vector": list(points)})
    for metric in ("euclidean", "city"):
        whole = N._distances(points, points, metric)
        place = np.argsort(np.argsort(ids))
        wanted = {i: [ids[j] for j in np.lexsort((place, row))[:4]] for i, row in zip(ids, whole, strict=True)}
        compared, plain = [0], N._distances
        monkeypatch.setattr(N, "_distances", lambda a, b, m="euclidean": compared.__setitem__(0, compared[0] + len(a) * len(b)) or plain(a, b, m))  # noqa: B023
        out = N._tile_search(4, metric)(left, right)
        monkeypatch.setattr(N, "_distances", plain)
        assert out.groupby("key")["nid"].agg(list).to_dict() == wanted
        assert compared[0] < 0.2 * len(points) ** 2


@pytest.mark.parametrize("metric", ["euclidean", "city"])
def test_few_rows_are_sent_to_other_cells(spark, monkeypatch, metric):
    from waymark.features import neighbours as N

    draw = np.random.default_rng(12)
    points = {f"r{i:04d}": draw.uniform(0, 10, 2).round(2).tolist() for i in range(1500)}
    df = spark.createDataFrame(list(points.items()), "id string, vector array<double>")
    searched, sent = N._searched, []
    monkeypatch.setattr(N, "_searched", lambda q, b, *rest: sent.append((q.count(), b.count())) or searched(q, b, *rest))
    out = found(nearest(df, df, 3, pivots=20, metric=metric))
    whole = N._distances(np.array(list(points.values())), np.array(list(points.values())), metric)
    names = list(points)
    for i, row in enumerate(whole):
        assert out[names[i]] == [names[j] for j in np.lexsort((np.arange(len(names)), row)) if j != i][:3]
    assert sent[1][0] <= 1500 and all(m == 1500 for _, m in sent)
