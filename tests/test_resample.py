"""Splits and balancing: exact sizes, independence of partitioning, no leaks."""

import pytest
from pyspark.sql import functions as F

from waymark.features import prepare as M
from waymark.features import resample as B
from waymark.models import classify as L
from waymark.plans.recipes import NAMES, fit_and_score, recipe


@pytest.fixture(scope="module")
def uneven(spark):
    """Two thirds of the rows in one class, one class with a single row, some without a label."""
    label = F.when(F.col("id") == 0, "solo").when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 31 == 2, None).otherwise("rare")
    return spark.range(600).select(F.col("id").cast("string").alias("id"), label.alias("y"), (F.col("id") % 17).cast("double").alias("x"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("digits", [1, 4])
def test_split_is_exact_and_stable(spark, uneven, digits):
    train, test = B.stratified_split(uneven, ["y"], ["id"], 0.8, 7, digits=digits)
    assert sorted(ids(train) + ids(test)) == ids(uneven)
    sizes = {r["y"]: r["count"] for r in uneven.groupBy("y").count().collect()}
    assert {r["y"]: r["count"] for r in train.groupBy("y").count().collect()} == {y: -(-n * 8 // 10) for y, n in sizes.items()}
    again, _ = B.stratified_split(uneven.repartition(11), ["y"], ["id"], 0.8, 7, digits=digits)
    assert ids(again) == ids(train)


def test_folds_are_balanced(uneven):
    folded = B.stratified_folds(uneven, ["y"], ["id"], 4, 7)
    assert folded.count() == 600
    for y, low, high in [tuple(r) for r in folded.groupBy("y", "fold").count().groupBy("y").agg(F.min("count"), F.max("count")).collect()]:
        assert high - low <= 1, y


def test_numbering_is_a_permutation(uneven):
    for digits in (1, 4):
        places = sorted(r["ordinal"] for r in B.numbered(uneven, [], ["id"], 3, digits=digits).collect())
        assert places == list(range(1, 601))


def test_down_and_up_sampling(uneven):
    known = uneven.where("y IS NOT NULL AND y <> 'solo'")
    down = {r["y"]: r["count"] for r in B.down_sample(known, "y", ["id"], 3).groupBy("y").count().collect()}
    assert len(set(down.values())) == 1
    up = B.up_sample(uneven.where("y IS NOT NULL"), "y", ["id"], 3)
    assert len({r["count"] for r in up.groupBy("y").count().collect()}) == 1
    assert ids(up.where("copy = 0")) == ids(uneven.where("y IS NOT NULL"))


def test_repeat_in_chunks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 1)], "id string, copies int")
    for chunk in (1, 10, 100):
        out = B.repeated(df, "copies", chunk=chunk)
        assert sorted((r["id"], r["copy"]) for r in out.collect()) == [("a", i) for i in range(1, 26)] + [("b", 1)]


def test_bootstrap_weights(uneven):
    rows = B.bootstrap(uneven, ["id"], 20, 3).groupBy("replicate").agg(F.sum("weight").alias("w"), F.avg((F.col("weight") == 0).cast("double")).alias("out")).collect()
    assert len(rows) == 20
    assert all(480 < r["w"] < 720 and 0.28 < r["out"] < 0.46 for r in rows)


def test_rose_halves(uneven):
    two = uneven.where("y IN ('hot', 'rare')")
    out = B.rose(two, "y", ["id"], ["x"], 5)
    n = two.count()
    assert sorted(r["count"] for r in out.groupBy("y").count().collect()) == sorted([n // 2, n - n // 2])


def test_weights(spark):
    df = spark.createDataFrame([("a",)] * 9 + [("b",)], "y string")
    assert {r["y"]: r["weight"] for r in M.class_weights(df, "y").collect()} == {"a": 1.0, "b": 3.0}


@pytest.fixture(scope="module")
def people(spark):
    n = F.col("id")
    return spark.range(240).select(
        n.cast("string").alias("id"),
        F.when(n % 9 != 0, (n * 7 % 50).cast("double")).alias("age"),
        (n * 13 % 29 + 1).cast("double").alias("secs"),
        F.when(n % 8 != 0, F.concat(F.lit("g"), (n % 3).cast("string"))).alias("gender"),
        F.lit("same").alias("constant"),
        F.lit(None).cast("date").alias("date_first_booking"),
        F.when(n % 3 < 2, "NDF").otherwise("US").alias("country_destination"),
    )


@pytest.mark.parametrize("name", NAMES)
def test_every_recipe(people, name):
    made = recipe(name, power_columns=["secs"])
    train, test = people.where("cast(id AS int) % 5 <> 0"), people.where("cast(id AS int) % 5 = 0")
    if name in ("minimal_smote", "extra_minimal_smote"):
        with pytest.raises(ValueError, match="complete"):
            made.fit(train)
        return
    done = made.fit(train)
    assert "constant" not in done.train.columns and "date_first_booking" not in done.train.columns
    out = done.model.transform(test)
    assert out.count() == 48
    if "dummies" not in name and name not in ("extra_minimal", "box_cox"):
        assert "gender" not in out.columns
    if name.endswith(("smote", "rose")):
        sizes = [r["count"] for r in done.train.groupBy("country_destination").count().collect()]
        assert max(sizes) - min(sizes) <= 1


def test_test_rows_do_not_change_the_fit(people):
    done = recipe("std_median").fit(people.where("cast(id AS int) % 5 <> 0"))
    some = people.where("id = '5'")
    alone = done.model.transform(some).collect()
    among = [r for r in done.model.transform(people).collect() if r["id"] == "5"]
    assert alone == among


def test_fit_and_score(people):
    done = fit_and_score(people, recipe("semi_minimal"), lambda df, label: L.forest(df, label, trees=3, depth=3))
    row = done.metrics.first()
    assert 0 <= row["test_acc"] <= 1 and row["test_ndcg"] > 0
    assert done.confusion.agg(F.sum("n")).first()[0] == done.predictions.where("dataset = 'test'").count()


def test_adaptive_boosting_beats_one_tree(people):
    frame = M.assembled(recipe("semi_minimal").fit(people).train, ["id"], "country_destination")
    score = lambda rounds: L.boosted_trees_m1(frame, "country_destination", rounds=rounds, depth=2).predictions(frame, "country_destination").agg(F.avg((F.col("predicted") == F.col("country_destination")).cast("double"))).first()[0]
    assert score(7) >= score(1)
