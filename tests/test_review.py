"""Cases beside the provided tables: long texts, clashing names, odd cells, large grids."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from waymark.features.impute import nearest_on_line
from waymark.features.levels import TopLevels
from waymark.features.neighbours import NeighbourImpute
from waymark.features.prepare import Dummies
from waymark.functions.scalars import strip_prefix
from waymark.models.tuning import evaluate_grid, evaluate_specs
from waymark.operators.metrics import threshold_sweep
from waymark.operators.reshape import column_names, spread_counts, widen
from waymark.operators.rows import level_grid
from waymark.operators.windows import ordered_ranges, running_totals, top_n_ties, top_n_ties_hot
from waymark.sources.delimited import lenient_number, read_declared, write_delimited
from waymark.sources.snapshots import load_pipeline, save_pipeline

ODD_LEVELS = ["a-b", "a b", "-unknown-", "unknown", "NA", None, "é", "ü", "A_B"]


def test_prefix_of_a_long_text(spark):
    df = spark.range(1).select(F.concat(F.lit("pre:"), F.repeat(F.lit("x"), 1_500_000)).alias("t"))
    assert df.select(F.length(strip_prefix(F.col("t"), "pre:"))).first()[0] == 1_500_000


def test_very_many_tied_levels(spark):
    df = spark.range(30_000).select(F.concat(F.lit("v"), "id").alias("c"), F.col("id"))
    extra = df.where("id < 10").unionByName(df.where("id < 5"))
    assert TopLevels(["c"], n=5).fit(df).transform(df).where("c = 'other'").count() == 0
    fitted = TopLevels(["c"], n=5).fit(df.unionByName(extra))
    assert fitted.transform(df).where("c <> 'other'").count() == 5


def test_cells_with_quotes_commas_and_breaks(spark, tmp_path):
    rows = [("1", 'say "hi", ok', 2.5), ("2", "one\ntwo", None), ("3", 'back\\slash "', -1.0), ("4", None, 0.0)]
    df = spark.createDataFrame(rows, "id string, text string, number double").coalesce(1)
    write_delimited(df, str(tmp_path / "all"), quote_all=True)
    kinds = {"id": "id", "text": "text", "number": "double"}
    found = {r.id: (r.text, r.number) for r in read_declared(spark, str(tmp_path / "all"), kinds, tokens=(), line_breaks=True).collect()}
    assert found["1"] == ('say "hi", ok', 2.5) and found["2"] == ("one\ntwo", None) and found["3"] == ('back\\slash "', -1.0)
    write_delimited(df.where("id <> '2'"), str(tmp_path / "some"))
    found = {r.id: r.text for r in read_declared(spark, str(tmp_path / "some"), kinds).collect()}
    assert found["1"] == 'say "hi", ok' and found["3"] == 'back\\slash "'


def test_lenient_numbers(spark):
    cells = [".5", "-.25", "1.234,5", "$1,234.50 net", "none", "", None, "-7", "3."]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(lenient_number(F.col("c"))).collect()] == [0.5, -0.25, 1.2345, 1234.5, None, None, None, -7.0, 3.0]


def test_names_of_levels_are_different(spark):
    names = column_names("c", ODD_LEVELS)
    assert len({n.lower() for n in names}) == len(ODD_LEVELS)
    rows = [(1, v) for v in ODD_LEVELS] + [(1, "NA"), (2, None)]
    df = spark.createDataFrame(rows, "id int, c string")
    wide = spread_counts(df, "id", "c")
    assert len(wide.columns) == 1 + len(ODD_LEVELS)
    found = {r.id: r.asDict() for r in wide.collect()}
    assert sorted(v for k, v in found[1].items() if k != "id") == [1] * 8 + [2]
    assert found[1]["c_NA"] == 1 and found[2]["c_NA"] == 1  # the missing value; the level comes after it
    coded = Dummies(["c"], full="all").fit(df).transform(df)
    assert len(set(coded.columns)) == len(coded.columns) == 1 + 8
    assert coded.select(*coded.columns).count() == len(rows)
    assert len(widen(df, ["id"], "c", ["a-b", "a b"], ["id"], "x").columns) == 3


def test_grid_is_made_by_many_tasks(spark):
    df = spark.range(700).select("id", (F.col("id") * 2).alias("other"))
    grid = level_grid(df, ["id", "other"])
    assert grid.count() == 490_000 and grid.rdd.getNumPartitions() >= 5
    assert level_grid(df.limit(0), ["id", "other"]).count() == 0


@pytest.mark.parametrize("range_rows", [7, 1000])
def test_ranges_grow_with_the_table(spark, range_rows):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    ranged, ranges = ordered_ranges(df.withColumn("__order", F.struct(F.col("x").alias("o0"))), range_rows)
    assert ranges == -(-100 // range_rows) and ranged.groupBy("__range").count().agg(F.max("count")).first()[0] <= 3 * range_rows
    out = running_totals(df, ["k"], [F.col("x")], {"s": F.col("x")}, range_rows=range_rows).collect()
    for r in out:
        assert r.s == sum(x for x in range(r.x + 1) if x % 3 == r.k)


def test_hot_ties_agree_with_plain_ones(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") % 5).alias("w"), "id")
    rows = lambda out: sorted(r.id for r in out.collect())
    assert rows(top_n_ties_hot(df, ["g"], "w", 3)) == rows(top_n_ties(df, ["g"], "w", 3))


def test_scores_outside_of_the_thresholds(spark):
    scores = [(-0.5, False), (0.5, True), (0.49999999999, False), (1.5, True), (0.3, True), (None, True), (0.0, False)]
    df = spark.createDataFrame(scores, "score double, y boolean")
    for r in threshold_sweep(df, "score", F.col("y"), step=0.1).collect():
        known = [(s, y) for s, y in scores if s is not None]
        assert r.sensitivity == pytest.approx(sum(y and s >= r.threshold for s, y in known) / 3)
        assert r.specificity == pytest.approx(sum((not y) and s < r.threshold for s, y in known) / 3)


def test_equal_donors_are_one(spark):
    donors = spark.createDataFrame([(0.0, 7)] * 900 + [(5.0, 8)], "at double, value int")
    gaps = spark.createDataFrame([(i, float(i)) for i in range(6)], "id int, at double")
    found = {r.id: r.value for r in nearest_on_line(gaps, donors, ["id"], "at", "value", range_rows=3).collect()}
    assert found == {0: 7, 1: 7, 2: 7, 3: 8, 4: 8, 5: 8}


def test_whole_error_texts(spark):
    text = "x" * 900

    def broken(*_):
        raise ValueError(text)

    assert evaluate_specs(spark, {"bad": broken}).first()["error"] == f"ValueError: {text}"
    df = spark.range(4).withColumn("fold", (F.col("id") % 2).cast("int"))
    assert {r.error for r in evaluate_grid(df, 2, [{"k": 1}], broken, broken).collect()} == {f"ValueError: {text}"}


def test_neighbours_fill_new_gaps_and_are_saved(spark, tmp_path):
    rows = [(i, "a", float(i), 10.0 * i) for i in range(30)]
    train = spark.createDataFrame(rows, "id int, part string, x double, y double")
    fitted = NeighbourImpute(k=3, ids=("id", "part"), label="none").fit(train)
    gaps = spark.createDataFrame([(100, "a", 5.0, None), (100, "b", None, 200.0), (101, "a", 1.0, 10.0)], train.schema)
    save_pipeline(PipelineModel([fitted]), str(tmp_path / "model"))
    for model in (fitted, load_pipeline(str(tmp_path / "model"))):
        found = {(r.id, r.part): (r.x, r.y) for r in model.transform(gaps).collect()}
        assert found == {(100, "a"): (5.0, 50.0), (100, "b"): (20.0, 200.0), (101, "a"): (1.0, 10.0)}


def test_grid_beyond_the_lookup_bound(spark):
    df = spark.createDataFrame([(i % 7, f"v{i % 11}", None if i % 5 else i) for i in range(77)], "a int, b string, c int")
    small = {tuple(r) for r in level_grid(df, ["a", "b", "c"]).collect()}
    large = [tuple(r) for r in level_grid(df, ["a", "b", "c"], limit=3).collect()]
    assert set(large) == small and len(large) == 7 * 11 * 16


def test_pivot_keys_are_bounded(spark, monkeypatch):
    from waymark.operators import reshape

    df = spark.createDataFrame([("u", f"k{i % 5}") for i in range(12)] + [("u", None)], "id string, key string")
    assert {(r.key, r.n) for r in reshape.key_counts(df, "id", "key").collect()} == {("k0", 3), ("k1", 3), ("k2", 2), ("k3", 2), ("k4", 2), (None, 1)}
    monkeypatch.setattr(reshape, "bounded_rows", lambda rows: None)
    with pytest.raises(ValueError, match="long form"):
        reshape.spread_counts(df, "id", "key")


def test_small_ranges_need_few_tasks(spark):
    rows = spark.range(5000).select(F.struct(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("o")).alias("__order"))
    ranged, ranges = ordered_ranges(rows, 10, task_rows=2000)
    assert ranges == 500 and ranged.rdd.getNumPartitions() == 3
    found = ranged.groupBy("__range").agg(F.min("__order.o").alias("low"), F.max("__order.o").alias("high"), F.count("*").alias("n")).orderBy("__range").collect()
    assert sum(r.n for r in found) == 5000 and max(r.n for r in found) <= 10 and len(found) <= 503
    assert all(a.high < b.low for a, b in zip(found, found[1:]))
