"""Known values of the expressions and edge cases of ties, nulls and bins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from waymark.features.levels import CommonLevels, ShareLevels, TopLevels
from waymark.functions import labels as L
from waymark.functions import scalars as S
from waymark.operators import metrics as E
from waymark.operators import profile as A
from waymark.operators import rows as N
from waymark.operators import windows as W
from waymark.operators.association import z_scores


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


MATRIX = [[0.3, 0.3, 0.4], [0.1, 0.1, 0.8], [0.3, 0.6, 0.1], [0.4, 0.3, 0.3], [0.8, 0.2, 0.0]]


@pytest.mark.parametrize(
    "truth,expected", [([3, 3, 2, 1, 1], 1.0), ([1, 2, 1, 2, 2], 0.604744), ([2, 3, 3, 3, 3], 0.6)]
)
def test_ndcg_at_3(spark, truth, expected):
    df = spark.createDataFrame([(p, t - 1) for p, t in zip(MATRIX, truth)], "prob array<double>, truth int")
    assert round(df.agg(E.ndcg(F.col("prob"), F.col("truth"), 3)).first()[0], 6) == expected


def test_gain_of_one_list(spark):
    df = spark.createDataFrame([([0.6, 0.3, 0.1], 0), ([0.6, 0.3, 0.1], 1)], "prob array<double>, truth int")
    assert [round(v, 7) for v in values(df.select(E.ranked_gain(F.col("prob"), F.col("truth")).alias("g")), "g")] == [1.0, 0.6309298]


def test_cyclic_month(spark):
    sine, cosine = S.cyclic_month(F.col("d"))
    row = spark.createDataFrame([(dt.date(2014, 6, 30),)], "d date").select(sine.alias("s"), cosine.alias("c")).first()
    assert (round(row["s"], 3), round(row["c"], 3)) == (-0.208, 0.978)


@pytest.mark.parametrize("limits", [{}, {"range_rows": 2}])
def test_quantiles(spark, limits):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert values(A.quantiles(df, ["x"], [0.5, 0.75, 0.9], **limits), "p50", "p75", "p90") == [(2.5, 3.25, pytest.approx(3.7))]


@pytest.mark.parametrize("data,expected", [([1, 2, 3, 4], (1, 1.5, 2.5, 3.5, 4)), ([5, 1, 2, 3, 4], (1, 2, 3, 4, 5)), ([7], (7, 7, 7, 7, 7))])
def test_five_numbers(spark, data, expected):
    out = A.five_numbers(spark.createDataFrame([(float(v),) for v in data], "x double"), ["x"])
    assert values(out, "minimum", "lower_hinge", "median", "upper_hinge", "maximum") == [expected]


def test_birth_year_and_range(spark):
    df = spark.createDataFrame([(1980.0,), (2014.0,), (104.0,), (105.0,), (15.0,), (14.0,), (None,)], "age double")
    assert values(df.select(S.plausible(S.repair_birth_year(F.col("age"))).alias("a")), "a") == [34, None, 104, None, 15, None, None]


def test_age_bins(spark):
    df = spark.createDataFrame([(15.0,), (19.9,), (20.0,), (104.0,), (105.0,), (None,)], "age double")
    assert values(df.select(S.half_open_bin(F.col("age")).alias("b")), "b") == ["[15,20)", "[15,20)", "[20,25)", "[100,105)", "unknown", "unknown"]


def test_sentinel_gap(spark):
    df = spark.createDataFrame([(None, dt.date(2014, 6, 30))], "b date, c date")
    assert values(df.select(S.day_gap(S.booking_or_sentinel(F.col("b")), F.col("c")).alias("g")), "g") == [550]


def test_made_booking(spark):
    df = spark.createDataFrame([("NDF",), ("US",), (None,)], "d string")
    assert values(df.select(L.yes_no(F.col("d") != "NDF").alias("y")), "y") == ["NO", "YES", None]


@pytest.mark.parametrize("top", [W.top_n_ties, W.top_n_ties_hot])
def test_top_n_ties(spark, top):
    df = spark.createDataFrame([("u", "a", 2), ("u", "b", 2), ("u", "c", 1), ("v", "d", None)], "u string, k string, n int")
    assert sorted(values(top(df, ["u"], "n", 1), "k")) == ["a", "b"]


@pytest.mark.parametrize("shares,expected", [([0.5, 0.3, 0.1, 0.06, 0.04], [0, 1]), ([0.9, 0.1], [])])
def test_nucleus(spark, shares, expected):
    df = spark.createDataFrame([("u", i, p) for i, p in enumerate(shares)], "u string, c int, p double")
    assert sorted(values(W.nucleus(df, ["u"], "p", "c"), "c")) == expected


def test_region_map(spark):
    df = spark.createDataFrame([("FR",), ("CA",), ("GB",), ("NDF",), ("zz",)], "d string")
    assert sorted(values(N.lookup_replace(df, "d", L.DESTINATION_REGIONS), "d")) == sorted(["EUR", "AUCA", "GB", "NDF", "zz"])
    assert values(df.select(L.remap(F.col("d"), L.DESTINATION_REGIONS).alias("r")), "r") == ["EUR", "AUCA", "GB", "NDF", "zz"]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (None,)], "p double")
    assert values(df.select(E.classify_at(F.col("p"), 0.5).alias("c")), "c") == ["NO", "YES", None]


def test_top_levels_keep_ties_and_null(spark):
    rows = [(v,) for v in ["a"] * 5 + ["b"] * 4 + [None] * 4 + ["c"] * 3 + ["d"] * 2 + ["e"] * 2 + ["f"]]
    df = spark.createDataFrame(rows, "c string")
    kept = set(values(TopLevels(["c"], n=5).fit(df).transform(df), "c"))
    assert kept == {"a", "b", None, "c", "d", "e", "other"}


def test_share_levels_need_two_rare_ones(spark):
    df = spark.createDataFrame([("a",)] * 30 + [("b",)] * 1, "c string")
    assert set(values(ShareLevels(["c"]).fit(df).transform(df), "c")) == {"a", "b"}
    assert set(values(CommonLevels(["c"]).fit(df).transform(df), "c")) == {"a", "Others"}


def test_common_levels_lump_unseen(spark):
    train = spark.createDataFrame([("a",)] * 10, "c string")
    test = spark.createDataFrame([("a",), ("new",), (None,)], "c string")
    assert values(CommonLevels(["c"]).fit(train).transform(test), "c") == ["a", "Others", None]


def test_nulls_in_filters_and_sort(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    assert values(df.where(S.without(F.col("x"), ["a"])), "x") == [None, "b"]
    assert values(N.sort_nulls_last(df, ("x", True)), "x") == ["b", "a", None]
    assert values(N.sort_nulls_last(df, ("x", False)), "x") == ["a", "b", None]
    assert values(df.agg(A.distinct_values("x").alias("n")), "n") == [3]


def test_empty_group_summary(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    assert sorted(values(A.value_summary(df, ["k"], "v"), "k", "mean", "sum", "n")) == [("a", None, 0.0, 1), ("b", 2.0, 2.0, 1)]


def test_z_scores_of_constant_are_null(spark):
    assert values(z_scores(spark.createDataFrame([(1.0,), (1.0,)], "x double"), ["x"]), "z_x") == [None, None]


@pytest.mark.parametrize("limits", [{}, {"range_rows": 3}])
def test_running_totals_agree(spark, limits):
    rows = [(f"k{i % 2}", float(i * 37 % 101), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x double, n int")
    out = {(r["k"], r["x"], r["n"]): r["upto"] for r in W.running_totals(df, ["k"], [-F.col("x"), F.col("n")], {"upto": F.col("n")}, **limits).collect()}
    assert len(out) == 300
    for k, x, n in rows:
        assert out[(k, x, n)] == sum(b for a, y, b in rows if a == k and (-y, b) <= (-x, n))


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "s double, y boolean")
    assert values(E.roc_auc(df, "s", F.col("y")), "roc_auc") == [0.875]


def test_wide_top_classes_keep_ties(spark):
    from waymark.models.classify import top_classes

    df = spark.createDataFrame([("u", [0.1, 0.4, 0.1, 0.4])], "id string, prob array<double>")
    assert values(top_classes(df, list("abcd"), 1), "place", "country") == [(1, "b"), (2, "d")]


def test_missing_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 3), ("k", "a", 2)], "g string, c string, n int")
    assert sorted((r["c"], r["pcnt"]) for r in W.share_within(df, ["g"], "n").collect()) == [("a", 0.25), ("a", 1.0), ("b", 0.75)]
    assert sorted(r["n"] for r in W.top_n_ties_hot(df, ["g"], "n", 1).collect()) == [2, 3]


def test_session_profile_equals_its_parts(spark):
    from waymark.plans.sessions import session_profile, session_totals, top_devices

    rows = [("u", "p", 1.0), ("u", "q", None), ("u", "q", 3.0), ("u", None, 2.0), ("v", "p", None), ("v", "q", None)]
    log = spark.createDataFrame(rows, "user_id string, device_type string, secs_elapsed double")
    columns = ["user_id", "avg_secs", "sum_secs", "cnt_actions", "top_device", "device_cnt"]
    for ties in ("keep", "first"):
        parts = session_totals(log).join(top_devices(log, ties), "user_id").select(*columns)
        assert sorted(map(str, session_profile(log, ties).select(*columns).collect())) == sorted(map(str, parts.collect()))


def test_pair_ndcg_with_graded_relevance(spark):
    import math

    pairs = [(1, 0), (2, 3), (3, 1), (4, 3), (5, 0)]
    df = spark.createDataFrame(pairs, "rank int, relevance int")
    dcg = sum((2**rel - 1) / math.log2(rank + 1) for rank, rel in pairs)
    ideal = sum((2**rel - 1) / math.log2(i + 2) for i, rel in enumerate(sorted((r for _, r in pairs), reverse=True)))
    assert abs(values(E.pair_ndcg(df, "rank", "relevance"), "ndcg")[0] - dcg / ideal) < 1e-12


def test_estimates_are_close_to_exact_values(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 10_007).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 5_000).alias("k"))
    exact = A.quantiles(df, ["x"], [0.1, 0.5, 0.99]).first()
    near = A.quantile_estimates(df, ["x"], [0.1, 0.5, 0.99]).first()
    assert near["column"] == "x" and all(abs(near[c] - exact[c]) <= 10_007 * 0.001 for c in ("p10", "p50", "p99"))
    distinct, estimate = df.agg(A.distinct_values("k"), A.distinct_values_estimate("k", 0.02)).first()
    assert distinct == 5_001 and abs(estimate - distinct) < 0.1 * distinct
    assert df.where("k IS NULL").agg(A.distinct_values_estimate("k")).first()[0] == 1
