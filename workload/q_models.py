"""Fitted models, scoring, submission and tuning runs on the user table."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.cluster import checkpointed, scratch_path
from waymark.features import prepare as M
from waymark.features import resample as B
from waymark.models import classify as L
from waymark.models import tuning as G
from waymark.operators.metrics import first_class_hit, hit, ndcg, roc_auc
from waymark.plans.recipes import fit_and_score, recipe
from waymark.plans.sessions import session_totals
from waymark.sources.snapshots import load_pipeline, save_pipeline
from workload.adapters import PREDICTIONS, USERS, predictions, sessions, tuning_results, users
from workload.registry import query, sql

SEED = 945
REGION_LABEL = "region_destination"


def model_table(spark, folder):
    """Users with session totals, and two labels: booked or not, and a coarse destination."""
    u = users(spark, folder).drop("timestamp_first_active", "dataset")
    joined = u.join(session_totals(sessions(spark, folder).where("user_id <> ''")), u["id"] == F.col("user_id"), "left").drop("user_id")
    nation = F.regexp_extract("country_destination", "([0-9]+)", 1).cast("int")
    coarse = F.when(F.col("country_destination") == "NDF", "NDF").otherwise(F.concat(F.lit("R"), (nation % 3).cast("string")))
    return M.CyclicDates("date_account_created").transform(joined).select(
        "id", "age", "balance", "avg_secs", "sum_secs", "cnt_actions", "gender", "signup_method", "language", "first_affiliate_tracked",
        "date_account_created_month_sin", "date_account_created_month_cos",
        F.when(F.col("country_destination") == "NDF", "NO").otherwise("YES").alias("booked"),
        coarse.alias(REGION_LABEL),
    )


def prepared(spark, folder, label=REGION_LABEL, name="semi_minimal"):
    data = model_table(spark, folder).drop("booked" if label != "booked" else REGION_LABEL)
    done = recipe(name, label=label, drop=()).fit(data)
    # Written once: fits and scores read it many times.
    return checkpointed(M.assembled(done.train, ["id"], label))


def held_out(spark, folder, label=REGION_LABEL, name="semi_minimal"):
    """Prepared rows as four fifths to fit on and one fifth to score."""
    marked = checkpointed(B.stratified_flag(prepared(spark, folder, label, name), [label], ["id"], 0.8, SEED, "kept"))
    return marked.where("kept").drop("kept"), marked.where("NOT kept").drop("kept")


def scores(fitted, frame, label):
    p, t = F.col("prob"), F.col("truth")
    return fitted.predictions(frame, label).agg(F.count(F.lit(1)).alias("n"), F.avg(hit(p, t)).alias("accuracy"), ndcg(p, t).alias("ndcg"))


@query("L1_boosted_binary")
def l1(spark, folder):
    train, test = held_out(spark, folder, "booked")
    return scores(L.boosted_binary(train, "booked", rounds=20, depth=4, seed=SEED), test, "booked")


@query("L2_boosted_classes")
def l2(spark, folder):
    train, test = held_out(spark, folder)
    return scores(L.boosted(train, REGION_LABEL, rounds=10, depth=4, seed=SEED), test, REGION_LABEL)


@query("L3_forest")
def l3(spark, folder):
    train, test = held_out(spark, folder)
    return scores(L.forest(train, REGION_LABEL, trees=100, depth=8, seed=SEED), test, REGION_LABEL)


@query("L4_forest_regression")
def l4(spark, folder):
    frame = M.assembled(G.collect_metrics(tuning_results(spark, folder), ["config", "trees"]).select("config", "mean", "trees", "n"), ["config"], "mean")
    model = L.forest_regression(frame, "mean", trees=100)
    return M.importance_table(model, frame)


@query("L5_adaptive_boosting")
def l5(spark, folder):
    train, test = held_out(spark, folder, "booked")
    return scores(L.boosted_trees_m1(train, "booked", rounds=10, depth=4), test, "booked")


@query("L6_logistic")
def l6(spark, folder):
    train, test = held_out(spark, folder, name="std_mean")
    return scores(L.logistic(train, REGION_LABEL, penalty=0.01, mixture=0.5, steps=100), test, REGION_LABEL)


@query("L7_naive_bayes")
def l7(spark, folder):
    train, test = held_out(spark, folder)
    return scores(L.naive_bayes(train, REGION_LABEL), test, REGION_LABEL)


@query("L8_polynomial_svm")
def l8(spark, folder):
    train, test = held_out(spark, folder, "booked", "pca_mean")
    return scores(L.polynomial_svm(train, "booked", steps=50), test, "booked")


@query("L9_boosted_entropy_trees")
def l9(spark, folder):
    train, test = held_out(spark, folder, "booked")
    return scores(L.boosted_trees_m1(train, "booked", rounds=10, depth=4, impurity="entropy"), test, "booked")


@query("L10_batch_scores")
def l10(spark, folder):
    """Probabilities of all users, by a model of four fifths of them."""
    train, test = held_out(spark, folder)
    fitted = L.forest(train, REGION_LABEL, trees=100, depth=8, seed=SEED)
    return L.wide_probabilities(fitted.scored(train.unionByName(test)), fitted.labels)


@query("L11_top_classes", sql("SELECT id, r AS place, 'c' || CAST(class AS VARCHAR) AS country FROM ranked WHERE r <= 5", PREDICTIONS))
def l11(spark, folder):
    return L.top_classes(predictions(spark, folder), [f"c{i}" for i in range(10)], 5)


@query("L12_fit_and_score")
def l12(spark, folder):
    data = model_table(spark, folder).drop("booked")
    done = fit_and_score(data, recipe("semi_minimal", label=REGION_LABEL, drop=()), lambda df, label: L.forest(df, label, trees=100, depth=8, seed=SEED))
    return done.metrics


@query("E18_error_by_round_binary")
def e18(spark, folder):
    train, test = held_out(spark, folder, "booked")
    fitted = L.boosted_binary(train, "booked", rounds=20, depth=4, seed=SEED)
    return L.error_by_round(fitted.model, test, "booked", fitted.labels, 20)


@query("M19_prepare_and_assemble", sql(
    """SELECT id, CASE WHEN country_destination = 'NDF' THEN 'NDF' ELSE 'R' || CAST(CAST(regexp_extract(country_destination, '([0-9]+)', 1) AS INTEGER) % 3 AS VARCHAR) END AS region_destination,
  CAST(7 + (SELECT sum(levels - 1) FROM widths) AS BIGINT) AS width FROM users""",
    USERS,
    "marks AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, coalesce({c}, 'unknown') AS level FROM users" for c in ("gender", "signup_method", "language", "first_affiliate_tracked")) + ")",
    "shares AS (SELECT name, level, count(*) >= 0.05 * sum(count(*)) OVER (PARTITION BY name) AS common FROM marks GROUP BY name, level)",
    "widths AS (SELECT name, count(*) FILTER (common) + CASE WHEN bool_and(common) THEN 0 ELSE 1 END AS levels FROM shares GROUP BY name)",
))
def m19(spark, folder):
    from pyspark.ml.functions import vector_to_array

    frame = prepared(spark, folder, name="std_median")
    return frame.select("id", REGION_LABEL, F.size(vector_to_array("features")).alias("width"))


@query("M20_importance")
def m20(spark, folder):
    frame = prepared(spark, folder)
    fitted = L.forest(frame, REGION_LABEL, trees=100, depth=8, seed=SEED)
    return M.grouped_importance(M.importance_table(fitted.model, frame))


@query("M21_fit_then_apply", sql(
    """SELECT part, count(*) AS n, round(avg((coalesce(age, middle) - age_mean) / age_sd), 6) + 0.0 AS age, round(avg((balance - balance_mean) / balance_sd), 6) + 0.0 AS balance
FROM parts, fitted GROUP BY part""",
    USERS,
    """coarse AS (SELECT id, CAST(age AS DOUBLE) AS age, CAST(balance AS DOUBLE) AS balance,
  CASE WHEN country_destination = 'NDF' THEN 'NDF' ELSE 'R' || CAST(CAST(regexp_extract(country_destination, '([0-9]+)', 1) AS INTEGER) % 3 AS VARCHAR) END AS y FROM users)""",
    f"""parts AS (SELECT *, CASE WHEN r <= ceil(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(id || ':{SEED}')) AS r, count(*) OVER (PARTITION BY y) AS n FROM coarse) AS t)""",
    "medians AS (SELECT quantile_cont(age, 0.5) AS middle FROM parts WHERE part = 'train')",
    """fitted AS (SELECT middle, avg(coalesce(age, middle)) AS age_mean, stddev_samp(coalesce(age, middle)) AS age_sd, avg(balance) AS balance_mean, stddev_samp(balance) AS balance_sd
  FROM parts, medians WHERE part = 'train' GROUP BY middle)""",
))
def m21(spark, folder):
    data = model_table(spark, folder).drop("booked")
    train, test = B.stratified_split(data, [REGION_LABEL], ["id"], 0.8, SEED)
    done = recipe("std_median", label=REGION_LABEL, drop=()).fit(train)
    both = done.train.withColumn("part", F.lit("train")).unionByName(done.model.transform(test).withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("age").alias("age"), F.avg("balance").alias("balance"))


FOLDS = 5  # of the grid queries


def grid_results(spark, folder, grid):
    frame = prepared(spark, folder, "booked")
    folded = B.stratified_folds(frame, ["booked"], ["id"], FOLDS, SEED)

    def fit(settings, train):
        return L.forest(train, "booked", seed=SEED, **settings)

    def score(fitted, test):
        # Scored once; the shares and the curve read the scores.
        found = checkpointed(fitted.predictions(test, "booked").select("prob", "truth"))
        shares = found.agg(F.avg(hit(F.col("prob"), F.col("truth"))), F.avg(first_class_hit(F.col("prob"), F.col("truth")))).first()
        area = roc_auc(found.select(F.col("prob")[1].alias("score"), "truth"), "score", F.col("truth") == 1).first()[0]
        return {"accuracy": shares[0], "binary_accuracy": shares[1], "roc_auc": area}

    return G.evaluate_grid(folded, FOLDS, grid, fit, score, parallelism=4)


@query("G1_full_grid")
def g1(spark, folder):
    return grid_results(spark, folder, G.full_grid({"trees": [10, 20], "depth": [3, 5, 7]}))


@query("G2_random_grid")
def g2(spark, folder):
    return grid_results(spark, folder, G.random_grid({"trees": (5, 30), "depth": (2, 8)}, 5, SEED))


@query("G3_space_filling_grid")
def g3(spark, folder):
    return grid_results(spark, folder, G.space_filling_grid({"trees": (5, 30), "depth": (2, 8)}, 5, SEED))


@query("G4_grid_by_folds")
def g4(spark, folder):
    return G.collect_metrics(grid_results(spark, folder, G.regular_grid({"trees": (5, 25), "depth": (3, 7)}, 3)), ["config", "settings"])


@query("G9_cross_product")
def g9(spark, folder):
    data = model_table(spark, folder).drop("booked")

    def run(spec):
        done = fit_and_score(data, recipe(spec["recipe"], label=REGION_LABEL, drop=()), lambda df, label: L.forest(df, label, trees=30, depth=6, seed=SEED))
        return done.metrics.first().asDict()

    specs = G.cross_specs(["semi_minimal", "minimal_smote"], {"forest": [{"trees": 30}]})
    return G.evaluate_specs(spark, {f"{s['recipe']}:{s['clf']}": (lambda s=s: run(s)) for s in specs})


@query("G10_refit_best")
def g10(spark, folder):
    data = model_table(spark, folder).drop("booked")
    grid = G.full_grid({"trees": [10, 20], "depth": [3, 6]})
    best = G.best_settings(grid_results(spark, folder, grid), grid, "roc_auc")
    done = fit_and_score(data, recipe("semi_minimal", label=REGION_LABEL, drop=()), lambda df, label: L.forest(df, label, seed=SEED, **best))
    return done.confusion


@query("G11_setting_importance")
def g11(spark, folder):
    metrics = G.collect_metrics(tuning_results(spark, folder), ["config", "trees"]).where("metric = 'roc_auc'")
    frame = M.assembled(metrics.select("config", F.col("mean"), "trees", F.coalesce("std_err", F.lit(0.0)).alias("std_err")), ["config"], "mean")
    return M.importance_table(L.forest_regression(frame, "mean", trees=100), frame)


@query("S12_saved_pipeline")
def s12(spark, folder):
    """A saved and reloaded preparation and forest score every row as before."""
    data = model_table(spark, folder).drop("booked")
    done = recipe("semi_minimal", label=REGION_LABEL, drop=()).fit(data)
    frame = M.assembled(done.train, ["id"], REGION_LABEL)
    fitted = L.forest(frame, REGION_LABEL, trees=20, depth=6, seed=SEED)
    steps, stages = scratch_path(spark, "preparation"), scratch_path(spark, "forest")
    save_pipeline(done.model, steps)
    save_pipeline(fitted.stages, stages)
    again = L.FittedClassifier(fitted.labels, load_pipeline(stages))
    return again.scored(M.assembled(load_pipeline(steps).transform(data), ["id"], REGION_LABEL))
