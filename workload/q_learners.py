"""Joint boosting with errors per round, kernel naive Bayes and mixed-distance neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.cluster import checkpointed, scratch_path
from waymark.features import prepare as M
from waymark.features import resample as B
from waymark.models import boosting as X
from waymark.models import classify as L
from waymark.models import importance as I
from waymark.models import tuning as G
from waymark.models.penalty_path import logistic_path
from waymark.operators.metrics import hit, ndcg, roc_auc
from workload.adapters import USERS, users
from workload.q_models import REGION_LABEL, SEED, held_out, prepared
from workload.registry import query, sql

MANY_LABEL = "destination"


def many_classes(spark, folder):
    """Prepared users with twelve destinations: none, and the countries dealt to eleven."""
    frame = prepared(spark, folder)
    nation = F.regexp_extract("country_destination", "([0-9]+)", 1).cast("int")
    label = F.when(F.col("country_destination") == "NDF", "NDF").otherwise(F.format_string("D%02d", nation % 11))
    return frame.drop(REGION_LABEL).join(users(spark, folder).select("id", label.alias(MANY_LABEL)), "id")


# A fifth of the rows is held out; a run stops when ten rounds brought nothing.
STOPPING = X.Settings(rounds=100, depth=4, rate=0.3, patience=10)


@query("L1_boosted_early_stop")
def l1_stop(spark, folder):
    """The round a two-class run is cut at, and its errors there and at the last round."""
    marked = B.stratified_flag(prepared(spark, folder, "booked"), ["booked"], ["id"], 0.8, SEED, "kept")
    run = X.boost(marked, "booked", STOPPING, ["kept"])
    history = run.by_round(spark).withColumn("chosen", F.lit(run.best[0]))
    return history.where((F.col("round") == F.col("chosen")) | (F.col("round") == len(run.forests))).drop("variant")


@query("L2_joint_classes")
def l2_joint(spark, folder):
    """Twelve classes boosted together, stopped on a fifth of the rows, scored on another."""
    folded = checkpointed(B.stratified_folds(many_classes(spark, folder), [MANY_LABEL], ["id"], 5, SEED))
    weighted = folded.where("fold > 0").withColumn("kept", (F.col("fold") > 1).cast("int"))
    model = X.boost(weighted, MANY_LABEL, X.Settings(rounds=50, depth=4, rate=0.3, patience=5), ["kept"]).classifier()
    p, t = F.col("prob"), F.col("truth")
    loss = F.avg(-F.ln(F.greatest(F.get(p, t), F.lit(1e-9)))).alias("loss")
    found = model.predictions(folded.where("fold = 0"), MANY_LABEL)
    return found.agg(F.count(F.lit(1)).alias("n"), F.avg(hit(p, t)).alias("accuracy"), ndcg(p, t).alias("ndcg"), loss)


@query("E18_error_by_round")
def e18_rounds(spark, folder):
    """Mean and deviation over five folds of the errors of twelve classes after every round."""
    folded = B.stratified_folds(many_classes(spark, folder), [MANY_LABEL], ["id"], 5, SEED)
    weighted, names = X.fold_weights(folded, 5)
    return X.error_by_round(X.boost(weighted, MANY_LABEL, X.Settings(rounds=10, depth=4, rate=0.3), names), spark)


BAYES_GRID, BAYES_FLOOR = 512, 1e-9


@query("L7_kernel_bayes", sql(
    f"""SELECT id, {", ".join(f"round(max(CASE WHEN y = '{c}' THEN p END), 6) AS pred_{c}" for c in ("NDF", "R0", "R1", "R2"))}
FROM (SELECT id, y, exp(s - max(s) OVER w) / sum(exp(s - m)) OVER w AS p FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM sums) AS x WINDOW w AS (PARTITION BY id)) AS q
GROUP BY id""",
    USERS,
    """coarse AS (
  SELECT id, CASE WHEN country_destination = 'NDF' THEN 'NDF' ELSE 'R' || CAST(CAST(regexp_extract(country_destination, '([0-9]+)', 1) AS INTEGER) % 3 AS VARCHAR) END AS y,
    CAST(age AS DOUBLE) AS age, CAST(balance AS DOUBLE) AS balance, gender, first_affiliate_tracked FROM users)""",
    """cells AS (SELECT id, y, 'age' AS name, age AS value FROM coarse WHERE age IS NOT NULL UNION ALL SELECT id, y, 'balance', balance FROM coarse)""",
    """bands AS (
  SELECT name, y, count(*) AS n, min(value) AS low, max(value) AS high,
    0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * pow(count(*), -0.2) AS band
  FROM cells GROUP BY name, y)""",
    f"""lines AS (
  SELECT name, min(low) - 3 * max(band) AS low, ((max(high) + 3 * max(band)) - (min(low) - 3 * max(band))) / {BAYES_GRID - 1} AS step FROM bands GROUP BY name)""",
    """held AS (SELECT name, y, CAST(floor((value - low) / step + 0.5) AS INTEGER) AS b, count(*) AS n FROM cells JOIN lines USING (name) GROUP BY ALL)""",
    f"""points AS (
  SELECT h.name, h.y, g, ln(greatest(sum(h.n * exp(-0.5 * pow((g - b) * step / band, 2))) / (any_value(s.n) * any_value(band) * sqrt(2 * pi())), {BAYES_FLOOR})) AS l
  FROM held AS h JOIN bands AS s ON h.name = s.name AND h.y = s.y JOIN lines ON lines.name = h.name, (SELECT unnest(range(0, {BAYES_GRID})) AS g) AS grid
  GROUP BY h.name, h.y, g)""",
    f"""placed AS (
  SELECT id, name, least(greatest((value - low) / step, 0), {BAYES_GRID - 1}) AS place FROM cells JOIN lines USING (name))""",
    f"""numbers AS (
  SELECT id, a.y, a.l + (b.l - a.l) * (place - a.g) AS s
  FROM placed AS p JOIN points AS a ON p.name = a.name AND a.g = least(CAST(floor(place) AS INTEGER), {BAYES_GRID - 2})
  JOIN points AS b ON b.name = a.name AND b.y = a.y AND b.g = a.g + 1)""",
    """marks AS (
  SELECT id, y, 'gender' AS name, gender AS level FROM coarse WHERE gender IS NOT NULL
  UNION ALL SELECT id, y, 'first_affiliate_tracked', first_affiliate_tracked FROM coarse WHERE first_affiliate_tracked IS NOT NULL)""",
    """classes AS (SELECT y, count(*) AS n FROM coarse GROUP BY y)""",
    """tables AS (
  SELECT l.name, l.level, c.y, ln((count(m.id) + 1.0) / (any_value(t.n) + any_value(v.n))) AS s
  FROM (SELECT DISTINCT name, level FROM marks) AS l CROSS JOIN classes AS c
  LEFT JOIN marks AS m ON m.name = l.name AND m.level = l.level AND m.y = c.y
  JOIN (SELECT name, y, count(*) AS n FROM marks GROUP BY ALL) AS t ON t.name = l.name AND t.y = c.y
  JOIN (SELECT name, count(DISTINCT level) AS n FROM marks GROUP BY name) AS v ON v.name = l.name
  GROUP BY l.name, l.level, c.y)""",
    """sums AS (
  SELECT id, y, sum(s) AS s FROM (
    SELECT id, c.y, ln(c.n / (SELECT CAST(sum(n) AS DOUBLE) FROM classes)) AS s FROM coarse, classes AS c
    UNION ALL SELECT id, y, s FROM numbers
    UNION ALL SELECT m.id, t.y, t.s FROM marks AS m JOIN tables AS t ON m.name = t.name AND m.level = t.level) AS parts
  GROUP BY id, y)""",
))
def l7_kernel(spark, folder):
    """Class probabilities of every user; both numbers and categories have gaps."""
    from waymark.models.kernel_bayes import kernel_bayes

    nation = F.regexp_extract("country_destination", "([0-9]+)", 1).cast("int")
    coarse = F.when(F.col("country_destination") == "NDF", "NDF").otherwise(F.concat(F.lit("R"), (nation % 3).cast("string")))
    u = users(spark, folder).select("id", "age", "balance", "gender", "first_affiliate_tracked", coarse.alias("y"))
    model = kernel_bayes(u, "y", ["age", "balance"], ["gender", "first_affiliate_tracked"], laplace=1.0, grid=BAYES_GRID, floor=BAYES_FLOOR)
    return L.wide_probabilities(model.scored(u), model.labels)


def _scaled(column: str) -> str:
    return f"floor((CAST({column} AS DOUBLE) - low_{column}) / (high_{column} - low_{column}) * 1073741824.0 + 0.5)"


def _gower(target: str, numbers: tuple[str, ...], marks: tuple[str, ...]) -> str:
    """The five nearest donors of every row with a gap in ``target``, by all pairs."""
    both = {c: f"a.{c} IS NOT NULL AND b.{c} IS NOT NULL" for c in (*numbers, *marks)}
    gap = {**{c: f"abs(a.{c} - b.{c})" for c in numbers}, **{c: f"CASE WHEN a.{c} <> b.{c} THEN 1073741824.0 ELSE 0.0 END" for c in marks}}
    total = " + ".join(f"CASE WHEN {both[c]} THEN {gap[c]} ELSE 0.0 END" for c in both)
    shared = " + ".join(f"CASE WHEN {both[c]} THEN 1 ELSE 0 END" for c in both)
    cells = ", ".join([f"CASE WHEN {c} IS NOT NULL THEN {_scaled(c)} END AS {c}" for c in numbers] + list(marks))
    return f"""near_{target} AS (
  SELECT id, b.value FROM (
    SELECT a.id, b.value, row_number() OVER (PARTITION BY a.id ORDER BY ({total}) / 1073741824.0 / ({shared}), b.id) AS place
    FROM (SELECT id, {cells} FROM gaps, ends WHERE {target} IS NULL) AS a
    JOIN (SELECT id, {target} AS value, {cells} FROM gaps, ends WHERE {target} IS NOT NULL) AS b ON {shared} > 0) AS b
  WHERE place <= 5)"""


@query("M3_gower_impute", sql(
    """SELECT g.id, round(coalesce(CAST(g.age AS DOUBLE), a.age), 6) AS age, round(CAST(g.balance AS DOUBLE), 6) AS balance, g.gender,
  coalesce(g.first_affiliate_tracked, t.level) AS first_affiliate_tracked
FROM gaps AS g LEFT JOIN (SELECT id, avg(CAST(value AS DOUBLE)) AS age FROM near_age GROUP BY id) AS a ON a.id = g.id
LEFT JOIN (SELECT id, value AS level FROM (
  SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, value) AS r FROM near_first_affiliate_tracked GROUP BY id, value) AS c WHERE r = 1) AS t ON t.id = g.id""",
    USERS,
    "gaps AS (SELECT id, age, CASE WHEN CAST(id AS BIGINT) % 6 <> 0 THEN balance END AS balance, gender, first_affiliate_tracked FROM users)",
    """ends AS (SELECT CAST(min(age) AS DOUBLE) AS low_age, CAST(max(age) AS DOUBLE) AS high_age,
  CAST(min(balance) AS DOUBLE) AS low_balance, CAST(max(balance) AS DOUBLE) AS high_balance FROM gaps)""",
    _gower("age", ("balance",), ("gender", "first_affiliate_tracked")),
    _gower("first_affiliate_tracked", ("age", "balance"), ("gender",)),
))
def m3_gower(spark, folder):
    """Ages and affiliates by five neighbours; the columns they are told apart by have gaps."""
    from waymark.features.gower import GowerImpute

    balance = F.when(F.col("id").cast("bigint") % 6 != 0, F.col("balance"))
    u = users(spark, folder).select("id", "age", balance.alias("balance"), "gender", "first_affiliate_tracked")
    return GowerImpute(["age", "first_affiliate_tracked"], k=5, ids=("id",), label="none").fit(u).transform(u)


PENALTIES = tuple(0.2 * 0.5**i for i in range(10))


@query("L6_penalty_path")
def l6_path(spark, folder):
    """Coefficients of four classes at ten penalties, with the accuracy on held-out rows."""
    train, test = held_out(spark, folder, REGION_LABEL, "std_mean")
    path = logistic_path(train, REGION_LABEL, PENALTIES, mixture=0.5)
    names = M._attribute_names(train.schema["features"])
    found = None
    for i, penalty in enumerate(path.penalties):
        share = path.classifier(i).predictions(test, REGION_LABEL).agg(F.avg(hit(F.col("prob"), F.col("truth"))).alias("accuracy"))
        one = share.withColumn("penalty", F.lit(penalty))
        found = one if found is None else found.unionByName(one)
    used = path.table(spark, names).groupBy("penalty").agg(F.count_if((F.col("coefficient") != 0) & (F.col("feature") != "(intercept)")).alias("used"))
    return found.join(F.broadcast(used), "penalty")  # one row per penalty


@query("L8_sketched_svm")
def l8_sketch(spark, folder):
    """A cubic support vector machine on 256 sketched features, on held-out rows."""
    train, test = held_out(spark, folder, "booked", "std_mean")
    fitted = L.sketched_svm(train, "booked", degree=3, width=256, scale=0.1, steps=50, seed=SEED)
    p, t = F.col("prob"), F.col("truth")
    return fitted.predictions(test, "booked").agg(F.count(F.lit(1)).alias("n"), F.avg(hit(p, t)).alias("accuracy"), ndcg(p, t).alias("ndcg"))


@query("M16_sketched_components")
def m16_sketch(spark, folder):
    u = users(spark, folder).select("id", F.coalesce("age", F.lit(40.0)).alias("age"), "balance", F.col("signup_flow").cast("double").alias("flow"), "country_destination")
    scaled = M.Normalize(["age", "balance", "flow"]).fit(u).transform(u)
    return M.SketchedComponents(["age", "balance", "flow"], k=3, degree=3, width=256, scale=0.5).fit(scaled).transform(scaled)


_AREAS = ("age", "balance", "flow")


@query("M20_roc_importance", sql(
    """SELECT feature, y AS class, round(max(area), 6) AS area FROM (
  SELECT feature, y, greatest(area, 1 - area) AS area FROM pairs UNION ALL SELECT feature, other, greatest(area, 1 - area) FROM pairs) AS both_ways GROUP BY feature, y""",
    USERS,
    """coarse AS (SELECT CASE WHEN country_destination = 'NDF' THEN 'NDF' ELSE 'R' || CAST(CAST(regexp_extract(country_destination, '([0-9]+)', 1) AS INTEGER) % 3 AS VARCHAR) END AS y,
  CAST(age AS DOUBLE) AS age, CAST(balance AS DOUBLE) AS balance, CAST(signup_flow AS DOUBLE) AS flow FROM users)""",
    "cells AS (" + " UNION ALL ".join(f"SELECT y, '{c}' AS feature, {c} AS value FROM coarse WHERE {c} IS NOT NULL" for c in _AREAS) + ")",
    "counted AS (SELECT feature, y, value, count(*) AS n FROM cells GROUP BY ALL)",
    """pairs AS (
  SELECT a.feature, a.y, b.y AS other, sum(a.n * b.n * CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END) / (any_value(s.n) * any_value(t.n)) AS area
  FROM counted AS a JOIN counted AS b ON a.feature = b.feature AND a.y < b.y
  JOIN (SELECT feature, y, sum(n) AS n FROM counted GROUP BY ALL) AS s ON s.feature = a.feature AND s.y = a.y
  JOIN (SELECT feature, y, sum(n) AS n FROM counted GROUP BY ALL) AS t ON t.feature = b.feature AND t.y = b.y
  GROUP BY a.feature, a.y, b.y)""",
))
def m20_roc(spark, folder):
    """How well each number alone tells a class from another one."""
    nation = F.regexp_extract("country_destination", "([0-9]+)", 1).cast("int")
    coarse = F.when(F.col("country_destination") == "NDF", "NDF").otherwise(F.concat(F.lit("R"), (nation % 3).cast("string")))
    u = users(spark, folder).select(coarse.alias("y"), "age", "balance", F.col("signup_flow").cast("double").alias("flow"))
    return I.class_areas(u, "y", list(_AREAS))


@query("M20_model_importance")
def m20_models(spark, folder):
    """Importance in a regression, a boosted run and an adaptive ensemble, by name prefix."""
    frame = prepared(spark, folder, "booked", "std_mean")
    fits = {
        "logistic": L.logistic(frame, "booked", penalty=0.01),
        "boosted": X.boost(frame, "booked", X.Settings(rounds=20, depth=4)).classifier(),
        "adaptive": L.boosted_trees_m1(frame, "booked", rounds=10, depth=4),
    }
    tables = [M.grouped_importance(I.model_importance(fitted, frame)).withColumn("model", F.lit(name)) for name, fitted in fits.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def _forest_by_weight(settings, train, weight):
    return L.forest(train, "booked", seed=SEED, weight=weight, **settings)


def _two_class_scores(fitted, test):
    found = checkpointed(fitted.predictions(test, "booked").select("prob", "truth"))  # scored once, read twice
    share = found.agg(F.avg(hit(F.col("prob"), F.col("truth")))).first()[0]
    area = roc_auc(found.select(F.col("prob")[1].alias("score"), "truth"), "score", F.col("truth") == 1).first()[0]
    return {"accuracy": share, "roc_auc": area}


@query("G4_bootstrap_replicates")
def g4_replicates(spark, folder):
    """A forest on 25 replicates, each a weight per row, scored on the rows not drawn."""
    frame = prepared(spark, folder, "booked")
    found = G.evaluate_replicates(frame, ["id"], [{"trees": 20, "depth": 5}], _forest_by_weight, _two_class_scores, times=25, seed=SEED, parallelism=4)
    return G.collect_metrics(found, ["config", "settings"])


@query("S12_resumed_sweep")
def s12_sweep(spark, folder):
    """A sweep that is stopped after its first setting goes on from its stored results."""
    folded = B.stratified_folds(prepared(spark, folder, "booked"), ["booked"], ["id"], 5, SEED)
    store = G.ResultStore(spark, scratch_path(spark, "sweep"))
    grid = G.full_grid({"trees": [20, 40], "depth": [5]})
    fit = lambda settings, train: L.forest(train, "booked", seed=SEED, **settings)
    G.evaluate_grid(folded, 5, grid[:1], fit, _two_class_scores, store=store, recipe="forest", parallelism=4)
    whole = G.evaluate_grid(folded, 5, grid, fit, _two_class_scores, store=store, recipe="forest", parallelism=4)
    stored = store.table().select("settings", F.col("entry").alias("fits")).groupBy("settings").agg(F.count_distinct("fits").alias("fits"))
    return G.collect_metrics(whole, ["config", "settings"]).join(F.broadcast(stored), "settings")  # one row per setting
