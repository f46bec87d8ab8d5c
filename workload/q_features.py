"""Fitted feature preparation, splits and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.features import prepare as M
from waymark.features import resample as B
from waymark.operators import profile as A
from waymark.operators.reshape import column_name
from workload.adapters import SESSIONS, USERS, sessions, table, users
from workload.registry import query, sql

SEED = 945
TRAIN = "train AS (SELECT * FROM users WHERE dataset = 'train')"


def train_rows(spark, folder):
    return users(spark, folder).where("dataset = 'train'")


def numbers(spark, folder):
    """A table with two numeric columns, one of them with gaps."""
    return users(spark, folder).select("id", "dataset", "age", "balance", "country_destination")


@query("M1_mean_impute", sql("SELECT id, round(coalesce(age, (SELECT avg(age) FROM train)), 6) AS age FROM users", USERS, TRAIN))
def m1(spark, folder):
    u = numbers(spark, folder)
    return M.MeanImpute(["age"]).fit(u.where("dataset = 'train'")).transform(u).select("id", "age")


@query("M2_median_impute", sql("SELECT id, round(coalesce(age, (SELECT quantile_cont(age, 0.5) FROM train)), 6) AS age FROM users", USERS, TRAIN))
def m2(spark, folder):
    u = numbers(spark, folder)
    return M.MedianImpute(["age"]).fit(u.where("dataset = 'train'")).transform(u).select("id", "age")


@query("M6_drop_constant", sql("SELECT id, round(age, 6) AS age FROM users", USERS))
def m6(spark, folder):
    u = users(spark, folder).select("id", "age", F.lit("x").alias("constant"), F.lit(1.0).alias("one"))
    return M.ConstantColumns().fit(u).transform(u)


_NZV = """SELECT '{c}' AS "column", round(max(CASE WHEN r = 1 THEN c END) / max(CASE WHEN r = 2 THEN c END), 6) AS freq_ratio, round(count(v) / sum(c) * 100, 6) AS percent_unique,
  CAST(coalesce(max(CASE WHEN r = 2 THEN c END), 0) = 0 OR (max(CASE WHEN r = 1 THEN c END) / max(CASE WHEN r = 2 THEN c END) > 19 AND count(v) / sum(c) * 100 <= 10) AS VARCHAR) AS near_constant
FROM (SELECT v, c, row_number() OVER (ORDER BY v IS NULL, c DESC, v) AS r FROM (SELECT {c} AS v, count(*) AS c FROM {t} GROUP BY 1) AS g) AS q"""


@query(
    "M7_near_constant",
    sql(
        "\nUNION ALL\n".join(_NZV.format(c=c, t="marked") for c in ("rare", "gender", "signup_method", "one")),
        USERS, "marked AS (SELECT CASE WHEN CAST(id AS BIGINT) % 50 = 0 THEN 'a' ELSE 'b' END AS rare, gender, signup_method, 'x' AS one FROM users)",
    ),
)
def m7(spark, folder):
    rare = F.when(F.col("id").cast("bigint") % 50 == 0, "a").otherwise("b").alias("rare")
    u = users(spark, folder).select(rare, "gender", "signup_method", F.lit("x").alias("one"))
    return M.near_constant(u, ["rare", "gender", "signup_method", "one"])


_METHODS = ["automobile", "building", "furniture", "household", "machinery"]


def _dummy_sql(columns: dict[str, list[str]]) -> str:
    return ", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {column_name(c, v)}" for c, vs in columns.items() for v in vs)


@query("M8_dummies", sql("SELECT id, " + _dummy_sql({"signup_method": _METHODS[1:], "gender": ["FEMALE", "MALE", "OTHER"]}) + " FROM users", USERS))
def m8(spark, folder):
    u = users(spark, folder).select("id", "signup_method", "gender")
    return M.Dummies(["signup_method", "gender"]).fit(u).transform(u)


@query("M9_one_hot", sql("SELECT id, " + _dummy_sql({"signup_method": _METHODS}) + " FROM users", USERS))
def m9(spark, folder):
    u = users(spark, folder).select("id", "signup_method")
    return M.Dummies(["signup_method"], full="all").fit(u).transform(u)


def _place_sql(column: str) -> str:
    """Place of a row's level among all levels, by falling count, then by name."""
    ranks = f"SELECT {column}, row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS r FROM users GROUP BY 1"
    return f"(SELECT r FROM ({ranks}) AS p WHERE p.{column} = users.{column})"


@query("M9_sparse_one_hot", sql(f"SELECT id, {_place_sql('signup_method')} AS method_cell, {_place_sql('gender')} AS gender_cell, CAST(2 AS BIGINT) AS set_cells FROM users", USERS))
def m9_sparse(spark, folder):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    u = users(spark, folder).select("id", "signup_method", "gender")
    out = Pipeline(stages=M.sparse_one_hot(["signup_method", "gender"])).fit(u).transform(u)
    cell = lambda c: (F.array_position(vector_to_array(c), F.lit(1.0)) - 1).cast("bigint")
    total = F.aggregate(vector_to_array("one_hot"), F.lit(0.0), lambda a, x: a + x).cast("bigint")
    return out.select("id", cell("signup_method_hot").alias("method_cell"), cell("gender_hot").alias("gender_cell"), total.alias("set_cells"))


@query("M10_design_matrix", sql("SELECT id, " + _dummy_sql({"signup_method": _METHODS, "gender": ["FEMALE", "MALE", "OTHER"]}) + " FROM users", USERS))
def m10(spark, folder):
    u = users(spark, folder).select("id", "signup_method", "gender")
    return M.Dummies(["signup_method", "gender"], full="first").fit(u).transform(u)


_STATS = "stats AS (SELECT avg(age) AS am, stddev_samp(age) AS asd, avg(balance) AS bm, stddev_samp(balance) AS bsd FROM train)"


@query("M11_center", sql("SELECT id, round(age - am, 6) + 0.0 AS age, round(balance - bm, 6) + 0.0 AS balance FROM users CROSS JOIN stats", USERS, TRAIN, _STATS))
def m11(spark, folder):
    u = numbers(spark, folder)
    return M.Center().fit(u.where("dataset = 'train'")).transform(u).select("id", "age", "balance")


@query("M12_scale", sql("SELECT id, round(age / asd, 6) AS age, round(balance / bsd, 6) AS balance FROM users CROSS JOIN stats", USERS, TRAIN, _STATS))
def m12(spark, folder):
    u = numbers(spark, folder)
    return M.Scale().fit(u.where("dataset = 'train'")).transform(u).select("id", "age", "balance")


@query("M13_normalize", sql("SELECT id, round((age - am) / asd, 6) + 0.0 AS age, round((balance - bm) / bsd, 6) + 0.0 AS balance FROM users CROSS JOIN stats", USERS, TRAIN, _STATS))
def m13(spark, folder):
    u = numbers(spark, folder)
    return M.Normalize().fit(u.where("dataset = 'train'")).transform(u).select("id", "age", "balance")


def lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )


@query("M14_principal_components")
def m14(spark, folder):
    df = lines(spark, folder)
    scaled = M.Normalize().fit(df).transform(df)
    return M.PrincipalComponents(k=2).fit(scaled).transform(scaled)


@query("M15_radial_components")
def m15(spark, folder):
    df = lines(spark, folder)
    scaled = M.Normalize().fit(df).transform(df)
    return M.RadialComponents(k=2, features=128).fit(scaled).transform(scaled)


@query("M16_quadratic_components")
def m16(spark, folder):
    df = lines(spark, folder)
    scaled = M.Normalize().fit(df).transform(df)
    return M.QuadraticComponents(k=2).fit(scaled).transform(scaled)


def _grid_step(n: int, low: str, high: str, width: int) -> str:
    """The power with the best profile likelihood on ``width`` points between two expressions."""
    power = f"CASE WHEN i = {width - 1} THEN {high} ELSE {low} + i * (({high} - ({low})) / {width - 1}) END"
    before = f", best{n - 1}" if n else ""
    return f"""grid{n} AS (SELECT {power} AS p FROM (SELECT unnest(range(0, {width})) AS i) AS g{before}),
best{n} AS (SELECT p AS b FROM (
  SELECT p, -count(*) / 2.0 * ln(var_pop(CASE WHEN abs(p) < 1e-9 THEN x ELSE (exp(x * p) - 1) / p END)) + (p - 1) * sum(x) AS fit FROM logs, grid{n} GROUP BY p) AS f
  ORDER BY fit DESC, p DESC LIMIT 1)"""


@query("M17_box_cox", sql(
    """SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS l_quantity, l_discount, l_tax,
  round(CASE WHEN abs(round(b, 6)) < 1e-9 THEN ln(l_extendedprice) ELSE (pow(l_extendedprice, round(b, 6)) - 1) / round(b, 6) END, 6) AS l_extendedprice FROM lineitem, best2""",
    "logs AS (SELECT ln(CAST(l_extendedprice AS DOUBLE)) AS x FROM lineitem)",
    _grid_step(0, "-2.0::DOUBLE", "2.0::DOUBLE", 9),
    _grid_step(1, "b - 0.5", "b + 0.5", 21),
    _grid_step(2, "b - 0.05", "b + 0.05", 21),
))
def m17(spark, folder):
    df = lines(spark, folder)
    return M.BoxCox(["l_extendedprice", "l_discount"]).fit(df).transform(df)


@query("M18_class_weights", sql("SELECT country_destination, round(sqrt(max(count(*)) OVER () / count(*)), 6) AS weight FROM users GROUP BY 1", USERS))
def m18(spark, folder):
    return M.class_weights(users(spark, folder), "country_destination")


# Splits. Both engines order rows by the same hash of id and seed.


def _h(id_column: str, seed: int = SEED) -> str:
    return f"md5(CAST({id_column} AS VARCHAR) || ':{seed}')"


@query(
    "B1_stratified_split",
    sql(f"SELECT id, CAST(r <= ceil(n * 0.8) AS VARCHAR) AS in_train FROM (SELECT id, row_number() OVER (PARTITION BY country_destination ORDER BY {_h('id')}) AS r, count(*) OVER (PARTITION BY country_destination) AS n FROM users) AS t", USERS),
)
def b1(spark, folder):
    u = users(spark, folder).select("id", "country_destination")
    return B.stratified_flag(u, ["country_destination"], ["id"], 0.8, SEED).select("id", "in_train")


@query(
    "B1_stratified_split_hot",
    f"SELECT event_id, CAST(r <= ceil(n * 0.8) AS VARCHAR) AS in_train FROM (SELECT event_id, row_number() OVER (PARTITION BY value > 10 ORDER BY {_h('event_id')}) AS r, count(*) OVER (PARTITION BY value > 10) AS n FROM events) AS t",
)
def b1_hot(spark, folder):
    e = table(spark, folder, "events").select("event_id", (F.col("value") > 10).alias("high"))
    return B.stratified_flag(e, ["high"], ["event_id"], 0.8, SEED).select("event_id", "in_train")


@query(
    "B2_stratified_sample",
    sql(f"SELECT id, country_destination FROM (SELECT id, country_destination, row_number() OVER (PARTITION BY country_destination ORDER BY {_h('id')}) AS r, count(*) OVER (PARTITION BY country_destination) AS n FROM users) AS t WHERE r <= ceil(n * 0.05)", USERS),
)
def b2(spark, folder):
    u = users(spark, folder).select("id", "country_destination")
    return B.stratified_sample(u, ["country_destination"], ["id"], 0.05, SEED)


@query(
    "B3_validation_split",
    sql(f"SELECT id, CAST(r <= ceil(n * 0.75) AS VARCHAR) AS in_analysis FROM (SELECT id, row_number() OVER (PARTITION BY country_destination ORDER BY {_h('id')}) AS r, count(*) OVER (PARTITION BY country_destination) AS n FROM users WHERE dataset = 'train') AS t", USERS),
)
def b3(spark, folder):
    u = train_rows(spark, folder).select("id", "country_destination")
    return B.stratified_flag(u, ["country_destination"], ["id"], 0.75, SEED, "in_analysis").select("id", "in_analysis")


@query("B4_stratified_folds", sql(f"SELECT id, ntile(10) OVER (PARTITION BY country_destination ORDER BY {_h('id')}) - 1 AS fold FROM users", USERS))
def b4(spark, folder):
    u = users(spark, folder).select("id", "country_destination")
    return B.stratified_folds(u, ["country_destination"], ["id"], 10, SEED).select("id", "fold")


def _edges() -> list[float]:
    """Cumulative Poisson(1) probabilities."""
    term, total, out = 0.36787944117144233, 0.0, []
    for k in range(16):
        term = term if k == 0 else term / k
        total += term
        out.append(total)
    return out


@query(
    "B5_bootstrap",
    sql(
        "SELECT id, round(age, 6) AS age, replicate, " + " + ".join(f"CASE WHEN u >= {e!r} THEN 1 ELSE 0 END::BIGINT" for e in _edges()) + " AS weight FROM drawn",
        USERS,
        f"""drawn AS (SELECT id, age, replicate, CAST(CAST('0x' || substr(md5(id || ':' || CAST(replicate AS VARCHAR) || ':{SEED}'), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976.0 AS u
  FROM users, (SELECT unnest(range(1, 26)) AS replicate) AS g)""",
    ),
)
def b5(spark, folder):
    return B.bootstrap(users(spark, folder).select("id", "age"), ["id"], 25, SEED)


@query(
    "B6_up_sample",
    sql(
        f"""SELECT id, country_destination AS label, CAST(0 AS BIGINT) AS copy FROM users
UNION ALL SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY j) FROM (
  SELECT s.label, j, CAST('0x' || substr(md5(s.label || ':' || CAST(j AS VARCHAR) || ':{SEED}'), 1, 15) AS BIGINT) % s.n + 1 AS pick
  FROM sizes AS s JOIN (SELECT unnest(range(0, (SELECT max(n) FROM sizes))) AS j) AS d ON j < (SELECT max(n) FROM sizes) - s.n) AS drawn
JOIN (SELECT id, country_destination AS label, row_number() OVER (PARTITION BY country_destination ORDER BY {_h('id')}) AS r FROM users) AS o USING (label) WHERE r = pick""",
        USERS, "sizes AS (SELECT country_destination AS label, count(*) AS n FROM users GROUP BY 1)",
    ),
)
def b6(spark, folder):
    u = users(spark, folder).select("id", F.col("country_destination").alias("label"))
    return B.up_sample(u, "label", ["id"], SEED)


@query(
    "B7_down_sample",
    sql(f"SELECT id, country_destination FROM (SELECT id, country_destination, row_number() OVER (PARTITION BY country_destination ORDER BY {_h('id')}) AS r FROM users) AS t WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM users GROUP BY country_destination) AS s)", USERS),
)
def b7(spark, folder):
    u = users(spark, folder).select("id", "country_destination")
    return B.down_sample(u, "country_destination", ["id"], SEED)


def _share(text: str, seed: int) -> str:
    return f"CAST(CAST('0x' || substr(md5({text} || ':{seed}'), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976.0"


_COPY = "id || ':' || CAST(copy AS VARCHAR)"


@query("B10_rose", sql(
    f"""SELECT id, booked, copy, round(balance + sqrt(-2 * ln(greatest({_share(_COPY, SEED + 1)}, 1e-12))) * cos({_share(_COPY, SEED + 1 + 104729)} * 6.283185307179586)
  * pow(4.0 / 3 / n, 1.0 / 5) * sd, 6) AS balance FROM copies JOIN moments USING (booked)""",
    USERS,
    "halves AS (SELECT id, CASE WHEN country_destination = 'NDF' THEN 'NO' ELSE 'YES' END AS booked, CAST(balance AS DOUBLE) AS balance FROM users)",
    "moments AS (SELECT booked, count(*) AS n, coalesce(stddev_samp(balance), 0) AS sd FROM halves GROUP BY booked)",
    """quotas AS (SELECT booked, n, CASE WHEN booked = 'NO' THEN (SELECT count(*) FROM halves) // 2 ELSE (SELECT count(*) FROM halves) - (SELECT count(*) FROM halves) // 2 END AS draws FROM moments)""",
    f"""picks AS (
  SELECT booked, CAST('0x' || substr(md5(booked || ':' || CAST(j AS VARCHAR) || ':{SEED}'), 1, 15) AS BIGINT) % n + 1 AS ordinal
  FROM quotas, (SELECT unnest(range(0, (SELECT max(draws) FROM quotas))) AS j) AS d WHERE j < draws)""",
    "drawn AS (SELECT booked, ordinal, count(*) AS copies FROM picks GROUP BY ALL)",
    f"ordered AS (SELECT *, row_number() OVER (PARTITION BY booked ORDER BY {_h('id')}) AS ordinal FROM halves)",
    "copies AS (SELECT id, booked, balance, unnest(range(1, copies + 1)) AS copy FROM ordered JOIN drawn USING (booked, ordinal))",
))
def b10(spark, folder):
    u = users(spark, folder).select("id", F.when(F.col("country_destination") == "NDF", "NO").otherwise("YES").alias("booked"), "balance")
    return B.rose(u, "booked", ["id"], ["balance"], SEED)


@query("B_random_order", f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_h('o_orderkey')}) AS ordinal FROM orders")
def random_order(spark, folder):
    return B.numbered(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], ["o_orderkey"], SEED).select("o_orderkey", "ordinal")


@query("M4_hot_deck", sql(
    f"""SELECT u.id, round(coalesce(u.age, d.age), 6) AS age FROM users AS u
LEFT JOIN (SELECT age, row_number() OVER (ORDER BY {_h('id')}) AS r FROM users WHERE age IS NOT NULL) AS d
ON u.age IS NULL AND d.r = CAST('0x' || substr({_h('u.id', SEED + 1)}, 1, 15) AS BIGINT) % (SELECT count(age) FROM users) + 1""",
    USERS,
))
def m4(spark, folder):
    from waymark.features.impute import hot_deck

    return hot_deck(users(spark, folder).select("id", "age"), ["id"], "age", SEED)


@query("M3_neighbour_impute")
def m3(spark, folder):
    from waymark.features.neighbours import NeighbourImpute

    u = users(spark, folder).select("id", "age", "balance", "gender", "signup_method", "country_destination")
    return NeighbourImpute(k=5).fit(u).transform(u)


@query("M5_chained_matching")
def m5(spark, folder):
    from waymark.features.impute import chained_matching

    u = users(spark, folder).select("id", "age", "balance", "first_affiliate_tracked")
    return chained_matching(u, ["id"], ["age", "balance", "first_affiliate_tracked"], sweeps=5, seed=SEED)


@query(
    "M5_nearest_on_line",
    """WITH d AS (SELECT DISTINCT c_acctbal AS at FROM customer WHERE c_custkey % 3 <> 0),
g AS (SELECT c_custkey, c_acctbal AS at FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey, round(CASE WHEN hi IS NULL OR g_at - lo <= hi - g_at THEN lo ELSE hi END, 6) AS value FROM (
  SELECT c_custkey, g.at AS g_at, max(CASE WHEN d.at <= g.at THEN d.at END) AS lo, min(CASE WHEN d.at >= g.at THEN d.at END) AS hi
  FROM g CROSS JOIN d GROUP BY 1, 2) AS t""",
)
def m5_line(spark, folder):
    from waymark.features.impute import nearest_on_line

    c = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("at"), F.col("c_acctbal").alias("value"))
    # Small limits force the ranged order, so that donors are carried between ranges.
    return nearest_on_line(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 3 <> 0"), ["c_custkey"], "at", "value", range_rows=50)


def growing_table(spark, folder):
    """Complete rows with an uneven label."""
    nation = F.regexp_extract("country_destination", "([0-9]+)", 1).cast("int")
    label = F.when(F.col("country_destination") == "NDF", "NDF").when(nation < 4, "near").otherwise("far")
    u = users(spark, folder)
    age = F.coalesce("age", F.lit(40.0))
    return u.select("id", label.alias("y"), age.alias("age"), (F.col("balance") / 100).alias("balance"), "gender")


@query("B8_smote")
def b8(spark, folder):
    from waymark.features.neighbours import smote

    return smote(growing_table(spark, folder), "y", ["id"], ["age", "balance"], SEED)


@query("B9_adasyn")
def b9(spark, folder):
    from waymark.features.neighbours import adasyn

    return adasyn(growing_table(spark, folder), "y", ["id"], ["age", "balance"], SEED)
