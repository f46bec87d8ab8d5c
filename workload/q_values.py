"""Scalar functions and category operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.features import levels as V
from waymark.functions import labels as L
from waymark.functions import scalars as S
from waymark.operators import profile as A
from workload.adapters import SESSIONS, TUNING, USERS, sessions, table, tuning_results, users
from workload.registry import query, sql


@query("X1_lower", "SELECT p_partkey, lower(p_brand) AS p_brand FROM part")
def x1(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.lower("p_brand").alias("p_brand"))


@query("X2_strip_prefix", "SELECT p_partkey, regexp_replace(p_brand, '^Brand#', '') AS code FROM part")
def x2(spark, folder):
    return table(spark, folder, "part").select("p_partkey", S.strip_prefix(F.col("p_brand"), "Brand#").alias("code"))


@query("X4_regex_extract", "SELECT o_orderkey, nullif(regexp_extract(o_orderpriority, '(.*)-', 1), '') AS level, nullif(regexp_extract(o_orderpriority, 'NOT (.*)', 1), '') AS tail FROM orders")
def x4(spark, folder):
    p = F.col("o_orderpriority")
    return table(spark, folder, "orders").select("o_orderkey", S.extract_or_null(p, "(.*)-", 1).alias("level"), S.extract_or_null(p, "NOT (.*)", 1).alias("tail"))


@query("X5_concat", "SELECT p_partkey, p_brand || '.' || p_type AS name FROM part")
def x5(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.concat_ws(".", "p_brand", "p_type").alias("name"))


@query("X8_two_branches", sql("SELECT id, CASE WHEN age > 40 THEN 'YES' WHEN age <= 40 THEN 'NO' END AS older FROM users", USERS))
def x8(spark, folder):
    return users(spark, folder).select("id", S.branch(F.col("age") > 40, "YES", "NO").alias("older"))


@query("X9_many_branches", "SELECT p_partkey, CAST(CASE WHEN p_size < 4 THEN 0 WHEN p_size < 8 THEN 5 WHEN p_size >= 4 THEN 10 END AS BIGINT) AS step FROM part")
def x9(spark, folder):
    size = F.col("p_size")
    return table(spark, folder, "part").select("p_partkey", S.cases((size < 4, 0), (size < 8, 5), (size >= 4, 10)).alias("step"))


@query("X10_fill_null", sql("SELECT id, CAST(coalesce(date_first_booking, DATE '2016-01-01') AS VARCHAR) AS booked, coalesce(first_affiliate_tracked, 'unknown') AS tracked FROM users", USERS))
def x10(spark, folder):
    return users(spark, folder).select(
        "id", S.booking_or_sentinel(F.col("date_first_booking")).alias("booked"), L.null_to(F.col("first_affiliate_tracked")).alias("tracked")
    )


@query("X11_compact_timestamp", sql("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events"))
def x11(spark, folder):
    return sessions(spark, folder).select("event_id", S.compact_timestamp_date(F.col("stamp")).alias("day"))


@query(
    "X12_day_gap",
    sql(
        "SELECT id, CAST(coalesce(date_first_booking, DATE '2016-01-01') - date_account_created AS BIGINT) AS days_book_signup, CAST(CAST(id AS BIGINT) % 3 AS BIGINT) AS days_signup_active FROM users",
        USERS,
    ),
)
def x12(spark, folder):
    created = F.col("date_account_created")
    active = S.compact_timestamp_date(F.col("timestamp_first_active"))
    return users(spark, folder).select(
        "id",
        S.day_gap(S.booking_or_sentinel(F.col("date_first_booking")), created).alias("days_book_signup"),
        S.day_gap(created, active).alias("days_signup_active"),
    )


@query("X13_month_name", "SELECT o_orderkey, monthname(o_orderdate) AS month FROM orders")
def x13(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", S.month_name(F.col("o_orderdate")).alias("month"))


@query(
    "X14_season",
    "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM orders",
)
def x14(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", S.season(F.col("o_orderdate")).alias("season"))


@query("X15_year_and_day", "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, CAST(dayofyear(o_orderdate) AS BIGINT) AS day FROM orders")
def x15(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", S.year_text(F.col("o_orderdate")).alias("year"), F.dayofyear("o_orderdate").alias("day"))


_ANGLE = "2 * pi() * (dayofmonth(d) - 1) / dayofmonth(last_day(d))"


@query(
    "X16_cyclic_month",
    f"SELECT o_orderkey, round(sin({_ANGLE}), 6) + 0.0 AS d_month_sin, round(cos({_ANGLE}), 6) + 0.0 AS d_month_cos FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) AS o",
)
def x16(spark, folder):
    from waymark.plans.munge import encode_cyclic_dates

    dates = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return encode_cyclic_dates(dates, ["d"])


@query("X17_logs_and_powers", "SELECT p_partkey, round(ln(p_retailprice), 6) AS ln, round(log2(p_retailprice), 6) AS log2, round(power(2, p_size % 8), 6) AS pow FROM part")
def x17(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", F.ln("p_retailprice").alias("ln"), F.log2("p_retailprice").alias("log2"), F.pow(F.lit(2.0), F.col("p_size") % 8).alias("pow")
    )


CLEAN_AGE = """aged AS (
  SELECT *, CASE WHEN age >= 1924 THEN 2014 - age ELSE age END AS repaired FROM users),
cleaned AS (SELECT *, CASE WHEN repaired BETWEEN 15 AND 104 THEN repaired END AS clean FROM aged),
ranged AS (
  SELECT *, CASE WHEN clean IS NULL THEN 'unknown' ELSE '[' || CAST(CAST(floor((clean - 15) / 5) * 5 + 15 AS INTEGER) AS VARCHAR) || ','
    || CAST(CAST(floor((clean - 15) / 5) * 5 + 20 AS INTEGER) AS VARCHAR) || ')' END AS age_range FROM cleaned)"""


@query("X18_half_open_bins", sql("SELECT id, age_range, CAST(floor((clean - 15) / 5) AS BIGINT) AS bin FROM ranged", USERS, CLEAN_AGE))
def x18(spark, folder):
    age = S.plausible(S.repair_birth_year(F.col("age")))
    return users(spark, folder).select("id", S.half_open_bin(age).alias("age_range"), S.bin_index(age).alias("bin"))


@query("X19_birth_year", sql("SELECT id, round(repaired, 6) AS age FROM aged", USERS, CLEAN_AGE))
def x19(spark, folder):
    return users(spark, folder).select("id", S.repair_birth_year(F.col("age")).alias("age"))


@query("X20_plausible_range", sql("SELECT id, round(clean, 6) AS age, round(CASE WHEN repaired BETWEEN 15 AND 100 THEN repaired END, 6) AS narrow FROM cleaned", USERS, CLEAN_AGE))
def x20(spark, folder):
    age = S.repair_birth_year(F.col("age"))
    return users(spark, folder).select("id", S.plausible(age).alias("age"), S.plausible(age, 15, 100).alias("narrow"))


@query("X21_ratio", sql("SELECT user_id, round(coalesce(sum(secs_elapsed), 0) / count(*), 6) AS secs_per_action FROM sessions GROUP BY user_id", SESSIONS))
def x21(spark, folder):
    sums = A.value_summary(sessions(spark, folder), ["user_id"], "secs_elapsed")
    return sums.select("user_id", S.ratio(F.col("sum"), F.col("n")).alias("secs_per_action"))


@query("X22_yes_no", sql("SELECT id, CASE WHEN dataset = 'test' THEN NULL WHEN country_destination <> 'NDF' THEN 'YES' ELSE 'NO' END AS made_booking FROM users", USERS))
def x22(spark, folder):
    label = F.when(F.col("dataset") == "train", F.col("country_destination"))
    return users(spark, folder).select("id", L.yes_no(label != "NDF").alias("made_booking"))


@query("X23_round", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(round(l_extendedprice / 7, 2), 6) AS seventh FROM lineitem")
def x23(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 2).alias("seventh"))


# Categories


@query("C1_relabel", sql("SELECT id, CASE WHEN lower(gender) = '-unknown-' THEN 'unknown' ELSE lower(gender) END AS gender FROM users", USERS))
def c1(spark, folder):
    return users(spark, folder).select("id", L.relabel(F.lower("gender"), "-unknown-", "unknown").alias("gender"))


@query("C2_null_to_level", sql("SELECT coalesce(first_affiliate_tracked, 'unknown') AS tracked, count(*) AS n FROM users GROUP BY 1", USERS))
def c2(spark, folder):
    return A.counts(users(spark, folder).select(L.null_to(F.col("first_affiliate_tracked")).alias("tracked")), "tracked")


@query("C3_sentinel_to_null", sql("SELECT id, nullif(gender, '-unknown-') AS gender FROM users", USERS))
def c3(spark, folder):
    return users(spark, folder).select("id", L.to_null(F.col("gender")).alias("gender"))


def _kept_top(column: str, n: int) -> str:
    return f"(SELECT coalesce({column}, '?') FROM (SELECT {column}, rank() OVER (ORDER BY count(*) DESC) AS r FROM users GROUP BY {column}) AS k WHERE r <= {n})"


@query(
    "C4_lump_top5",
    sql(
        "SELECT id, "
        + ", ".join(
            f"CASE WHEN coalesce({c}, '?') IN {_kept_top(c, 5)} THEN {c} ELSE 'other' END AS {c}"
            for c in ("gender", "language", "signup_flow", "first_affiliate_tracked", "first_browser")
        )
        + " FROM users",
        USERS,
    ),
)
def c4(spark, folder):
    columns = ["gender", "language", "signup_flow", "first_affiliate_tracked", "first_browser"]
    u = users(spark, folder).select("id", *columns)
    return V.TopLevels(columns).fit(u).transform(u)


def _share_lump(column: str, test: str, fewest: int, source: str, other: str) -> str:
    counts = f"(SELECT {column} AS v, count(*) AS c FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)"
    total = f"(SELECT count({column}) FROM {source})"
    lost = f"(SELECT count(*) FROM {counts} AS q WHERE NOT (CAST(c AS DOUBLE) / {total} {test}))"
    kept = f"(SELECT v FROM {counts} AS q WHERE CAST(c AS DOUBLE) / {total} {test} OR {lost} < {fewest})"
    return f"CASE WHEN {column} IS NULL OR {column} IN {kept} THEN {column} ELSE '{other}' END AS {column}"


@query(
    "C5_lump_by_share",
    sql("SELECT id, " + ", ".join(_share_lump(c, "> 0.05", 2, "users", "Other") for c in ("language", "signup_flow", "first_browser", "first_affiliate_tracked")) + " FROM users", USERS),
)
def c5(spark, folder):
    columns = ["language", "signup_flow", "first_browser", "first_affiliate_tracked"]
    u = users(spark, folder).select("id", *columns)
    return V.ShareLevels(columns, 0.05).fit(u).transform(u)


@query(
    "C6_lump_fitted",
    sql(
        "SELECT id, dataset, " + ", ".join(_share_lump(c, ">= 0.05", 1, "train", "Others") for c in ("language", "signup_flow", "first_browser")) + " FROM users",
        USERS, "train AS (SELECT * FROM users WHERE dataset = 'train')",
    ),
)
def c6(spark, folder):
    columns = ["language", "signup_flow", "first_browser"]
    u = users(spark, folder).select("id", "dataset", *columns)
    return V.CommonLevels(columns, 0.05).fit(u.where("dataset = 'train'")).transform(u)


@query("C7_unknown_step", sql("SELECT id, coalesce(first_affiliate_tracked, 'unknown') AS first_affiliate_tracked FROM users", USERS))
def c7(spark, folder):
    u = users(spark, folder).select("id", "first_affiliate_tracked")
    return V.Unknown().fit(u).transform(u)


@query("C8_collapse", sql("SELECT CASE WHEN country_destination = 'NDF' THEN 'NO' ELSE 'YES' END AS booked, count(*) AS n FROM users GROUP BY 1", USERS))
def c8(spark, folder):
    booked = L.collapse(F.col("country_destination"), {"NO": ["NDF"]}, rest="YES")
    return A.counts(users(spark, folder).select(booked.alias("booked")), "booked")


@query("C9_event_level", sql("SELECT CAST(CASE WHEN country_destination = 'NDF' THEN 1 ELSE 0 END AS BIGINT) AS code, count(*) AS n FROM users GROUP BY 1", USERS))
def c9(spark, folder):
    booked = L.collapse(F.col("country_destination"), {"NO": ["NDF"]}, rest="YES")
    # The event level comes first in the level list, so its code is 0.
    return A.counts(users(spark, folder).select(L.to_code(booked, ["YES", "NO"]).alias("code")), "code")


@query("C10_order_levels", sql("SELECT config, round(avg(value), 6) AS value, row_number() OVER (ORDER BY avg(value) DESC, config) AS position FROM tuning GROUP BY config", TUNING))
def c10(spark, folder):
    return V.ordered_by(tuning_results(spark, folder), "config", "value")


@query("C11_unused_levels", "SELECT DISTINCT lang FROM documents WHERE n_chars > 1000")
def c11(spark, folder):
    return table(spark, folder, "documents").where("n_chars > 1000").select("lang").distinct()


@query("C12_extend_levels", sql("SELECT 'gender' AS \"column\", gender AS level, count(*) AS n FROM users GROUP BY 2 UNION ALL SELECT 'gender', 'weibo', 0", USERS))
def c12(spark, folder):
    return V.discover_levels(users(spark, folder), ["gender"], {"gender": ["weibo"]})


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("C13_codes", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS code, o_orderpriority AS back FROM orders")
def c13(spark, folder):
    coded = table(spark, folder, "orders").select("o_orderkey", L.to_code(F.col("o_orderpriority"), _PRIORITIES).alias("code"))
    return coded.withColumn("back", L.from_code(F.col("code"), _PRIORITIES))
