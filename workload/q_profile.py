"""Aggregates, profiles, histograms and statistics on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.scalars import half_open_bin, plausible, repair_birth_year, without
from waymark.operators import association as T
from waymark.operators import profile as A
from waymark.plans.munge import clean_users
from workload.adapters import SESSIONS, TUNING, USERS, sessions, table, tuning_results, users
from workload.q_values import CLEAN_AGE
from workload.registry import query, sql


def aged(spark, folder):
    """Users with a cleaned age, its range and the booking flag."""
    return clean_users(users(spark, folder))


@query("A1_count_by_level", sql("SELECT device_type, count(*) AS n FROM sessions GROUP BY 1", SESSIONS))
def a1(spark, folder):
    return A.counts(sessions(spark, folder), "device_type")


@query("A2_count_by_two_keys", sql("SELECT user_id, device_type, count(*) AS n FROM sessions GROUP BY 1, 2", SESSIONS))
def a2(spark, folder):
    return A.counts(sessions(spark, folder), "user_id", "device_type")


@query("A3_mean_sum_count", sql("SELECT user_id, round(avg(secs_elapsed), 6) AS mean, round(coalesce(sum(secs_elapsed), 0.0), 6) AS sum, count(*) AS n FROM sessions GROUP BY 1", SESSIONS))
def a3(spark, folder):
    return A.value_summary(sessions(spark, folder), ["user_id"], "secs_elapsed")


@query("A4_distinct_rows", sql("SELECT DISTINCT action_type, action_detail, action FROM sessions", SESSIONS))
def a4(spark, folder):
    return sessions(spark, folder).select("action_type", "action_detail", "action").distinct()


@query(
    "A5_count_distinct",
    sql(
        "SELECT count(DISTINCT action) + max(CASE WHEN action IS NULL THEN 1 ELSE 0 END) AS action, count(DISTINCT action_type) + max(CASE WHEN action_type IS NULL THEN 1 ELSE 0 END) AS action_type, count(DISTINCT device_type) + max(CASE WHEN device_type IS NULL THEN 1 ELSE 0 END) AS device_type FROM sessions",
        SESSIONS,
    ),
)
def a5(spark, folder):
    return sessions(spark, folder).agg(*[A.distinct_values(c).alias(c) for c in ("action", "action_type", "device_type")])


@query(
    "A6_contingency",
    sql(
        """SELECT action_type, device_type, count(k.event_id) AS n FROM (
  SELECT a.action_type, b.device_type FROM (SELECT DISTINCT action_type FROM sessions WHERE action_type IS NOT NULL) AS a
  CROSS JOIN (SELECT DISTINCT device_type FROM sessions WHERE device_type IS NOT NULL) AS b) AS g
LEFT JOIN sessions AS k USING (action_type, device_type) GROUP BY 1, 2""",
        SESSIONS,
    ),
)
def a6(spark, folder):
    return A.contingency(sessions(spark, folder), "action_type", "device_type")


@query("A7_contingency_with_null", sql("SELECT first_affiliate_tracked, dataset, count(*) AS n FROM users GROUP BY 1, 2", USERS))
def a7(spark, folder):
    return A.counts(users(spark, folder), "first_affiliate_tracked", "dataset")


@query("A8_class_shares", sql("SELECT country_destination, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pcnt FROM users GROUP BY 1", USERS))
def a8(spark, folder):
    return A.class_shares(users(spark, folder), "country_destination")


@query("A9_conditional_count", sql("SELECT count(CASE WHEN user_id = '' THEN 1 END) AS no_user, count(CASE WHEN secs_elapsed > 100 THEN 1 END) AS long FROM sessions", SESSIONS))
def a9(spark, folder):
    return sessions(spark, folder).agg(F.count_if(F.col("user_id") == "").alias("no_user"), F.count_if(F.col("secs_elapsed") > 100).alias("long"))


@query("A10_null_counts", sql("SELECT 'device_type' AS \"column\", count(*) - count(device_type) AS n_null FROM sessions UNION ALL SELECT 'secs_elapsed', count(*) - count(secs_elapsed) FROM sessions UNION ALL SELECT 'action', count(*) - count(action) FROM sessions", SESSIONS))
def a10(spark, folder):
    return A.null_counts(sessions(spark, folder), ["device_type", "secs_elapsed", "action"])


def _summary(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) - count({column}) AS n_missing, round(count({column}) / count(*), 6) AS complete_rate,
  round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS sd, round(min({column}), 6) AS min, round(quantile_cont({column}, 0.25), 6) AS q1,
  round(quantile_cont({column}, 0.5), 6) AS median, round(quantile_cont({column}, 0.75), 6) AS q3, round(max({column}), 6) AS max FROM {source}"""


@query("A11_column_summary", sql(_summary("secs_elapsed", "sessions"), SESSIONS))
def a11(spark, folder):
    return A.column_summary(sessions(spark, folder), ["secs_elapsed"])


@query("A11_level_counts", sql("SELECT 'action_type' AS \"column\", action_type AS level, count(*) AS n FROM sessions GROUP BY 2 UNION ALL SELECT 'device_type', device_type, count(*) FROM sessions GROUP BY 2", SESSIONS))
def a11_levels(spark, folder):
    return A.level_counts(sessions(spark, folder), ["action_type", "device_type"])


@query("A12_profile", "\nUNION ALL\n".join(_summary(f"CAST({c} AS DOUBLE)", "lineitem").replace(f"'CAST({c} AS DOUBLE)'", f"'{c}'") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")))
def a12(spark, folder):
    return A.column_summary(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"])


@query("A12_profile_ranged", _summary("o_totalprice", "orders"))
def a12_ranged(spark, folder):
    # A low limit takes the path for columns too long for one window.
    return A.column_summary(table(spark, folder, "orders"), ["o_totalprice"], range_rows=1000)


@query(
    "A13_five_numbers",
    """WITH placed AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders),
places AS (SELECT DISTINCT n, floor((n + 3) / 2) / 2 AS h, (n + 1) / 2 AS m FROM placed)
SELECT 'o_totalprice' AS "column", round(min(v), 6) AS minimum,
  round(sum(CASE WHEN r = floor(h) THEN v ELSE 0 END) / 2 + sum(CASE WHEN r = ceil(h) THEN v ELSE 0 END) / 2, 6) AS lower_hinge,
  round(sum(CASE WHEN r = floor(m) THEN v ELSE 0 END) / 2 + sum(CASE WHEN r = ceil(m) THEN v ELSE 0 END) / 2, 6) AS median,
  round(sum(CASE WHEN r = floor(placed.n + 1 - h) THEN v ELSE 0 END) / 2 + sum(CASE WHEN r = ceil(placed.n + 1 - h) THEN v ELSE 0 END) / 2, 6) AS upper_hinge,
  round(max(v), 6) AS maximum
FROM placed JOIN places ON placed.n = places.n""",
)
def a13(spark, folder):
    return A.five_numbers(table(spark, folder, "orders"), ["o_totalprice"])


@query("A14_quantiles", "SELECT 'l_extendedprice' AS \"column\", " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{n}" for p, n in ((0.5, 50), (0.75, 75), (0.9, 90), (0.95, 95), (0.99, 99))) + " FROM lineitem")
def a14(spark, folder):
    return A.quantiles(table(spark, folder, "lineitem"), ["l_extendedprice"], [0.5, 0.75, 0.9, 0.95, 0.99])


@query("A15_mean_and_sd", sql("SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM tuning GROUP BY metric", TUNING))
def a15(spark, folder):
    return A.spread_summary(tuning_results(spark, folder), ["metric"], "value")


@query("A16_mean_per_category", sql("SELECT device_type, round(avg(secs_elapsed), 6) AS mean FROM sessions GROUP BY 1", SESSIONS))
def a16(spark, folder):
    return sessions(spark, folder).groupBy("device_type").agg(F.avg("secs_elapsed").alias("mean"))


@query("A17_histogram", sql("SELECT CAST(floor((clean - 15) / 5) * 5 + 15 AS DOUBLE) AS bin, count(*) AS n FROM cleaned WHERE clean IS NOT NULL GROUP BY 1", USERS, CLEAN_AGE))
def a17(spark, folder):
    return A.histogram(aged(spark, folder), "age", 5, origin=15, limits=(15, 105))


@query("A17_density", "SELECT CAST(floor(value / 10) * 10 AS DOUBLE) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER () / 10, 6) AS density FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def a17_density(spark, folder):
    return A.density(table(spark, folder, "events"), "value", 10, limits=(0, 100))


@query("A17_equal_bins", "SELECT CAST(least(floor((value - lo) / (hi - lo) * 30) + 1, 30) AS BIGINT) AS bin, count(*) AS n FROM events CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM events) AS r GROUP BY 1")
def a17_equal(spark, folder):
    return A.equal_bins(table(spark, folder, "events"), "value", 30)


@query(
    "A18_stacked_histogram",
    sql("SELECT bin, made_booking, n, round(n / sum(n) OVER (PARTITION BY bin), 6) AS share FROM (SELECT CAST(floor(clean / 4) * 4 AS DOUBLE) AS bin, CASE WHEN country_destination = 'NDF' THEN 'NO' ELSE 'YES' END AS made_booking, count(*) AS n FROM cleaned WHERE clean IS NOT NULL GROUP BY 1, 2) AS h", USERS, CLEAN_AGE),
)
def a18(spark, folder):
    return A.stacked_histogram(aged(spark, folder), "age", "made_booking", 4)


@query(
    "A19_category_shares",
    sql("SELECT made_booking, gender, n, round(n / sum(n) OVER (PARTITION BY made_booking), 6) AS share FROM (SELECT CASE WHEN country_destination = 'NDF' THEN 'NO' ELSE 'YES' END AS made_booking, replace(lower(gender), '-', '') AS gender, count(*) AS n FROM users GROUP BY 1, 2) AS h", USERS),
)
def a19(spark, folder):
    return A.category_shares(aged(spark, folder), "made_booking", "gender")


@query(
    "A20_counts_by_day",
    sql("SELECT year, day, country_destination, n, round(n / sum(n) OVER (PARTITION BY year, day), 6) AS share FROM (SELECT strftime(date_account_created, '%Y') AS year, CAST(dayofyear(date_account_created) AS BIGINT) AS day, country_destination, count(*) AS n FROM users WHERE country_destination <> 'NDF' GROUP BY 1, 2, 3) AS h", USERS),
)
def a20(spark, folder):
    created = F.col("date_account_created")
    days = users(spark, folder).where("country_destination <> 'NDF'").select(F.date_format(created, "yyyy").alias("year"), F.dayofyear(created).alias("day"), "country_destination")
    from waymark.operators.windows import share_within

    return share_within(A.counts(days, "year", "day", "country_destination"), ["year", "day"], "n", "share")


@query("A21_counts_by_date", sql("SELECT CAST(date_first_booking AS VARCHAR) AS date_first_booking, dataset, count(*) AS n FROM users GROUP BY 1, 2", USERS))
def a21(spark, folder):
    return A.counts(users(spark, folder), "date_first_booking", "dataset")


@query("A22_log_histogram", "SELECT event_type, CAST(floor(log10(value) / 0.25) * 0.25 AS DOUBLE) AS bin, count(*) AS n FROM events WHERE value > 0 GROUP BY 1, 2")
def a22(spark, folder):
    return A.log_histogram(table(spark, folder, "events"), "value", 0.25, by=["event_type"])


_DENSITY = """SELECT round(lo + i * step, 6) AS x, round(sum(c.n * exp(-pow((lo + i * step - mid) / width, 2) / 2) / sqrt(2 * pi())) / (any_value(total) * any_value(width)), 6) AS density
FROM grid, cells AS c GROUP BY i, lo, step"""


@query(
    "A23_kernel_density",
    sql(
        _DENSITY,
        "stats AS (SELECT count(value) AS n, min(value) AS low, max(value) AS high, stddev_samp(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events)",
        "widths AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS width FROM stats)",
        "grid AS (SELECT i, n AS total, width, low - 3 * width AS lo, ((high + 3 * width) - (low - 3 * width)) / 511 AS step FROM widths, (SELECT unnest(range(0, 512)) AS i))",
        "cells AS (SELECT least(floor((value - low) / ((high - low) / 2048)), 2047) AS slot, count(*) AS n, avg(value) AS mid FROM events, stats WHERE value IS NOT NULL GROUP BY 1)",
    ),
)
def a23(spark, folder):
    return A.kernel_density(table(spark, folder, "events"), "value")


@query("A24_missing_patterns", sql("SELECT CASE WHEN device_type IS NULL THEN '1' ELSE '0' END || CASE WHEN secs_elapsed IS NULL THEN '1' ELSE '0' END || CASE WHEN action_type IS NULL THEN '1' ELSE '0' END AS pattern, count(*) AS n FROM sessions GROUP BY 1", SESSIONS))
def a24(spark, folder):
    return A.missing_patterns(sessions(spark, folder), ["device_type", "secs_elapsed", "action_type"])


@query("A25_counts_without_set", sql("SELECT age_range, gender, count(*) AS n FROM ranged WHERE age_range <> 'unknown' AND gender NOT IN ('-unknown-', 'OTHER') GROUP BY 1, 2", USERS, CLEAN_AGE))
def a25(spark, folder):
    age = plausible(repair_birth_year(F.col("age")))
    ranged = users(spark, folder).select(half_open_bin(age).alias("age_range"), "gender")
    kept = ranged.where((F.col("age_range") != "unknown") & without(F.col("gender"), ["-unknown-", "OTHER"]))
    return A.counts(kept, "age_range", "gender")


# Statistics

CELLS = """observed AS (
  SELECT age_range, CASE WHEN country_destination = 'NDF' THEN 'NO' ELSE 'YES' END AS made_booking, count(*) AS n FROM ranged GROUP BY 1, 2),
grid AS (SELECT a.age_range, b.made_booking FROM (SELECT DISTINCT age_range FROM observed) AS a CROSS JOIN (SELECT DISTINCT made_booking FROM observed) AS b),
cells AS (
  SELECT age_range, made_booking, coalesce(n, 0) AS n,
    CAST(sum(coalesce(n, 0)) OVER (PARTITION BY age_range) AS DOUBLE) * sum(coalesce(n, 0)) OVER (PARTITION BY made_booking) / sum(coalesce(n, 0)) OVER () AS expected
  FROM grid LEFT JOIN observed USING (age_range, made_booking))"""


@query("T1_chi_squared", sql("SELECT round(sum((n - expected) * (n - expected) / expected), 6) AS statistic, (count(DISTINCT age_range) - 1) * (count(DISTINCT made_booking) - 1) AS df, round(sqrt(sum((n - expected) * (n - expected) / expected) / sum(n)), 6) AS cramers_v FROM cells", USERS, CLEAN_AGE, CELLS))
def t1(spark, folder):
    return T.independence(aged(spark, folder), "age_range", "made_booking")


@query("T1_p_value", sql(
    """SELECT round(x2, 6) AS statistic, df, round(1 - sum(exp((df / 2.0 + k) * ln(x2 / 2) - x2 / 2 - lgamma(df / 2.0 + k + 1))), 6) AS p_value
FROM tested, (SELECT unnest(range(0, 1000)) AS k) AS terms GROUP BY x2, df""",
    USERS, CLEAN_AGE, CELLS,
    "tested AS (SELECT sum((n - expected) * (n - expected) / expected) AS x2, (count(DISTINCT age_range) - 1) * (count(DISTINCT made_booking) - 1) AS df FROM cells)",
))
def t1_p(spark, folder):
    return T.independence_p_value(aged(spark, folder), "age_range", "made_booking")


@query("T2_residuals", sql("SELECT age_range, made_booking, n, round(expected, 6) AS expected, round((n - expected) / sqrt(expected), 6) + 0.0 AS residual FROM cells", USERS, CLEAN_AGE, CELLS))
def t2(spark, folder):
    return T.expected_cells(aged(spark, folder), "age_range", "made_booking")


@query(
    "T3_cramers_v",
    """WITH o AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2),
g AS (SELECT a.quality, b.toxic FROM (SELECT DISTINCT quality FROM o) AS a CROSS JOIN (SELECT DISTINCT toxic FROM o) AS b),
c AS (SELECT coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY quality) AS DOUBLE) * sum(coalesce(n, 0)) OVER (PARTITION BY toxic) / sum(coalesce(n, 0)) OVER () AS e FROM g LEFT JOIN o USING (quality, toxic))
SELECT round(sqrt(sum((n - e) * (n - e) / e) / sum(n)), 6) AS cramers_v FROM c""",
)
def t3(spark, folder):
    return T.independence(table(spark, folder, "labels"), "quality", "toxic").select("cramers_v")


@query("T4_z_scores", "SELECT c_custkey, round((c_acctbal - m) / s, 6) + 0.0 AS z_c_acctbal FROM customer CROSS JOIN (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) AS t")
def t4(spark, folder):
    return T.z_scores(table(spark, folder, "customer"), ["c_acctbal"]).select("c_custkey", "z_c_acctbal")
