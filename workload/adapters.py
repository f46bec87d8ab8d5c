"""The user, session, prediction and tuning tables, derived from the provided tables.

Each adapter exists twice: as a DataFrame and as a SQL table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Session log. Some rows have an empty user id, some cells are missing."""
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        "event_id",
        F.when(e % 17 == 0, "").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("a"), (e % 7).cast("string")).alias("action"),
        F.when(e % 19 != 0, F.concat(F.lit("t"), (e % 3).cast("string"))).alias("action_type"),
        F.col("event_type").alias("action_detail"),
        F.when(e % 11 != 0, F.concat(F.lit("d"), (e % 4).cast("string"))).alias("device_type"),
        F.when(e % 13 != 0, F.col("value")).alias("secs_elapsed"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"),
    )


SESSIONS = """sessions AS (
  SELECT event_id,
    CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id,
    'a' || CAST(event_id % 7 AS VARCHAR) AS action,
    CASE WHEN event_id % 19 <> 0 THEN 't' || CAST(event_id % 3 AS VARCHAR) END AS action_type,
    event_type AS action_detail,
    CASE WHEN event_id % 11 <> 0 THEN 'd' || CAST(event_id % 4 AS VARCHAR) END AS device_type,
    CASE WHEN event_id % 13 <> 0 THEN value END AS secs_elapsed,
    strftime(ts, '%Y%m%d%H%M%S') AS stamp
  FROM events)"""


def users(spark: SparkSession, folder: str) -> DataFrame:
    """User table: account date = first order, booking date = first urgent finished order."""
    c = F.col("c_custkey")
    booked = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    firsts = (
        table(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(F.min("o_orderdate").alias("first_any"), F.min(F.when(booked, F.col("o_orderdate"))).alias("first_booking"))
    )
    base = (
        table(spark, folder, "customer")
        .join(firsts, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    gender = F.when(c % 4 == 0, "-unknown-").when(c % 4 == 1, "MALE").when(c % 4 == 2, "FEMALE").otherwise("OTHER")
    messy_age = (
        F.when(c % 10 == 0, 1930 + c % 50).when(c % 10 == 2, 100 + c % 50).when(c % 10 != 1, 10 + c % 50).cast("double")
    )
    active = F.date_format(F.date_sub(F.col("first_any").cast("date"), (c % 3).cast("int")), "yyyyMMdd")
    return base.select(
        c.cast("string").alias("id"),
        F.col("first_any").cast("date").alias("date_account_created"),
        F.concat(active, F.lit("101500")).alias("timestamp_first_active"),
        F.col("first_booking").cast("date").alias("date_first_booking"),
        gender.alias("gender"),
        messy_age.alias("age"),
        F.lower("c_mktsegment").alias("signup_method"),
        (c % 23).cast("string").alias("signup_flow"),
        F.when(c % 10 < 6, "en").otherwise(F.lower("n_name")).alias("language"),
        F.when(c % 7 != 0, F.when(c % 3 == 0, "linked").otherwise("untracked")).alias("first_affiliate_tracked"),
        F.when(c % 5 == 0, "-unknown-").otherwise(F.concat(F.lit("b"), (c % 9).cast("string"))).alias("first_browser"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("first_booking").isNull(), "NDF").otherwise(F.col("n_name")).alias("country_destination"),
        F.when(c % 5 == 0, "test").otherwise("train").alias("dataset"),
    )


USERS = """firsts AS (
  SELECT o_custkey, min(o_orderdate) AS first_any,
    min(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN o_orderdate END) AS first_booking
  FROM orders GROUP BY o_custkey),
users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
    CAST(first_any AS DATE) AS date_account_created,
    strftime(CAST(first_any AS DATE) - CAST(c_custkey % 3 AS INTEGER), '%Y%m%d') || '101500' AS timestamp_first_active,
    CAST(first_booking AS DATE) AS date_first_booking,
    CASE c_custkey % 4 WHEN 0 THEN '-unknown-' WHEN 1 THEN 'MALE' WHEN 2 THEN 'FEMALE' ELSE 'OTHER' END AS gender,
    CAST(CASE WHEN c_custkey % 10 = 0 THEN 1930 + c_custkey % 50 WHEN c_custkey % 10 = 2 THEN 100 + c_custkey % 50
      WHEN c_custkey % 10 <> 1 THEN 10 + c_custkey % 50 END AS DOUBLE) AS age,
    lower(c_mktsegment) AS signup_method,
    CAST(c_custkey % 23 AS VARCHAR) AS signup_flow,
    CASE WHEN c_custkey % 10 < 6 THEN 'en' ELSE lower(n_name) END AS language,
    CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'linked' ELSE 'untracked' END END AS first_affiliate_tracked,
    CASE WHEN c_custkey % 5 = 0 THEN '-unknown-' ELSE 'b' || CAST(c_custkey % 9 AS VARCHAR) END AS first_browser,
    c_acctbal AS balance,
    CASE WHEN first_booking IS NULL THEN 'NDF' ELSE n_name END AS country_destination,
    CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS dataset
  FROM customer LEFT JOIN firsts ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def countries(spark: SparkSession, folder: str) -> DataFrame:
    """One row per destination with its language and distance."""
    n = F.col("n_nationkey")
    return (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("country_destination"),
            (n * 1.5 - 10).alias("lat_destination"),
            (n * 100 + 50).cast("double").alias("distance_km"),
            F.lower("r_name").alias("destination_language"),
        )
    )


COUNTRIES = """countries AS (
  SELECT n_name AS country_destination, CAST(n_nationkey * 1.5 - 10 AS DOUBLE) AS lat_destination,
    CAST(n_nationkey * 100 + 50 AS DOUBLE) AS distance_km, lower(r_name) AS destination_language
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Class probabilities: ten positive weights per row, normalized; truth is 0..9."""
    weights = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") + 1.0)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return (
        table(spark, folder, "embeddings")
        .select(F.col("vec_id").alias("id"), F.col("label").alias("truth"), weights.alias("w"))
        .select("id", "truth", F.transform("w", lambda x: x / total).alias("prob"))
    )


# Long form: one row per observation and zero-based class, with its rank.
PREDICTIONS = """weights AS (
  SELECT vec_id AS id, label AS truth, CAST(i - 1 AS BIGINT) AS class, CAST(embedding[i] AS DOUBLE) + 1.0 AS w
  FROM embeddings CROSS JOIN (SELECT unnest(range(1, 11)) AS i) AS places),
predictions AS (SELECT id, truth, class, w / sum(w) OVER (PARTITION BY id) AS p FROM weights),
ranked AS (
  SELECT id, truth, class, p, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS r FROM predictions),
scored AS (
  SELECT id, truth, max(CASE WHEN class = truth THEN r END) AS truth_rank, max(CASE WHEN r = 1 THEN class END) AS predicted
  FROM ranked GROUP BY id, truth)"""


def binary_scores(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("booked"), (d * 7919 % 1000 / 1000.0).alias("score"))


BINARY = """scores AS (
  SELECT doc_id, quality = 1 AS booked, CAST(doc_id * 7919 % 1000 AS DOUBLE) / 1000.0 AS score FROM labels)"""


def tuning_results(spark: SparkSession, folder: str) -> DataFrame:
    """Metric values per configuration and fold, taken from the part table."""
    p = F.col("p_partkey")
    return (
        table(spark, folder, "part")
        .select(
            F.col("p_brand").alias("config"),
            (F.col("p_size") % 5).alias("fold"),
            F.when(p % 2 == 0, "roc_auc").otherwise("accuracy").alias("metric"),
            F.col("p_size").alias("size"),
        )
        .groupBy("config", "fold", "metric")
        .agg((F.avg("size") / 50.0).alias("value"))
        .withColumn("trees", F.regexp_extract("config", "([0-9]+)", 1).cast("bigint") * 10)
    )


TUNING = """tuning AS (
  SELECT p_brand AS config, p_size % 5 AS fold, CASE WHEN p_partkey % 2 = 0 THEN 'roc_auc' ELSE 'accuracy' END AS metric,
    avg(p_size) / 50.0 AS value, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) * 10 AS trees
  FROM part GROUP BY 1, 2, 3),
collected AS (
  SELECT config, trees, metric, avg(value) AS mean, count(*) AS n, stddev_samp(value) / sqrt(count(*)) AS std_err
  FROM tuning GROUP BY config, trees, metric)"""
