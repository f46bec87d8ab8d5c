"""Session features per user and the user tables built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.labels import null_to
from waymark.functions.scalars import compact_timestamp_date, ratio
from waymark.operators.reshape import count_columns, key_values
from waymark.operators.rows import inner_join_on, left_join_on
from waymark.operators.windows import first_per_key, top_n_ties
from waymark.sources.delimited import LABELLED_USER_COLUMNS, SESSION_COLUMNS, USER_COLUMNS, read_declared


def session_totals(sessions: DataFrame) -> DataFrame:
    """Mean seconds, total seconds and number of actions per user."""
    return sessions.groupBy("user_id").agg(
        F.avg("secs_elapsed").alias("avg_secs"),
        F.coalesce(F.sum("secs_elapsed"), F.lit(0.0)).alias("sum_secs"),
        F.count(F.lit(1)).alias("cnt_actions"),
    )


def top_devices(sessions: DataFrame, ties: str = "keep") -> DataFrame:
    """Most used device type per user.

    With ``ties="keep"`` a user with several equally used devices has several rows, with
    ``ties="first"`` only the alphabetically first one.
    """
    used = sessions.groupBy("user_id", "device_type").agg(F.count(F.lit(1)).alias("device_cnt"))
    if ties == "keep":
        top = top_n_ties(used, ["user_id"], "device_cnt", 1)
    elif ties == "first":
        top = first_per_key(used, ["user_id"], [F.desc("device_cnt"), F.asc_nulls_last("device_type")])
    else:
        raise ValueError("ties must be keep or first")
    return top.withColumnRenamed("device_type", "top_device")


def session_profile(sessions: DataFrame, ties: str = "keep") -> DataFrame:
    """``session_totals`` and ``top_devices`` of every user from one scan.

    Rows are grouped by user and device first; totals and the device ranking are then read
    off one window over a user's few device rows, already partitioned for a join on users.
    """
    if ties not in ("keep", "first"):
        raise ValueError("ties must be keep or first")
    per_device = sessions.groupBy("user_id", "device_type").agg(
        F.count(F.lit(1)).alias("device_cnt"), F.sum("secs_elapsed").alias("__secs"), F.count("secs_elapsed").alias("__timed")
    )
    user = Window.partitionBy("user_id")
    ranked = user.orderBy(F.desc("device_cnt")) if ties == "keep" else user.orderBy(F.desc("device_cnt"), F.asc_nulls_last("device_type"))
    place = F.rank() if ties == "keep" else F.row_number()
    total = F.sum("__secs").over(user)
    joined = per_device.withColumns(
        {
            "__place": place.over(ranked),
            "avg_secs": F.try_divide(total, F.sum("__timed").over(user)),
            "sum_secs": F.coalesce(total, F.lit(0.0)),
            "cnt_actions": F.sum("device_cnt").over(user),
        }
    )
    return joined.where(F.col("__place") == 1).select(
        "user_id", "avg_secs", "sum_secs", "cnt_actions", F.col("device_type").alias("top_device"), "device_cnt"
    )


def session_features(sessions: DataFrame, action_details: Sequence[str] | None = None, device_types: Sequence[str] | None = None) -> DataFrame:
    """Counts by action detail and device, and totals, all in one grouping by user.

    The value lists fix the columns. Pass the training lists for new data; if they are not
    given they are read from the table, which takes one more pass.
    """
    if action_details is None or device_types is None:
        seen = key_values(sessions, "action_detail", "device_type")
    details = seen["action_detail"] if action_details is None else action_details
    devices = seen["device_type"] if device_types is None else device_types
    return sessions.groupBy("user_id").agg(
        *count_columns("action_detail", details),
        *count_columns("device_type", devices),
        F.avg("secs_elapsed").alias("avg_secs"),
        F.coalesce(F.sum("secs_elapsed"), F.lit(0.0)).alias("sum_secs"),
        F.count(F.lit(1)).alias("cnt_actions"),
    )


def wide_users(users: DataFrame, sessions: DataFrame, action_details: Sequence[str] | None = None, device_types: Sequence[str] | None = None) -> DataFrame:
    """Users that have sessions, with all session features."""
    features = session_features(sessions.where(F.col("user_id") != ""), action_details, device_types)
    return inner_join_on(users, features, "id", "user_id")


def users_with_sessions(users: DataFrame, sessions: DataFrame, ties: str = "keep") -> DataFrame:
    """All users with totals, top device and seconds per action; no sessions gives nulls
    and the device ``unknown``."""
    known = sessions.where(F.col("user_id") != "")
    joined = left_join_on(users, session_profile(known, ties), "id", "user_id")
    return joined.withColumns(
        {
            "secs_per_action": ratio(F.col("sum_secs"), F.col("cnt_actions")),
            "top_device": null_to(F.col("top_device")),
        }
    )


def read_users(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """User file with the first-active date parsed from its compact text."""
    raw = read_declared(spark, path, LABELLED_USER_COLUMNS if labelled else USER_COLUMNS)
    return raw.withColumn("date_first_active", compact_timestamp_date(F.col("timestamp_first_active"))).drop("timestamp_first_active")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return read_declared(spark, path, SESSION_COLUMNS)


def read_wide_users(spark: SparkSession, users_path: str, sessions_path: str | None = None, labelled: bool = True) -> DataFrame:
    """Files to the wide user table; without a session file just the users."""
    users = read_users(spark, users_path, labelled)
    if sessions_path is None:
        return users
    return wide_users(users, read_sessions(spark, sessions_path))
