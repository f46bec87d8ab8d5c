"""CSV edge cells, snapshots and saved steps."""

import datetime as dt

from pyspark.sql import functions as F

from waymark.features.levels import CommonLevels
from waymark.plans.munge import munge
from waymark.plans.sessions import read_sessions, read_users, read_wide_users, users_with_sessions
from waymark.sources import delimited as D
from waymark.sources import snapshots as P

USERS = """id,date_account_created,timestamp_first_active,date_first_booking,gender,age,signup_method,signup_flow,language,affiliate_channel,affiliate_provider,first_affiliate_tracked,signup_app,first_device_type,first_browser,country_destination
u1,2014-06-30,20090319043255,,-unknown-,"1,980",basic,0,en,direct,direct,null,Web,Mac,Chrome,NDF
u2,2014-13-01,bad,2014-07-02,MALE,abc,basic,0,en,direct,direct,empty,Web,Mac,-unknown-,US
u3,2014-01-01,20140101000000,2014-01-05,FEMALE,34,weibo,0,en,direct,direct,omg,Web,Mac,Chrome,FR
"""
SESSIONS = """user_id,action,action_type,action_detail,device_type,secs_elapsed
u1,show,view,p3,Mac Desktop,10
u1,show,view,p3,iPhone,null
u1,show,-unknown-,,Mac Desktop,30.5
,show,view,p3,iPhone,7
"",show,view,p3,iPhone,8
u3,show,view,p3,iPhone,x1
u3,show,view,p4,Mac Desktop,2
"""


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_declared_users(spark, tmp_path):
    rows = {r["id"]: r for r in read_users(spark, write(tmp_path, "users.csv", USERS)).collect()}
    assert rows["u1"]["age"] == 1980.0
    assert rows["u2"]["age"] is None
    assert rows["u1"]["date_first_active"] == dt.date(2009, 3, 19)
    assert rows["u2"]["date_first_active"] is None
    assert rows["u2"]["date_account_created"] is None
    assert rows["u1"]["date_first_booking"] is None
    assert rows["u1"]["first_affiliate_tracked"] is None and rows["u2"]["first_affiliate_tracked"] is None
    assert "timestamp_first_active" not in rows["u1"].asDict()


def test_empty_ids_are_kept_as_text(spark, tmp_path):
    sessions = read_sessions(spark, write(tmp_path, "sessions.csv", SESSIONS))
    assert sessions.where("user_id = ''").count() == 2
    assert sessions.where("user_id IS NULL").count() == 0
    assert sessions.where("secs_elapsed IS NULL").count() == 2


def test_wide_users_from_files(spark, tmp_path):
    out = read_wide_users(spark, write(tmp_path, "users.csv", USERS), write(tmp_path, "sessions.csv", SESSIONS))
    rows = {r["id"]: r for r in out.collect()}
    assert set(rows) == {"u1", "u3"}
    assert (rows["u1"]["action_detail_p3"], rows["u1"]["action_detail_NA"], rows["u1"]["device_type_Mac_Desktop"]) == (2, 1, 2)
    assert (rows["u1"]["avg_secs"], rows["u1"]["sum_secs"], rows["u1"]["cnt_actions"]) == (20.25, 40.5, 3)


def test_device_ties_repeat_users(spark, tmp_path):
    users = read_users(spark, write(tmp_path, "users.csv", USERS))
    sessions = read_sessions(spark, write(tmp_path, "sessions.csv", SESSIONS))
    assert users_with_sessions(users, sessions).where("id = 'u3'").count() == 2
    first = users_with_sessions(users, sessions, ties="first").where("id = 'u3'").collect()
    assert [r["top_device"] for r in first] == ["Mac Desktop"]
    assert users_with_sessions(users, sessions).where("id = 'u2'").first()["top_device"] == "unknown"


def test_munge_from_files(spark, tmp_path):
    path, log = write(tmp_path, "users.csv", USERS), write(tmp_path, "sessions.csv", SESSIONS)
    raw = D.read_declared(spark, path, D.LABELLED_USER_COLUMNS)
    train = D.tagged(raw.where("id <> 'u2'"), "train")
    test = D.tagged(raw.where("id = 'u2'").drop("country_destination"), "test")
    countries = spark.createDataFrame([("FR", 46.2, "fra")], "country_destination string, lat_destination double, destination_language string")
    rows = {r["id"]: r for r in munge(train, test, read_sessions(spark, log), countries, ties="first").collect()}
    assert rows["u1"]["days_book_signup"] == 550 and rows["u1"]["made_booking"] == "NO"
    assert rows["u1"]["age"] == 34.0 and rows["u1"]["age_range"] == "[30,35)" and rows["u1"]["gender"] == "unknown"
    assert rows["u2"]["made_booking"] is None and rows["u2"]["destination_language"] == "-unknown-"
    assert rows["u3"]["book_month"] == "January" and rows["u3"]["signup_season"] == "winter" and rows["u3"]["destination_language"] == "fra"


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("$1,234.50 net",), ("-7",), ("abc",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(D.lenient_number(F.col("c"))).collect()] == [1234.5, -7.0, None, None, None]


def test_declared_levels(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [r[0] for r in df.select(D.within_levels(F.col("c"), ["a", "b"])).collect()] == ["a", None, None]


def test_snapshot_and_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, "train"), ("b", None, "test")], "id string, x double, dataset string")
    P.write_snapshot(df, str(tmp_path / "snap"), ["dataset"])
    assert sorted(map(tuple, P.read_snapshot(spark, str(tmp_path / "snap")).select("id", "x", "dataset").collect())) == [("a", 1.5, "train"), ("b", None, "test")]
    D.write_delimited(df, str(tmp_path / "csv"))
    assert sorted(r["id"] for r in D.read_inferred(spark, str(tmp_path / "csv")).collect()) == ["a", "b"]


def test_saved_step_keeps_its_levels(spark, tmp_path):
    train = spark.createDataFrame([("a",)] * 5, "c string")
    step = CommonLevels(["c"]).fit(train)
    step.write().overwrite().save(str(tmp_path / "step"))
    from waymark.features.levels import FittedLumper

    again = FittedLumper.load(str(tmp_path / "step"))
    assert [r["c"] for r in again.transform(spark.createDataFrame([("q",)], "c string")).collect()] == ["Others"]


def test_bucketed_tables_join_without_a_shuffle(spark):
    left = spark.range(500).select((F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    P.write_bucketed(left, "bucketed_left", ["k"], 4)
    P.write_bucketed(right, "bucketed_right", ["k"], 4)
    try:
        joined = spark.table("bucketed_left").hint("merge").join(spark.table("bucketed_right"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 500 and joined.where("y <> 2 * k").count() == 0
    finally:
        spark.sql("DROP TABLE bucketed_left")
        spark.sql("DROP TABLE bucketed_right")
