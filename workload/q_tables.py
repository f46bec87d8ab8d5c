"""Sources, projection, filters, joins, reshape, unions and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.cluster import scratch_path
from waymark.functions.labels import DESTINATION_REGIONS
from waymark.functions.scalars import without
from waymark.operators import columns as C
from waymark.operators import profile as A
from waymark.operators import reshape as R
from waymark.operators import rows as N
from waymark.operators import windows as W
from waymark.sources import delimited as D
from waymark.sources.snapshots import read_snapshot, write_snapshot
from workload.adapters import (
    COUNTRIES, SESSIONS, TUNING, USERS, countries, sessions, table, tuning_results, users,
)
from workload.registry import query, sql

# Sources. Files are written to and read back from the shared checkpoint folder.

FILE_COLUMNS = {
    "id": "id", "date_account_created": "date", "timestamp_first_active": "text", "date_first_booking": "date", "gender": "text",
    "age": "number", "balance": "double", "first_affiliate_tracked": "text", "country_destination": "text", "dataset": "skip",
}


@query(
    "S1_declared_csv",
    sql(
        "SELECT id, CAST(date_account_created AS VARCHAR) AS date_account_created, timestamp_first_active, CAST(date_first_booking AS VARCHAR) AS date_first_booking, gender, round(age, 6) AS age, round(balance, 6) AS balance, first_affiliate_tracked, country_destination FROM users",
        USERS,
    ),
)
def s1(spark, folder):
    path = scratch_path(spark, "users-csv")
    D.write_delimited(users(spark, folder).select(*FILE_COLUMNS), path)
    return D.read_declared(spark, path, FILE_COLUMNS)


@query("S2_inferred_csv", sql("SELECT country_destination, round(lat_destination, 6) AS lat_destination, CAST(distance_km AS DOUBLE) AS distance_km FROM countries", COUNTRIES))
def s2(spark, folder):
    path = scratch_path(spark, "countries-csv")
    D.write_delimited(countries(spark, folder).select("country_destination", "lat_destination", "distance_km"), path)
    return D.read_inferred(spark, path)


@query("S10_csv_sink", sql("SELECT event_id, user_id, action_detail, round(secs_elapsed, 6) AS secs_elapsed FROM sessions", SESSIONS))
def s10(spark, folder):
    path = scratch_path(spark, "sessions-csv")
    D.write_delimited(sessions(spark, folder).select("event_id", "user_id", "action_detail", "secs_elapsed"), path)
    kinds = {"event_id": "double", "user_id": "id", "action_detail": "text", "secs_elapsed": "double"}
    return D.read_declared(spark, path, kinds).withColumn("event_id", F.col("event_id").cast("bigint"))


@query("S11_snapshot", sql("SELECT id, CAST(date_account_created AS VARCHAR) AS date_account_created, round(age, 6) AS age, dataset FROM users WHERE dataset = 'train'", USERS))
def s11(spark, folder):
    path = scratch_path(spark, "users-snapshot")
    kept = users(spark, folder).select("id", "date_account_created", "age", "dataset")
    write_snapshot(kept, path, ["dataset"])
    return read_snapshot(spark, path).where("dataset = 'train'")


@query("S3_null_tokens", sql("SELECT device_type, count(*) AS n FROM (SELECT CASE WHEN device_type NOT IN ('d1', 'd3') THEN device_type END AS device_type FROM sessions) AS s GROUP BY 1", SESSIONS))
def s3(spark, folder):
    return A.counts(D.null_tokens(sessions(spark, folder).select("device_type"), ["d1", "d3"]), "device_type")


@query("S4_skip_column", "SELECT r_name FROM region")
def s4(spark, folder):
    return table(spark, folder, "region").drop("r_regionkey")


@query(
    "S5_lenient_number",
    "SELECT o_orderkey, round(o_totalprice, 6) AS amount, CAST(o_orderkey % 100 AS DOUBLE) * 1000.0 AS grouped, CAST(NULL AS DOUBLE) AS none, CAST(-(10 + o_orderkey % 90) AS DOUBLE) / 100 AS part FROM orders",
)
def s5(spark, folder):
    cell = F.concat(F.lit("EUR "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" net"))
    grouped = F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(",000"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        D.lenient_number(cell).alias("amount"),
        D.lenient_number(grouped).alias("grouped"),
        D.lenient_number(F.col("o_orderpriority").substr(3, 20)).alias("none"),
        D.lenient_number(F.concat(F.lit("about -."), (F.col("o_orderkey") % 90 + 10).cast("string"))).alias("part"),
    )


@query(
    "S6_date_by_pattern",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
)
def s6(spark, folder):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    cell = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("x"), day)).otherwise(day)
    return table(spark, folder, "orders").select("o_orderkey", D.date_by_pattern(cell).alias("day"))


@query(
    "S7_declared_levels",
    "SELECT o_orderpriority AS level, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS o_orderpriority FROM orders) AS o GROUP BY 1",
)
def s7(spark, folder):
    level = D.within_levels(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])
    return A.counts(table(spark, folder, "orders").select(level.alias("level")), "level")


@query(
    "S8_discover_levels",
    """SELECT 'lang' AS "column", lang AS level, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'lang', 'xx', 0""",
)
def s8(spark, folder):
    from waymark.features.levels import discover_levels

    return discover_levels(table(spark, folder, "documents"), ["lang", "source"], {"lang": ["xx", "en"]})


@query("S9_dataset_tag", "SELECT 'train' AS dataset, count(*) AS n FROM customer")
def s9(spark, folder):
    return A.counts(D.tagged(table(spark, folder, "customer"), "train"), "dataset")


@query(
    "S13_literal_table",
    "SELECT d.new AS region, count(*) AS n FROM documents JOIN (VALUES ('en', 'island'), ('de', 'mainland'), ('fr', 'mainland'), ('es', 'mainland')) AS d(old, new) ON lang = d.old GROUP BY 1",
)
def s13(spark, folder):
    pairs = D.literal_table(spark, [("en", "island"), ("de", "mainland"), ("fr", "mainland"), ("es", "mainland")], "old string, new string")
    joined = table(spark, folder, "documents").join(pairs, F.col("lang") == F.col("old"))
    return A.counts(joined.select(F.col("new").alias("region")), "region")


# Projection


@query("P1_select", "SELECT c_custkey, c_mktsegment FROM customer")
def p1(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", "c_mktsegment")


@query("P2_drop", "SELECT n_nationkey + 0 AS n_nationkey, n_name FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation) AS n")
def p2(spark, folder):
    return table(spark, folder, "nation").drop("n_regionkey")


@query("P3_rename", "SELECT n_name AS nation, CAST(n_nationkey AS BIGINT) AS code FROM nation")
def p3(spark, folder):
    return table(spark, folder, "nation").select("n_name", "n_nationkey").withColumnsRenamed({"n_name": "nation", "n_nationkey": "code"})


@query("P4_rename_by_rule", "SELECT o_orderkey AS orderkey_o, o_custkey AS custkey_o, o_orderstatus FROM orders")
def p4(spark, folder):
    narrow = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return C.rename_by_rule(narrow, lambda n: f"{n[2:]}_o", C.named(narrow, ends="key"))


@query("P5_computed_columns", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem")
def p5(spark, folder):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, folder, "lineitem").withColumns({"net": net, "gross": net * (1 + F.col("l_tax"))}).select("l_orderkey", "l_linenumber", "net", "gross")


@query("P6_select_by_type", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM part")
def p6(spark, folder):
    part = table(spark, folder, "part")
    return part.select(*C.numeric_columns(part))


@query("P7_select_by_name", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM (SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM orders) AS o")
def p7(spark, folder):
    orders = table(spark, folder, "orders")
    between = C.column_range(orders, "o_orderstatus", "o_totalprice")
    return orders.select("o_orderkey", *between, *C.named(orders, starts="o_order", contains="prior"))


@query("P8_apply_across", "SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand, upper(p_type) AS p_type FROM part")
def p8(spark, folder):
    part = table(spark, folder, "part")
    return C.apply_across(part, C.nominal_columns(part), F.upper).select("p_partkey", "p_name", "p_brand", "p_type")


@query("P9_attach_by_id", sql("SELECT id, country_destination, date_part('year', date_account_created) AS year FROM users".replace("date_part('year', date_account_created)", "CAST(date_part('year', date_account_created) AS BIGINT)"), USERS))
def p9(spark, folder):
    u = users(spark, folder)
    extra = u.select("id", F.year("date_account_created").alias("year"))
    return C.attach_by_id(u.select("id", "country_destination"), extra, ["id"])


@query("P10_roles", sql("SELECT round(avg(age), 6) AS age, round(avg(balance), 6) AS balance FROM users", USERS))
def p10(spark, folder):
    u = users(spark, folder)
    return u.agg(*[F.avg(c).alias(c) for c in C.Roles().numeric(u)])


@query("P11_drop_in_pipeline", sql("SELECT id, gender, country_destination FROM users", USERS))
def p11(spark, folder):
    from waymark.features.levels import DropColumns

    u = users(spark, folder).select("id", "gender", "date_first_booking", "country_destination")
    return DropColumns("date_first_booking").transform(u)


@query("P12_extract_dataset", sql("SELECT id, gender, country_destination FROM users WHERE dataset = 'test'", USERS))
def p12(spark, folder):
    u = users(spark, folder).select("id", "gender", "date_first_booking", "country_destination", "dataset")
    return C.extract_dataset(u, "test")


@query("P13_pull_column", "SELECT round(o_totalprice, 6) AS o_totalprice FROM orders")
def p13(spark, folder):
    return table(spark, folder, "orders").select("o_totalprice")


@query("P13_pull_value", "SELECT round(max(o_totalprice), 6) AS top FROM orders")
def p13_value(spark, folder):
    return table(spark, folder, "orders").select("o_totalprice").agg(F.max("o_totalprice").alias("top"))


# Filters


@query("F1_comparison", sql("SELECT event_id, user_id, round(secs_elapsed, 6) AS secs_elapsed FROM sessions WHERE user_id <> '' AND secs_elapsed > 100", SESSIONS))
def f1(spark, folder):
    s = sessions(spark, folder)
    return s.where((F.col("user_id") != "") & (F.col("secs_elapsed") > 100)).select("event_id", "user_id", "secs_elapsed")


@query("F2_membership", sql("SELECT event_id, device_type FROM sessions WHERE NOT coalesce(device_type IN ('d1', 'd2'), FALSE)", SESSIONS))
def f2(spark, folder):
    s = sessions(spark, folder)
    return s.where(without(F.col("device_type"), ["d1", "d2"])).select("event_id", "device_type")


@query("F3_null_predicate", sql("SELECT event_id FROM sessions WHERE device_type IS NULL AND secs_elapsed IS NOT NULL", SESSIONS))
def f3(spark, folder):
    return sessions(spark, folder).where(F.col("device_type").isNull() & F.col("secs_elapsed").isNotNull()).select("event_id")


@query("F4_complete_rows", sql("SELECT event_id FROM sessions WHERE device_type IS NOT NULL AND secs_elapsed IS NOT NULL AND action_type IS NOT NULL", SESSIONS))
def f4(spark, folder):
    return N.complete_rows(sessions(spark, folder), ["device_type", "secs_elapsed", "action_type"]).select("event_id")


@query("F5_not_all_null", sql("SELECT device_type, round(secs_elapsed, 6) AS secs_elapsed FROM sessions WHERE NOT (device_type IS NULL AND secs_elapsed IS NULL)", SESSIONS))
def f5(spark, folder):
    return N.not_all_null(sessions(spark, folder).select("device_type", "secs_elapsed"))


@query("F6_omit_at_fit", sql("SELECT dataset, count(*) AS n FROM users WHERE dataset = 'test' OR age IS NOT NULL GROUP BY dataset", USERS))
def f6(spark, folder):
    from waymark.features.prepare import OmitIncomplete

    u = users(spark, folder)
    train, test = u.where("dataset = 'train'"), u.where("dataset = 'test'")
    step = OmitIncomplete(columns=["age"]).fit(train)
    return A.counts(step.training_rows(train).unionByName(step.transform(test)), "dataset")


@query("F7_overwrite_where", sql("SELECT id, round(CASE WHEN age > 104 THEN NULL ELSE age END, 6) AS age FROM users", USERS))
def f7(spark, folder):
    return N.overwrite_where(users(spark, folder), "age", F.col("age") > 104, None).select("id", "age")


@query("F8_rows_at_maximum", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def f8(spark, folder):
    return N.rows_at_maximum(table(spark, folder, "part"), "p_size").select("p_partkey", "p_size")


# Joins


@query("J1_left_join", sql("SELECT id, n FROM users LEFT JOIN (SELECT user_id, count(*) AS n FROM sessions GROUP BY 1) AS s ON id = s.user_id", USERS, SESSIONS))
def j1(spark, folder):
    return N.left_join_on(users(spark, folder).select("id"), A.counts(sessions(spark, folder), "user_id"), "id", "user_id")


@query("J2_natural_left_join", sql("SELECT id, country_destination, destination_language, round(distance_km, 6) AS distance_km FROM users LEFT JOIN countries USING (country_destination)", USERS, COUNTRIES))
def j2(spark, folder):
    right = countries(spark, folder).select("country_destination", "destination_language", "distance_km")
    return N.natural_join(users(spark, folder).select("id", "country_destination"), right)


@query(
    "J3_inner_join_chain",
    sql(
        """SELECT id, actions, round(secs, 6) AS secs FROM users
JOIN (SELECT user_id, count(*) AS actions FROM sessions GROUP BY 1) AS a ON id = a.user_id
JOIN (SELECT user_id, coalesce(sum(secs_elapsed), 0.0) AS secs FROM sessions GROUP BY 1) AS b ON id = b.user_id""",
        USERS, SESSIONS,
    ),
)
def j3(spark, folder):
    s = sessions(spark, folder)
    # The two session tables share their key, so they are one grouping here.
    both = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("actions"), F.coalesce(F.sum("secs_elapsed"), F.lit(0.0)).alias("secs"))
    return N.inner_join_on(users(spark, folder).select("id"), both, "id", "user_id")


@query("J4_natural_inner_join", sql("SELECT id, country_destination, destination_language FROM users JOIN countries USING (country_destination)", USERS, COUNTRIES))
def j4(spark, folder):
    right = countries(spark, folder).select("country_destination", "destination_language")
    return N.natural_join(users(spark, folder).select("id", "country_destination"), right, "inner")


@query("J5_grid", "SELECT a.o_orderstatus, b.o_orderpriority FROM (SELECT DISTINCT o_orderstatus FROM orders) AS a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) AS b")
def j5(spark, folder):
    return N.level_grid(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "J6_lookup_remap",
    "SELECT coalesce(m.new, p_type) AS p_type, count(*) AS n FROM part LEFT JOIN (VALUES ('ECONOMY', 'cheap'), ('PROMO', 'cheap'), ('LARGE', 'big')) AS m(old, new) ON p_type = m.old GROUP BY 1",
)
def j6(spark, folder):
    out = N.lookup_replace(table(spark, folder, "part").select("p_type"), "p_type", {"ECONOMY": "cheap", "PROMO": "cheap", "LARGE": "big"})
    return A.counts(out, "p_type")


@query("J7_members_of_set", sql("SELECT event_id FROM sessions WHERE coalesce(device_type, '?') NOT IN (SELECT d FROM (SELECT coalesce(device_type, '?') AS d, rank() OVER (ORDER BY count(*) DESC) AS r FROM sessions GROUP BY 1) AS k WHERE r <= 2)", SESSIONS))
def j7(spark, folder):
    s = sessions(spark, folder)
    top = W.top_levels(A.counts(s, "device_type"), "n", 2)
    return N.members(s, top.select("device_type"), "device_type", inside=False).select("event_id")


# Unions and reshape


@query("U1_union_by_name", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def u1(spark, folder):
    narrow = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return N.stack_tables(narrow.where("c_custkey % 5 <> 0"), narrow.where("c_custkey % 5 = 0").drop("c_mktsegment"))


@query("U2_tagged_union", "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS data_set, count(*) AS n FROM customer GROUP BY 1")
def u2(spark, folder):
    c = table(spark, folder, "customer")
    return A.counts(N.stack_tagged({"train": c.where("c_custkey % 5 <> 0"), "test": c.where("c_custkey % 5 = 0")}), "data_set")


@query("U3_split_by_column", sql("SELECT dataset AS part, id, country_destination FROM users", USERS))
def u3(spark, folder):
    parts = N.split_by(users(spark, folder).select("id", "country_destination", "dataset"), "dataset", ["train", "test"])
    return N.stack_tagged(parts, "part")


@query("U4_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def u4(spark, folder):
    return table(spark, folder, "part").select("p_brand", "p_type").distinct()


@query(
    "R1_spread_counts",
    sql(
        "SELECT user_id, count(CASE WHEN device_type IS NULL THEN 1 END) AS device_type_NA, "
        + ", ".join(f"count(CASE WHEN device_type = '{v}' THEN 1 END) AS device_type_{v}" for v in ("d0", "d1", "d2", "d3"))
        + " FROM sessions GROUP BY user_id",
        SESSIONS,
    ),
)
def r1(spark, folder):
    return R.spread_counts(sessions(spark, folder), "user_id", "device_type")


@query("R2_gather", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 'l_tax' AS part, round(l_tax, 6) AS value FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT), 'l_discount', round(l_discount, 6) FROM lineitem")
def r2(spark, folder):
    return R.gather(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"], "part", "value")


@query("R3_gather_numeric", "SELECT p_brand, 'p_size' AS feature, round(CAST(p_size AS DOUBLE), 6) AS value FROM part UNION ALL SELECT p_brand, 'p_retailprice', round(p_retailprice, 6) FROM part UNION ALL SELECT p_brand, 'p_partkey', CAST(p_partkey AS DOUBLE) FROM part")
def r3(spark, folder):
    return R.gather_numeric(table(spark, folder, "part"), ["p_brand"])


@query("R4_widen_one", sql("SELECT config, round(max(CASE WHEN metric = 'accuracy' THEN mean END), 6) AS best_accuracy, round(max(CASE WHEN metric = 'roc_auc' THEN mean END), 6) AS best_roc_auc FROM collected GROUP BY config", TUNING))
def r4(spark, folder):
    means = tuning_results(spark, folder).groupBy("config", "metric").agg(F.avg("value").alias("mean"))
    return R.widen(means, ["config"], "metric", ["accuracy", "roc_auc"], ["mean"], prefix="best")


@query(
    "R5_widen_several",
    sql(
        """SELECT config, round(max(CASE WHEN metric = 'accuracy' THEN m END), 6) AS mean_accuracy, round(max(CASE WHEN metric = 'roc_auc' THEN m END), 6) AS mean_roc_auc,
  round(max(CASE WHEN metric = 'accuracy' THEN s END), 6) AS sd_accuracy, round(max(CASE WHEN metric = 'roc_auc' THEN s END), 6) AS sd_roc_auc
FROM (SELECT config, metric, avg(value) AS m, stddev_samp(value) AS s FROM tuning GROUP BY 1, 2) AS t GROUP BY config""",
        TUNING,
    ),
)
def r5(spark, folder):
    spread = A.spread_summary(tuning_results(spark, folder), ["config", "metric"], "value")
    return R.widen(spread, ["config"], "metric", ["accuracy", "roc_auc"], ["mean", "sd"])


# Ordering


@query("O1_sort", sql("SELECT event_id, device_type FROM sessions ORDER BY device_type DESC NULLS LAST, event_id", SESSIONS))
def o1(spark, folder):
    return N.sort_nulls_last(sessions(spark, folder).select("event_id", "device_type"), ("device_type", True), ("event_id", False))


@query("O2_count_sorted", sql("SELECT user_id, count(*) AS n FROM sessions GROUP BY user_id ORDER BY n DESC, user_id", SESSIONS))
def o2(spark, folder):
    return A.counts(sessions(spark, folder), "user_id", sort=True)


@query("O3_first_rows", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o3(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(
    "O4_sorted_importance",
    sql(
        "SELECT feature, round(sum(importance), 6) AS importance FROM (SELECT split_part(p_name, ' ', 1) AS feature, p_retailprice / 1000000 AS importance FROM part) AS f GROUP BY feature ORDER BY importance DESC, feature"
    ),
)
def o4(spark, folder):
    from waymark.features.prepare import grouped_importance

    named = F.regexp_replace("p_name", " ", "_").alias("feature")
    return grouped_importance(table(spark, folder, "part").select(named, (F.col("p_retailprice") / 1000000).alias("importance")))


@query("C15_regions", sql("SELECT region, count(*) AS n FROM (SELECT CASE WHEN country_destination = 'NDF' THEN 'NDF' WHEN destination_language = 'africa' THEN 'EUR' ELSE 'US' END AS region FROM users LEFT JOIN countries USING (country_destination)) AS u GROUP BY region", USERS, COUNTRIES))
def c15(spark, folder):
    joined = N.natural_join(users(spark, folder).select("country_destination"), countries(spark, folder))
    code = F.when(F.col("country_destination") == "NDF", "NDF").when(F.col("destination_language") == "africa", "FR").otherwise("US")
    return A.counts(N.lookup_replace(joined.select(code.alias("region")), "region", DESTINATION_REGIONS), "region")
