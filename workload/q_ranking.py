"""Windows, top-n and scores of prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import metrics as E
from waymark.operators import profile as A
from waymark.operators import reshape as R
from waymark.operators import windows as W
from waymark.operators.rows import rows_at_maximum
from workload.adapters import BINARY, PREDICTIONS, SESSIONS, TUNING, USERS, binary_scores, predictions, sessions, table, tuning_results, users
from workload.q_values import CLEAN_AGE
from workload.registry import query, sql

CLASSES = 10


def long_predictions(spark, folder):
    return predictions(spark, folder).select("id", "truth", F.posexplode("prob").alias("class", "p"))


def hard(spark, folder):
    return predictions(spark, folder).select("id", "truth", W.likeliest_class(F.col("prob")).alias("predicted"))


@query("W1_share_of_total", sql("SELECT age_range, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pcnt FROM ranged GROUP BY 1", USERS, CLEAN_AGE))
def w1(spark, folder):
    from workload.q_profile import aged

    return W.share_of_total(A.counts(aged(spark, folder), "age_range"))


_CUMULATIVE = "SELECT p_name, n, round(pcnt, 6) AS pcnt, round(sum(pcnt) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING), 6) AS cumpcnt FROM (SELECT p_name, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS pcnt FROM part GROUP BY 1) AS t"


@query("W2_cumulative_share", _CUMULATIVE.format(order="n DESC, p_name"))
def w2(spark, folder):
    return W.cumulative_share(A.counts(table(spark, folder, "part"), "p_name"), "p_name")


@query("W2_cumulative_by_key", _CUMULATIVE.format(order="p_name"))
def w2_key(spark, folder):
    return W.cumulative_share(A.counts(table(spark, folder, "part"), "p_name"), "p_name", by_count=False)


@query("W3_top_n_ties", sql("SELECT user_id, device_type, n FROM (SELECT user_id, device_type, count(*) AS n, rank() OVER (PARTITION BY user_id ORDER BY count(*) DESC) AS r FROM sessions GROUP BY 1, 2) AS t WHERE r <= 1", SESSIONS))
def w3(spark, folder):
    return W.top_n_ties(A.counts(sessions(spark, folder), "user_id", "device_type"), ["user_id"], "n", 1)


@query("W3_top_n_ties_hot", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, round(l_quantity, 6) AS l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS r FROM lineitem) AS t WHERE r <= 5")
def w3_hot(spark, folder):
    narrow = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return W.top_n_ties_hot(narrow, ["l_returnflag"], "l_quantity", 5)


@query("W4_top_levels", "SELECT p_name, n FROM (SELECT p_name, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM part GROUP BY 1) AS t WHERE r <= 5")
def w4(spark, folder):
    return W.top_levels(A.counts(table(spark, folder, "part"), "p_name"), "n", 5)


@query("W5_dense_rank", sql("SELECT id, class, dense_rank() OVER (PARTITION BY id ORDER BY p DESC) AS score FROM predictions", PREDICTIONS))
def w5(spark, folder):
    return W.dense_ranked(long_predictions(spark, folder), ["id"], "p", "score").select("id", "class", "score")


@query("W6_best_row", sql("SELECT metric, config, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, config) AS r FROM collected) AS t WHERE r = 1", TUNING))
def w6(spark, folder):
    means = tuning_results(spark, folder).groupBy("metric", "config").agg(F.avg("value").alias("mean"))
    return W.first_per_key(means, ["metric"], [F.desc("mean"), F.asc("config")])


@query("W7_share_within", sql("SELECT user_id, device_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS pcnt FROM (SELECT user_id, device_type, count(*) AS n FROM sessions GROUP BY 1, 2) AS t", SESSIONS))
def w7(spark, folder):
    return W.share_within(A.counts(sessions(spark, folder), "user_id", "device_type"), ["user_id"], "n")


_SHARES = """shares AS (SELECT id, class, p / sum(p) OVER (PARTITION BY id) AS pcnt FROM ranked WHERE r <= 5),
summed AS (SELECT *, sum(pcnt) OVER (PARTITION BY id ORDER BY pcnt DESC, class ROWS UNBOUNDED PRECEDING) AS cum_pcnt FROM shares)"""


@query("W8_nucleus", sql("SELECT id, class, round(pcnt, 6) AS pcnt, round(cum_pcnt, 6) AS cum_pcnt FROM summed WHERE cum_pcnt < 0.85", PREDICTIONS, _SHARES))
def w8(spark, folder):
    top = W.top_n_ties(long_predictions(spark, folder), ["id"], "p", 5)
    return W.nucleus(top, ["id"], "p", "class").select("id", "class", "pcnt", "cum_pcnt")


@query("W9_class_ranks", sql("SELECT id, class, r AS place FROM ranked", PREDICTIONS))
def w9(spark, folder):
    ordered = predictions(spark, folder).select("id", F.posexplode(W.class_order(F.col("prob"))).alias("pos", "class"))
    return ordered.select("id", "class", (F.col("pos") + 1).alias("place"))


@query("W10_first_per_key", sql("SELECT user_id, event_id, action FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM sessions) AS t WHERE r = 1", SESSIONS))
def w10(spark, folder):
    return W.first_per_key(sessions(spark, folder).select("user_id", "event_id", "action"), ["user_id"], [F.asc("event_id")])


@query("W11_likeliest_class", sql("SELECT id, truth, predicted FROM (SELECT id, CAST(truth AS BIGINT) AS truth, predicted FROM scored) AS s", PREDICTIONS))
def w11(spark, folder):
    return hard(spark, folder)


@query("W12_first_n", "SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def w12(spark, folder):
    return table(spark, folder, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


# Scores


@query("E1_gain", sql("SELECT id, truth_rank AS place, round(1 / log2(truth_rank + 1), 6) AS gain FROM scored", PREDICTIONS))
def e1(spark, folder):
    ranked = predictions(spark, folder).select("id", W.class_rank(F.col("prob"), F.col("truth")).alias("place"))
    return ranked.withColumn("gain", E.gain_at_rank(F.col("place")))


@query("E2_ndcg_at_5", sql("SELECT round(avg(CASE WHEN truth_rank <= 5 THEN 1 / log2(truth_rank + 1) ELSE 0 END), 6) AS ndcg FROM scored", PREDICTIONS))
def e2(spark, folder):
    return predictions(spark, folder).agg(E.ndcg(F.col("prob"), F.col("truth"), 5).alias("ndcg"))


@query("E3_ndcg_all", sql("SELECT round(avg(1 / log2(truth_rank + 1)), 6) AS ndcg FROM scored", PREDICTIONS))
def e3(spark, folder):
    return predictions(spark, folder).agg(E.ndcg(F.col("prob"), F.col("truth")).alias("ndcg"))


@query(
    "E4_pair_ndcg",
    sql(
        "SELECT round((SELECT sum(CASE WHEN class = truth THEN 1 ELSE 0 END / log2(r + 1)) FROM ranked) / (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM ranked WHERE class = truth))) AS i) AS q), 6) AS ndcg",
        PREDICTIONS,
    ),
)
def e4(spark, folder):
    ranked = predictions(spark, folder).select("truth", F.posexplode(W.class_order(F.col("prob"))).alias("pos", "class"))
    pairs = ranked.select((F.col("pos") + 1).alias("rank"), (F.col("class") == F.col("truth")).cast("int").alias("relevance"))
    return E.pair_ndcg(pairs, "rank", "relevance")


@query("E5_top1_accuracy", sql("SELECT round(avg(CASE WHEN predicted = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored", PREDICTIONS))
def e5(spark, folder):
    return predictions(spark, folder).agg(F.avg(E.hit(F.col("prob"), F.col("truth"))).alias("accuracy"))


@query("E6_binary_accuracy", sql("SELECT round(avg(CASE WHEN (predicted = 0) = (truth = 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored", PREDICTIONS))
def e6(spark, folder):
    return predictions(spark, folder).agg(F.avg(E.first_class_hit(F.col("prob"), F.col("truth"))).alias("accuracy"))


@query("E7_label_accuracy", sql("SELECT round(avg(CASE WHEN predicted = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored", PREDICTIONS))
def e7(spark, folder):
    return E.accuracy(hard(spark, folder), "truth", "predicted")


@query(
    "E8_score_bundle",
    sql(
        "SELECT "
        + ", ".join(
            f"round(avg(CASE WHEN {test} THEN {value} END), 6) AS {d}_{name}"
            for d, test in (("train", "id % 5 <> 0"), ("test", "id % 5 = 0"))
            for name, value in (
                ("acc", "CASE WHEN predicted = truth THEN 1.0 ELSE 0.0 END"),
                ("binary_acc", "CASE WHEN (predicted = 0) = (truth = 0) THEN 1.0 ELSE 0.0 END"),
                ("ndcg", "1 / log2(truth_rank + 1)"),
            )
        )
        + " FROM scored",
        PREDICTIONS,
    ),
)
def e8(spark, folder):
    tagged = predictions(spark, folder).withColumn("dataset", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    return E.score_bundle(tagged)


@query(
    "E9_confusion",
    sql(
        "SELECT CAST(p.i AS BIGINT) AS predicted, CAST(t.i AS BIGINT) AS truth, count(id) AS n FROM (SELECT unnest(range(0, 10)) AS i) AS p CROSS JOIN (SELECT unnest(range(0, 10)) AS i) AS t LEFT JOIN scored ON predicted = p.i AND truth = t.i GROUP BY 1, 2",
        PREDICTIONS,
    ),
)
def e9(spark, folder):
    return E.confusion(hard(spark, folder), "truth", "predicted", list(range(CLASSES)))


_PER_CLASS = """per_class AS (
  SELECT CAST(c.i AS BIGINT) AS class, count(CASE WHEN truth = c.i AND predicted = c.i THEN 1 END) AS tp, count(CASE WHEN truth = c.i THEN 1 END) AS pos,
    count(CASE WHEN predicted = c.i THEN 1 END) AS pred, count(*) AS total
  FROM scored CROSS JOIN (SELECT unnest(range(0, 10)) AS i) AS c GROUP BY 1 HAVING count(CASE WHEN truth = c.i OR predicted = c.i THEN 1 END) > 0)"""


@query(
    "E10_class_measures",
    sql(
        """SELECT class, round(tp / nullif(pos, 0), 6) AS sensitivity, round((total - pos - pred + tp) / nullif(total - pos, 0), 6) AS specificity,
  round(tp / nullif(pred, 0), 6) AS ppv, round((total - pos - pred + tp) / nullif(total - pred, 0), 6) AS npv, round(pos / total, 6) AS prevalence,
  round((tp / nullif(pos, 0) + (total - pos - pred + tp) / nullif(total - pos, 0)) / 2, 6) AS balanced_accuracy FROM per_class""",
        PREDICTIONS, _PER_CLASS,
    ),
)
def e10(spark, folder):
    return E.class_measures(hard(spark, folder), "truth", "predicted")


@query(
    "E11_kappa",
    sql(
        "SELECT round(po, 6) AS accuracy, round(nir, 6) AS no_information_rate, round((po - pe) / (1 - pe), 6) + 0.0 AS kappa FROM (SELECT sum(tp) / max(total) AS po, max(pos) / max(total) AS nir, sum(pos * pred) / (CAST(max(total) AS DOUBLE) * max(total)) AS pe FROM per_class) AS k",
        PREDICTIONS, _PER_CLASS,
    ),
)
def e11(spark, folder):
    return E.overall_measures(hard(spark, folder), "truth", "predicted")


@query("E12_macro_precision", sql("SELECT round(avg(tp / nullif(pred, 0)), 6) AS ppv FROM per_class", PREDICTIONS, _PER_CLASS))
def e12(spark, folder):
    return E.macro_precision(hard(spark, folder), "truth", "predicted")


@query(
    "E13_roc_curve",
    sql(
        "SELECT round(threshold, 6) AS threshold, round(tp / p, 6) AS sensitivity, round(1 - fp / n, 6) + 0.0 AS specificity FROM (SELECT score AS threshold, sum(sum(CASE WHEN booked THEN 1 ELSE 0 END)) OVER (ORDER BY score DESC) AS tp, sum(sum(CASE WHEN booked THEN 0 ELSE 1 END)) OVER (ORDER BY score DESC) AS fp, (SELECT count(*) FROM scores WHERE booked) AS p, (SELECT count(*) FROM scores WHERE NOT booked) AS n FROM scores GROUP BY score) AS t",
        BINARY,
    ),
)
def e13(spark, folder):
    return E.roc_points(binary_scores(spark, folder), "score", F.col("booked"))


@query(
    "E13_roc_one_vs_rest",
    sql(
        """SELECT class, round(score, 6) AS threshold, round(sum(tp) OVER (PARTITION BY class ORDER BY score DESC) / sum(tp) OVER (PARTITION BY class), 6) AS sensitivity,
  round(1 - sum(fp) OVER (PARTITION BY class ORDER BY score DESC) / sum(fp) OVER (PARTITION BY class), 6) + 0.0 AS specificity FROM one_rest""",
        PREDICTIONS,
        """one_rest AS (
  SELECT class, p AS score, sum(CASE WHEN class = truth THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN class = truth THEN 0 ELSE 1 END) AS fp
  FROM predictions GROUP BY 1, 2)""",
    ),
)
def e13_many(spark, folder):
    long = E.one_vs_rest(predictions(spark, folder), "prob", "truth", CLASSES)
    return E.roc_points(long, "score", F.col("positive"), ["class"], range_rows=500)


_AUC = "SELECT {keys} round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) / count(*), 6) AS roc_auc FROM {source}"


@query("E14_roc_auc", sql(_AUC.format(keys="", source="scores AS p JOIN scores AS n ON p.booked AND NOT n.booked"), BINARY))
def e14(spark, folder):
    return E.roc_auc(binary_scores(spark, folder), "score", F.col("booked"))


@query(
    "E14_roc_auc_pairs",
    sql(
        """SELECT round(avg(auc), 6) AS roc_auc FROM (
  SELECT least(a, b) AS lo, greatest(a, b) AS hi, avg(auc) AS auc FROM (
    SELECT p.truth AS a, n.truth AS b, avg(CASE WHEN p.p > n.p THEN 1.0 WHEN p.p = n.p THEN 0.5 ELSE 0.0 END) AS auc
    FROM predictions AS p JOIN predictions AS n ON p.class = p.truth AND n.class = p.truth AND n.truth <> p.truth GROUP BY 1, 2) AS each
  GROUP BY 1, 2) AS pairs""",
        PREDICTIONS,
    ),
)
def e14_pairs(spark, folder):
    return E.roc_auc_pairs(predictions(spark, folder), "prob", "truth", CLASSES)


@query("E15_classify", sql("SELECT doc_id, CASE WHEN score > 0.5 THEN 'YES' ELSE 'NO' END AS predicted FROM scores", BINARY))
def e15(spark, folder):
    return binary_scores(spark, folder).select("doc_id", E.classify_at(F.col("score"), 0.5).alias("predicted"))


_SWEEP = """steps AS (SELECT CAST(i AS DOUBLE) / 2000 AS threshold, i FROM (SELECT unnest(range(0, 2001)) AS i) AS g),
sweep AS (
  SELECT threshold, count(CASE WHEN booked AND score >= threshold THEN 1 END) / count(CASE WHEN booked THEN 1 END) AS sensitivity,
    1 - count(CASE WHEN NOT booked AND score >= threshold THEN 1 END) / count(CASE WHEN NOT booked THEN 1 END) AS specificity
  FROM steps CROSS JOIN scores WHERE score IS NOT NULL GROUP BY threshold),
measured AS (
  SELECT round(threshold, 6) AS threshold, round(sensitivity, 6) AS sensitivity, round(specificity, 6) + 0.0 AS specificity,
    sensitivity + specificity - 1 AS j, (1 - sensitivity) * (1 - sensitivity) + (1 - specificity) * (1 - specificity) AS d FROM sweep)"""


@query("E16_threshold_sweep", sql("SELECT threshold, sensitivity, specificity, round(j, 6) + 0.0 AS j_index, round(d, 6) + 0.0 AS distance FROM measured", BINARY, _SWEEP))
def e16(spark, folder):
    return E.threshold_sweep(binary_scores(spark, folder), "score", F.col("booked"))


@query("E17_best_threshold", sql("SELECT threshold, round(j, 6) + 0.0 AS j_index FROM measured WHERE j = (SELECT max(j) FROM measured)", BINARY, _SWEEP))
def e17(spark, folder):
    return E.best_threshold(E.threshold_sweep(binary_scores(spark, folder), "score", F.col("booked"))).select("threshold", "j_index")


@query("E19_long_comparison", sql("SELECT id, 'truth' AS type, CAST(truth AS BIGINT) AS destination FROM scored UNION ALL SELECT id, 'predicted', predicted FROM scored", PREDICTIONS))
def e19(spark, folder):
    wide = hard(spark, folder).select("id", F.col("truth").cast("bigint").alias("truth"), F.col("predicted").cast("bigint").alias("predicted"))
    return R.gather(wide, ["id"], ["truth", "predicted"], "type", "destination")


# Tuning tables


@query("G5_collect_metrics", sql("SELECT config, trees, metric, round(mean, 6) AS mean, n, round(std_err, 6) AS std_err FROM collected", TUNING))
def g5(spark, folder):
    from waymark.models.tuning import collect_metrics

    return collect_metrics(tuning_results(spark, folder), ["config", "trees"])


@query("G6_show_best", sql("SELECT metric, config, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, config) AS r FROM collected) AS t WHERE r <= 5", TUNING))
def g6(spark, folder):
    from waymark.models.tuning import collect_metrics, show_best

    return show_best(collect_metrics(tuning_results(spark, folder), ["config", "trees"]), ["config"], 5).select("metric", "config", "mean")


@query(
    "G7_simplest_good",
    sql(
        """SELECT t.metric, 'one_std_err' AS rule, t.config, t.trees FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.metric ORDER BY c.trees, c.config) AS r FROM collected AS c JOIN best ON c.metric = best.metric WHERE c.mean >= best.mean - coalesce(best.std_err, 0)) AS t WHERE r = 1
UNION ALL SELECT t.metric, 'pct_loss', t.config, t.trees FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.metric ORDER BY c.trees, c.config) AS r FROM collected AS c JOIN best ON c.metric = best.metric WHERE (best.mean - c.mean) / best.mean * 100 <= 2) AS t WHERE r = 1""",
        TUNING, "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, config) AS r FROM collected) AS b WHERE r = 1)",
    ),
)
def g7(spark, folder):
    from waymark.models.tuning import collect_metrics, select_within_pct_loss, select_within_std_err

    metrics = collect_metrics(tuning_results(spark, folder), ["config", "trees"])
    near = select_within_std_err(metrics, ["config"], ["trees"]).withColumn("rule", F.lit("one_std_err"))
    loss = select_within_pct_loss(metrics, ["config"], ["trees"], 2.0).withColumn("rule", F.lit("pct_loss"))
    return near.unionByName(loss).select("metric", "rule", "config", "trees")


@query(
    "G8_tuning_summary",
    sql(
        "SELECT "
        + ", ".join(
            f"round(max(CASE WHEN metric = '{m}' THEN mean END), 6) AS best_{m}, round(avg(CASE WHEN metric = '{m}' THEN mean END), 6) AS mean_{m}, "
            f"round(stddev_samp(CASE WHEN metric = '{m}' THEN mean END), 6) AS sd_{m}, (SELECT config FROM collected WHERE metric = '{m}' ORDER BY mean DESC, config LIMIT 1) AS best_{m}_model"
            for m in ("accuracy", "roc_auc")
        )
        + " FROM collected",
        TUNING,
    ),
)
def g8(spark, folder):
    from waymark.models.tuning import collect_metrics, tuning_summary

    return tuning_summary(collect_metrics(tuning_results(spark, folder), ["config", "trees"]), "config", ["accuracy", "roc_auc"])


@query("F8_best_estimate", sql("SELECT config, metric, round(mean, 6) AS mean FROM collected WHERE mean = (SELECT max(mean) FROM collected)", TUNING))
def f8_best(spark, folder):
    return rows_at_maximum(tuning_results(spark, folder).groupBy("config", "metric").agg(F.avg("value").alias("mean")), "mean")
