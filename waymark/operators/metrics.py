"""Scores of prediction tables.

A prediction table has one row per observation: a zero-based ``truth`` and an array of
class probabilities. Ranking happens inside the array, so scoring is one pass and one
small aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.cluster import bounded_rows
from waymark.operators.profile import contingency
from waymark.operators.windows import class_rank, likeliest_class, running_totals


def gain_at_rank(rank: Column) -> Column:
    """Discounted gain of one relevant class at a one-based rank."""
    return F.lit(1.0) / F.log2(rank + 1)


def ranked_gain(probabilities: Column, truth: Column, k: int | None = None) -> Column:
    """Gain of the true class; zero beyond the first ``k`` if ``k`` is given."""
    rank = class_rank(probabilities, truth)
    gain = gain_at_rank(rank)
    return gain if k is None else F.when(rank <= k, gain).otherwise(0.0)


def ndcg(probabilities: Column, truth: Column, k: int | None = None) -> Column:
    """Mean gain. With ``k`` the list is cut there, without it all classes count."""
    return F.avg(ranked_gain(probabilities, truth, k))


def pair_ndcg(df: DataFrame, rank: str, relevance: str) -> DataFrame:
    """Gain of (estimated rank, relevance) pairs divided by the best reachable gain.

    The best order depends only on how often each relevance occurs: the rows of one
    relevance fill one run of consecutive places, and the discounts of all places are
    summed in parallel.
    """
    gain = lambda rel: F.pow(F.lit(2.0), rel) - 1
    actual = df.agg(F.sum(gain(F.col(relevance)) / F.log2(F.col(rank) + 1)).alias("dcg"))
    levels = bounded_rows(df.where(F.col(relevance) > 0).groupBy(relevance).agg(F.count(F.lit(1)).alias("n")))
    if levels is None:
        raise ValueError("relevance must have few different values")
    ideal, last = F.lit(0.0), 0
    for level in sorted(levels, key=lambda r: -r[relevance]):
        first, last = last + 1, last + level["n"]
        ideal = F.when((F.col("id") >= first) & (F.col("id") <= last), gain(F.lit(level[relevance]))).otherwise(ideal)
    places = df.sparkSession.range(1, last + 1)
    best = places.agg(F.sum(ideal / F.log2(F.col("id") + 1)))
    return actual.select(F.try_divide(F.col("dcg"), best.scalar()).alias("ndcg"))


def hit(probabilities: Column, truth: Column) -> Column:
    return (likeliest_class(probabilities) == truth).cast("double")


def first_class_hit(probabilities: Column, truth: Column) -> Column:
    """Agreement on whether the class is the first one."""
    return ((likeliest_class(probabilities) == 0) == (truth == 0)).cast("double")


def score_bundle(df: DataFrame, probabilities: str = "prob", truth: str = "truth", dataset: str = "dataset") -> DataFrame:
    """Accuracy, first-class accuracy and ndcg of the train and test rows, as one row."""
    p, t = F.col(probabilities), F.col(truth)
    scored = df.select(dataset, hit(p, t).alias("acc"), first_class_hit(p, t).alias("binary_acc"), ranked_gain(p, t).alias("ndcg"))
    cells = [
        F.avg(F.when(F.col(dataset) == d, F.col(m))).alias(f"{d}_{m}") for m in ("acc", "binary_acc", "ndcg") for d in ("train", "test")
    ]
    return scored.agg(*cells)


# Hard labels


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, truth: str, predicted: str, labels: Sequence | None = None) -> DataFrame:
    """Counts of every (predicted, truth) pair of the labels, zeros included."""
    if labels is None:
        return contingency(df, predicted, truth)
    seen = df.groupBy(predicted, truth).agg(F.count(F.lit(1)).alias("n"))
    one = df.sparkSession.range(1)
    kind = df.schema[truth].dataType.simpleString()
    values = F.lit(list(labels)).cast(f"array<{kind}>")
    grid = one.select(F.explode(values).alias(predicted)).select("*", F.explode(values).alias(truth))
    return grid.join(seen, [predicted, truth], "left").fillna(0, ["n"])


def class_measures(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Sensitivity, specificity, predictive values, prevalence and balanced accuracy per class."""
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    # Each cell adds to its true class and to its predicted class; one grouping sums both.
    own = cells.select(
        F.explode(
            F.array(
                F.struct(F.col(truth).alias("class"), F.col("n").alias("pos"), F.lit(0).cast("bigint").alias("pred"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("tp")),
                F.struct(F.col(predicted).alias("class"), F.lit(0).cast("bigint").alias("pos"), F.col("n").alias("pred"), F.lit(0).cast("bigint").alias("tp")),
            )
        ).alias("s")
    ).select("s.*")
    per_class = own.groupBy("class").agg(F.sum("pos").alias("pos"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp"))
    total = per_class.agg(F.sum("pos")).scalar()
    tp, pos, pred = F.col("tp"), F.col("pos"), F.col("pred")
    with_n = per_class.withColumn("total", total)
    tn = F.col("total") - pos - pred + tp
    return with_n.select(
        "class",
        F.try_divide(tp, pos).alias("sensitivity"),
        F.try_divide(tn, F.col("total") - pos).alias("specificity"),
        F.try_divide(tp, pred).alias("ppv"),
        F.try_divide(tn, F.col("total") - pred).alias("npv"),
        F.try_divide(pos, F.col("total")).alias("prevalence"),
    ).withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def overall_measures(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, no-information rate and Cohen's kappa."""
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n")).scalar()
    rows = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("pos"))
    columns = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("pred"))
    chance = rows.join(columns, "class").agg(F.coalesce(F.sum(F.col("pos") * F.col("pred")), F.lit(0))).scalar()
    agreed = cells.agg(F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("agreed"))
    full = agreed.select("agreed", total.alias("total"), chance.alias("chance"), rows.agg(F.max("pos")).scalar().alias("largest"))
    po = F.col("agreed") / F.col("total")
    pe = F.col("chance") / (F.col("total").cast("double") * F.col("total"))
    return full.select(po.alias("accuracy"), (F.col("largest") / F.col("total")).alias("no_information_rate"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def macro_precision(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean of the per-class positive predictive values; classes never predicted are left out."""
    return class_measures(df, truth, predicted).agg(F.avg("ppv").alias("ppv"))


# Curves


def one_vs_rest(df: DataFrame, probabilities: str, truth: str, classes: int) -> DataFrame:
    """One ``(class, score, positive)`` row per observation and class."""
    scores = df.select(F.col(truth).alias("__t"), F.posexplode(F.slice(F.col(probabilities), 1, classes)).alias("class", "score"))
    return scores.select("class", "score", (F.col("class") == F.col("__t")).alias("positive"))


def score_counts(df: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Positives and negatives per distinct score: what every curve is built from."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def roc_points(df: DataFrame, score: str, positive: Column, keys: Sequence[str] = (), **limits) -> DataFrame:
    """Sensitivity and specificity at every distinct score, predicting at or above it."""
    grouped = score_counts(df, keys, score, positive)
    curve = running_totals(grouped, keys, [-F.col("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, **limits)
    if keys:
        totals = curve.groupBy(*keys).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
        sized = curve.join(totals, list(keys))
    else:
        both = curve.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
        sized = curve.withColumns({"__p": both["p"], "__n": both["n"]})
    return sized.select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("tp"), F.col("__p")).alias("sensitivity"),
        (1 - F.try_divide(F.col("fp"), F.col("__n"))).alias("specificity"),
    )


def roc_auc(df: DataFrame, score: str, positive: Column, keys: Sequence[str] = (), **limits) -> DataFrame:
    """Exact area under the curve: a positive beats a negative, ties count half."""
    grouped = score_counts(df, keys, score, positive)
    below = running_totals(grouped, keys, [F.col("score")], {"neg_upto": F.col("neg")}, **limits)
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    sums = below.groupBy(*keys).agg(F.sum(wins).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(*keys, F.try_divide(F.col("w"), F.col("p").cast("double") * F.col("n")).alias("roc_auc"))


def roc_auc_pairs(df: DataFrame, probabilities: str, truth: str, classes: int, **limits) -> DataFrame:
    """Multiclass area by the mean over unordered class pairs.

    Rows of class i meet each other class j once with the score for i, and once with the
    score for j, so one observation yields 2 (classes - 1) rows, never row pairs.
    """
    c = F.col(truth)
    others = F.filter(F.sequence(F.lit(0), F.lit(classes - 1)), lambda j: j != c)
    sides = F.flatten(
        F.transform(
            others,
            lambda j: F.array(
                F.struct(c.cast("int").alias("scored"), j.cast("int").alias("rival"), F.lit(True).alias("positive")),
                F.struct(j.cast("int").alias("scored"), c.cast("int").alias("rival"), F.lit(False).alias("positive")),
            ),
        )
    )
    long = df.select(F.col(probabilities).alias("__p"), F.explode(sides).alias("s"))
    scored = long.select("s.*", F.element_at("__p", F.col("s.scored") + 1).alias("score"))
    each = roc_auc(scored, "score", F.col("positive"), ["scored", "rival"], **limits)
    pairs = each.groupBy(F.least("scored", "rival").alias("a"), F.greatest("scored", "rival").alias("b")).agg(F.avg("roc_auc").alias("auc"))
    return pairs.agg(F.avg("auc").alias("roc_auc"))


def classify_at(score: Column, threshold: float = 0.5) -> Column:
    """YES when the score is strictly above the threshold."""
    return F.when(score > threshold, "YES").when(score <= threshold, "NO")


def threshold_sweep(df: DataFrame, score: str, positive: Column, step: float = 0.0005) -> DataFrame:
    """Measures at every threshold from 0 to 1, predicting at or above the threshold.

    Each score is counted at the highest threshold it still reaches (-1: none); the rest is a
    running sum over the fixed number of thresholds.
    """
    steps = round(1 / step)
    near = F.greatest(F.lit(-1.0), F.least(F.floor(F.col(score) * steps).cast("double"), F.lit(float(steps))))
    # The product may be off by one rounding; the thresholds themselves decide.
    slot = near + (((near + 1) / steps <= F.col(score)) & (near < steps)).cast("int") - (near / steps > F.col(score)).cast("int")
    slot = F.greatest(slot, F.lit(-1.0))
    counted = df.where(F.col(score).isNotNull()).groupBy(slot.cast("int").alias("i")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    grid = df.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("i"))
    filled = grid.join(F.broadcast(counted), "i", "left").fillna(0, ["pos", "neg"])  # at most steps + 2 rows
    down = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = filled.select(
        "i", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(everything).alias("p"), F.sum("neg").over(everything).alias("n")
    )
    sensitivity = F.try_divide(F.col("tp"), F.col("p"))
    specificity = 1 - F.try_divide(F.col("fp"), F.col("n"))
    return sums.where("i >= 0").select((F.col("i") / steps).alias("threshold"), sensitivity.alias("sensitivity"), specificity.alias("specificity")).withColumns(
        {
            "j_index": F.col("sensitivity") + F.col("specificity") - 1,
            "distance": F.pow(1 - F.col("sensitivity"), 2) + F.pow(1 - F.col("specificity"), 2),
        }
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Thresholds with the largest J index, ties kept."""
    return sweep.where(F.col("j_index") == sweep.agg(F.max("j_index")).scalar())
