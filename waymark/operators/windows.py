"""Shares, running totals, top-n and ranking.

Windows are used where the group size is bounded by the data model or cut before the
shuffle (``rank() <= n`` keeps n rows per group and map task). Everything that needs a
position in a long order goes through ``running_totals``, which never sorts a whole group
in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.cluster import checkpointed, null_safe_join

# Rows of one range of a long order; the number of ranges grows with the table.
RANGE_ROWS = 250_000


def share_of_total(df: DataFrame, count: str = "n", out: str = "pcnt", scale: float = 100.0) -> DataFrame:
    """Share of the column total. The total is a scalar subquery, not a window."""
    return df.withColumn(out, F.col(count) / df.agg(F.sum(count)).scalar() * scale)


def share_within(df: DataFrame, keys: Sequence[str], value: str, out: str = "pcnt") -> DataFrame:
    """Share of the group total. The totals are aggregated before the shuffle and joined
    back, so that a hot group is split across tasks."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    return null_safe_join(df, totals, list(keys)).withColumn(out, F.col(value) / F.col("__total")).drop("__total")


def ordered_ranges(base: DataFrame, range_rows: int = RANGE_ROWS, task_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """``base`` with ``__range``, a number that rises with the value ranges in the order
    ``__order``, and the number of ranges. Spark cuts the table into tasks from a sample, so they
    hold similar row counts; ranges smaller than ``task_rows`` are cut from the sorted rows of a
    task, so the number of tasks, each of which reports to the driver, does not depend on
    ``range_rows``. The result is written once, because another sample would cut elsewhere."""
    n = base.count()
    ranges = max(1, -(-n // range_rows))
    if ranges == 1:
        return base.withColumn("__range", F.lit(0)), 1
    tasks = -(-n // max(range_rows, task_rows))
    dealt = base.repartitionByRange(tasks, "__order")
    if tasks == ranges:
        return checkpointed(dealt.withColumn("__range", F.spark_partition_id())), ranges
    # The number has the task in its upper bits and counts the task's rows in the lower 33.
    number, most = F.monotonically_increasing_id(), 2**33
    cut = dealt.sortWithinPartitions("__order").withColumn("__range", number)
    task, place = F.shiftright("__range", 33), F.col("__range").bitwiseAND(F.lit(most - 1))
    return checkpointed(cut.withColumn("__range", task * most + F.floor(place / range_rows))), ranges


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add running sums in a total order, per key.

    ``order`` lists expressions compared ascending (negate a number to go down) that
    together make the order total. Pass a table already grouped by its order values.

    The table is cut into value ranges: the window runs inside each range, range totals are
    summed once more, and the two are added. No task sees more than one range of one key.
    """
    base = checkpointed(
        df.withColumns({"__order": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]), **{f"__{k}": v for k, v in sums.items()}})
    )
    ranged, ranges = ordered_ranges(base, range_rows)
    slot = [*keys, "__range"]
    inside = Window.partitionBy(*slot).orderBy("__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({k: F.sum(f"__{k}").over(inside) for k in sums})
    if ranges == 1:  # nothing lies before the only range
        return local.drop("__order", "__range", *[f"__{k}" for k in sums])

    totals = ranged.groupBy(*slot).agg(*[F.sum(f"__{k}").alias(f"__sum_{k}") for k in sums])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(slot)],
        *[F.sum(f"__sum_{k}").over(before).alias(f"__before_{k}") for k in sums],
    )
    match = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(slot)]
    joined = local.join(offsets, match, "left")
    zero = {k: F.coalesce(F.col(f"__before_{k}"), F.lit(0)) for k in sums}
    out = joined.withColumns({k: F.col(k) + zero[k] for k in sums})
    drop = [f"__k{i}" for i in range(len(slot))] + [f"__{k}" for k in sums] + [f"__before_{k}" for k in sums]
    return out.drop("__order", "__range", *drop)


def cumulative_share(df: DataFrame, key: str, count: str = "n", by_count: bool = True) -> DataFrame:
    """Percent of total and its running sum, in falling count order or in key order."""
    shares = share_of_total(df, count)
    order = [-F.col(count), F.col(key)] if by_count else [F.col(key)]
    return running_totals(shares, [], order, {"cumpcnt": F.col("pcnt")})


def top_n_ties(df: DataFrame, keys: Sequence[str], weight: str, n: int) -> DataFrame:
    """Rows whose weight ranks in the first ``n`` of their group, ties kept, null weights out.

    Spark applies the rank limit before the shuffle as well, so only candidates travel.
    """
    window = Window.partitionBy(*keys).orderBy(F.desc("__weight"))
    ranked = df.where(F.col(weight).isNotNull()).withColumn("__weight", F.col(weight))
    return ranked.withColumn("__rank", F.rank().over(window)).where(F.col("__rank") <= n).drop("__rank", "__weight")


def top_n_ties_hot(df: DataFrame, keys: Sequence[str], weight: str, n: int) -> DataFrame:
    """``top_n_ties`` for groups in which very many rows may tie.

    The n-th largest weight of each group is found first, with the rank limit applied before
    the shuffle, and the rows are matched against it. Spark's statistics decide how.
    """
    window = Window.partitionBy(*keys).orderBy(F.desc(weight))
    narrow = df.select(*keys, weight).where(F.col(weight).isNotNull())
    floor = (
        narrow.withColumn("__row", F.row_number().over(window))
        .where(F.col("__row") <= n)
        .groupBy(*keys)
        .agg(F.min(weight).alias("__floor"))
    )
    return null_safe_join(df, floor, list(keys)).where(F.col(weight) >= F.col("__floor")).drop("__floor")


def top_levels(counts: DataFrame, count: str, n: int) -> DataFrame:
    """Rows of a count table that reach the n-th largest count, ties kept."""
    floor = counts.select(count).orderBy(F.desc(count)).limit(n).agg(F.min(count))
    return counts.where(F.col(count) >= floor.scalar())


def dense_ranked(df: DataFrame, keys: Sequence[str], weight: str, out: str) -> DataFrame:
    """Dense rank of a weight, highest first, inside groups of bounded size."""
    window = Window.partitionBy(*keys).orderBy(F.desc(weight))
    return df.withColumn(out, F.dense_rank().over(window))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, first in an explicit order. Cut to one row per map task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(window)).where(F.col("__row") == 1).drop("__row")


def nucleus(df: DataFrame, keys: Sequence[str], value: str, tie: str, cut: float = 0.85) -> DataFrame:
    """Keep a group's largest values while their running share stays below ``cut``.

    For groups of bounded size, such as the classes of one observation; a first row that
    alone reaches the cut goes too.
    """
    group = Window.partitionBy(*keys)
    running = group.orderBy(F.desc("pcnt"), F.asc(tie)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = df.withColumn("pcnt", F.col(value) / F.sum(value).over(group))
    return shares.withColumn("cum_pcnt", F.sum("pcnt").over(running)).where(F.col("cum_pcnt") < cut)


# Ranking inside one probability array: no shuffle at all.


def class_order(probabilities: Column) -> Column:
    """Zero-based class indexes, most likely first, ties to the lower index."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((-p).alias("p"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda pair: pair["i"])


def class_rank(probabilities: Column, truth: Column) -> Column:
    """One-based rank of one class: classes that beat it, plus one."""
    own = F.element_at(probabilities, truth.cast("int") + 1)
    beats = F.filter(probabilities, lambda p, i: (p > own) | ((p == own) & (i < truth)))
    return F.size(beats) + 1


def likeliest_class(probabilities: Column) -> Column:
    """Zero-based index of the largest probability, ties to the lower index."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")
