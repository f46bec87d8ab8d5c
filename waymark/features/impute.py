"""Imputation from donor rows: random hot deck and chained predictive matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.cluster import checkpointed, seeded_hash, seeded_integer
from waymark.features.prepare import _level_lists
from waymark.features.resample import numbered
from waymark.functions.labels import to_code
from waymark.operators.windows import ordered_ranges


def hot_deck(df: DataFrame, ids: Sequence[str], column: str, seed: int) -> DataFrame:
    """Fill gaps with observed values drawn at random with replacement.

    Donors are numbered in random order, each gap picks a number from its own id, and the
    two meet in a join. Picks are spread evenly, so no join key is hot.
    """
    donors = numbered(df.where(F.col(column).isNotNull()).select(*ids, column), [], ids, seed, "__pick")
    size = df.agg(F.count(column)).first()[0]
    if not size:
        return df
    gaps = df.where(F.col(column).isNull()).withColumn("__pick", seeded_integer(seeded_hash(list(ids), seed + 1), size) + 1)
    filled = gaps.drop(column).join(donors.select("__pick", column), "__pick", "left").drop("__pick")
    return df.where(F.col(column).isNotNull()).unionByName(filled.select(df.columns))


def nearest_on_line(gaps: DataFrame, donors: DataFrame, ids: Sequence[str], at: str, value: str, **limits) -> DataFrame:
    """``(ids, value)``: for every gap row the value of the donor with the closest ``at``.

    Equal distances go to the lower donor, equal donors to the smaller value. Rows of both
    tables are put in one order that is cut into ranges; each range looks at its own donors
    and at the nearest donor outside it, which is carried over from the range table.
    """
    kind = donors.schema[value].dataType
    asked = gaps.select(F.struct(*ids).alias("__ids"), F.col(at).alias("__at"), F.lit(None).cast(kind).alias("__value"), F.lit(1).alias("__gap"))
    nobody = F.lit(None).cast(asked.schema["__ids"].dataType)
    given = donors.select(nobody.alias("__ids"), F.col(at).alias("__at"), F.col(value).alias("__value"), F.lit(0).alias("__gap"))
    both = given.distinct().unionByName(asked)  # equal donors are one donor
    tie = F.when(F.col("__gap") == 1, F.md5(F.to_json("__ids"))).otherwise(F.lit("")).alias("tie")
    order = F.struct(F.col("__at").alias("at"), F.col("__gap").alias("gap"), F.col("__value").alias("value"), tie)
    base = checkpointed(both.withColumn("__order", order))
    ranged, ranges = ordered_ranges(base, **limits)
    donor = F.when(F.col("__gap") == 0, F.struct(F.col("__at").alias("at"), F.col("__value").alias("value")))
    marked = ranged.withColumn("__donor", donor)
    # Both directions look back from the row: a frame that ends at the partition's end
    # would be scanned again for every row.
    so_far = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy("__range").orderBy(F.asc("__order")).rowsBetween(*so_far)
    down = Window.partitionBy("__range").orderBy(F.desc("__order")).rowsBetween(*so_far)
    nearest_donor = F.last("__donor", ignorenulls=True)
    seen = marked.withColumns({"__low": nearest_donor.over(up), "__high": nearest_donor.over(down)}).where(F.col("__gap") == 1)
    if ranges > 1:
        ends = marked.where(F.col("__gap") == 0).groupBy("__range").agg(F.max_by("__donor", "__order").alias("last"), F.min_by("__donor", "__order").alias("first"))
        steps = marked.select("__range").distinct().join(ends, "__range", "left")
        line = Window.orderBy("__range")  # one row per range
        carried = steps.select(
            "__range",
            F.last("last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
            F.first("first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
        )
        seen = seen.join(carried, "__range").withColumns({"__low": F.coalesce("__low", "__before"), "__high": F.coalesce("__high", "__after")})
    below, above = F.col("__at") - F.col("__low.at"), F.col("__high.at") - F.col("__at")
    lower = F.col("__high").isNull() | (F.col("__low").isNotNull() & (below <= above))
    return seen.select("__ids.*", F.when(lower, F.col("__low.value")).otherwise(F.col("__high.value")).alias(value))


def chained_matching(df: DataFrame, ids: Sequence[str], columns: Sequence[str], sweeps: int = 5, seed: int = 1, **limits) -> DataFrame:
    """Chained equations with predictive mean matching, one imputed table.

    Gaps start from a random hot deck. In every sweep each column with gaps is regressed on
    all the others over its observed rows; a gap takes the observed value of the row with
    the nearest prediction. Text columns are regressed by their level codes and always
    receive observed levels. Each update is checkpointed, which keeps the plan short.
    """
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    levels = _level_lists(df, text, "")
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    gappy = [c for c in columns if missing[c]]
    flags = {f"__gap_{c}": F.col(c).isNull() for c in gappy}
    current = df.select(*ids, *columns)
    for i, c in enumerate(gappy):
        current = hot_deck(current, ids, c, seed + i)
    current = checkpointed(current.join(df.select(*ids, *[f.alias(n) for n, f in flags.items()]), list(ids)))
    number = lambda c: (to_code(F.col(c), levels[c]) if c in text else F.col(c)).cast("double")
    for _ in range(sweeps):
        for c in gappy:
            others = [o for o in columns if o != c]
            coded = current.select(*ids, c, f"__gap_{c}", number(c).alias("__y"), *[number(o).alias(f"__x_{o}") for o in others])
            rows = VectorAssembler(inputCols=[f"__x_{o}" for o in others], outputCol="__x").transform(coded)
            fitted = LinearRegression(featuresCol="__x", labelCol="__y", predictionCol="__at", solver="normal", regParam=1e-6).fit(rows.where(~F.col(f"__gap_{c}")))
            placed = fitted.transform(rows)
            filled = nearest_on_line(placed.where(f"__gap_{c}"), placed.where(~F.col(f"__gap_{c}")), ids, "__at", c, **limits)
            renamed = filled.withColumnRenamed(c, "__new")
            current = current.join(renamed, list(ids), "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
            current = checkpointed(current)
    done = current.select(*ids, *columns)
    rest = [c for c in df.columns if c not in {*ids, *columns}]
    return df.select(*ids, *rest).join(done, list(ids)).select(*df.columns) if rest else done
