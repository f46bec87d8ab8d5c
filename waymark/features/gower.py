"""Neighbour imputation by the mixed distance of Gower, which leaves out missing cells.

The distance of two rows is the mean, over the columns that both have, of the difference of two
numbers divided by the column's range, and of 0 or 1 for equal or different categories. Rows
without a common column are not neighbours.

It obeys the triangle inequality only among rows that lack the same cells, so rows are grouped
by what they lack. Between a group of rows with a gap and a group of donors the common columns
are the same for every pair; with all other columns set to zero the sum of differences is the
city-block distance, and the exact partitioned join of ``neighbours`` applies with its pivot
bounds. Donors are sent once to each pattern of gaps that rows with a gap have. The k best of
every group of donors are merged by the mean over the common columns.

Scaled numbers are rounded to multiples of 2^-30, so sums and ties are exact; ties go to the
smaller id as text. A column whose range is zero, and NaN, count as missing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.cluster import LOOKUP_ROWS, bounded_rows, checkpointed
from waymark.features.base import FittedStep, Step
from waymark.features.neighbours import _DonorReader, _DonorWriter, nearest
from waymark.features.prepare import _level_lists
from waymark.operators.columns import nominal_columns

UNIT = 2**30
_BREAK = "\u0001"


def _present(column: str, spec: dict) -> Column:
    if column in spec["levels"]:
        return F.col(column).isNotNull()
    low, high = spec["ranges"][column]
    if low is None or high is None or low == high:
        return F.lit(False)
    return F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))


def _cells(column: str, spec: dict) -> list[Column]:
    """The coordinates of a column: one for a number, one per level for a category and one more
    for levels that were not seen in fitting, which no donor has."""
    if column in spec["levels"]:
        known = spec["levels"][column]
        half = lambda hit: F.when(hit, float(UNIT // 2)).otherwise(0.0)
        return [*[half(F.col(column) == v) for v in known], half(~F.col(column).isin(known)) if known else half(F.lit(True))]
    low, high = spec["ranges"][column]
    if low is None or high is None or low == high:
        return [F.lit(0.0)]
    return [F.floor((F.col(column).cast("double") - F.lit(low)) / F.lit(high - low) * F.lit(float(UNIT)) + 0.5).cast("double")]


def gower_spec(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> dict:
    """Ranges and levels of the columns that distances use."""
    ends = [e for c in numeric for x in [F.col(c).cast("double")] for e in (F.min(F.nullif(x, F.lit(float("nan")))).alias(f"low_{c}"), F.max(F.when(~F.isnan(x), x)).alias(f"high_{c}"))]
    row = df.agg(*ends).first() if ends else {}
    return {"ranges": {c: [row[f"low_{c}"], row[f"high_{c}"]] for c in numeric}, "levels": _level_lists(df, nominal, "") if nominal else {}}


def _shaped(df: DataFrame, columns: Sequence[str], spec: dict) -> DataFrame:
    """``id, mask, cells``: a character per column that says whether it is there, and its
    coordinates, zero where it is not."""
    mask = F.concat(*[F.when(_present(c, spec), "1").otherwise("0") for c in columns])
    cells = F.array(*[F.array(*[F.when(_present(c, spec), x).otherwise(0.0) for x in _cells(c, spec)]) for c in columns])
    return df.select(F.col("id").cast("string").alias("id"), mask.alias("mask"), cells.alias("cells"))


def _common(mask: Column, other: Column) -> Column:
    both = F.zip_with(F.split(mask, ""), F.split(other, ""), lambda a, b: F.when((a == "1") & (b == "1"), "1").otherwise("0"))
    return F.array_join(both, "")


def _kept(cells: Column, common: Column) -> Column:
    """The coordinates of the common columns, zero elsewhere."""
    return F.flatten(F.zip_with(cells, F.split(common, ""), lambda x, b: F.transform(x, lambda v: F.when(b == "1", v).otherwise(0.0))))


def _patterns(df: DataFrame) -> list[str]:
    rows = bounded_rows(df.select("mask").distinct())
    if rows is None:
        raise ValueError(f"more than {LOOKUP_ROWS} different patterns of gaps")
    return sorted(r["mask"] for r in rows)


def gower_nearest(asked: DataFrame, donors: DataFrame, k: int, columns: Sequence[str], spec: dict, **limits) -> DataFrame:
    """``(id, neighbour, distance, place)``: the k nearest of ``donors`` for every row of
    ``asked``. Both have an ``id``."""
    queries, offered = (checkpointed(_shaped(df, columns, spec)) for df in (asked, donors))
    masks, theirs = _patterns(queries), _patterns(offered)
    empty = asked.sparkSession.createDataFrame([], "id string, neighbour string, distance double, place int")
    if not masks or not theirs:
        return empty
    pair = lambda mask, common: F.concat_ws(":", mask, common)
    # A row meets the donors of one pattern of common columns at a time.
    pairs = {m: sorted({"".join("1" if a == b == "1" else "0" for a, b in zip(m, t, strict=True)) for t in theirs} - {"0" * len(columns)}) for m in masks}
    options = F.element_at(F.from_json(F.lit(json.dumps(pairs)), "map<string,array<string>>"), F.col("mask"))
    left = queries.withColumn("common", F.explode(options))
    left = left.select("id", pair(F.col("mask"), F.col("common")).alias("grp"), _kept(F.col("cells"), F.col("common")).alias("vector"))
    right = offered.withColumn("asked", F.explode(F.from_json(F.lit(json.dumps(masks)), "array<string>"))).withColumn("common", _common(F.col("asked"), F.col("mask")))
    right = right.where(F.col("common").contains("1"))
    right = right.select("id", pair(F.col("asked"), F.col("common")).alias("grp"), _kept(F.col("cells"), F.col("common")).alias("vector"))
    named = left.select(F.concat_ws(_BREAK, "grp", "id").alias("id"), "grp", "vector")
    near = nearest(named, right, k, within="grp", skip_self=False, metric="city", **limits)
    parts = F.split("id", _BREAK, 2)
    group = near.select(parts[1].alias("id"), parts[0].alias("grp"), "neighbour", "distance")
    columns_held = F.length(F.translate(F.substring_index("grp", ":", -1), "0", ""))
    means = group.select("id", "neighbour", (F.col("distance") / F.lit(float(UNIT)) / columns_held).alias("distance"))
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return means.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


class GowerImpute(Step):
    """Fill gaps of numbers with the mean, and of categories with the most frequent level (ties:
    the first by name), of the k nearest training rows that have a value.

    ``columns`` are the columns to fill (default: all predictors). Distances use all other
    predictors as they are in the table, filled or not. The donors are saved with a pipeline.
    A row without neighbours keeps its gap.
    """

    def __init__(self, columns=None, k=5, **roles):
        super().__init__(columns, k=k, **roles)

    def _fit(self, df):
        roles = self.roles
        numeric, nominal = roles.numeric(df), nominal_columns(df, roles.reserved)
        targets = self.values["columns"] if self.values["columns"] is not None else [*numeric, *nominal]
        spec = gower_spec(df, numeric, nominal)
        return FittedGowerImpute(df, targets=list(targets), numeric=numeric, nominal=nominal, spec=spec, ids=list(roles.ids), k=self.values["k"])


class FittedGowerImpute(FittedStep):
    def __init__(self, donors: DataFrame | None = None, **state):
        super().__init__(**state)
        self.donors = donors

    def write(self):
        return _DonorWriter(self)

    @classmethod
    def read(cls):
        return _DonorReader(cls)

    def _transform(self, df):
        v = self.values
        one = F.col(v["ids"][0]).cast("string") if len(v["ids"]) == 1 else F.to_json(F.struct(*v["ids"]))
        keyed, donors = df.withColumn("__key", one), self.donors.withColumn("__key", one)
        gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in v["targets"]]).first() if v["targets"] else {}
        out = keyed
        for target in v["targets"]:
            if not gaps[target]:
                continue
            others = [c for c in (*v["numeric"], *v["nominal"]) if c != target]
            named = lambda rows: rows.select(F.col("__key").alias("id"), *others)  # noqa: E731, B023
            known = donors.where(F.col(target).isNotNull())
            near = gower_nearest(named(keyed.where(F.col(target).isNull())).dropDuplicates(["id"]), named(known), v["k"], others, v["spec"])
            values = known.select(F.col("__key").alias("neighbour"), F.col(target).alias("__value"))
            met = near.join(values, "neighbour")
            if target in v["numeric"]:
                filled = met.groupBy("id").agg(F.avg(F.col("__value").cast("double")).alias("__fill"))
            else:
                counted = met.groupBy("id", "__value").agg(F.count("*").alias("n"))
                filled = counted.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "__value")).alias("m")).select("id", F.col("m.__value").alias("__fill"))
            filled = filled.withColumnRenamed("id", "__id")
            current = F.col(target).cast("double") if target in v["numeric"] else F.col(target)
            out = out.join(filled, F.col("__key") == F.col("__id"), "left").withColumn(target, F.coalesce(current, "__fill")).drop("__id", "__fill")
        return out.select(*df.columns)
