"""Exact nearest neighbours as a partitioned join, and what is built on them.

The join follows the pivot scheme of k-nearest-neighbour joins on shared-nothing clusters:

1. Equal vectors are collapsed first. A vector keeps its k+1 smallest ids, which is all any
   row can ask of a group of copies, so a large group of copies costs one search.
2. Pivots split the space into cells; their number is a power of the number of candidates.
   Every candidate stays in the one cell of its nearest pivot.
3. A query is searched in its own cell. The k-th distance found there, or a bound from the
   pivot distances of the candidates if that cell holds fewer, says which other cells can
   still hold a neighbour, by cell radii and the planes between pivots. The query goes to
   those and no others, so the result is exact and few rows travel.
4. A cell is cut into tiles of limited size in both directions. A tile orders both sides by
   median cuts into small boxes and compares a box of queries with the boxes of candidates
   that are near enough only. It emits at most k rows per query; tiles are merged by a
   ranked window.

Driver and closures hold only pivots and per-cell bounds (pivots times classes).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.cluster import LOOKUP_ROWS, as_lookup, bounded_rows, checkpointed, seeded_hash, seeded_integer, seeded_uniform
from waymark.features.base import FittedStep, Step
from waymark.features.prepare import _level_lists, _moments
from waymark.features.resample import class_sizes, draws_with_replacement, numbered, repeated
from waymark.operators.columns import nominal_columns

# Cells grow in number with this power of the candidates, without a ceiling.
FEWEST_PIVOTS, PIVOT_POWER = 16, 1 / 3
TILE_QUERIES = 16384
TILE_CANDIDATES = 65536
BOX_ROWS = 64
_SLACK = 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.empty((0, 0))


def _distances(left: np.ndarray, right: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of all rows of two matrices, row blocks at a time: ``euclidean``, or ``city``
    for the sum of absolute differences. Both obey the triangle inequality."""
    out = np.empty((len(left), len(right)))
    block = max(1, 2_000_000 // max(1, right.size))
    for i in range(0, len(left), block):
        gap = left[i : i + block, None, :] - right[None, :, :]
        out[i : i + block] = np.abs(gap).sum(axis=2) if metric == "city" else np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def _cell_column(pivots: np.ndarray, metric: str):
    @F.pandas_udf("cell int, d double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        near = _distances(_matrix(vectors), pivots, metric)
        best = near.argmin(axis=1)
        return pd.DataFrame({"cell": best.astype("int32"), "d": near[np.arange(len(best)), best]})

    return place


def _far_column(bounds: dict[str, np.ndarray]):
    """How far the neighbours of a query can be: no farther than the k-th row found so far."""

    @F.pandas_udf("double")
    def far(groups: pd.Series, cells: pd.Series, d: pd.Series, kth: pd.Series) -> pd.Series:
        known = np.array([bounds[g][c] if g in bounds else math.inf for g, c in zip(groups, cells, strict=True)], dtype=float)
        return pd.Series(np.fmin(kth.to_numpy(dtype=float, na_value=math.inf), d.to_numpy(dtype=float) + known) * (1 + _SLACK) + _SLACK)

    return far


def _route_column(pivots: np.ndarray, radii: dict[str, np.ndarray], metric: str):
    """The cells besides its own that hold candidates of its class within ``far`` of a query."""
    between = _distances(pivots, pivots, metric)

    @F.pandas_udf("array<int>")
    def route(vectors: pd.Series, groups: pd.Series, cells: pd.Series, d: pd.Series, far: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        away, own, cell = _distances(_matrix(vectors), pivots, metric), d.to_numpy()[:, None], cells.to_numpy()
        # A row of another cell lies on the far side of the middle between the two pivots.
        if metric == "euclidean":
            gap = np.where(between[cell] > 0, between[cell], math.inf)
            least = (away**2 - own**2) / (2 * gap) - 1e-13 * (away**2 + own**2) / gap
        else:
            least = (away - own) / 2
        none = np.full(len(pivots), -math.inf)
        radius = np.stack([radii.get(g, none) for g in groups])
        least = np.maximum(least, away - radius)
        asked = (least * (1 - _SLACK) <= far.to_numpy()[:, None]) & (radius >= 0)
        asked[np.arange(len(cell)), cell] = False
        return pd.Series([np.flatnonzero(row).astype("int32").tolist() for row in asked])

    return route


def _bounds(pivots: np.ndarray, nearest: list, k: int, metric: str) -> dict[str, np.ndarray]:
    """How far from its pivot the k-th neighbour of a row at the pivot can be, per class and cell."""
    between = _distances(pivots, pivots, metric)
    known: dict[str, tuple[list[int], list[float]]] = {}
    for row in nearest:
        cells, away = known.setdefault(row["grp"], ([], []))
        cells.append(row["cell"])
        away.append(row["d"])
    out = {}
    for group, (cells, away) in known.items():
        # Fewer than k candidates in the class: every one of them is a neighbour.
        far = between[:, cells] + np.array(away)
        out[group] = np.partition(far, k - 1, axis=1)[:, k - 1] if len(cells) >= k else np.full(len(pivots), math.inf)
    return out


def _boxes(rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size`` rows that lie close together: halves at the
    median of the widest column, again and again."""
    out, left = [], [np.arange(len(rows))]
    while left:
        part = left.pop()
        if len(part) <= size:
            out.append(part)
            continue
        own = rows[part]
        column = own[:, int(np.argmax(own.max(axis=0) - own.min(axis=0)))]
        order = np.argpartition(column, len(part) // 2)
        left += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return out


def _tile_search(k: int, metric: str):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts: dict[str, list] = {"grp": [], "key": [], "nid": [], "nkey": [], "distance": []}
        if not left.empty and not right.empty:
            asked, offered, far = _matrix(left["vector"]), _matrix(right["vector"]), left["far"].to_numpy()
            ids, keys = right["nid"].to_numpy(), right["nkey"].to_numpy()
            rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            boxes = _boxes(offered, BOX_ROWS)
            low, high = (np.stack([edge(offered[b], axis=0) for b in boxes]) for edge in (np.min, np.max))
            sizes = np.array([len(b) for b in boxes])
            rows, columns, distances = [], [], []
            for box in _boxes(asked, BOX_ROWS):
                own, limit = asked[box], far[box]
                gap = np.maximum(np.maximum(low - own.max(axis=0), own.min(axis=0) - high), 0.0)
                least = gap.sum(axis=1) if metric == "city" else np.sqrt((gap * gap).sum(axis=1))
                order = np.argsort(least, kind="stable")
                order = order[least[order] <= limit.max()]
                # The nearest boxes first; what they hold says how many others can matter.
                first = int(np.searchsorted(np.cumsum(sizes[order]), k + BOX_ROWS)) + 1
                near = np.concatenate([boxes[i] for i in order[:first]]) if len(order) else np.zeros(0, int)
                if not len(near):
                    continue
                away = _distances(own, offered[near], metric)
                if first < len(order):
                    if len(near) >= k:
                        limit = np.minimum(limit, np.partition(away, k - 1, axis=1)[:, k - 1] * (1 + _SLACK) + _SLACK)
                    more = [boxes[i] for i in order[first:] if least[i] <= limit.max()]
                    if more:
                        rest = np.concatenate(more)
                        near, away = np.concatenate([near, rest]), np.concatenate([away, _distances(own, offered[rest], metric)], axis=1)
                last = min(k, len(near)) - 1
                kept = np.minimum(limit, np.partition(away, last, axis=1)[:, last])
                row, column = np.nonzero(away <= kept[:, None])
                found = away[row, column]
                order = np.lexsort((rank[near[column]], found, row))
                row, column, found = row[order], column[order], found[order]
                chosen = np.arange(len(row)) - np.searchsorted(row, row) < k
                rows.append(box[row[chosen]])
                columns.append(near[column[chosen]])
                distances.append(found[chosen])
            if rows:
                row, column = np.concatenate(rows), np.concatenate(columns)
                parts["grp"], parts["key"] = left["grp"].to_numpy()[row], left["key"].to_numpy()[row]
                parts["nid"], parts["nkey"], parts["distance"] = ids[column], keys[column], np.concatenate(distances)
        return pd.DataFrame(parts).astype({"grp": object, "key": object, "nid": object, "nkey": object, "distance": "float64"})

    return search


def _searched(queries: DataFrame, candidates: DataFrame, k: int, metric: str, tile: tuple[int, int]) -> DataFrame:
    """``(grp, key, nid, nkey, distance)``: at most k rows per query and tile of its cell."""
    loads = candidates.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("m"))
    sizes = queries.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"))
    tiles = as_lookup(
        sizes.join(loads, ["grp", "cell"]).select(
            "grp", "cell", F.ceil(F.col("n") / tile[0]).cast("int").alias("qt"), F.ceil(F.col("m") / tile[1]).cast("int").alias("bt")
        )
    )
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    slot = lambda key, count: F.pmod(F.xxhash64(key), F.col(count)).cast("int")
    left = queries.join(tiles, ["grp", "cell"]).select("grp", "cell", "key", "vector", "far", slot("key", "qt").alias("qi"), each("bt").alias("bi"))
    right = candidates.join(tiles, ["grp", "cell"]).select("grp", "cell", "nid", "nkey", "vector", slot("nid", "bt").alias("bi"), each("qt").alias("qi"))
    by = ["grp", "cell", "qi", "bi"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(
        _tile_search(k, metric), "grp string, key string, nid string, nkey string, distance double"
    )


def _vector_key(vector: str) -> Column:
    return F.md5(F.concat_ws(",", F.transform(vector, lambda x: (x + F.lit(0.0)).cast("string"))))


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    id_column: str = "id",
    vector: str = "vector",
    within: str | None = None,
    skip_self: bool = True,
    pivots: int | None = None,
    tile: tuple[int, int] = (TILE_QUERIES, TILE_CANDIDATES),
    metric: str = "euclidean",
) -> DataFrame:
    """``(id, neighbour, distance, place)``: the k nearest candidates of every query row.

    Ties in distance go to the smaller id (as text). With ``within`` only rows of the same
    class are neighbours. Vectors are arrays of doubles without missing values.
    """
    group = F.coalesce(F.col(within).cast("string"), F.lit("")) if within else F.lit("")
    shape = [group.alias("grp"), F.col(id_column).cast("string").alias("qid"), F.col(vector).cast("array<double>").alias("vector")]
    asked = queries.select(*shape).withColumn("key", _vector_key("vector"))
    offered = candidates.select(*shape).withColumnRenamed("qid", "nid").withColumn("nkey", _vector_key("vector"))
    wanted = k + 1 if skip_self else k

    copies = Window.partitionBy("grp", "nkey").orderBy("nid")
    kept = checkpointed(offered.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= wanted).drop("r"))
    if pivots is None:
        pivots = max(FEWEST_PIVOTS, round(kept.count() ** PIVOT_POWER))
    middle = kept.select("vector", "nkey").dropDuplicates(["nkey"]).orderBy("nkey").limit(pivots).collect()
    if not middle:
        return asked.sparkSession.createDataFrame([], "id string, neighbour string, distance double, place int")
    centres = np.array([r["vector"] for r in middle], dtype=float)
    place = _cell_column(centres, metric)
    q = checkpointed(asked.select("grp", "key", "vector").dropDuplicates(["grp", "key"]).withColumn("p", place("vector")).select("grp", "key", "vector", "p.cell", "p.d"))
    b = checkpointed(kept.withColumn("p", place("vector")).select("grp", "nid", "nkey", "vector", "p.cell", "p.d"))

    closest = Window.partitionBy("grp", "cell").orderBy("d", "nid")
    nearest_rows = _cells(b.withColumn("r", F.row_number().over(closest)).where(F.col("r") <= wanted).select("grp", "cell", "d"), wanted)
    bounds = _bounds(centres, nearest_rows, wanted, metric)
    radii: dict[str, np.ndarray] = {}
    for row in _cells(b.groupBy("grp", "cell").agg(F.max("d").alias("radius"))):
        radii.setdefault(row["grp"], np.full(len(centres), -math.inf))[row["cell"]] = row["radius"]

    # Its own cell first, then the cells that can hold a nearer row.
    inside = checkpointed(_searched(q.withColumn("far", F.lit(math.inf)), b, wanted, metric, tile))
    kth = inside.groupBy("grp", "key").agg(F.get(F.sort_array(F.collect_list("distance")), F.lit(wanted - 1)).alias("kth"))
    limited = q.join(kth, ["grp", "key"], "left").withColumn("far", _far_column(bounds)("grp", "cell", "d", "kth"))
    route = _route_column(centres, radii, metric)("vector", "grp", "cell", "d", "far")
    sent = checkpointed(limited.select("grp", "key", "vector", "far", F.explode(route).alias("cell")))
    found = inside.unionByName(_searched(sent, b, wanted, metric, tile))
    order = Window.partitionBy("grp", "key").orderBy("distance", "nid")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= wanted).drop("r")

    matched = asked.select("grp", "qid", "key").join(best, ["grp", "key"])
    if skip_self:
        matched = matched.where(F.col("qid") != F.col("nid"))
    final = Window.partitionBy("grp", "qid").orderBy("distance", "nid")
    placed = matched.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k)
    return placed.select(F.col("qid").alias("id"), F.col("nid").alias("neighbour"), "distance", "place")


def _cells(df: DataFrame, per_cell: int = 1) -> list:
    """Per-cell rows on the driver; their number is at most pivots x classes x ``per_cell``."""
    rows = bounded_rows(df, 10 * LOOKUP_ROWS * per_cell)
    if rows is None:
        raise ValueError("too many classes for a neighbour search within classes")
    return rows


# Vectors


def distance_vectors(df: DataFrame, ids: Sequence[str], numeric: Sequence[str], nominal: Sequence[str] = (), fitted: dict | None = None) -> tuple[DataFrame, dict]:
    """Ids and a ``vector``: numbers scaled to unit deviation with gaps at the mean, and
    0/1 cells for categories, weighted so that two different levels are one apart."""
    if fitted is None:
        moments = _moments(df, numeric)
        fitted = {
            "mean": {c: m or 0.0 for c, (m, _) in moments.items()},
            "sd": {c: s if s else 1.0 for c, (_, s) in moments.items()},
            "levels": _level_lists(df, nominal, ""),
        }
    cells = [
        (F.coalesce(F.col(c).cast("double"), F.lit(float(fitted["mean"][c]))) - F.lit(float(fitted["mean"][c]))) / F.lit(float(fitted["sd"][c]))
        for c in numeric
    ]
    half = math.sqrt(0.5)
    cells += [F.when(F.col(c) == v, half).otherwise(0.0) for c, values in fitted["levels"].items() for v in values]
    return df.select(*ids, F.array(*cells).alias("vector")), fitted


# Imputation


class NeighbourImpute(Step):
    """Fill numeric gaps with the mean of the k nearest training rows that have a value.

    Every numeric predictor is filled where it has gaps, also one that had none at fit time.
    Distances use all other predictors. The donors are saved with a pipeline as a table.
    """

    def __init__(self, columns=None, k=5, **roles):
        super().__init__(columns, k=k, **roles)

    def _fit(self, df):
        roles = self.roles
        numeric = roles.numeric(df)
        targets = self.values["columns"] if self.values["columns"] is not None else numeric
        return FittedNeighbourImpute(
            df, targets=list(targets), numeric=numeric, nominal=nominal_columns(df, roles.reserved), ids=list(roles.ids), k=self.values["k"]
        )


class _DonorWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:  # noqa: N802 (the name is Spark's)
        super().saveImpl(path)
        self.instance.donors.write.parquet(f"{path}/donors")


class _DonorReader(DefaultParamsReader):
    def load(self, path: str):
        loaded = super().load(path)
        loaded.donors = SparkSession.active().read.parquet(f"{path}/donors")
        return loaded


class FittedNeighbourImpute(FittedStep):
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
        out, donors = df.withColumn("__key", one), self.donors.withColumn("__key", one)
        missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in v["targets"]]).first() if v["targets"] else {}
        keyed = out
        for target in v["targets"]:
            if not missing[target]:
                continue
            others = [c for c in v["numeric"] if c != target]
            known = donors.where(F.col(target).isNotNull())
            donor_vectors, fitted = distance_vectors(known, ["__key"], others, v["nominal"])
            gaps, _ = distance_vectors(keyed.where(F.col(target).isNull()), ["__key"], others, v["nominal"], fitted)
            near = nearest(gaps, donor_vectors, v["k"], "__key", skip_self=False)
            values = known.select(F.col("__key").alias("neighbour"), F.col(target).cast("double").alias("__value"))
            means = near.join(values, "neighbour").groupBy("id").agg(F.avg("__value").alias("__mean")).withColumnRenamed("id", "__id")
            filled = out.join(means, F.col("__key") == F.col("__id"), "left")
            out = filled.withColumn(target, F.coalesce(F.col(target).cast("double"), "__mean")).drop("__id", "__mean")
        return out.select(*df.columns)


# Synthetic minority rows


def _between(df: DataFrame, draws: DataFrame, label: str, ids: Sequence[str], numeric: Sequence[str], near: DataFrame, seed: int) -> DataFrame:
    """One synthetic row per drawn copy, on the line from a row to one of its neighbours."""
    key = ids[0]
    numbers = F.array(*[F.col(c).cast("double") for c in numeric])
    points = df.select(F.col(key).cast("string").alias("neighbour"), numbers.alias("to"))
    # A row has at most k neighbours, so these lists are short.
    lists = near.join(points, "neighbour").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "to"))).alias("near"))
    made = draws.join(lists.withColumnRenamed("id", "__id"), F.col(key).cast("string") == F.col("__id"))
    pick = seeded_integer(seeded_hash([key, "copy"], seed), F.size("near")).cast("int")
    far = F.element_at("near", pick + 1)["to"]
    u = seeded_uniform([key, "copy"], seed + 1)
    moved = F.zip_with(numbers, far, lambda a, b: a + (b - a) * F.col("__u"))
    rows = made.withColumn("__u", u).withColumn("__moved", moved)
    cells = {c: F.col("__moved")[i] for i, c in enumerate(numeric)}
    return rows.withColumns(cells).drop("__id", "near", "__u", "__moved")


def smote(df: DataFrame, label: str, ids: Sequence[str], numeric: Sequence[str], seed: int, k: int = 5) -> DataFrame:
    """Raise every class to the largest one with points between neighbours of the class.

    Original rows have ``copy`` 0. Categories and other columns of a synthetic row are
    those of the row it starts from. A class with a single row cannot grow.
    """
    sizes = class_sizes(df, label)
    largest = max(sizes.values(), default=0)
    small = {c: (n, largest - n) for c, n in sizes.items() if 1 < n < largest}
    whole = df.withColumn("copy", F.lit(0).cast("bigint"))
    if not small:
        return whole
    minority = df.where(F.col(label).cast("string").isin(*small))
    draws = _drawn(minority, label, ids, small, seed)
    vectors = minority.select(ids[0], label, F.array(*[F.col(c).cast("double") for c in numeric]).alias("vector"))
    near = nearest(vectors, vectors, k, ids[0], within=label)
    return whole.unionByName(_between(minority, draws, label, ids, numeric, near, seed).select(whole.columns))


def _drawn(df: DataFrame, label: str, ids: Sequence[str], totals: dict[str, tuple[int, int]], seed: int) -> DataFrame:
    """Rows of each class drawn with replacement, one row per draw, numbered by ``copy``."""
    picks = draws_with_replacement(totals, df.sparkSession, seed)
    known = numbered(df, [label], ids, seed)
    hit = (known[label].cast("string") == picks["stratum"]) & (known["ordinal"] == picks["ordinal"])
    chosen = known.join(picks, hit).drop(picks["ordinal"]).drop("stratum", "ordinal")
    return repeated(chosen, "copies", "copy").drop("copies")


def adasyn(df: DataFrame, label: str, ids: Sequence[str], numeric: Sequence[str], seed: int, k: int = 5) -> DataFrame:
    """Like ``smote``, with more synthetic rows where more neighbours are of other classes.

    A row's share of its class's new rows is its share of foreign neighbours; a class whose
    rows have none is spread evenly.
    """
    key = ids[0]
    sizes = class_sizes(df, label)
    largest = max(sizes.values(), default=0)
    small = {c: n for c, n in sizes.items() if 1 < n < largest}
    whole = df.withColumn("copy", F.lit(0).cast("bigint"))
    if not small:
        return whole
    minority = df.where(F.col(label).cast("string").isin(*small))
    vectors = df.select(key, label, F.array(*[F.col(c).cast("double") for c in numeric]).alias("vector"))
    few = vectors.where(F.col(label).cast("string").isin(*small))
    around = nearest(few, vectors, k, key)
    own = vectors.select(F.col(key).cast("string").alias("id"), F.col(label).cast("string").alias("own"))
    theirs = own.select(F.col("id").alias("neighbour"), F.col("own").alias("other"))
    foreign = around.join(theirs, "neighbour").join(own, "id").groupBy("id", "own").agg(F.avg((F.col("own") != F.col("other")).cast("double")).alias("share"))
    totals = foreign.groupBy("own").agg(F.sum("share").alias("total"), F.count(F.lit(1)).alias("rows"))
    missing = F.element_at(F.create_map(*[x for c, n in small.items() for x in (F.lit(c), F.lit(largest - n))]), F.col("own"))
    portion = F.when(F.col("total") > 0, F.col("share") / F.col("total")).otherwise(1.0 / F.col("rows"))
    wanted = foreign.join(as_lookup(totals), "own").select(F.col("id").alias("__id"), F.round(portion * missing).cast("bigint").alias("copies"))
    chosen = minority.join(wanted.where("copies > 0"), F.col(key).cast("string") == F.col("__id")).drop("__id")
    draws = repeated(chosen, "copies", "copy").drop("copies")
    near = nearest(few, few, k, key, within=label)
    return whole.unionByName(_between(minority, draws, label, ids, numeric, near, seed).select(whole.columns))
