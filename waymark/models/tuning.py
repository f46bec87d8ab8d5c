"""Parameter grids, resampled evaluation and choice of a configuration.

Each fit is a distributed Spark job; the driver holds settings and metric values only.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.cluster import checkpointed
from waymark.features.resample import bootstrap_draws
from waymark.operators.profile import spread_summary
from waymark.operators.reshape import widen
from waymark.operators.windows import first_per_key

Grid = list[dict]


# Grids. A space maps a name to a list of values or to a (low, high) range.


def full_grid(space: Mapping[str, Sequence]) -> Grid:
    names = list(space)
    return [dict(zip(names, values)) for values in itertools.product(*space.values())]


def regular_grid(space: Mapping[str, tuple[float, float]], levels: int = 3) -> Grid:
    """Evenly spaced values of every range; whole-number ranges stay whole."""
    return full_grid({k: _unique(_scaled(bounds, np.linspace(0, 1, levels))) for k, bounds in space.items()})


def _unique(values: list) -> list:
    return list(dict.fromkeys(values))


def random_grid(space: Mapping[str, Sequence], size: int, seed: int) -> Grid:
    draw = np.random.default_rng(seed)
    return [{k: _pick(v, draw.random()) for k, v in space.items()} for _ in range(size)]


def space_filling_grid(space: Mapping[str, Sequence], size: int, seed: int) -> Grid:
    """Latin hypercube: each range is cut into ``size`` strips and every strip is used once."""
    draw = np.random.default_rng(seed)
    places = {k: (draw.permutation(size) + draw.random(size)) / size for k in space}
    return [{k: _pick(v, places[k][i]) for k, v in space.items()} for i in range(size)]


def _scaled(bounds: tuple, at) -> list:
    low, high = bounds
    values = low + (high - low) * np.asarray(at)
    if isinstance(low, int) and isinstance(high, int):
        return [int(v) for v in np.rint(values)]
    return [float(v) for v in values]


def _pick(values: Sequence, at: float):
    if isinstance(values, tuple):
        return _scaled(values, [at])[0]
    return values[min(int(at * len(values)), len(values) - 1)]


# Evaluation


_RESULT = "config int, settings string, fold int, metric string, value double, error string"


def fingerprint(df: DataFrame) -> str:
    """A name for the rows of a table that does not depend on their order."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    n, total, mixed = df.agg(F.count("*"), F.sum(row.cast("decimal(20,0)")), F.bit_xor(F.xxhash64(row))).first()
    return hashlib.sha256(f"{df.schema.simpleString()}:{n}:{total}:{mixed}".encode()).hexdigest()


class ResultStore:
    """An append-only table of finished fits in a folder, so that a stopped sweep goes on.

    An entry is named by a hash of the data, what is done to it, the settings and the fold, and
    is written to a folder of its own when its fit has ended, so fits that end at the same time
    do not meet. ``compact`` makes one file of them.
    """

    _SCHEMA = f"entry string, {_RESULT}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def entry(data: str, recipe: str, settings: Mapping, fold: int) -> str:
        text = json.dumps([data, recipe, sorted(settings.items()), fold], default=str)
        return "e" + hashlib.sha256(text.encode()).hexdigest()

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._SCHEMA).parquet(self.path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self._SCHEMA)

    def done(self, entries: Sequence[str]) -> dict[str, list[tuple]]:
        """The rows of those of ``entries`` that are there. An entry that was written twice
        counts once."""
        wanted = self.spark.createDataFrame([(e,) for e in entries], "entry string")
        found: dict[str, dict] = {}
        for r in self.table().join(wanted, "entry", "left_semi").collect():  # at most the grid's own rows
            found.setdefault(r["entry"], {})[r["metric"]] = tuple(r)[1:]
        return {e: list(rows.values()) for e, rows in found.items()}

    def add(self, entry: str, rows: Sequence[tuple]) -> None:
        self.spark.createDataFrame(rows, _RESULT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/entry={entry}")

    def compact(self, path: str) -> ResultStore:
        """The same entries as one file per task in a new folder."""
        self.table().dropDuplicates(["entry", "metric"]).coalesce(1).write.parquet(path)
        return ResultStore(self.spark, path)


def _run(jobs: Sequence[tuple], run: Callable[[tuple], list[tuple]], parallelism: int, store: ResultStore | None, names: Mapping[tuple, str]) -> list[tuple]:
    """The rows of all jobs; those that the store holds are not run."""
    known = store.done(list(names.values())) if store else {}

    def one(job: tuple) -> list[tuple]:
        name = names.get(job[:2])
        if name in known:
            return [(job[0], *row[1:]) for row in known[name]]
        rows = run(job)
        if store:
            store.add(name, rows)
        return rows

    with ThreadPoolExecutor(parallelism) as pool:
        return [row for part in pool.map(one, jobs) for row in part]


def _attempt(config: int, settings: Mapping, fold: int, measure: Callable[[], Mapping[str, float]]) -> list[tuple]:
    name, error = str(sorted(settings.items())), None
    try:
        values = measure()
    except Exception as problem:  # a poor setting must not end the whole run
        values, error = {"failed": 1.0}, f"{type(problem).__name__}: {problem}"
    return [(config, name, fold, m, float(v), error) for m, v in values.items()]


def evaluate_grid(
    folded: DataFrame,
    folds: int,
    grid: Grid,
    fit: Callable[[dict, DataFrame], object],
    score: Callable[[object, DataFrame], Mapping[str, float]],
    parallelism: int = 2,
    column: str = "fold",
    store: ResultStore | None = None,
    recipe: str = "",
) -> DataFrame:
    """Fit and score every configuration on every fold of a table that carries its fold.

    Gives ``(config, settings, fold, metric, value, error)``. The table is written to the
    checkpoint folder once, since every fit reads it again. A fit that fails is recorded
    with the metric ``failed`` and its whole error text, and the run goes on. With a ``store``
    finished fits are kept there, and those it holds for this table and ``recipe`` (a name for
    what ``fit`` and ``score`` do) are not run again.
    """
    ready = checkpointed(folded)
    jobs = [(i, k, settings) for k in range(folds) for i, settings in enumerate(grid)]

    def run(job):
        i, k, settings = job
        train, test = fold_pair(ready, k, column)
        return _attempt(i, settings, k, lambda: score(fit(settings, train), test))

    data = fingerprint(ready) if store else ""
    names = {(i, k): ResultStore.entry(data, recipe, settings, k) for i, k, settings in jobs} if store else {}
    return folded.sparkSession.createDataFrame(_run(jobs, run, parallelism, store, names), _RESULT)


def evaluate_replicates(
    df: DataFrame,
    ids: Sequence[str],
    grid: Grid,
    fit: Callable[[dict, DataFrame, str], object],
    score: Callable[[object, DataFrame], Mapping[str, float]],
    times: int = 25,
    seed: int = 1,
    parallelism: int = 2,
    store: ResultStore | None = None,
    recipe: str = "",
) -> DataFrame:
    """Fit and score every configuration on bootstrap replicates, without copying a row.

    A replicate is a weight per row, its number of draws, which follows from the row's id: the
    fit gets the rows with a weight above zero and the weight column's name, the score gets the
    rows that were not drawn. Gives what ``evaluate_grid`` gives, with the replicate (from 1) as
    the fold.
    """
    ready, weight = checkpointed(df), "__draws"
    jobs = [(i, r, settings) for r in range(1, times + 1) for i, settings in enumerate(grid)]

    def run(job):
        i, r, settings = job
        drawn = ready.withColumn(weight, bootstrap_draws(ids, F.lit(r), seed).cast("double"))
        measure = lambda: score(fit(settings, drawn.where(F.col(weight) > 0), weight), drawn.where(F.col(weight) == 0).drop(weight))
        return _attempt(i, settings, r, measure)

    data = f"{fingerprint(ready)}:{seed}" if store else ""
    names = {(i, r): ResultStore.entry(data, recipe, settings, r) for i, r, settings in jobs} if store else {}
    return df.sparkSession.createDataFrame(_run(jobs, run, parallelism, store, names), _RESULT)


def fold_pair(df: DataFrame, k: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Training and assessment rows of fold ``k``."""
    return df.where(F.col(column) != k).drop(column), df.where(F.col(column) == k).drop(column)


def evaluate_specs(spark: SparkSession, specs: Mapping[str, Callable[[], Mapping[str, float]]]) -> DataFrame:
    """Run named fits one after another; a failed one is listed with its error and skipped."""
    rows = []
    for name, run in specs.items():
        try:
            rows += [(name, metric, float(value), None) for metric, value in run().items()]
        except Exception as error:  # one broken combination must not end the sweep
            rows.append((name, "failed", None, f"{type(error).__name__}: {error}"))
    return spark.createDataFrame(rows, "spec string, metric string, value double, error string")


def cross_specs(preparations: Sequence[str], classifiers: Mapping[str, Grid]) -> list[dict]:
    """Every preparation with every classifier and its grid, with the size of the search."""
    return [
        {"recipe": r, "clf": c, "num_params": len(grid[0]) if grid else 0, "tune_size": len(grid)}
        for r, (c, grid) in itertools.product(preparations, classifiers.items())
    ]


# Metric tables


def collect_metrics(results: DataFrame, config: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, count and standard error per configuration and metric."""
    return results.groupBy(*config, "metric").agg(
        F.avg(value).alias("mean"),
        F.count(value).alias("n"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("std_err"),
    )


def show_best(metrics: DataFrame, config: Sequence[str], n: int = 1) -> DataFrame:
    """The n best configurations of each metric; ties go to the earlier configuration."""
    from pyspark.sql import Window

    order = Window.partitionBy("metric").orderBy(F.desc("mean"), *config)
    return metrics.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= n).drop("__place")


def best_settings(results: DataFrame, grid: Grid, metric: str) -> dict:
    """Settings with the best mean of a metric over the folds, to refit with."""
    metrics = collect_metrics(results.where(F.col("metric") == metric), ["config"])
    row = show_best(metrics, ["config"]).first()
    if row is None:
        raise ValueError(f"no configuration has a value for {metric}")
    return grid[row["config"]]


def _simplest(metrics: DataFrame, config: Sequence[str], simpler: Sequence[str], good: Column) -> DataFrame:
    best = show_best(metrics, config).select(
        F.col("metric"), F.col("mean").alias("__best"), F.coalesce(F.col("std_err"), F.lit(0.0)).alias("__err")
    )
    near = metrics.join(best, "metric").where(good).drop("__best", "__err")
    return first_per_key(near, ["metric"], [F.asc(c) for c in (*simpler, *config)])


def select_within_std_err(metrics: DataFrame, config: Sequence[str], simpler: Sequence[str]) -> DataFrame:
    """Simplest configuration whose mean is within one standard error of the best."""
    return _simplest(metrics, config, simpler, F.col("mean") >= F.col("__best") - F.col("__err"))


def select_within_pct_loss(metrics: DataFrame, config: Sequence[str], simpler: Sequence[str], limit: float = 2.0) -> DataFrame:
    """Simplest configuration that loses at most ``limit`` percent against the best."""
    return _simplest(metrics, config, simpler, (F.col("__best") - F.col("mean")) / F.col("__best") * 100 <= limit)


def tuning_summary(metrics: DataFrame, config: str, names: Sequence[str]) -> DataFrame:
    """One wide row: best value, its configuration, and mean and sd over configurations."""
    spark = metrics.sparkSession
    best = show_best(metrics, [config]).select(F.lit(1).alias("one"), "metric", F.col("mean").alias("best"), F.col(config).alias("model"))
    spread = spread_summary(metrics, ["metric"], "mean").withColumn("one", F.lit(1))
    wide_best = widen(best, ["one"], "metric", names, ["best"])
    wide_model = widen(best, ["one"], "metric", names, ["model"]).withColumnsRenamed({f"model_{n}": f"best_{n}_model" for n in names})
    wide_spread = widen(spread, ["one"], "metric", names, ["mean", "sd"])
    return spark.range(1).select(F.lit(1).alias("one")).join(wide_best, "one").join(wide_spread, "one").join(wide_model, "one").drop("one")
