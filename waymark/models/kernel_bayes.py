"""Naive Bayes with kernel densities for numbers and smoothed tables for categories.

The density of a number in a class is a Gaussian kernel estimate on a grid: values are counted
at their nearest grid point, the counts are smoothed, and what is between two points is
interpolated on the log scale. The bandwidth is 0.9 times the smaller of the standard deviation
and the interquartile range / 1.34, times n^(-1/5), times ``smoothness``. A category's share in
a class is ``(count + laplace) / (n + laplace * levels)``. Densities and shares below ``floor``
count as ``floor``.

Fitting takes one aggregate for the moments, one for exact quartiles, and one for the counts;
what comes to the driver is columns x classes x grid points, however many rows there are. A
score is a sum of looked-up logs, in JVM expressions. A missing cell says nothing, neither in
fitting nor in scoring. A level that was not seen in fitting has the floor in every class.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.cluster import LOOKUP_ROWS, bounded_rows
from waymark.features.base import FixedStep
from waymark.functions.labels import to_code
from waymark.models.classify import FittedClassifier, labels_of
from waymark.operators.profile import long_order_statistics

GRID, MARGIN = 512, 3.0  # grid points, and bandwidths beyond the outermost values


class KernelBayesScores(FixedStep):
    """``prob`` from priors, log densities on grids and log shares of levels."""

    def _transform(self, df):
        v = self.values
        parts = [F.lit([float(x) for x in v["priors"]]).cast("array<double>")]
        parts += [_looked_up(F.col(t["column"]).cast("double"), t) for t in v["numbers"]]
        parts += [_level(F.col(t["column"]).cast("string"), t) for t in v["levels"]]
        total = parts[0]
        for part in parts[1:]:
            total = F.when(part.isNull(), total).otherwise(F.zip_with(total, part, lambda a, b: a + b))
        weights = F.transform(F.array(total), lambda t: F.transform(t, lambda x: F.exp(x - F.array_max(t))))[0]
        prob = F.transform(F.array(weights), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, y: a + y)))[0]
        return df.withColumn("prob", prob)


def _looked_up(x: Column, spec: dict) -> Column:
    """Log densities of all classes at ``x``; null if it is missing."""
    points = F.from_json(F.lit(json.dumps(spec["logs"])), "array<array<double>>")
    last = len(spec["logs"]) - 1
    place = F.least(F.greatest((x - F.lit(spec["low"])) / F.lit(spec["step"]), F.lit(0.0)), F.lit(float(last)))
    at = F.least(F.floor(place), F.lit(last - 1)).cast("int")
    between = F.zip_with(points[at], points[at + 1], lambda a, b: a + (b - a) * (place - at))
    return F.when(x.isNotNull() & ~F.isnan(x), between)


def _level(x: Column, spec: dict) -> Column:
    known = F.from_json(F.lit(json.dumps(spec["logs"])), "map<string,array<double>>")
    return F.when(x.isNotNull(), F.coalesce(F.element_at(known, x), F.lit([float(z) for z in spec["unseen"]]).cast("array<double>")))


def _bandwidth(n: int, sd: float | None, low: float, high: float, mean: float, smoothness: float) -> float:
    sd = sd or 0.0
    spread = min(sd, (high - low) / 1.34) or sd or abs(mean) or 1.0
    return 0.9 * spread * n**-0.2 * smoothness


def kernel_bayes(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    nominal: Sequence[str] = (),
    smoothness: float = 1.0,
    laplace: float = 0.0,
    grid: int = GRID,
    floor: float = 1e-9,
    declared: Sequence[str] | None = None,
) -> FittedClassifier:
    """Fit on plain columns. A number without any value, and a category without any level, is
    left out."""
    labels = labels_of(df, label, declared)
    rows = df.where(F.col(label).isin(*labels)).select(to_code(F.col(label).cast("string"), labels).cast("int").alias("__class"), *numeric, *nominal)
    sizes = {r["__class"]: r["count"] for r in rows.groupBy("__class").count().collect()}
    total = sum(sizes.values())
    state = {
        "priors": [math.log(sizes[c] / total) for c in range(len(labels))],
        "numbers": _numbers(rows, numeric, len(labels), smoothness, grid, floor),
        "levels": _levels(rows, nominal, len(labels), laplace, floor),
    }
    return FittedClassifier(labels, PipelineModel([KernelBayesScores(**state)]))


def _numbers(rows: DataFrame, numeric: Sequence[str], classes: int, smoothness: float, grid: int, floor: float) -> list[dict]:
    if not numeric:
        return []
    cells = rows.select("__class", *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(["__class"], list(numeric), "name", "value")
    cells = cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
    moments = cells.groupBy("name", "__class").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    keyed = cells.select(F.concat_ws("\u0001", "name", "__class").alias("column"), "value")
    marks = long_order_statistics(keyed, lambda n: {"low": (n - 1) * 0.25, "high": (n - 1) * 0.75})
    quartiles = {r["column"]: (r["low"], r["high"]) for r in marks.collect()}
    bands, ends = {}, {}
    for r in moments.collect():
        c = r["name"], r["__class"]
        bands[c] = _bandwidth(r["n"], r["sd"], *quartiles[f"{c[0]}\u0001{c[1]}"], r["mean"], smoothness)
        low, high, widest = ends.get(c[0], (math.inf, -math.inf, 0.0))
        ends[c[0]] = min(low, r["min"]), max(high, r["max"]), max(widest, bands[c])
    lines = {}
    for name, (low, high, widest) in ends.items():
        low, high = low - MARGIN * widest, high + MARGIN * widest
        lines[name] = low, (high - low) / (grid - 1)
    at = F.lit(None).cast("int")
    for name, (low, step) in lines.items():
        at = F.when(F.col("name") == name, F.floor((F.col("value") - F.lit(low)) / F.lit(step) + 0.5).cast("int")).otherwise(at)
    held = {c: np.zeros(grid) for c in bands}
    for r in cells.groupBy("name", "__class", at.alias("at")).count().collect():  # at most columns x classes x grid
        held[r["name"], r["__class"]][min(max(r["at"], 0), grid - 1)] += r["count"]
    out = []
    for name in (c for c in numeric if c in lines):
        low, step = lines[name]
        logs = np.full((grid, classes), math.log(floor))
        for c in range(classes):
            if (name, c) in bands:
                band, counts = bands[name, c], held[name, c]
                used = np.flatnonzero(counts)
                gaps = (np.arange(grid)[:, None] - used[None, :]) * step / band
                density = np.exp(-0.5 * gaps**2) @ counts[used] / (counts.sum() * band * math.sqrt(2 * math.pi))
                logs[:, c] = np.log(np.maximum(density, floor))
        out.append({"column": name, "low": low, "step": step, "logs": logs.tolist()})
    return out


def _levels(rows: DataFrame, nominal: Sequence[str], classes: int, laplace: float, floor: float) -> list[dict]:
    if not nominal:
        return []
    cells = rows.select("__class", *[F.col(c).cast("string").alias(c) for c in nominal]).unpivot(["__class"], list(nominal), "name", "level")
    counted = bounded_rows(cells.where("level IS NOT NULL").groupBy("name", "__class", "level").count(), LOOKUP_ROWS * classes)
    if counted is None:
        raise ValueError("a category has too many levels for a table; lump them first")
    out = []
    for name in nominal:
        own = [r for r in counted if r["name"] == name]
        levels = sorted({r["level"] for r in own})
        if not levels:
            continue
        table = np.zeros((len(levels), classes))
        for r in own:
            table[levels.index(r["level"]), r["__class"]] = r["count"]
        sums = table.sum(axis=0) + laplace * len(levels)
        shares = np.where(sums > 0, (table + laplace) / np.where(sums > 0, sums, 1.0), 0.0)
        logs = np.log(np.maximum(shares, floor))
        out.append({"column": name, "logs": dict(zip(levels, logs.tolist(), strict=True)), "unseen": [math.log(floor)] * classes})
    return out
