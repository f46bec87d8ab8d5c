"""Gradient boosting of all classes and all resamples at once, with errors per round.

A round grows one regression tree per class on the gradients of the joint softmax loss (one tree
in all for two classes, on the logistic loss). Variants of the training rows, such as the folds
of a cross-validation or the replicates of a bootstrap, are columns of row weights: a row with
weight zero in a variant is held out there. One pass over the rows serves a level of the trees
of every class and variant, so a cross-validated run takes as many jobs as a single one.

A pass adds up, in each task, the gradients and curvatures of the rows of every node by feature
and bin; tasks' sums meet by (variant, class, node), where the best cut is taken, and only that
cut comes to the driver. Leaf values follow from the sums on both
sides of the last cuts. The pass for the first level of a round also measures the rounds so far
on the training and the held-out rows, so the errors per round cost no pass of their own.

Numbers are cut into bins at approximate quantiles; a missing number has the lowest bin.
Gradients are rounded to multiples of 2^-20 and added as integers, so the trees do not depend on
how rows are partitioned or on lost tasks.

The driver holds bin edges and trees. A task's sums have
variants x classes x nodes of a level x features x bins cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.cluster import checkpointed
from waymark.features.base import FixedStep
from waymark.functions.labels import to_code
from waymark.models.classify import FittedClassifier, labels_of

UNIT = 2**20  # gradients are added as multiples of 1 / UNIT
CUT_EVERY = 2  # rounds after which the scores are written; until then every pass walks their trees
MOST_BINS = 255


@dataclass(frozen=True)
class Settings:
    """``patience``: rounds without a better held-out loss after which a variant stops growing
    (``None``: all rounds). ``l2`` smooths leaf values, ``min_rows`` is the least weight of a
    leaf, ``min_gain`` the least gain of a cut."""

    rounds: int = 20
    depth: int = 4
    rate: float = 0.3
    bins: int = 32
    l2: float = 1.0
    min_rows: float = 1.0
    min_gain: float = 0.0
    patience: int | None = None


@dataclass
class Forest:
    """Trees of one round: cut feature (-1: leaf), cut bin and value by (variant, class, node);
    the children of node i are 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, variants: int, outputs: int, depth: int) -> Forest:
        shape = (variants, outputs, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of every row after at most ``levels`` cuts, by (row, variant, class)."""
        variants, outputs, size = self.feature.shape
        tree = np.arange(variants * outputs).reshape(variants, outputs) * size
        row = (np.arange(len(bins)) * bins.shape[1])[:, None, None]
        features, cuts, cells = self.feature.ravel(), self.cut.ravel(), bins.ravel()
        node = np.zeros((len(bins), variants, outputs), np.int64)
        for _ in range(levels):
            at = node + tree
            feature = features.take(at)
            right = cells.take(row + np.maximum(feature, 0)) > cuts.take(at)
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node

    def scores(self, bins: np.ndarray, depth: int) -> np.ndarray:
        variants, outputs, size = self.value.shape
        tree = np.arange(variants * outputs).reshape(variants, outputs) * size
        return self.value.ravel().take(self.nodes(bins, depth) + tree)


@dataclass
class Boosted:
    """A run: ``history`` has one row per round and variant, ``best`` the round of each variant
    with the least held-out loss (all rounds if nothing is held out)."""

    labels: list[str]
    edges: list[np.ndarray]
    settings: Settings
    forests: list[Forest] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    best: list[int] = field(default_factory=list)

    def classifier(self, variant: int = 0, rounds: int | None = None) -> FittedClassifier:
        """The model of one variant, cut at its best round unless ``rounds`` is given."""
        rounds = self.best[variant] if rounds is None else rounds
        state = {
            "edges": [e.tolist() for e in self.edges],
            "classes": len(self.labels),
            "depth": self.settings.depth,
            "trees": [[f.feature[variant].tolist(), f.cut[variant].tolist(), f.value[variant].tolist()] for f in self.forests[:rounds]],
        }
        return FittedClassifier(list(self.labels), PipelineModel([BoostedScores(**state)]), self)

    def by_round(self, spark) -> DataFrame:
        """``variant, round, train_error, train_loss, test_error, test_loss``."""
        schema = "variant int, round int, train_error double, train_loss double, test_error double, test_loss double"
        return spark.createDataFrame([tuple(h.values()) for h in self.history], schema)

    def importance(self, variant: int = 0) -> np.ndarray:
        """How often each feature is cut."""
        used = np.concatenate([f.feature[variant].ravel() for f in self.forests[: self.best[variant]]] or [np.zeros(0, np.int32)])
        return np.bincount(used[used >= 0], minlength=len(self.edges))


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Class probabilities from scores along the last axis; one score is that of the second class."""
    if scores.shape[-1] == 1:
        second = 1.0 / (1.0 + np.exp(-scores))
        return np.concatenate([1.0 - second, second], axis=-1)
    shifted = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of a table of numbers: 0 for a missing one, else one more than the edges below it."""
    out = np.zeros(values.shape, np.uint8)
    for j, cuts in enumerate(edges):
        column = values[:, j]
        out[:, j] = np.where(np.isnan(column), 0, np.searchsorted(cuts, column, side="left") + 1)
    return out


class BoostedScores(FixedStep):
    """``prob`` from the trees of a boosted model."""

    def _transform(self, df):
        v = self.values
        edges = [np.array(e, float) for e in v["edges"]]
        outputs = 1 if v["classes"] == 2 else v["classes"]
        forests = [Forest(np.array(f, np.int32)[None], np.array(c, np.int32)[None], np.array(x, float)[None]) for f, c, x in v["trees"]]
        depth = v["depth"]

        @F.pandas_udf("array<double>")
        def prob(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            bins = binned(np.stack(features.to_numpy()), edges)
            scores = np.zeros((len(bins), 1, outputs))
            for forest in forests:
                scores += forest.scores(bins, depth)
            return pd.Series(list(probabilities(scores[:, 0])))

        return df.withColumn("prob", prob(vector_to_array("features")))


def bin_edges(df: DataFrame, bins: int) -> list[np.ndarray]:
    """Different approximate quantiles of every cell of ``features``."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"between 2 and {MOST_BINS} bins")
    width = df.select(F.size(vector_to_array("features")).alias("n")).first()
    if width is None:
        raise ValueError("no rows to boost on")
    cells = df.select(F.posexplode(vector_to_array("features")).alias("j", "x")).where(~F.isnan("x"))
    shares = [float(i) / bins for i in range(1, bins)]
    rows = cells.groupBy("j").agg(F.percentile_approx("x", shares, 100 * bins).alias("q")).collect()
    found = {r["j"]: np.unique(np.array(r["q"], float)) for r in rows}
    return [found.get(j, np.zeros(0)) for j in range(width["n"])]


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A binary column of equally long rows as a matrix."""
    whole = column.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if whole.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data.view(kind).reshape(len(whole), width) if width else np.zeros((len(whole), 0), kind)


def _rows_as_bytes(values: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values).reshape(len(values), -1)
    size = data.shape[1] * data.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int64) * size
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _binned_rows(edges: list[np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.asarray(batch["features"].flatten()).reshape(batch.num_rows, -1)
                bins = _rows_as_bytes(binned(values, edges))
                yield pa.RecordBatch.from_arrays([batch["label"], batch["weights"], bins, batch["scores"]], ["label", "weights", "bins", "scores"])

    return run


_ROW = "label int, weights array<int>, bins binary, scores binary"


@dataclass
class _Pass:
    """What a task needs to know of the trees so far."""

    features: int
    variants: int
    outputs: int
    bins: int
    depth: int
    done: list[Forest]
    growing: Forest | None
    level: int

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Labels, weights, bins and scores after the finished rounds."""
        labels = batch["label"].to_numpy()
        weights = np.asarray(batch["weights"].flatten()).reshape(len(labels), self.variants)
        bins = _matrix(batch["bins"], np.uint8, self.features)
        scores = _matrix(batch["scores"], np.float64, self.variants * self.outputs).reshape(len(labels), self.variants, self.outputs).copy()
        for forest in self.done:
            scores += forest.scores(bins, self.depth)
        return labels, weights, bins, scores

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of the batches whose arrays stay small."""
        step = max(1, 4_000_000 // (self.variants * self.outputs * 4 + self.features * 4))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with their scores written down."""
        for batch in self.slices(batches):
            *_, scores = self.read(batch)
            yield pa.RecordBatch.from_arrays([batch["label"], batch["weights"], batch["bins"], _rows_as_bytes(scores)], ["label", "weights", "bins", "scores"])

    def measured(self, labels: np.ndarray, weights: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Weight, mistakes and loss of the training and the held-out rows of each variant."""
        wrong = prob.argmax(axis=-1) != labels[:, None]
        own = prob[np.arange(len(labels)), :, labels]
        loss = np.rint(-np.log(np.maximum(own, 1e-15)) * UNIT)
        out = np.zeros((self.variants, 6))
        for start, w in ((0, weights), (3, (weights == 0).astype(float))):
            out[:, start] = w.sum(axis=0)
            out[:, start + 1] = (w * wrong).sum(axis=0)
            out[:, start + 2] = (w * loss).sum(axis=0)
        return out

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of gradients, curvatures and weights by (variant, class, node, feature, bin); and
        the measures, as rows without a class."""
        base, nodes = 2**self.level - 1, 2**self.level
        cells = nodes * self.features * self.bins
        held = np.zeros((self.variants, self.outputs, 3, cells))
        measures = np.zeros((self.variants, 6))
        for batch in self.slices(batches):
            labels, weights, bins, scores = self.read(batch)
            prob = probabilities(scores)
            if self.level == 0:
                measures += self.measured(labels, weights, prob)
            if self.growing is None:
                continue
            node = self.growing.nodes(bins, self.level)
            at = np.arange(self.features) * self.bins + bins
            for v in range(self.variants):
                used = weights[:, v] > 0
                for k in range(self.outputs):
                    rows = np.flatnonzero(used & (node[:, v, k] >= base))
                    p = prob[rows, v, 1 if self.outputs == 1 else k]
                    truth = labels[rows] == (1 if self.outputs == 1 else k)
                    w = weights[rows, v]
                    index = ((node[rows, v, k] - base)[:, None] * (self.features * self.bins) + at[rows]).ravel()
                    for s, values in enumerate((np.rint((p - truth) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-6) * UNIT), np.ones(len(rows)))):
                        held[v, k, s] += np.bincount(index, np.repeat(values * w, self.features), cells)
        names, lists = [], []
        if self.growing is not None:
            split = held.reshape(self.variants, self.outputs, 3, nodes, self.features, self.bins).astype(np.int64)
            seen = split[:, :, 2].any(axis=-1)
            for v, k, node, j in np.argwhere(seen).tolist():
                names.append((v, k, base + node, j))
                lists.append(split[v, k, :, node, j].ravel())
        if self.level == 0:
            for v in range(self.variants):
                names.append((v, -1, -1, -1))
                lists.append(measures[v].astype(np.int64))
        columns = [pa.array([n[i] for n in names], pa.int32()) for i in range(4)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        values = pa.array(np.concatenate([np.zeros(0, np.int64), *lists]), pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), values)], ["variant", "class", "node", "feature", "sums"])


_SUMS = "variant int, class int, node int, feature int, sums array<bigint>"
_CUTS = "variant int, class int, node int, feature int, cut int, gain double, sums array<bigint>"


def best_cut(sums: np.ndarray, settings: Settings) -> tuple[int, int, float, list[int]]:
    """The best cut of a node whose ``sums`` are by (feature, gradient / curvature / weight, bin):
    feature, bin, gain, and the sums of the node and of the bins up to the cut, which go left.
    Gains are compared after rounding, so that equal cuts tie; the first one is taken."""
    total = sums.sum(axis=2)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, :, None] - left
    l2 = settings.l2 * UNIT
    part = lambda x: x[:, 0].astype(float) ** 2 / (x[:, 1] + l2)
    ok = (left[:, 2] >= settings.min_rows) & (right[:, 2] >= settings.min_rows) & (left[:, 2] > 0) & (right[:, 2] > 0)
    gain = np.where(ok, np.round((part(left) + part(right) - part(total)[:, None]) / UNIT, 9), -np.inf)
    feature, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not np.isfinite(gain[feature, cut]):
        return -1, -1, 0.0, [*total[0].tolist(), 0, 0, 0]
    return int(feature), int(cut), float(gain[feature, cut]), [*total[feature].tolist(), *left[feature, :, cut].tolist()]


def _chosen(settings: Settings, bins: int) -> Callable[[pa.Table], pa.Table]:
    def choose(rows: pa.Table) -> pa.Table:
        name = {c: rows[c][0].as_py() for c in ("variant", "class", "node")}
        values = np.stack(rows["sums"].to_numpy())
        if name["class"] < 0:
            feature, cut, gain, held = -1, -1, 0.0, values.sum(axis=0).tolist()
        else:
            features, at = np.unique(rows["feature"].to_numpy(), return_inverse=True)
            sums = np.zeros((len(features), values.shape[1]), np.int64)
            np.add.at(sums, at, values)
            place, cut, gain, held = best_cut(sums.reshape(len(features), 3, bins), settings)
            feature = int(features[place]) if cut >= 0 else -1
        name |= {"feature": feature, "cut": cut}
        return pa.table({**{c: pa.array([x], pa.int32()) for c, x in name.items()}, "gain": [gain], "sums": [held]})

    return choose


def boost(df: DataFrame, label: str, settings: Settings = Settings(), weights: Sequence[str] = (), declared: Sequence[str] | None = None) -> Boosted:
    """Fit on ``df``, which holds ``features`` and a text label.

    ``weights`` names integer columns, one per variant (none: one variant with all rows); a row
    counts as often as its weight says and is held out where it is zero. Every variant tells the
    same classes apart, those of the whole table.
    """
    spark, labels = df.sparkSession, labels_of(df, label, declared)
    if len(labels) < 2:
        raise ValueError("boosting needs at least two classes")
    variants, outputs, bins = max(len(weights), 1), 1 if len(labels) == 2 else len(labels), settings.bins + 1
    df = df.where(F.col(label).isin(*labels))
    edges = bin_edges(df, settings.bins)
    counts = F.array(*[F.coalesce(F.col(w).cast("int"), F.lit(0)) for w in weights]) if weights else F.array(F.lit(1))
    start = F.lit(bytearray(8 * variants * outputs))
    ready = df.select(to_code(F.col(label).cast("string"), labels).cast("int").alias("label"), counts.alias("weights"), vector_to_array("features").alias("features"), start.alias("scores"))
    rows = checkpointed(ready.mapInArrow(_binned_rows(edges), _ROW))
    out, done = Boosted(labels, edges, settings), []
    alive = np.ones(variants, bool)

    def one_pass(growing: Forest | None, level: int) -> list:
        task = _Pass(len(edges), variants, outputs, bins, settings.depth, done, growing, level)
        sent = spark.sparkContext.broadcast(task)
        sums = rows.mapInArrow(lambda batches: sent.value.sums(batches), _SUMS)
        found = sums.groupBy("variant", "class", "node").applyInArrow(_chosen(settings, bins), _CUTS).collect()
        sent.unpersist()
        return found

    def record(found: list) -> None:
        for r in sorted((r for r in found if r["class"] < 0), key=lambda r: r["variant"]):
            n, wrong, loss, n_out, wrong_out, loss_out = r["sums"]
            share = lambda x, of: x / of if of else None
            measures = [share(wrong, n), share(loss / UNIT, n), share(wrong_out, n_out), share(loss_out / UNIT, n_out)]
            out.history.append(dict(zip(("variant", "round", "train_error", "train_loss", "test_error", "test_loss"), (r["variant"], len(out.forests), *measures), strict=True)))

    def settle() -> None:
        """Best rounds so far, and which variants go on."""
        out.best = []
        for v in range(variants):
            own = [h for h in out.history if h["variant"] == v]
            losses = [h["test_loss"] for h in own]
            best = own[int(np.argmin(losses))]["round"] if losses and None not in losses else len(out.forests)
            out.best.append(best)
            alive[v] = settings.patience is None or len(out.forests) - best < settings.patience

    for round_ in range(settings.rounds):
        growing = Forest.empty(variants, outputs, settings.depth)
        for level in range(settings.depth):
            found = one_pass(growing, level)
            if level == 0 and round_:
                record(found)
                settle()
                if not alive.any():
                    return out
            for r in found:
                if r["class"] >= 0:
                    _grow(growing, r, settings, alive)
        done.append(growing)
        out.forests.append(growing)
        if (round_ + 1) % CUT_EVERY == 0 and round_ + 1 < settings.rounds:
            task = _Pass(len(edges), variants, outputs, bins, settings.depth, done, None, 0)
            rows = checkpointed(rows.mapInArrow(task.scored, _ROW))
            done = []
    if settings.rounds:
        record(one_pass(None, 0))
    settle()
    return out


def _grow(growing: Forest, row, settings: Settings, alive: np.ndarray) -> None:
    """Give a node its cut and its children their values; a node that is not cut keeps the value
    it has. A variant that has stopped gets empty trees."""
    v, k, node = row["variant"], row["class"], row["node"]
    if not alive[v]:
        return
    g, h, _, g_left, h_left, _ = row["sums"]
    value = lambda g, h: -settings.rate * g / (h + settings.l2 * UNIT)
    if node == 0:
        growing.value[v, k, 0] = value(g, h)
    if row["cut"] >= 0 and row["gain"] > settings.min_gain:
        growing.feature[v, k, node], growing.cut[v, k, node] = row["feature"], row["cut"]
        growing.value[v, k, 2 * node + 1] = value(g_left, h_left)
        growing.value[v, k, 2 * node + 2] = value(g - g_left, h - h_left)


def fold_weights(df: DataFrame, folds: int, column: str = "fold") -> tuple[DataFrame, list[str]]:
    """A weight column per fold, zero on the rows of that fold."""
    names = [f"__weight_{k}" for k in range(folds)]
    return df.withColumns({n: (F.col(column) != k).cast("int") for k, n in enumerate(names)}), names


def error_by_round(run: Boosted, spark) -> DataFrame:
    """``round, train_mean, train_sd, test_mean, test_sd`` of the error rate over the variants."""
    table = run.by_round(spark)
    return table.groupBy("round").agg(
        F.count("*").alias("variants"),
        F.avg("train_error").alias("train_mean"), F.stddev_samp("train_error").alias("train_sd"),
        F.avg("test_error").alias("test_mean"), F.stddev_samp("test_error").alias("test_sd"),
    )
