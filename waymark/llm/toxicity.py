"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives. The unlabelled side is a draw from all texts of the
training folds, the confirmed ones included, so that it holds the class prior's share of
toxic texts. A linear classifier on word
presence is fitted with numpy on the class-prior-corrected risk

    prior * mean_P loss(z) + max(0, mean_U loss(-z) - prior * mean_P loss(-z))

whose second part may not fall below zero: where it does, the step goes the other way, so a
flexible model cannot push unlabelled positives down. Scores are sigmoids of the linear part.

Spark picks the rows and builds features in tasks, numpy fits on a bounded sample, and Spark
scores every whole text in one pass without a shuffle.

Words are runs of letters after lower-casing A-Z; their beginnings count as features too. Missing and empty texts have no words and
get the score of the bias alone. Without a positive the score is 0 everywhere. A document
labelled twice counts as toxic if one label says so. Repeated rows are scored each; columns
other than the named ones are passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm import text_arrays
from waymark.llm.tables import fold, narrow, share_hash, stored, table

SLOT_BITS = 20
# Word beginnings of these many bytes are features too, for words with changing endings.
BEGINNINGS = (4, 5, 6)
FOLDS = 5


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the kept word slots (ascending), the bias and the class prior."""

    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf
    prior: float = 0.0

    def scores(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        if self.bias == -np.inf:
            return np.zeros(n)
        z = np.full(n, self.bias)
        if len(self.slots):
            at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            known = self.slots[at] == slot
            z += np.bincount(doc[known], self.weights[at[known]], minlength=n)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def word_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document index and slot of each distinct word, and word beginning, of each text."""
    data, offsets = text_arrays.flat(texts)
    low = text_arrays.lowered(data)
    starts, ends, doc = text_arrays.words(low, offsets, text_arrays.NO_LETTER)
    prefix = text_arrays.PrefixHash(low)
    hashes, rows = [prefix.of(starts, ends)], [doc]
    for size in BEGINNINGS:
        longer = ends - starts > size
        hashes.append(text_arrays.mixed(prefix.of(starts[longer], starts[longer] + size) + np.uint64(1)))
        rows.append(doc[longer])
    doc, hashes = np.concatenate(rows).astype(np.uint64), np.concatenate(hashes)
    key = np.sort((doc << np.uint64(SLOT_BITS)) | (hashes >> np.uint64(64 - SLOT_BITS)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(SLOT_BITS)).astype(np.int64), (key & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_arrays.pieces(batch):
            doc, slot = word_slots(piece["text"])
            ends = np.searchsorted(doc, np.arange(piece.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(slot.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([piece["toxic"], piece["drawn"], lists], ["toxic", "drawn", "slots"])


def _pairs(slots: pa.ListArray, step: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text index and slot of all features, some texts at a time."""
    offsets, values = np.asarray(slots.offsets), np.asarray(slots.values)
    for start in range(0, len(slots), step):
        ends = offsets[start : start + step + 1]
        doc = np.repeat(np.arange(start, start + len(ends) - 1), np.diff(ends))
        yield doc, values[ends[0] : ends[-1]].astype(np.int64)


def _selected(slots: pa.ListArray, positive: np.ndarray, min_z: float) -> np.ndarray:
    """Slots whose share of positives differs from that of unlabelled texts by ``min_z``
    standard errors."""
    total, hits = np.zeros((2, 1 << SLOT_BITS))
    for doc, slot in _pairs(slots):
        total += np.bincount(slot, minlength=len(total))
        hits += np.bincount(slot[positive[doc]], minlength=len(total))
    share = positive.mean()
    z = (hits - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9) + 1.0)
    return np.flatnonzero(np.abs(z) >= min_z)


def _bounded_prior(prior: float, hits: np.ndarray, marginal: np.ndarray) -> float:
    """The prior, lowered to what the drawn texts can hold at most.

    A word that has the share ``hits`` among confirmed and ``marginal`` among drawn texts
    allows a toxic share of at most their ratio. The tightest half-supported words decide.
    """
    strong = hits >= 0.5 * hits.max(initial=0)
    return min(prior, marginal[strong].sum() / hits[strong].sum()) if hits.max(initial=0) > 0 else prior


def nnpu_risk(z: np.ndarray, confirmed: np.ndarray, drawn: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk of scores ``z`` under the weights of confirmed and of drawn texts:
    of missing toxic texts, and the corrected one of flagging clean texts, which counts as zero
    where it is negative."""
    missed = prior * (confirmed * np.logaddexp(0, -z)).sum()
    as_negative = np.logaddexp(0, z)  # loss of calling a text clean
    return missed, (drawn * as_negative).sum() - prior * (confirmed * as_negative).sum()


def nnpu_slope(z: np.ndarray, confirmed: np.ndarray, drawn: np.ndarray, prior: float) -> np.ndarray:
    """The slope by score: of the whole risk, or, where the corrected part is negative, the
    negative slope of that part, which leads back to zero."""
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))
    slope_negative = (drawn - prior * confirmed) * p
    return -prior * confirmed * (1 - p) + slope_negative if nnpu_risk(z, confirmed, drawn, prior)[1] >= 0 else -slope_negative


def fit_nnpu(
    features: pa.ListArray,
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    min_z: float = 5.0,
    steps: int = 400,
    rate: float = 0.1,
    l2: float = 1e-6,
) -> ToxicityModel:
    """Fit on the word slots of each text. ``positive`` and ``unlabelled`` have one flag per text; a
    confirmed text that was also drawn from all texts has both."""
    if not positive.any() or positive.all() or not unlabelled.any():
        return ToxicityModel(prior=prior)
    slots = _selected(features, positive, min_z)
    if not len(slots):
        return ToxicityModel(bias=float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), prior=prior)
    docs, places, n = [], [], len(positive)
    for doc, slot in _pairs(features):
        place = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
        known = slots[place] == slot
        docs.append(doc[known])
        places.append(place[known])
    doc, at = np.concatenate(docs), np.concatenate(places)
    share = {True: positive / positive.sum(), False: unlabelled / unlabelled.sum()}
    hits, marginal = (np.bincount(at, share[side][doc], minlength=len(slots)) for side in (True, False))
    risen = hits > 2 * marginal
    prior = _bounded_prior(prior, hits[risen], marginal[risen])
    theta = np.zeros(len(slots) + 1)
    theta[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(doc, theta[at], minlength=n) + theta[-1]
        slope = nnpu_slope(z, share[True], share[False], prior)
        gradient = np.append(np.bincount(at, slope[doc], minlength=len(slots)) + l2 * theta[:-1], slope.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel(slots, theta[:-1], float(theta[-1]), prior)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 16000, seed: int = 7) -> ToxicityModel:
    """Fit on a bounded sample of the training folds of ``docs``.

    The expected number of sampled positives and unlabelled texts is at most ``max_positive``
    and ``max_unlabelled``; rows are drawn by a hash of their id. The class prior is the
    toxic share of all labelled training rows.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n_toxic, n_clean = known.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1))).first()
    if not n_toxic:
        return ToxicityModel()
    rows = docs.select("doc_id", "text").where(fold("doc_id", FOLDS) != 0)
    n_rows = rows.select("doc_id").count()
    draw = share_hash([F.col("doc_id")], seed)
    drawn = draw < min(1.0, max_unlabelled / max(n_rows, 1))
    confirmed = known.where((F.col("toxic") == 1) & (draw < min(1.0, max_positive / n_toxic))).select("doc_id", F.lit(True).alias("toxic"))
    # The ids of the confirmed sample are few, so the texts stay where they are.
    sample = rows.join(narrow(stored(confirmed, "confirmed")), "doc_id", "left").withColumn("drawn", drawn)
    sample = sample.select(F.coalesce("toxic", F.lit(False)).alias("toxic"), "drawn", "text").where(F.col("toxic") | F.col("drawn"))
    found = sample.mapInArrow(_feature_rows, "toxic boolean, drawn boolean, slots array<int>").toArrow().combine_chunks()
    if not found.num_rows:
        return ToxicityModel()
    lists = found["slots"].combine_chunks() if isinstance(found["slots"], pa.ChunkedArray) else found["slots"]
    flags = [np.asarray(found[c]).astype(bool) for c in ("toxic", "drawn")]
    return fit_nnpu(lists, *flags, prior=n_toxic / (n_toxic + n_clean))


def with_toxicity(docs: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """``docs`` with the score of every text in a new last column ``out``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_arrays.pieces(batch):
                scores = model.scores(*word_slots(piece["text"]), piece.num_rows)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores)], [*piece.schema.names, out])

    return docs.mapInArrow(score, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), "__score")
    return scored.select(
        "doc_id",
        (fold("doc_id", FOLDS) == 0).alias("held_out"),
        F.round("__score", 6).alias("score"),
        (F.round("__score", 6) >= 0.5).cast("int").alias("predicted"),
    )
