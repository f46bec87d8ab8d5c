"""Language-model scores by deleted interpolation.

The model mixes three estimates of a token after its predecessor,

    p = w2 * c(previous, token) / c(previous) + w1 * c(token) / N + w0 / (V + 1),

with weights that depend on how often the predecessor was seen (buckets of powers of two). The
counts come from the training documents. The weights come from expectation maximisation on
held-out counts: every training document is scored with its own occurrences deleted from all
counts, so each of them serves as held-out data once.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; each document ends with one end token,
which is also the predecessor of its first word. Words and pairs are named by 64-bit and 53-bit
hashes.

How it runs. Documents are dealt to units of bounded size. A unit asks for the counts of its
distinct words and pairs: sorted hashes, delta coded, cut into as many hash ranges as there are
units. A range adds up the counts of all units and answers each in the order of its question.
The unit puts the answers to its tokens and is written: so words never gather at a key, the
traffic is one entry per distinct pair and unit, and no task holds more than a unit or a range.
The held-out statistics are counted into a grid of bucket by logarithmic cells of both
estimates (eighths of a power of two); only this bounded grid comes to the driver.

Missing and empty texts consist of the end token. Missing ids are allowed, repeated rows count
each. Without training documents N and V are 0 and only the last term is left. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import text_arrays
from waymark.llm.tables import fold, stored, table
from waymark.llm.units import UNIT_BYTES, distinct, in_units, loose, packed, range_edges, squeezed, texts_of, units_of, unpacked

FOLDS, HELD_OUT = 7, 2
BUCKETS, CELLS, PER_OCTAVE = 48, 400, 8
PAIR_SHIFT = np.uint64(11)
_END = np.uint64(0x51ED270B9F2C3A57)
_PAIR = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Weights:
    """Training totals and one row of weights (pair, word, even) per context bucket."""

    tokens: int
    words: int
    by_bucket: np.ndarray


class Unit:
    """The tokens of some documents: names of words and pairs, and where they stand."""

    def __init__(self, texts: pa.Array):
        found = [text_arrays.word_hashes(p["text"]) for p in text_arrays.pieces(pa.RecordBatch.from_arrays([texts], ["text"]))]
        hashes = np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in found]])
        sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(o) for _, o in found]]) + 1
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        tokens = np.full(self.offsets[-1], _END, np.uint64)
        is_word = np.ones(len(tokens), bool)
        is_word[self.offsets[1:] - 1] = False
        tokens[is_word] = hashes
        previous = np.concatenate([[_END], tokens[:-1]]).astype(np.uint64)
        pairs = text_arrays.mixed(previous * _PAIR + tokens) >> PAIR_SHIFT
        self.words, self.pairs = distinct(tokens), distinct(pairs)
        self.word_at, self.pair_at = np.searchsorted(self.words, tokens), np.searchsorted(self.pairs, pairs)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)

    def counts(self, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each name stands in training documents."""
        used = training[self.doc]
        return np.bincount(self.word_at[used], minlength=len(self.words)), np.bincount(self.pair_at[used], minlength=len(self.pairs))

    def ranges(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the hash ranges begin among the words and among the pairs."""
        edges = range_edges(parts)
        cut = lambda names, edges: np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])
        return cut(self.words, edges), cut(self.pairs, edges >> PAIR_SHIFT)

    def own(self, at: np.ndarray) -> np.ndarray:
        """For each token, how often its name stands in the same document."""
        key = (self.doc.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64)
        names = distinct(key)
        place = np.searchsorted(names, key)
        return np.bincount(place, minlength=len(names))[place]


def _asked(parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in units_of(batches):
            unit = Unit(texts_of(rows))
            word_counts, pair_counts = unit.counts(np.asarray(rows["training"]).astype(bool))
            words, pairs = unit.ranges(parts)
            for part in range(parts):
                w, p = slice(words[part], words[part + 1]), slice(pairs[part], pairs[part + 1])
                if w.start == w.stop and p.start == p.stop:
                    continue  # of many small ranges a unit asks few
                columns = [*packed(unit.words[w]), squeezed(word_counts[w]), *packed(unit.pairs[p]), squeezed(pair_counts[p])]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "unit": pa.array([number], pa.int32()), **{f"b{i}": [c] for i, c in enumerate(columns)}})

    return ask


_ASKED = "part int, unit int, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary, b5 binary"
_ANSWERED = "part int, unit int, words binary, pairs binary, tokens long, distinct long"


def _totals(names: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sums over all lists, in the order of each list, and by distinct name."""
    known = distinct(np.concatenate(names))
    places = [np.searchsorted(known, n) for n in names]
    sums = np.zeros(len(known), np.int64)
    for place, count in zip(places, counts, strict=True):
        sums[place] += count
    return [sums[p] for p in places], sums


def _answered(asked: pa.Table) -> pa.Table:
    column = lambda i: asked[f"b{i}"].to_pylist()
    words, by_word = _totals([unpacked(*x) for x in zip(column(0), column(1), strict=True)], [loose(x) for x in column(2)])
    pairs, _ = _totals([unpacked(*x) for x in zip(column(3), column(4), strict=True)], [loose(x) for x in column(5)])
    n = asked.num_rows
    # The totals of the range go with its first answer.
    first = lambda value: pa.array([int(value), *[0] * (n - 1)], pa.int64())
    return pa.table(
        {
            "part": asked["part"],
            "unit": asked["unit"],
            "words": pa.array(map(squeezed, words), pa.binary()),
            "pairs": pa.array(map(squeezed, pairs), pa.binary()),
            "tokens": first(by_word.sum()),
            "distinct": first((by_word > 0).sum()),
        }
    )


_COUNTED = (
    "unit int, doc_ids array<long>, held_out array<boolean>, sizes array<int>, words binary, pairs binary, "
    "cells array<int>, cell_n array<double>, cell_pair array<double>, cell_word array<double>, tokens long, distinct long"
)


def _octave(values: np.ndarray) -> np.ndarray:
    """Logarithmic cell of positive numbers (0 for zero)."""
    with np.errstate(divide="ignore"):
        cell = np.floor(np.log2(values) * PER_OCTAVE) + CELLS // 2
    return np.where(values > 0, np.clip(cell, 1, CELLS - 1), 0).astype(np.int64)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _counted(rows: pa.Table, answers: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    unit = Unit(texts_of(rows))
    answers = answers.sort_by("part")
    merged = lambda name: np.concatenate([np.zeros(0, np.int64), *map(loose, answers[name].to_pylist())])
    words, pairs = merged("words")[unit.word_at], merged("pairs")[unit.pair_at]
    training = np.asarray(rows["training"]).astype(bool)

    used = training[unit.doc]
    begins = unit.offsets[:-1]
    back = np.maximum(np.arange(len(words)) - 1, 0)
    back[begins] = unit.offsets[1:] - 1  # the end token of the own document stands for its begin
    own_word = unit.own(unit.word_at)
    word, pair = (words - own_word)[used], (pairs - unit.own(unit.pair_at))[used]
    context = (words - own_word)[back][used]
    share = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    cell = (_bucket(context) * CELLS + _octave(share)) * CELLS + _octave(word.astype(float))
    cells, place = np.unique(cell, return_inverse=True)
    add = lambda v=None: np.bincount(place, v, minlength=len(cells)).astype(float)
    one = lambda values, kind=None: pa.array([values], kind)
    return pa.table(
        {
            "unit": pa.array([rows["unit"][0].as_py()], pa.int32()),
            "doc_ids": one(rows["doc_id"].to_pylist(), pa.list_(pa.int64())),
            "held_out": one(~training, pa.list_(pa.bool_())),
            "sizes": one(np.diff(unit.offsets), pa.list_(pa.int32())),
            "words": one(squeezed(words), pa.binary()),
            "pairs": one(squeezed(pairs), pa.binary()),
            "cells": one(cells, pa.list_(pa.int32())),
            "cell_n": one(add(), pa.list_(pa.float64())),
            "cell_pair": one(add(share), pa.list_(pa.float64())),
            "cell_word": one(add(word.astype(float)), pa.list_(pa.float64())),
            "tokens": one(sum(answers["tokens"].to_pylist()), pa.int64()),
            "distinct": one(sum(answers["distinct"].to_pylist()), pa.int64()),
        }
    )


def counted(docs: DataFrame, training: Column, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Units of documents whose tokens carry their training counts, stored.

    ``training`` says which documents the model learns from.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("training"))
    dealt, count = in_units(docs, unit_bytes)
    answers = dealt.mapInArrow(_asked(count), _ASKED).groupBy("part").applyInArrow(_answered, _ANSWERED)
    return stored(dealt.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_counted, _COUNTED), "counted")


def fit_weights(units: DataFrame, rounds: int = 60) -> Weights:
    """Learn the weights from the units' held-out grids."""
    tokens, words = (x or 0 for x in units.agg(F.sum("tokens"), F.sum("distinct")).first())
    grid = units.select(F.explode(F.arrays_zip("cells", "cell_n", "cell_pair", "cell_word")).alias("c")).groupBy("c.cells")
    grid = grid.agg(F.sum("c.cell_n"), F.sum("c.cell_pair"), F.sum("c.cell_word")).collect()
    cell, n, pair, word = (np.array(x, dtype=float) for x in zip(*sorted(map(tuple, grid)), strict=True)) if grid else (np.zeros(0),) * 4
    bucket = (cell // CELLS**2).astype(int)
    estimates = np.stack([pair / np.maximum(n, 1), word / np.maximum(n, 1) / max(tokens, 1), np.full(len(n), 1 / (words + 1))], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        parts = weights[bucket] * estimates
        parts = parts / parts.sum(axis=1, keepdims=True) * n[:, None]
        sums = np.stack([np.bincount(bucket, parts[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + 1
        weights = sums / sums.sum(axis=1, keepdims=True)
    weights[0] = [0, *(weights[0][1:] / weights[0][1:].sum())]  # an unseen context has no pairs
    return Weights(tokens, words, weights)


def scored(units: DataFrame, model: Weights) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"])
                at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                words, pairs = loose(row["words"]), loose(row["pairs"])
                back = np.maximum(np.arange(len(words)) - 1, 0)
                back[at] = at + sizes - 1
                context = words[back]
                weights = model.by_bucket[_bucket(context)]
                even = 1 / (model.words + 1)
                p = weights[:, 0] * pairs / np.maximum(context, 1) + weights[:, 1] * words / max(model.tokens, 1) + weights[:, 2] * even
                base = np.log10((words + 1) / (model.tokens + 1 * (model.words + 1)))
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["held_out"], pa.bool_()),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(np.add.reduceat((words > 0).astype(np.int64), at)),
                    pa.array(np.full(len(sizes), model.tokens, np.int64)),
                    pa.array(np.add.reduceat(base, at)),
                    pa.array(np.add.reduceat(np.log10(p), at)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return units.select("doc_ids", "held_out", "sizes", "words", "pairs").mapInArrow(score, schema)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = counted(table(spark, sf_dir, "documents"), fold("doc_id", FOLDS) != HELD_OUT)
    return scored(units, fit_weights(units))
