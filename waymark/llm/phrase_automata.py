"""Removal of repeated phrases with Aho-Corasick automata.

A word goes if it lies in a window of ``LENGTH`` words whose sequence also starts anywhere else,
in another document or the same one.

1. Candidates. The anchor of a window is its first smallest gram of ``GRAM`` words by hash, so
   equal windows have equal anchors at equal places; consecutive windows with one anchor are a
   run. A run can only hold a repeated window if its anchor occurs at least twice.
2. Frequent grams come last in the order, so that a line that stands in every document does not
   gather the windows around it under one anchor. They are found by Misra-Gries counters in
   every task: each gram with a share of 1 / ``FREQUENT`` of all grams is among them, and they
   are at most twice as many, however large the corpus is.
3. Passages. The words of the runs whose anchor recurs (pieces) go to shards by anchor, each
   different piece once with its number. A shard counts the windows of its pieces and joins
   neighbouring repeated windows into one passage as long as no occurrence is lost by that.
4. Automata. The shard compiles its passages into an Aho-Corasick automaton and streams the
   pieces through it. A passage that is located at least twice is confirmed; the located words
   are sent back to the documents the pieces came from. A document is so streamed through the
   automata of the shards of its anchors and no others: all equal windows meet in one shard.

Hashes only propose passages, what is located is compared by its bytes.

Words are ``[^\\x20\\x09-\\x0D]+`` of whole texts; a missing text has none. Windows never cross
rows. Rows are told apart by a 128-bit hash of id and text: repeated rows and missing ids are
rows like any other (equal rows repeat each other's windows). Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.tables import narrow, stored, table
from waymark.llm.text_arrays import PrefixHash, flat, mixed, pieces, words

LENGTH, GRAM = 35, 8
GRAMS = LENGTH - GRAM + 1  # of a window
FREQUENT = 32_768
COUNTERS = 2 * FREQUENT
SHARD_ANCHORS = 4_000  # different anchors of a shard, on average
_STEP = np.uint64(0xA24BAED4963EE407)
_LAST = np.uint64(1 << 63)
_KEYS = ["k1", "k2"]


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all grams of the rows with at least ``LENGTH`` words, the numbers of these rows,
    and where their words begin and end. Grams that cross rows are among them."""
    data, offsets = flat(texts)
    starts, ends, row = words(data, offsets)
    hashes = PrefixHash(data).of(starts, ends)
    counts = np.bincount(row, minlength=len(texts))
    long = np.flatnonzero(counts >= LENGTH)
    values = hashes[counts[row] >= LENGTH]
    edges = np.concatenate([[0], np.cumsum(counts[long])])
    grams = np.zeros(max(len(values) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM):
        grams = (grams ^ values[i : i + len(grams)]) * _STEP + (grams >> np.uint64(29))
    return mixed(grams), long, edges


def _starts(edges: np.ndarray, size: int) -> np.ndarray:
    """Where the runs of ``size`` words that lie in one row start."""
    counts = np.maximum(np.diff(edges) - size + 1, 0)
    total = np.cumsum(counts)
    return np.repeat(edges[:-1] - (total - counts), counts) + np.arange(counts.sum())


def _fewest(names: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries: at most ``limit`` counters, all lowered by what the next one holds."""
    if len(names) > limit:
        counts = counts - np.partition(counts, len(counts) - limit - 1)[len(counts) - limit - 1]
        names, counts = names[counts > 0], counts[counts > 0]
    return names, counts


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for batch in batches:
        for part in pieces(batch):
            grams, _, edges = _grams(part["text"])
            grams = grams[_starts(edges, GRAM)]
            total += len(grams)
            found, times = np.unique(grams, return_counts=True)
            both, at = np.unique(np.concatenate([names, found]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([counts, times]), len(both)).astype(np.int64)
            names, counts = _fewest(both, sums, COUNTERS)
    none = pa.nulls(1, pa.int64())
    yield pa.RecordBatch.from_arrays([none, pa.array([total], pa.int64())], ["gram", "n"])
    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], ["gram", "n"])


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of at most ``COUNTERS`` grams, among them every one with a share of
    1 / ``FREQUENT`` of all grams."""
    counted = stored(docs.select("text").mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = counted.where("gram IS NULL").agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("gram").isNotNull() & (F.col("n") * COUNTERS >= total)).select("gram").toArrow()
    return np.sort(rows["gram"].to_numpy().astype(np.int64).view(np.uint64))


def _first_smallest(order: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values where its first smallest one is."""
    best, span = np.arange(len(order)), 1

    def lesser(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(order[left] <= order[right], left, right)

    while span * 2 <= width:
        best = lesser(best[:-span], best[span:])
        span *= 2
    return lesser(best[: len(best) - (width - span)], best[width - span :]) if span < width else best


def runs_of(texts: pa.Array, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first and last window start (in words of the row) and anchor of every run."""
    grams, long, edges = _grams(texts)
    if not len(long):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.uint64))
    order = grams >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        order[frequent[at] == grams] |= _LAST
    begin = _starts(edges, LENGTH)
    place = _first_smallest(order, GRAMS)[begin]
    row = np.searchsorted(edges, begin, side="right") - 1
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    inside = begin - edges[row]
    return long[row[first]], inside[first].astype(np.int32), inside[last].astype(np.int32), grams[place[first]]


def _runs(frequent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                row, first, last, anchor = runs_of(part["text"], frequent.value)
                keys = [part[k].take(pa.array(row)) for k in _KEYS]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(first), pa.array(last), pa.array(anchor.view(np.int64))], [*_KEYS, "first", "last", "anchor"])

    return find


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the runs ``hits`` of each row."""
    for batch in batches:
        k1, k2 = (batch[k].to_pylist() for k in _KEYS)
        names, firsts, anchors, cut = [], [], [], []
        for i, (text, hits) in enumerate(zip(batch["text"], batch["hits"], strict=True)):
            found = text.as_py().encode().split()
            for hit in hits.as_py():
                names.append(i)
                firsts.append(hit["first"])
                anchors.append(hit["anchor"])
                cut.append(b" ".join(found[hit["first"] : hit["last"] + LENGTH]))
        of = lambda keys: pa.array([keys[i] for i in names], pa.int64())
        columns = [of(k1), of(k2), pa.array(firsts, pa.int32()), pa.array(anchors, pa.int64()), pa.array(cut, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [*_KEYS, "first", "anchor", "piece"])


class Shard:
    """Different pieces of some anchors, how often each occurs, and their repeated passages."""

    def __init__(self, anchors: np.ndarray, texts: pa.Array, times: np.ndarray):
        self.times = times
        self.data, self.offsets = flat(texts)
        self.starts, self.ends, self.piece = words(self.data, self.offsets)
        self.edges = np.searchsorted(self.piece, np.arange(len(texts) + 1))
        self._hash = PrefixHash(self.data)
        self._anchors = anchors

    def _counted(self, begin: np.ndarray, size: int) -> np.ndarray:
        """How often the words from ``begin`` on occur at their anchor."""
        piece = self.piece[begin]
        name = mixed(self._hash.of(self.starts[begin], self.ends[begin + size - 1]) ^ self._anchors[piece])
        _, at = np.unique(name, return_inverse=True)
        return np.bincount(at, self.times[piece])[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)

    def passages(self) -> list[bytes]:
        """Different runs of words between single spaces; every repeated window is in one of
        them, and each of them occurs wherever one of its windows does."""
        begin = _starts(self.edges, LENGTH)
        times = self._counted(begin, LENGTH)
        longer = np.flatnonzero(self.piece[begin[:-1]] == self.piece[begin[1:]])
        both = self._counted(begin[longer], LENGTH + 1)
        joined = np.zeros(len(begin), bool)  # with the window before
        joined[longer + 1] = (both > 1) & (both == times[longer]) & (both == times[longer + 1])
        first = np.flatnonzero((times > 1) & ~joined)
        step = np.cumsum(~joined)
        last = np.searchsorted(step, step[first], side="right") - 1
        low, high = self.starts[begin[first]], self.ends[begin[last] + LENGTH - 1]
        _, one = np.unique(self._hash.of(low, high), return_index=True)
        whole = self.data.tobytes()
        return [b" %b " % whole[a:b] for a, b in zip(low[one].tolist(), high[one].tolist(), strict=True)]

    def located(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, first word and the word behind the last one of every run of located words."""
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        passages = self.passages()
        for i, passage in enumerate(passages):
            automaton.add_word(passage.decode("latin-1"), i)
        found = []
        if passages:
            automaton.make_automaton()
            whole = self.data.tobytes().decode("latin-1")
            cuts = self.offsets.tolist()
            for i, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                found += [(i, end, which) for end, which in automaton.iter(f" {whole[low:high]} ")]
        piece, end, which = np.array(found, np.int64).reshape(-1, 3).T
        confirmed = np.bincount(which, self.times[piece], len(passages)) > 1
        piece, end, which = (x[confirmed[which]] for x in (piece, end, which))
        sizes = np.array([len(p) for p in passages], np.int64)
        low = self.offsets[piece] + end - sizes[which] + 1  # where the passage's first word begins
        begin = np.searchsorted(self.starts, low)
        behind = np.searchsorted(self.ends, low + sizes[which] - 2) + 1
        level = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(level, begin, 1)
        np.add.at(level, behind, -1)
        covered = np.cumsum(level[:-1]) > 0
        edge = np.zeros(len(covered) + 1, bool)
        edge[self.edges] = True
        opens = covered & (edge[:-1] | ~np.concatenate([[False], covered[:-1]]))
        closes = covered & (edge[1:] | ~np.concatenate([covered[1:], [False]]))
        begin, behind = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        piece = self.piece[begin]
        return piece, begin - self.edges[piece], behind - self.edges[piece]


def _locate(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    texts = rows["piece"].cast(pa.large_binary()).combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    shard = Shard(rows["anchor"].to_numpy().view(np.uint64), texts, rows["n"].to_numpy())
    piece, begin, behind = shard.located()
    at = pa.array(piece)
    return pa.table(
        {"p1": rows["p1"].take(at), "p2": rows["p2"].take(at), "begin": pa.array(begin.astype(np.int32)), "behind": pa.array(behind.astype(np.int32))}
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """``k1, k2, doc_id, text``; the keys are 128 bits of a hash of id and text."""
    row = [F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"]
    return docs.select(F.xxhash64(F.lit(1), *row).alias("k1"), F.xxhash64(F.lit(2), *row).alias("k2"), "doc_id", "text")


def repeated_words(docs: DataFrame) -> DataFrame:
    """``k1, k2, ranges`` of the rows that lose words: ``ranges`` holds ``begin, behind`` in words
    and may overlap. ``docs`` are keyed."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs))
    runs = docs.select(*_KEYS, "text").mapInArrow(_runs(frequent), "k1 long, k2 long, first int, last int, anchor long")
    runs = stored(runs, "runs")
    recurring = stored(runs.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    shards = max(1, math.ceil(recurring.count() / SHARD_ANCHORS))
    hits = runs.join(narrow(recurring), "anchor", "left_semi")
    hits = hits.groupBy(*_KEYS).agg(F.collect_set(F.struct("first", "last", "anchor")).alias("hits"))
    cut = docs.join(hits, _KEYS).mapInArrow(_cut, "k1 long, k2 long, first int, anchor long, piece binary")
    named = [F.xxhash64(F.lit(i), "anchor", "piece").alias(f"p{i}") for i in (1, 2)]
    different = cut.groupBy("anchor", "piece").agg(F.count("*").alias("n"))
    different = different.select("*", *named, F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"))
    located = different.groupBy("shard").applyInArrow(_locate, "p1 long, p2 long, begin int, behind int")
    places = cut.select(*_KEYS, "first", *named).join(located, ["p1", "p2"])
    ranges = places.select(*_KEYS, F.struct((F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("behind")).alias("behind")).alias("range"))
    return ranges.groupBy(*_KEYS).agg(F.collect_set("range").alias("ranges"))


def _cleaned(keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, ranges in zip(batch["text"], batch["ranges"], strict=True):
                found = (text.as_py() or "").encode().split()
                counts.append(len(found))
                if ranges.is_valid:
                    behind, left = 0, []
                    for one in sorted((r["begin"], r["behind"]) for r in ranges.as_py()):
                        left += found[behind : one[0]]
                        behind = max(behind, one[1])
                    found = left + found[behind:]
                removed.append(counts[-1] - len(found))
                kept.append(b" ".join(found))
            columns = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array([k.decode() for k in kept], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return clean


def without_repeated_phrases(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row, and ``kept_text``: the words that
    stay, joined by one space."""
    rows = _keyed(docs)
    ranges = repeated_words(rows)
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    return rows.join(ranges, _KEYS, "left").mapInArrow(_cleaned(keep_text), fields + (", kept_text string" if keep_text else ""))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_phrases(table(spark, sf_dir, "documents"), keep_text=False)


SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
    FROM documents
),
windows AS (SELECT r, words, unnest(range(1, len(words) - {LENGTH} + 2)) AS p FROM docs WHERE len(words) >= {LENGTH}),
named AS (SELECT r, p, sha256(array_to_string(words[p:p + {LENGTH} - 1], ' ')) AS w FROM windows),
starts AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY w) AS n FROM named) WHERE n > 1),
single AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs),
flagged AS (
    SELECT s.r, s.p, s.word, coalesce(max(CASE WHEN t.p IS NOT NULL THEN 1 ELSE 0 END) OVER (
        PARTITION BY s.r ORDER BY s.p ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), 0) AS gone
    FROM single s LEFT JOIN starts t ON s.r = t.r AND s.p = t.p
),
kept AS (SELECT r, sum(gone) AS n_removed, coalesce(string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY p), '') AS kept FROM flagged GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
