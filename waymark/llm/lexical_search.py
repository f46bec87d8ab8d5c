"""Ranked lexical search by norm buckets, exact in integers.

A document is a vector of impacts, one per term that an item asks for: ``(10^9 tf) div
(1000 tf + 20 m)``, where ``m`` grows with the document's share of the mean length. An item is a
vector of term weights, floor(1000 ln((2N + 2) / (2 df + 1))), and a score is their product.

1. One pass over the texts keeps each document's length and the counts of the items' terms, and
   is stored. Corpus size, total length and document frequencies are sums over that table.
2. Tasks read it in shards of ``SHARD_ROWS`` documents, order a shard by the length (Euclidean
   norm) of the impact vectors and cut it into buckets of doubling size.
3. For an item, the best ``TOP`` scores seen by the task so far give a threshold. A bucket is
   pruned if the norm of the item times the largest norm in the bucket is below it
   (Cauchy-Schwarz), and so are all buckets behind it. Inside a bucket the heaviest coordinates
   of the item (the focus) are multiplied out; what the others can add is bounded by the norms
   of the two rests. Rows whose bound is below the threshold are dropped.
4. Survivors are scored again in 64-bit integers. Each task returns its ``TOP`` rows per item,
   and a rank window merges them; Spark cuts each task's rows to ``TOP`` before they are shuffled.

Bounds are rounded up, so no row that ties with the threshold is lost, and ties go to the
smaller id. Items come in blocks of bounded size, each one pass over the documents, so what is
sent to the tasks is bounded however many items there are.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z
lower-cased. Term equality is that of 64-bit hashes of the bytes with the length. A missing text
has no terms; a document without terms does not count. Repeated document rows are ranked each;
a document without an id comes behind its ties. Rows of one item id are one item with the terms
of all of them, items without an id are one too; an item without terms, or of terms that no
document holds, has no results. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.tables import stored, table
from waymark.llm.text_arrays import NO_LETTER, pieces, word_hashes

TOP = 50
SHARD_ROWS, FIRST_BUCKET = 32_768, 512
BLOCK_CHARS = 4 << 20  # text of the items of a block
FOCUS = 0.8  # share of an item's squared norm in its focus
_UP = 1 + 1e-9
_NO_TERM = NO_LETTER.copy()
_NO_TERM[0x30:0x3A] = False


class Items:
    """The items of a block: ids, and the hash of each of their different terms."""

    def __init__(self, ids: list, texts: list[list[str]]):
        self.ids = ids
        hashes, cuts = word_hashes(pa.array([t for ts in texts for t in ts], pa.string()), _NO_TERM)
        rows = np.concatenate([[0], np.cumsum([len(ts) for ts in texts])])
        terms = [np.unique(hashes[cuts[a] : cuts[b]]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]))
        self.terms = [np.searchsorted(self.vocabulary, t) for t in terms]

    def weights(self, n: int, df: np.ndarray) -> np.ndarray:
        """The weight of every term; one that no document holds has none."""
        return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """The items, dealt to blocks of some ``block_chars`` characters by a hash of their id."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_chars))
    for block in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = part.groupBy("item_id").agg(F.collect_list("text").alias("texts")).collect()
        if rows:
            yield Items([r.item_id for r in rows], [r.texts for r in rows])


def _counted(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            for part in pieces(batch):
                hashes, cuts = word_hashes(part["text"], _NO_TERM)
                at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                hit = np.flatnonzero(vocabulary[at] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
                row = np.searchsorted(cuts, hit, side="right") - 1
                pair, times = np.unique(row * max(len(vocabulary), 1) + at[hit], return_counts=True)
                row, term = np.divmod(pair, max(len(vocabulary), 1))
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(cuts)), *lists], ["doc_id", "n", "terms", "times"])

    return count


def term_counts(docs: DataFrame, items: Items) -> DataFrame:
    """``doc_id, n, terms, times`` of the documents with terms: their length, and which of the
    items' terms they hold how often."""
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counted(sent), "doc_id long, n long, terms array<int>, times array<int>").where("n > 0")


class Shard:
    """Impact vectors ordered by their norm, by row and by term."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, m: np.ndarray, cuts: np.ndarray, terms: np.ndarray, times: np.ndarray):
        row = np.repeat(np.arange(len(ids)), np.diff(cuts))
        times = times.astype(np.int64)
        impact = (1_000_000_000 * times) // (1000 * times + 20 * m[row])
        squares = np.bincount(row, impact.astype(float) ** 2, len(ids))
        order = np.argsort(-squares, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.squares, self.norms = squares[order], np.sqrt(squares[order])
        self.ids, self.missing = ids[order], missing[order]
        by_row = np.argsort(place[row], kind="stable")
        self.terms, self.impacts = terms[by_row], impact[by_row]
        self.cuts = np.concatenate([[0], np.cumsum(np.diff(cuts)[order])])
        # Postings: by term, rows ascending, so a bucket is a slice of each.
        by_term = np.argsort(self.terms, kind="stable")
        self.rows = np.repeat(np.arange(len(ids)), np.diff(self.cuts))[by_term]
        self.held = self.impacts[by_term]
        self.names = self.terms[by_term]
        self.edges = self._buckets()
        self._postings: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _buckets(self) -> list[int]:
        edges, size = [0], FIRST_BUCKET
        while edges[-1] < len(self.ids):
            edges.append(min(edges[-1] + size, len(self.ids)))
            size *= 2
        return edges

    def posting(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if term not in self._postings:
            low, high = np.searchsorted(self.names, [term, term + 1])
            self._postings[term] = self.rows[low:high], self.held[low:high].astype(float)
        return self._postings[term]

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The exact scores of some rows."""
        sizes = self.cuts[rows + 1] - self.cuts[rows]
        begin = np.cumsum(sizes) - sizes
        at = np.repeat(self.cuts[rows] - begin, sizes) + np.arange(sizes.sum())
        sums = np.concatenate([[0], np.cumsum(query[self.terms[at]] * self.impacts[at])])
        return sums[begin + sizes] - sums[begin]


class Best:
    """The best rows of one item that a task has met."""

    def __init__(self) -> None:
        self.scores, self.missing, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def threshold(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == TOP else 1

    def add(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        joined = [np.concatenate(x) for x in ((self.scores, scores), (self.missing, missing), (self.ids, ids))]
        order = np.lexsort((joined[2], joined[1], -joined[0]))[:TOP]
        self.scores, self.missing, self.ids = (x[order] for x in joined)


def search(shard: Shard, terms: np.ndarray, weights: np.ndarray, query: np.ndarray, best: Best) -> int:
    """Improve ``best`` by the rows of a shard. ``terms`` and ``weights`` are the item, ``query``
    its weights by term. Returns how many rows were scored exactly."""
    order = np.argsort(-weights, kind="stable")
    terms, weights = terms[order], weights[order].astype(float)
    squares = np.cumsum(weights**2)
    norm = math.sqrt(squares[-1])
    focus = int(np.searchsorted(squares, FOCUS * squares[-1])) + 1
    rest = math.sqrt(max(squares[-1] - squares[focus - 1], 0.0)) * _UP
    scored = 0
    for low, high in zip(shard.edges[:-1], shard.edges[1:], strict=True):
        threshold = best.threshold()
        if norm * shard.norms[low] * _UP < threshold:
            break
        # Rows are in descending order of their norms: the bucket may end early.
        high = low + int(np.searchsorted(-shard.norms[low:high] * norm * _UP, -threshold, side="right"))
        part, left = np.zeros(high - low), shard.squares[low:high].copy()
        for term, weight in zip(terms[:focus].tolist(), weights[:focus].tolist(), strict=True):
            rows, held = shard.posting(term)
            a, b = np.searchsorted(rows, [low, high])
            part[rows[a:b] - low] += weight * held[a:b]
            left[rows[a:b] - low] -= held[a:b] ** 2
        # Differences of squares below 2^53 / 2 are exact; the rest is rounded up.
        bound = part + rest * np.sqrt(np.maximum(left, 0.0) * _UP + 1.0)
        rows = low + np.flatnonzero(bound * _UP + 1.0 >= threshold)
        exact = shard.scores(rows, query)
        scored += len(rows)
        good = exact >= threshold
        best.add(exact[good], shard.missing[rows[good]], shard.ids[rows[good]])
    return scored


def _searched(sent, n: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        asked = [terms[weights[terms] > 0] for terms in items.terms]
        best = [Best() for _ in items.ids]
        query = np.zeros(len(weights), np.int64)

        def look(rows: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(rows).combine_chunks()
            ids, sizes, terms, times = (whole[c].combine_chunks() for c in ("doc_id", "n", "terms", "times"))
            m = 100 - 50 + (50 * sizes.to_numpy() * n) // length
            cuts = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
            shard = Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), m, cuts, terms.flatten().to_numpy(), times.flatten().to_numpy())
            for mine, found in zip(asked, best, strict=True):
                if len(mine):
                    query[mine] = weights[mine]
                    search(shard, mine, weights[mine], query, found)
                    query[mine] = 0

        held, count = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD_ROWS):
                held.append(batch.slice(start, SHARD_ROWS))
                count += held[-1].num_rows
                if count >= SHARD_ROWS:
                    look(held)
                    held, count = [], 0
        if count:
            look(held)
        for name, found in zip(items.ids, best, strict=True):
            if len(found.ids):
                ids = pa.array(found.ids, pa.int64(), mask=found.missing)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.int64()), ids, pa.array(found.scores)], ["item_id", "doc_id", "score"])

    return find


def ranked(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``TOP`` best documents of each item."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in item_blocks(items, block_chars):
        counts = stored(term_counts(docs, block), "terms")
        n, length = counts.agg(F.count("*"), F.sum("n")).first()
        held = np.zeros(len(block.vocabulary), np.int64)
        for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the block's terms
            held[row["term"]] = row["count"]
        sent = spark.sparkContext.broadcast((block, block.weights(n, held)))
        out = out.unionByName(counts.mapInArrow(_searched(sent, n, length or 1), out.schema))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return best.select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERMS}') AS terms FROM documents WHERE text IS NOT NULL
),
sized AS (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sized),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS term FROM benchmark WHERE text IS NOT NULL
),
counts AS (
    SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(all_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term
),
impacts AS (
    SELECT c.r, c.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * all_docs) // all_terms)))) AS part
    FROM counts c JOIN sized s ON c.r = s.r JOIN weights ON c.term = weights.term, total
),
scores AS (
    SELECT item_id, r, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN impacts ON asked.term = impacts.term GROUP BY item_id, r
),
placed AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM scores JOIN sized USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {TOP}
"""
