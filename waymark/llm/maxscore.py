"""Exact top-k inner products by MaxScore.

Vectors become integers, floor(256 x). The dimensions are the terms of a query: a shard keeps
for each of them its postings (one column of all its rows) and the bounds of what it can add to
a score. For a query the terms are ordered by the width of their bounds. The essential terms
are the shortest run of widest ones without which no row can reach the threshold; their
postings are traversed for all rows of the shard. The other terms are probed only for rows
that stay competitive: partial score plus the upper bounds of what is left. The k-th largest
lower bound is the threshold, so it rises while terms are added. Every bound is exact, ties at
the threshold stay, and the shards' k best are merged by Spark.

Rows are dealt to shards and queries to blocks of bounded size by a hash of their id, so each
task holds one shard and one block. Rows are queries for every fiftieth id.

Vectors that are missing, or hold missing or non-finite components, take no part, nor do rows
without an id. Of rows with one id the smallest vector counts. Shorter vectors count as padded
with zeros. Ties go to the smaller id. Shards whose products could leave 62 bits are scored with
Python's integers; a component beyond a long, or a score among the best that is, ends the query
with an error that says so.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.tables import stored, table

SCALE, EVERY, TOP = 256, 50, 5
SHARD_ROWS, BLOCK_ROWS = 16_384, 65_536
PROBED = 8  # terms that are probed at once
_EXACT, _LONG = float(2**53), float(2**62)


class Shard:
    """Postings and bounds of the rows of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)
        self.ids = ids[order]
        self.postings = np.ascontiguousarray(vectors[order].T)
        self.low = self.postings.min(axis=1)
        self.high = self.postings.max(axis=1)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than ``own``, best first."""
        ends = np.stack([query * self.low, query * self.high])
        lower, upper = ends.min(axis=0), ends.max(axis=0)
        order = np.argsort(lower - upper, kind="stable")
        rest_low = np.append(np.cumsum(lower[order][::-1])[::-1], 0)
        rest_high = np.append(np.cumsum(upper[order][::-1])[::-1], 0)
        rows = np.arange(len(self.ids))
        if (at := np.searchsorted(self.ids, own)) < len(self.ids) and self.ids[at] == own:
            rows = np.delete(rows, at)
        if len(rows) <= k:
            done, partial = len(order), query @ self.postings[:, rows]
        else:
            # Rows at the lower bound of all essential terms stay below a first threshold.
            first = query @ self.postings[:, rows[: 4 * k]]
            threshold = np.partition(first, len(first) - k)[len(first) - k]
            gain = np.cumsum(lower[order] - upper[order]) + upper.sum()
            done = min(int(np.searchsorted(-gain, -threshold, side="right")) + 1, len(order))
            done = max(done, min(PROBED, len(order)))
            terms = order[:done]
            partial = query[terms] @ self.postings[terms]
            partial = partial[rows]
            while True:
                floor = partial + rest_low[done]
                threshold = max(threshold, np.partition(floor, len(floor) - k)[len(floor) - k])
                alive = partial + rest_high[done] >= threshold
                rows, partial = rows[alive], partial[alive]
                if done == len(order):
                    break
                terms = order[done : done + PROBED]
                partial = partial + query[terms] @ self.postings[np.ix_(terms, rows)]
                done += len(terms)
        best = np.lexsort((self.ids[rows], -partial))[:k]
        return self.ids[rows[best]], partial[best]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists))
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
    return out


def _best_in_shard(rows: pa.Table, queries: pa.Table) -> pa.Table:
    query_ids, vec_ids, scores = [], [], []
    if rows.num_rows and queries.num_rows:
        width = max(pc.max(pc.list_value_length(t["vector"])).as_py() for t in (rows, queries))
        vectors, wanted = _matrix(rows["vector"], width), _matrix(queries["vector"], width)
        largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * max(width, 1)
        kind = np.float64 if largest < _EXACT else np.int64 if largest < _LONG else object
        shard = Shard(np.asarray(rows["vec_id"]), vectors.astype(kind))
        for own, query in zip(np.asarray(queries["vec_id"]), wanted.astype(kind), strict=True):
            ids, found = shard.top(own, query, TOP)
            query_ids.append(np.full(len(ids), own))
            vec_ids.append(ids)
            if len(found) and max(found.max(), -found.min()) >= 2**63:
                raise OverflowError(f"a score of vector {own} does not fit a long")
            scores.append(found.astype(np.int64))
    join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return pa.table({"query_id": join(query_ids), "vec_id": join(vec_ids), "score": join(scores)})


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    usable = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    beyond = F.raise_error(F.lit("a component times 256 does not fit a long")).cast("long")
    whole = lambda x: F.floor(x.cast("double") * SCALE).cast("long")
    scaled = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * SCALE) < float(2**63), whole(x)).otherwise(beyond))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    return kept.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(scaled).alias("vector"))


def top_products(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The ``TOP`` best rows of ``vectors (vec_id, vector)`` for each of ``queries``.

    Returns ``query_id, rank, vec_id, score``."""
    shards = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(queries.count() / BLOCK_ROWS))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    held = vectors.withColumn("shard", dealt(shards)).withColumn("block", numbers(blocks))
    asked = queries.withColumn("block", dealt(blocks)).withColumn("shard", numbers(shards))
    pairs = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    best = pairs.applyInArrow(_best_in_shard, "query_id long, vec_id long, score long")
    merged = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("lost"), "vec_id"))).alias("found"))
    ranked = merged.select("query_id", F.posexplode(F.slice("found", 1, TOP)).alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.lost")).alias("score"))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_products(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH v AS (
    SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT))) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    GROUP BY vec_id
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= {TOP}
"""
