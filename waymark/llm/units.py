"""Units of documents and the traffic between them.

Some operators have to know, for each of very many names (words, pairs, anchors), a fact about
the whole corpus. Documents are dealt to units of bounded size; a unit asks once for each of
its distinct names; names are cut into hash ranges, one task each, that add up what the units
say and answer each unit in the order of its question. So a frequent name costs one entry per
unit, and the number of units and ranges grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT_BYTES = 8 << 20


def in_units(docs: DataFrame, unit_bytes: int = UNIT_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with a number ``unit``, partitioned by it, and how many units there are."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / unit_bytes))
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")
    return docs.withColumn("unit", unit).repartition(count, "unit"), count


def squeezed(values: np.ndarray) -> bytes:
    """Compressed numbers, all first bytes before all second ones: high bytes are mostly zero."""
    values = np.ascontiguousarray(values)
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def loose(blob: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed(names: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted names as low and high halves of their differences."""
    steps = np.diff(names, prepend=np.uint64(0))
    return steps.astype(np.uint32).tobytes(), squeezed((steps >> np.uint64(32)).astype(np.uint32))


def unpacked(low: bytes, high: bytes) -> np.ndarray:
    steps = np.frombuffer(low, np.uint32).astype(np.uint64) | (loose(high, np.uint32).astype(np.uint64) << np.uint64(32))
    return np.cumsum(steps, dtype=np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def range_edges(parts: int) -> np.ndarray:
    """Where the second and all later of ``parts`` equal ranges of 64-bit hashes begin."""
    return np.array([((i << 64) + parts - 1) // parts for i in range(1, parts)], dtype=np.uint64)


def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each unit of a partition."""
    rows = list(batches)
    if rows:
        whole = pa.Table.from_batches(rows)
        numbers = np.asarray(whole["unit"])
        for unit in np.unique(numbers):
            yield int(unit), whole.filter(pa.array(numbers == unit)).combine_chunks()


def texts_of(rows: pa.Table, column: str = "text") -> pa.Array:
    texts = rows[column].cast(pa.large_string())
    return texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
