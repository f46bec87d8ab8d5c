"""Token counts that follow edits.

A text is cut into pre-tokens, whose byte-pair codes do not depend on each other. A document
keeps a segment tree: its leaves are slots of consecutive pre-tokens (their lengths and token
counts), its inner nodes hold the sums of characters and tokens below them. The root is the
token count.

An edit replaces a range of characters. Only the pre-tokens around it are cut again: from the
last boundary that the change cannot reach (the expression looks at most three characters past
the end of a match and never back) until a new boundary meets an old one behind the edit. From
there the old pre-tokens hold, because the cut depends on what follows only. The new counts go
to the slots, and the sums on the way to the root are updated. Edits of a document are applied
in turn, each to the text that its predecessor left.

The vocabulary is a file of base64 symbols and ranks, named by a parameter. The driver reads it
once and sends its few hundred kilobytes to the tasks.

A missing text is empty. A start behind the end means the end; a missing start, length or
insertion means 0 or nothing. Repeated rows are counted each. Texts are cut whole; a task holds
one batch. Columns other than the named ones are kept by ``with_trees`` (which replaces columns
of the tree's names).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm import text_arrays
from waymark.llm.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary cuts a text before coding.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOK_AHEAD = 4
SLOT = 32
CACHE = 200_000
_CUT = regex.compile(PRE_TOKEN)
_TREE = [
    T.StructField("lengths", T.ArrayType(T.IntegerType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())),
    T.StructField("fill", T.ArrayType(T.IntegerType())),
    T.StructField("chars", T.ArrayType(T.IntegerType())),
    T.StructField("tokens", T.ArrayType(T.IntegerType())),
]


class Counter(dict):
    """Tokens of a pre-token, remembered up to a bound."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(symbol): int(rank) for symbol, rank in map(bytes.split, vocabulary.splitlines()) if symbol}
        # One match for the whole pre-token, so it is coded as one piece.
        self._coder = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self._coder.encode_ordinary(piece))
        if len(self) >= CACHE:
            self.clear()
        self[piece] = n
        return n


class Tree:
    """The segment tree of one text: slots of pre-tokens under heaps of sums."""

    def __init__(self, lengths: Sequence, counts: Sequence, fill: Sequence, chars: np.ndarray, tokens: np.ndarray):
        ends = np.cumsum(fill)
        cut = lambda values: [list(values[e - f : e]) for f, e in zip(fill, ends, strict=True)]
        self.lengths, self.counts = cut(lengths), cut(counts)
        self.chars, self.tokens = chars, tokens
        self.leaves = len(chars) // 2

    @staticmethod
    def sums(leaves: np.ndarray) -> np.ndarray:
        """A heap whose second half are the leaves, padded to a power of two."""
        size = 1 << max(0, int(len(leaves) - 1).bit_length())
        level = np.zeros(size, np.int32)
        level[: len(leaves)] = leaves
        levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).sum(axis=1, dtype=np.int32)
            levels.append(level)
        return np.concatenate([np.zeros(1, np.int32), *levels[::-1]])

    @classmethod
    def columns(cls, text: str, counter: Counter) -> tuple[np.ndarray, ...]:
        """``lengths, counts, fill, chars, tokens`` of a text."""
        found = _CUT.findall(text)
        n = len(found)
        lengths = np.fromiter(map(len, found), np.int32, n)
        counts = np.fromiter(map(counter.__getitem__, found), np.int32, n)
        at = np.arange(0, max(n, 1), SLOT)
        fill = np.minimum(n - at, SLOT).astype(np.int32)
        slot = lambda values: np.add.reduceat(values, at) if n else np.zeros(1, np.int32)
        return lengths, counts, fill, cls.sums(slot(lengths)), cls.sums(slot(counts))

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, position: int) -> tuple[int, int]:
        """The slot that holds a character position, and where the slot begins."""
        node, begin = 1, 0
        while node < self.leaves:
            node *= 2
            if position >= begin + self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return min(node - self.leaves, len(self.lengths) - 1), begin

    def set_slot(self, slot: int, lengths: list, counts: list) -> None:
        self.lengths[slot], self.counts[slot] = lengths, counts
        for heap, value in ((self.chars, sum(lengths)), (self.tokens, sum(counts))):
            node = slot + self.leaves
            gain = value - heap[node]
            while node:
                heap[node] += gain
                node //= 2

    def edit(self, text: str, start: int, removed: int, inserted: str, counter: Counter) -> tuple[str, int]:
        """Replace a range; returns the new text and how many characters were cut again."""
        start = min(max(start, 0), len(text))
        old_end = min(start + max(removed, 0), len(text))
        changed = text[:start] + inserted + text[old_end:]
        new_end, shift = start + len(inserted), len(inserted) - (old_end - start)

        # The last boundary that is out of reach of the change.
        first, begin = self.find(max(start - LOOK_AHEAD, 0))
        if begin > max(start - LOOK_AHEAD, 0):
            begin -= sum(self.lengths[first])
        kept, boundary = 0, begin
        for length in self.lengths[first]:
            if boundary + length > start - LOOK_AHEAD:
                break
            boundary, kept = boundary + length, kept + 1

        # Cut from there until a new boundary behind the edit is an old one.
        slot, at, old = first, kept, boundary
        lengths, counts, reached = [], [], boundary
        matches = _CUT.finditer(changed, boundary)
        while True:
            if reached >= new_end:
                while old < reached - shift and slot < len(self.lengths):
                    if at < len(self.lengths[slot]):
                        old, at = old + self.lengths[slot][at], at + 1
                    else:
                        slot, at = slot + 1, 0
                if old == reached - shift and old >= old_end:
                    break
            match = next(matches, None)
            if match is None:
                slot, at = len(self.lengths) - 1, len(self.lengths[-1])
                break
            reached = match.end()
            lengths.append(match.end() - match.start())
            counts.append(counter[match.group()])

        slot = min(slot, len(self.lengths) - 1)
        if slot == first:
            tail_lengths, tail_counts = self.lengths[slot][at:], self.counts[slot][at:]
        else:
            tail_lengths, tail_counts = [], []
            self.set_slot(slot, self.lengths[slot][at:], self.counts[slot][at:])
            for between in range(first + 1, slot):
                self.set_slot(between, [], [])
        self.set_slot(first, self.lengths[first][:kept] + lengths + tail_lengths, self.counts[first][:kept] + counts + tail_counts)
        return changed, reached - boundary

    def as_columns(self) -> tuple:
        flat = lambda parts: np.fromiter(chain.from_iterable(parts), np.int32)
        return flat(self.lengths), flat(self.counts), np.array([len(x) for x in self.lengths], np.int32), self.chars, self.tokens


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _arrays(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def with_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with the tree of every ``text`` in the columns ``lengths, counts, fill, chars,
    tokens``. ``tokens[1]`` is the token count."""
    sent = _vocabulary(docs.sparkSession, vocabulary)
    docs = docs.drop(*[f.name for f in _TREE])
    names = docs.columns + [f.name for f in _TREE]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            for piece in text_arrays.pieces(batch):
                trees = [Tree.columns(text or "", counter) for text in piece["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, *[_arrays([t[i] for t in trees]) for i in range(len(_TREE))]], names)

    return docs.mapInArrow(build, T.StructType([*docs.schema.fields, *_TREE]))


def gathered(edits: DataFrame) -> DataFrame:
    """``edits (doc_id, seq, start, removed, inserted)`` as one ordered array ``edits`` per id."""
    one = F.struct("seq", "start", "removed", "inserted")
    return edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("edits"))


def edited(trees: DataFrame, vocabulary: str = VOCABULARY, keep_trees: bool = False) -> DataFrame:
    """Apply the array column ``edits`` of every row to its text and tree.

    Returns ``doc_id, n_edits, tokens_before, tokens_after, pre_tokens, chars_after,
    chars_cut``; with ``keep_trees`` also the new ``text`` and tree columns.
    """
    sent = _vocabulary(trees.sparkSession, vocabulary)
    numbers = ["n_edits", "tokens_before", "tokens_after", "pre_tokens", "chars_after", "chars_cut"]
    fields = [trees.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in numbers]]
    fields += [T.StructField("text", T.StringType()), *_TREE] if keep_trees else []

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            rows, texts, columns = [], [], []
            stored = [batch[f.name] for f in _TREE]
            ends = [np.asarray(c.offsets) for c in stored]
            values = [np.asarray(c.values) for c in stored]
            for i, (text, edits) in enumerate(zip(batch["text"].to_pylist(), batch["edits"].to_pylist(), strict=True)):
                parts = [v[e[i] : e[i + 1]] for v, e in zip(values, ends, strict=True)]
                tree = Tree(parts[0].tolist(), parts[1].tolist(), parts[2].tolist(), parts[3].copy(), parts[4].copy())
                text, before, cut = text or "", tree.total, 0
                for one in edits or []:
                    text, again = tree.edit(text, one["start"] or 0, one["removed"] or 0, one["inserted"] or "", counter)
                    cut += again
                rows.append((len(edits or []), before, tree.total, sum(map(len, tree.lengths)), len(text), cut))
                if keep_trees:
                    texts.append(text)
                    columns.append(tree.as_columns())
            out = [batch["doc_id"], *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(numbers))]]
            if keep_trees:
                out += [pa.array(texts, pa.string()), *[_arrays([c[i] for c in columns]) for i in range(len(_TREE))]]
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    columns = ["doc_id", "text", "edits", *[f.name for f in _TREE]]
    return trees.select(*columns).mapInArrow(apply, T.StructType(fields))


def drawn_edits(text: Column, doc_id: Column, count: int = 3) -> Column:
    """Edits that depend on a row only: places, lengths and inserted passages of the text itself
    are drawn by a hash."""
    size = F.length(text)
    draw = lambda k, n: F.pmod(F.xxhash64(doc_id, F.lit(k)), n.cast("long")).cast("int")
    one = lambda k: F.struct(
        F.lit(k).alias("seq"),
        draw(4 * k, size + 1).alias("start"),
        draw(4 * k + 1, F.lit(30)).alias("removed"),
        F.substring(text, draw(4 * k + 2, size + 1) + 1, draw(4 * k + 3, F.lit(40))).alias("inserted"),
    )
    return F.array(*[one(k) for k in range(count)])


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edits = drawn_edits(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("edits")
    return edited(with_trees(docs.select("doc_id", "text", edits)))
