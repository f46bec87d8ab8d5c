"""Removal of repeated substrings with a collection's Burrows-Wheeler transform.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a document with
a smaller id. Deciding that for all strings at once takes the sorted order of the suffixes of
all documents; it is built column-wise, as in short-read indexing: in each round every string
gets one more symbol to its left, the new suffixes find their place by the last-to-first
mapping of the transform, and the transform, the common prefixes and the string numbers are
rewritten in one sequential pass. Equal strings of ``LENGTH`` bytes are then neighbours with a
common prefix of that length.

Rounds over whole documents would be as many as the longest document has bytes. So the texts
are first cut at anchors: the anchor of a string of ``LENGTH`` bytes is its smallest hashed
19-gram, equal strings have equal anchors, and consecutive strings with one anchor form a piece
of at most 81 bytes. Only pieces whose anchor occurs in more than one document are kept. Pieces
go to ranges of their mixed anchors, and a task indexes the strings of its range some anchors at a
time, in memory: the columns of the strings are the rounds. There are no external files; between
the steps Spark shuffles whole strings and answers, not rounds. An anchor with very many pieces
(a line that is everywhere) is cut into its single strings, which spread by their own hash. A
string that is the only one of its anchor needs no index. Names of anchors and strings are 64-bit
hashes.

Documents are dealt to units (see ``units``): a unit asks which anchors are shared, sends its
distinct pieces to the ranges, and learns for each piece which of its strings also start in a
smaller document. Texts are UTF-8 bytes, a missing text is empty, and strings never cross
documents. Rows without an id neither lose nor cause anything. Rows of one id are not smaller
than each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import text_arrays
from waymark.llm.tables import table
from waymark.llm.units import in_units, loose, packed, range_edges, squeezed, texts_of, units_of, unpacked

LENGTH, GRAM = 50, 19
STARTS = LENGTH - GRAM + 1  # grams of a string, and the most strings of one piece
HOT = 10_000  # pieces of an anchor in the corpus
UNIT_BYTES = 6 << 20  # text of a unit; the arrays of a task are some forty times as large
CUT_BYTES = 1 << 16  # bytes that are hashed together, so that the arrays stay in cache
BATCH = 1_000  # pieces that are indexed together, so that the arrays of a round stay in cache
_SALT = np.uint64(0x8F3A6C1D5B79E247)


class Index:
    """Transform, common prefixes, and string number and length of all suffixes of a collection.

    ``codes`` name the symbols before the suffixes (0: the suffix is a whole string).
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        n = len(starts)
        present = np.bincount(data, minlength=256) > 0
        kind = np.uint8 if present.sum() < 256 else np.uint16  # one byte per code sorts in one pass
        self.symbols = np.cumsum(present).astype(kind)  # code of each symbol, from 1
        self.codes, self.common = np.zeros(n, kind), np.zeros(n, np.uint8)
        self.string, self.length = np.arange(n, dtype=np.int32), np.zeros(n, np.uint8)
        active, place = np.arange(n), np.arange(n)  # the strings, and where their longest suffix is
        for round_ in range(1, int(lengths.max(initial=0)) + 1):
            going = lengths[active] >= round_
            active, place = active[going], place[going]
            self._insert(round_, active, place, data[starts[active] + lengths[active] - round_], n)
            place = self._placed

    def _insert(self, round_: int, active: np.ndarray, place: np.ndarray, symbols: np.ndarray, n: int) -> None:
        """One more symbol for each active string, whose longest suffix is at ``place``."""
        self.codes[place] = self.symbols[symbols]
        order = np.argsort(self.codes, kind="stable")  # last to first: all symbols, then all first symbols
        ended = len(order) - np.count_nonzero(self.codes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[place]
        target = at - ended + n
        # Common prefixes with the suffixes before and after: one more than the least between
        # the suffixes without their first symbols.
        with_last = self._least(order, at - 1, at, ended)
        with_next = self._least(order, at, at + 1, ended)

        size = len(order) - ended + n
        new = np.zeros(size, bool)
        new[target] = True
        for name, values in (("codes", 0), ("common", None), ("string", active), ("length", round_)):
            before = getattr(self, name)
            after = np.empty(size, before.dtype)
            after[~new] = before
            if values is not None:
                after[target] = values
            setattr(self, name, after)
        follows = target + 1 < size
        self.common[target[follows] + 1] = with_next[follows]
        self.common[target] = with_last
        self._placed = target

    def _least(self, order: np.ndarray, first: np.ndarray, second: np.ndarray, ended: int) -> np.ndarray:
        """Common prefix of the suffixes with the given neighbouring ranks."""
        out = np.zeros(len(first), np.uint8)
        ok = np.flatnonzero((first >= ended) & (second < len(order)))
        low, high = order[first[ok]], order[second[ok]]
        same = self.codes[low] == self.codes[high]
        ok, low, high = ok[same], low[same], high[same]
        if len(ok):
            # Pairs of begin and end. From the last pair to the first no pair begins behind the
            # end of the one before it, so what reduceat takes between two pairs is one cell.
            turn = np.argsort(-low, kind="stable")
            bounds = np.stack([low[turn] + 1, high[turn] + 1], axis=1).ravel()
            padded = np.append(self.common, np.uint8(0))
            out[ok[turn]] = np.minimum.reduceat(padded, bounds)[::2] + np.uint8(1)
        return out

    def repeated(self, owner: np.ndarray) -> np.ndarray:
        """For each string, one bit per start: whether the ``LENGTH`` bytes from there are also
        in a string with a smaller owner."""
        masks = np.zeros(len(owner), np.uint32)
        if len(self.string):
            begin = np.flatnonzero(np.concatenate([[True], self.common[1:] < LENGTH]))
            least = np.minimum.reduceat(owner[self.string], begin)
            least = np.repeat(least, np.diff(np.append(begin, len(self.string))))
            hit = (self.length >= LENGTH) & (least < owner[self.string])
            string = self.string[hit]
            longest = np.zeros(len(owner), np.int64)
            np.maximum.at(longest, self.string, self.length)
            start = (longest[string] - self.length[hit]).astype(np.uint32)
            np.bitwise_or.at(masks, string, np.uint32(1) << start)
        return masks


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


class Pieces:
    """The pieces of a unit's documents: anchor, name, bytes from ``begin`` to ``last + LENGTH``,
    and the document's row. ``last`` is where the last string of the piece starts."""

    def __init__(self, rows: pa.Table):
        texts = texts_of(rows)
        self.data, self.offsets = text_arrays.flat(texts)
        self.ids = np.asarray(rows["doc_id"].combine_chunks().fill_null(0))
        known = np.asarray(rows["doc_id"].combine_chunks().is_valid())
        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        row = 0
        while row < len(self.ids):
            stop = max(int(np.searchsorted(self.offsets, self.offsets[row] + CUT_BYTES, side="right")) - 1, row + 1)
            stop = min(stop, len(self.ids))
            for part, values in zip(parts, self._cut(row, stop, known), strict=True):
                part.append(values)
            row = stop
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
        self.anchor, self.name, self.begin, self.last, self.row = (np.concatenate([np.zeros(0, k), *p]) for p, k in zip(parts, kinds, strict=True))

    def _cut(self, row: int, stop: int, known: np.ndarray) -> tuple[np.ndarray, ...]:
        base = int(self.offsets[row])
        data, ends = self.data[base : self.offsets[stop]], self.offsets[row : stop + 1] - base
        if len(data) < LENGTH:
            return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        prefix = text_arrays.PrefixHash(data)
        at = np.arange(len(data) - GRAM + 1)
        least = _sliding_minimum(prefix.of(at, at + GRAM), STARTS)
        doc = np.repeat(np.arange(stop - row), np.diff(ends))[: len(least)]
        start = np.flatnonzero((np.arange(len(least)) + LENGTH <= ends[doc + 1]) & known[row:stop][doc])
        least, doc = least[start], doc[start]
        new = np.ones(len(start), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        # An anchor that occurs twice in a row must not make a piece longer than the bits of its answer.
        first = np.flatnonzero(new)
        run = np.repeat(start[first], np.diff(np.append(first, len(start))))
        new |= (start - run) % STARTS == 0
        first = np.flatnonzero(new)
        begin = start[first]
        last = start[np.append(first[1:] - 1, len(start) - 1)] if len(start) else begin
        name = prefix.of(begin, last + LENGTH)
        # The least of many hashes is a small one; mixed again, anchors fill all ranges alike.
        return text_arrays.mixed(least[first] ^ _SALT), name, begin + base, last + base, doc[first] + row

    def strings(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every string of the given pieces."""
        counts = self.last[pieces] - self.begin[pieces] + 1
        piece = np.repeat(pieces, counts)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.begin[piece] + step, piece


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the place of each key among them."""
    distinct = np.unique(key) if len(key) < 2 else np.sort(key)
    distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])] if len(distinct) else distinct
    return distinct, np.searchsorted(distinct, key)


def _extreme(values: np.ndarray, place: np.ndarray, size: int, ufunc: np.ufunc) -> np.ndarray:
    order = np.argsort(place, kind="stable")
    begin = np.searchsorted(place[order], np.arange(size))
    return ufunc.reduceat(values[order], begin) if size else values[:0]


def _asked(parts: int):
    """For each range: a unit's anchors with their smallest and largest id and their count."""
    edges = range_edges(parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in units_of(batches):
            pieces = Pieces(rows)
            anchors, place = _grouped(pieces.anchor)
            ids = pieces.ids[pieces.row]
            low, high = _extreme(ids, place, len(anchors), np.minimum), _extreme(ids, place, len(anchors), np.maximum)
            counts = np.bincount(place, minlength=len(anchors))
            cut = np.concatenate([[0], np.searchsorted(anchors, edges), [len(anchors)]])
            for part in range(parts):
                s = slice(cut[part], cut[part + 1])
                if cut[part] == cut[part + 1]:
                    continue  # of many small ranges a unit asks few
                blobs = [*packed(anchors[s]), squeezed(low[s]), squeezed(high[s] - low[s]), squeezed(counts[s])]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "unit": pa.array([number], pa.int32()), **{f"b{i}": [b] for i, b in enumerate(blobs)}})

    return ask


def _shared(hot: int):
    def share(asked: pa.Table) -> pa.Table:
        """Per anchor: 0 for one document only, 1 for several, 2 for very many pieces."""
        column = lambda i: asked[f"b{i}"].to_pylist()
        names = [unpacked(*x) for x in zip(column(0), column(1), strict=True)]
        low = [loose(x) for x in column(2)]
        high = [a + loose(x) for a, x in zip(low, column(3), strict=True)]
        anchors, place = _grouped(np.concatenate(names))
        least, most = _extreme(np.concatenate(low), place, len(anchors), np.minimum), _extreme(np.concatenate(high), place, len(anchors), np.maximum)
        counts = np.bincount(place, np.concatenate([loose(x) for x in column(4)]), minlength=len(anchors))
        state = np.where(least < most, np.where(counts > hot, 2, 1), 0).astype(np.uint8)[place]
        ends = np.cumsum([len(n) for n in names])
        blobs = [squeezed(state[e - len(n) : e]) for e, n in zip(ends, names, strict=True)]
        return pa.table({"part": asked["part"], "unit": asked["unit"], "answer": pa.array(blobs, pa.binary())})

    return share


class Sent:
    """What a unit sends to be indexed: distinct pieces of shared anchors, and distinct single
    strings of very frequent ones, by ascending key."""

    def __init__(self, pieces: Pieces, answers: pa.Table):
        anchors, place = _grouped(pieces.anchor)
        blobs = answers.sort_by("part")["answer"].to_pylist()
        state = np.concatenate([np.zeros(0, np.uint8), *(loose(b, np.uint8) for b in blobs)])[place]
        usual, hot = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        at, self.hot_piece = pieces.strings(hot)
        self.hot_at = at
        single = text_arrays.mixed(self._hash(pieces, at) ^ _SALT)
        ids = pieces.ids[pieces.row]
        # The key decides the range and, within it, the index: the anchor, or the string itself.
        key = np.concatenate([pieces.anchor[usual], single])
        name = np.concatenate([text_arrays.mixed(pieces.anchor[usual] ^ pieces.name[usual]), single])
        begin = np.concatenate([pieces.begin[usual], at])
        end = np.concatenate([pieces.last[usual] + LENGTH, at + LENGTH])
        owner = np.concatenate([ids[usual], ids[self.hot_piece]])
        order = np.lexsort((owner, name, key))
        sorted_key, sorted_name = key[order], name[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (sorted_name[1:] != sorted_name[:-1])
        first = order[new]
        self.key, self.begin, self.end, self.owner = key[first], begin[first], end[first], owner[first]
        item = np.empty(len(order), np.int64)
        item[order] = np.cumsum(new) - 1
        self.usual, self.usual_item, self.hot_item = usual, item[: len(usual)], item[len(usual) :]

    @staticmethod
    def _hash(pieces: Pieces, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.uint64)
        step, out = np.uint64(0xA24BAED4963EE407), np.zeros(len(at), np.uint64)
        for i in range(LENGTH):
            out = (out ^ pieces.data[at + i].astype(np.uint64)) * step + (out >> np.uint64(29))
        return text_arrays.mixed(out)


def _sent(parts: int):
    edges = range_edges(parts)

    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = Pieces(rows)
        sent = Sent(pieces, answers)
        cut = np.concatenate([[0], np.searchsorted(sent.key, edges), [len(sent.key)]])
        out = {name: [] for name in ("part", "unit", "keys_low", "keys_high", "owners", "lengths", "bytes")}
        for part in range(parts):
            s = slice(cut[part], cut[part + 1])
            if cut[part] == cut[part + 1]:
                continue
            length = sent.end[s] - sent.begin[s]
            at = np.repeat(sent.begin[s] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            low, high = packed(sent.key[s])
            row = (part, rows["unit"][0].as_py(), low, high, squeezed(sent.owner[s]), squeezed(length.astype(np.uint8)), squeezed(pieces.data[at]))
            for values, value in zip(out.values(), row, strict=True):
                values.append(value)
        return pa.table({k: pa.array(v, pa.int32() if k in ("part", "unit") else pa.binary()) for k, v in out.items()})

    return send


_SENT = "part int, unit int, keys_low binary, keys_high binary, owners binary, lengths binary, bytes binary"


def _names(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of consecutive strings, some bytes at a time."""
    out, begin = np.zeros(len(starts), np.uint64), 0
    while begin < len(starts):
        end = max(int(np.searchsorted(starts, starts[begin] + CUT_BYTES)), begin + 1)
        stop = starts[end - 1] + length[end - 1]
        some = starts[begin:end] - starts[begin]
        out[begin:end] = text_arrays.PrefixHash(data[starts[begin] : stop]).of(some, some + length[begin:end])
        begin = end
    return out


def _indexed(sent: pa.Table) -> pa.Table:
    """Answer, for each string sent, which of its starts also begin in a smaller document."""
    column = lambda name: sent[name].to_pylist()
    names = [unpacked(*x) for x in zip(column("keys_low"), column("keys_high"), strict=True)]
    key, owner = np.concatenate(names), np.concatenate([loose(x) for x in column("owners")])
    length = np.concatenate([loose(x, np.uint8) for x in column("lengths")]).astype(np.int64)
    data = np.concatenate([loose(x, np.uint8) for x in column("bytes")])
    starts = np.cumsum(length) - length
    name = _names(data, starts, length)
    # Equal strings of several units are one string of the smallest owner.
    order = np.lexsort((owner, name, key))
    key, owner, name, length, starts = key[order], owner[order], name[order], length[order], starts[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    # A key with one string has nothing to compare; the others are indexed, a key at a time.
    one_key = key[first]
    alone = np.ones(len(first), bool)
    alone[1:] &= one_key[1:] != one_key[:-1]
    alone[:-1] &= one_key[1:] != one_key[:-1]
    some, found = first[~alone], np.zeros(len(first), np.uint32)
    places = np.flatnonzero(~alone)
    begin = 0
    while begin < len(some):
        end = min(begin + BATCH, len(some))
        end = int(np.searchsorted(key[some], key[some[end - 1]], side="right"))
        part = some[begin:end]
        stop = np.cumsum(length[part])
        at = np.repeat(starts[part] - (stop - length[part]), length[part]) + np.arange(stop[-1])
        found[places[begin:end]] = Index(data[at], stop - length[part], length[part]).repeated(owner[part])
        begin = end
    masks = np.zeros(len(key), np.uint32)
    masks[order] = np.where(owner > owner[first][group], np.uint32(2**32 - 1), found[group])
    ends = np.cumsum([len(n) for n in names])
    blobs = [squeezed(masks[e - len(n) : e]) for e, n in zip(ends, names, strict=True)]
    return pa.table({"part": sent["part"], "unit": sent["unit"], "answer": pa.array(blobs, pa.binary())})


_ANSWER = "part int, unit int, answer binary"
_FOUND = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _covered(pieces: Pieces, sent: Sent, masks: np.ndarray) -> np.ndarray:
    """How many repeated strings cover each byte of the unit."""
    ids = pieces.ids[pieces.row]
    at, piece = pieces.strings(sent.usual)
    item = np.repeat(sent.usual_item, pieces.last[sent.usual] - pieces.begin[sent.usual] + 1)
    bit = (masks[item] >> (at - pieces.begin[piece]).astype(np.uint32)) & np.uint32(1)
    hits = [at[(bit == 1) | (sent.owner[item] < ids[piece])]]
    hits.append(sent.hot_at[(masks[sent.hot_item] & np.uint32(1) == 1) | (sent.owner[sent.hot_item] < ids[sent.hot_piece])])
    change = np.zeros(len(pieces.data) + 1, np.int32)
    for at in hits:
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change[:-1])


def _removed(digest: bool):
    def remove(rows: pa.Table, shared: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = Pieces(rows)
        sent = Sent(pieces, shared)
        blobs = answers.sort_by("part")["answer"].to_pylist()
        masks = np.concatenate([np.zeros(0, np.uint32), *(loose(b, np.uint32) for b in blobs)])
        gone = _covered(pieces, sent, masks) > 0
        spans, kept = [], []
        for a, b in zip(pieces.offsets[:-1].tolist(), pieces.offsets[1:].tolist(), strict=True):
            part = gone[a:b]
            if part.any():
                change = np.flatnonzero(np.diff(part.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": s, "end": e} for s, e in change.reshape(-1, 2).tolist()])
                rest = pieces.data[a:b][~part].tobytes()
            else:
                spans.append([])
                rest = pieces.data[a:b].tobytes()
            kept.append(hashlib.sha256(rest).hexdigest().encode() if digest else rest)
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": pa.array(np.diff(pieces.offsets), pa.int64()), "spans": pa.array(spans, kinds), "kept": pa.array(kept, pa.binary())})

    return remove


def repeated_spans(docs: DataFrame, digest: bool = False, unit_bytes: int = UNIT_BYTES, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row: the removed byte spans and the bytes that
    are left, or with ``digest`` their SHA-256 in hexadecimal. Anchors with more than ``hot``
    pieces are cut into single strings."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt, count = in_units(docs, unit_bytes)
    asked = dealt.mapInArrow(_asked(count), "part int, unit int, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary")
    shared = asked.groupBy("part").applyInArrow(_shared(hot), _ANSWER)
    sent = dealt.groupBy("unit").cogroup(shared.groupBy("unit")).applyInArrow(_sent(count), _SENT)
    answers = sent.groupBy("part").applyInArrow(_indexed, _ANSWER)
    both = shared.withColumn("step", F.lit(0)).unionByName(answers.withColumn("step", F.lit(1)))
    remove = _removed(digest)

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        step = np.asarray(told["step"])
        return remove(rows, told.filter(pa.array(step == 0)), told.filter(pa.array(step == 1)))

    return dealt.groupBy("unit").cogroup(both.groupBy("unit")).applyInArrow(finish, _FOUND)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"), digest=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("kept").cast("string").alias("kept_sha256")
    )


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT r, doc_id, substr(h, 2 * p + 1, 2) AS b, p, CASE WHEN 2 * p + {2 * LENGTH} <= len(h) THEN substr(h, 2 * p + 1, {2 * LENGTH}) END AS s
    FROM (SELECT *, unnest(range(0, len(h) // 2)) AS p FROM docs)),
starts AS (SELECT r, b, p, s IS NOT NULL AND coalesce(min(doc_id) OVER (PARTITION BY md5_number(s)) < doc_id, false) AS found FROM bytes),
covered AS (SELECT r, b, p, bool_or(found) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM starts),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM covered),
sums AS (
    SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT gone), '') AS kept
    FROM edges GROUP BY r
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN sums USING (r)
"""
