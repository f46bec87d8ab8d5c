"""Near-duplicates by b-bit MinHash.

A document is the set of its distinct 5-word shingles. Each set gets 128 minima of hash
functions. Thirty-two bands of four full minima find candidates: a pair at similarity 0.75
shares no band with a probability of 5e-6. Of each minimum only the four low bits are kept,
packed to 64 bytes, and two sets are compared by bit counts. Unequal minima agree on four bits
in a sixteenth of all cases, so the estimate is (agreement - 1/16) / (15/16). Candidates whose
estimate is more than 4.25 standard errors below 0.75 are left out, as are those whose set
sizes alone rule the similarity out. The rest is confirmed on the full sets.

Groups of copies never become all pairs:

1. Rows with equal sets are one class, found by partial aggregation and named by its number in
   the written table.
2. Each band bucket links its members to its smallest member only. Confirmed links are
   contracted to components.
3. In buckets that still hold several components, all members are compared with the one whose
   shingles are the most common, and links are contracted again.
4. What shares a bucket with other components then is searched exactly: shingles are ordered
   from rare to frequent, and two sets of the wanted similarity share one among the first quarter
   of the larger and the first seventh of the smaller. Sets with a common template that are just
   too different have shingles of their own there and are never paired. Holders of a shingle
   outside of its most frequent component are paired with those of other components.

The pairs of 3 and 4 are estimated by a finer signature of 1024 minima and then confirmed.

Missing and empty texts have an empty set and are linked with nothing. A text of fewer than
five words is one shingle. A row without an id takes part and links others, but gives no
component id; a group without any id has none. Repeated rows are copies of each other, and
different texts of one id are documents of their own. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import text_arrays
from waymark.llm.graph import connected_components
from waymark.llm.tables import narrow, stored, table

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
COARSE, FINE = BANDS * ROWS, 1024
ERRORS = 4.25
_BITS = 4
_PER_LONG = 64 // _BITS
_RNG = np.random.Generator(np.random.PCG64(8))
_FACTORS = _RNG.integers(0, 2**64, FINE, dtype=np.uint64) | np.uint64(1)
_TERMS = _RNG.integers(0, 2**64, FINE, dtype=np.uint64)
_BAND_SEEDS = _RNG.integers(0, 2**64, BANDS, dtype=np.uint64)
_SIGNED = "doc_id long, text_hash long, n long, f1 long, f2 long, bands array<long>, bits array<long>"
_KEY = ["n", "f1", "f2"]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and their row offsets."""
    hashes, offsets = text_arrays.windows(*text_arrays.word_hashes(texts), WORDS)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def _minima(values: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of minima of the value runs that begin at ``at``."""
    out = np.zeros((count, len(at)), np.uint64)
    if len(at):
        for k in range(count):
            out[k] = np.minimum.reduceat(values * _FACTORS[k] + _TERMS[k], at)
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of the minima, sixteen to a long."""
    # The low bits of a product mod 2^64 are not mixed, so the minima are mixed first.
    low = text_arrays.mixed(minima) & np.uint64(2**_BITS - 1)
    bits = np.zeros((len(minima) // _PER_LONG, minima.shape[1]), np.uint64)
    for k in range(len(minima)):
        bits[k // _PER_LONG] |= low[k] << np.uint64(_BITS * (k % _PER_LONG))
    return bits


def _lists(matrix: np.ndarray) -> pa.ListArray:
    """One list for each column of a matrix."""
    ends = np.arange(matrix.shape[1] + 1, dtype=np.int32) * len(matrix)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix.T).ravel().view(np.int64)))


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, set fingerprint, band keys and packed low bits of every document."""
    for batch in batches:
        for piece in text_arrays.pieces(batch):
            values, offsets = shingle_sets(piece["text"])
            full = np.flatnonzero(np.diff(offsets) > 0)
            n, at = len(full), offsets[:-1][full]
            fingerprints = _fingerprints(values, at)
            minima = _minima(values, at, COARSE)
            keys = np.repeat(_BAND_SEEDS[:, None], n, axis=1)
            for row in range(ROWS):
                keys = text_arrays.mixed(keys ^ minima[row::ROWS])
            place = np.full(piece.num_rows, -1)
            place[full] = np.arange(n)
            take = pa.array(place, mask=place < 0)
            columns = [pa.array(np.diff(offsets))]
            columns += [pa.array(x.view(np.int64)).take(take) for x in fingerprints]
            columns += [_lists(keys).take(take), _lists(_packed(minima)).take(take)]
            yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["text_hash"], *columns], ["doc_id", "text_hash", *_KEY, "bands", "bits"])


def _fingerprints(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two sums over the shingle runs that begin at ``at``."""
    out = np.zeros((2, len(at)), np.uint64)
    if len(at):
        out[0] = np.add.reduceat(values, at)
        out[1] = np.add.reduceat(text_arrays.mixed(values ^ _TERMS[0]), at)
    return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have a shingle, with the size and the fingerprint of their sets."""
    for batch in batches:
        for piece in text_arrays.pieces(batch):
            values, offsets = shingle_sets(piece["text"])
            full = np.flatnonzero(np.diff(offsets) > 0)
            f1, f2 = _fingerprints(values, offsets[:-1][full]).view(np.int64)
            columns = [piece["text"].take(pa.array(full)), pa.array(np.diff(offsets)[full]), pa.array(f1), pa.array(f2)]
            yield pa.RecordBatch.from_arrays(columns, ["text", *_KEY])


def _finely_signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The finer signature and the whole set of documents that have a shingle."""
    for batch in batches:
        for piece in text_arrays.pieces(batch):
            values, offsets = shingle_sets(piece["text"])
            sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([piece["id"], _lists(_packed(_minima(values, offsets[:-1], FINE))), sets], ["id", "bits", "shingles"])


def estimate(a: Column, b: Column, count: int) -> Column:
    """Collision-corrected similarity from two packed signatures of ``count`` minima."""

    def unequal(x: Column, y: Column) -> Column:
        differ = x.bitwiseXOR(y)
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 1))
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 2)).bitwiseAND(F.lit(0x1111111111111111))
        return F.bit_count(differ)

    total = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / 2**_BITS
    return (1 - total / F.lit(float(count)) - chance) / (1 - chance)


def least_estimate(count: int) -> float:
    """The lowest estimate that a link may have."""
    chance = 1.0 / 2**_BITS
    agreement = PERCENT / 100 * (1 - chance) + chance
    return PERCENT / 100 - ERRORS * math.sqrt(agreement * (1 - agreement) / count) / (1 - chance)


def _possible(a: str, b: str, count: int) -> Column:
    """Whether the set sizes and the estimate of two classes allow a link."""
    sizes = 100 * F.least(f"n_{a}", f"n_{b}") >= PERCENT * F.greatest(f"n_{a}", f"n_{b}")
    return sizes & (estimate(F.col(f"bits_{a}"), F.col(f"bits_{b}"), count) >= least_estimate(count))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        for piece in text_arrays.pieces(batch, "text_a"):
            for part in text_arrays.pieces(piece, "text_b"):
                (va, oa), (vb, ob) = shingle_sets(part["text_a"]), shingle_sets(part["text_b"])
                keep = []
                for i in range(part.num_rows):
                    x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that pass the exact test."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.mapInArrow(_confirmed, "a long, b long")


def rare_first(members: DataFrame) -> DataFrame:
    """Of ``members (id, shingles)``: ``id, n, common, first``. ``first`` are the shingles that others
    hold too among the rarest quarter, with their place in the order from rare to frequent;
    ``common`` is the mean number of holders of all shingles."""
    cells = members.select("id", F.explode("shingles").alias("shingle"))
    counts = cells.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    # A shingle that nobody else holds comes first and pairs nothing.
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "shingle")))
    ordered = cells.join(counts, "shingle", "left").groupBy("id").agg(order.alias("order"), F.avg(F.coalesce("held", F.lit(1))).alias("common"))
    n = F.size("order")
    place = lambda s, i: F.struct(s["held"].alias("held"), s["shingle"].alias("shingle"), i.alias("at"))
    first = F.transform(F.slice("order", 1, (n - F.ceil(n * PERCENT / 100) + 1).cast("int")), place)
    return ordered.select("id", n.alias("n"), "common", F.filter(first, lambda s: s["held"] > 1).alias("first"))


def _size_class(n: Column) -> Column:
    return F.floor(F.ln(n.cast("double")) * 20).cast("int")


def rare_pairs(rare: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different components, from ``rare_first`` and ``components (id,
    component)``, among them all that have the wanted similarity.

    Two sets of n and m shingles have to share 75 / 175 of n + m. Behind the first shingle that
    they share there are no more than what is left of either, so a shingle at place i of the
    larger one pairs it only with sizes m that n - i can reach, and these are part of the key.
    """
    places = stored(rare.select("id", "n", F.inline("first")).drop("held").join(components, "id"), "places")
    groups = places.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    main = groups.groupBy("shingle").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
    places = places.join(main.where("parts > 1").select("shingle", "main"), "shingle").withColumn("outside", F.col("component") != F.col("main"))
    places = stored(places.drop("main"), "places")
    n, left = F.col("n"), F.col("n") - F.col("at")
    whole = 100 + PERCENT
    most = F.least(n, F.floor(left * whole / PERCENT) - n)
    larger = places.withColumns({"least": F.ceil(n * PERCENT / 100), "most": most}).where("most >= least")
    larger = larger.withColumn("class", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))))
    smaller = places.where(left * whole >= 2 * PERCENT * n).withColumn("class", _size_class(n))
    side = lambda rows, x: rows.select("shingle", "class", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "component", "at")])
    order = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") > F.col("id_b")))
    reach = whole * F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= PERCENT * (F.col("n_a") + F.col("n_b"))
    apart = (F.col("component_a") != F.col("component_b")) & order & reach
    first = side(larger.where("outside"), "a").join(side(smaller, "b"), ["shingle", "class"]).where(apart)
    second = side(larger.where("not outside"), "a").join(side(smaller.where("outside"), "b"), ["shingle", "class"]).where(apart)
    return first.unionByName(second).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups (id, component)`` with the components that ``links (a, b)`` connect made one."""
    if links.isEmpty():
        return groups
    of = lambda x: groups.select(F.col("id").alias(x), F.col("component").alias(f"component_{x}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    merged = connected_components(edges).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return stored(groups.join(merged, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "groups")


def _crowded(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """``band, id, component`` of the buckets that hold several components."""
    grouped = buckets.join(groups, "id")
    several = grouped.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    return grouped.select("band", "id", "component").join(several, "band", "left_semi")


def _grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n, component, least`` of every row: its group (missing if it has no
    shingle) and the smallest id of that."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sets = stored(docs.mapInArrow(signed, _SIGNED), "sets")
    classes = sets.where("n > 0").groupBy(*_KEY).agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    banded = classes.select("id", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1").select("band", "head")
    buckets = stored(banded.join(heads, "band"), "buckets")
    shared = stored(buckets.select("id").distinct(), "shared")
    shared = stored(classes.select("id", *_KEY, "least").join(narrow(shared), "id"), "shared")
    # One text of each class: those of its smallest id are looked at, or all without an id.
    held = docs.join(narrow(shared.select(F.col("least").alias("doc_id")).where("doc_id is not null").distinct()), "doc_id", "left_semi")
    held = held.select("text").unionByName(docs.where("doc_id is null").select("text"))
    texts = held.mapInArrow(_named, "text string, n long, f1 long, f2 long").dropDuplicates(_KEY)
    texts = stored(texts.join(shared.select("id", *_KEY), _KEY).select("id", "text"), "texts")

    stars = buckets.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    signature = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    stars = stored(stars.join(signature("a"), "a").join(signature("b"), "b").where(_possible("a", "b", COARSE)).select("a", "b"), "stars")
    links = stored(_links(stars, texts), "links")
    groups = _joined(shared.select("id", F.col("id").alias("component")), links)

    crowded = stored(_crowded(buckets, groups), "crowded")
    members = crowded.select("id").distinct().join(texts, "id").select("id", "text")
    members = stored(members.mapInArrow(_finely_signed, "id long, bits array<long>, shingles array<long>"), "members")
    rare = stored(rare_first(members), "rare")
    fine = lambda x: members.select(F.col("id").alias(x), F.size("shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    likely = lambda pairs: pairs.join(fine("a"), "a").join(fine("b"), "b").where(_possible("a", "b", FINE)).select("a", "b")
    # The member with the most common shingles is close to most others of its bucket.
    middle = crowded.join(rare.select("id", "common"), "id").groupBy("band").agg(F.max_by(F.struct("id", "component"), F.struct("common", "id")).alias("m"))
    near = crowded.join(middle, "band").where(F.col("component") != F.col("m.component"))
    near = near.select(F.least("id", "m.id").alias("a"), F.greatest("id", "m.id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    groups = _joined(groups, stored(_links(stored(likely(near), "near"), texts), "links"))

    crowded = stored(_crowded(buckets, groups).select("id", "component").distinct(), "crowded")
    across = stored(likely(rare_pairs(rare, crowded)), "across")
    groups = _joined(groups, stored(_links(across, texts), "links"))

    named = classes.select("id", *_KEY, "least").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = stored(named.select(*_KEY, "least", "component"), "named")
    named = named.drop("least").join(named.groupBy("component").agg(F.min("least").alias("least")), "component")
    return sets.select("doc_id", "text_hash", *_KEY).join(named, _KEY, "left").select("doc_id", "text_hash", "n", "component", "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``."""
    found = _grouped(docs)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group, all columns kept: one with the smallest id, and of several texts of
    that id the one with the smallest hash. Rows without a shingle all stay."""
    rows = _grouped(docs).where("component is not null")
    rows = stored(rows.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("rows")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_hash")
    stands = rows.groupBy("component").agg(F.min(order).alias("stands"))
    judged = rows.join(stands, "component").withColumn("stays", order == F.col("stands"))
    judged = stored(judged.where("not stays or rows > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "stays"), "judged")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    # Rows that go, and rows that are there several times and stay once.
    kept = docs.join(narrow(judged.select("__id", "__hash")), match, "left_anti")
    again = judged.where("stays").select("__id", "__hash")
    if again.isEmpty():
        return kept
    held = stored(docs.join(narrow(again), match, "left_semi"), "repeated")
    return kept.unionByName(_first_of_equals(held))


def _first_of_equals(docs: DataFrame) -> DataFrame:
    """One row of those with equal id and text: the least row of each task, then of all tasks."""
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("name"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("order"))
    picked = whole.groupBy("name", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")).agg(F.min_by("row", "order").alias("row"))
    return picked.select("row.*")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = f"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
),
cells AS (
    SELECT DISTINCT r, array_to_string(w[i:i + {WORDS - 1}], ' ') AS shingle
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT r, count(*) AS n FROM cells GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM cells a JOIN cells b ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT r AS a, r AS b FROM sizes UNION SELECT reached.a, ways.b FROM reached JOIN ways ON reached.b = ways.a),
named AS (SELECT reached.a AS r, min(d.doc_id) AS component_id FROM reached JOIN docs d ON d.r = reached.b GROUP BY reached.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
    doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS kept
FROM docs LEFT JOIN sizes USING (r) LEFT JOIN named USING (r)
"""
