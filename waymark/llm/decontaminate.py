"""Benchmark decontamination by spaced seeds.

A seed is a window of six to nine tokens of which a fixed mask keeps six and ignores the others,
so a replaced token under an ignored position does not hide the window. Kept tokens of every
benchmark window are hashed per mask and joined with those of every document window. The masks
are lossless: every stretch that satisfies the rule below has a seed, wherever its replaced
tokens are. (A stretch of 34 or more tokens has a half that satisfies the rule as well; shorter
ones are checked one and all in the tests.) Each hit
names a diagonal: a document shift against an item. Along a diagonal the tokens are compared
one by one. A document overlaps an item if any stretch of a diagonal holds at least 13 matching
tokens which are three quarters of it. Reported is the best-scoring stretch (a match counts 1, a
substitution -2) if it is such a one, else the stretch with the most matches that is: the best
score alone trims the ends behind a replaced word and may join stretches to less than three
quarters.

Tokens are runs of letters and digits after lower-casing A-Z. All work is DataFrame
expressions; the document side is never shuffled while the benchmark's seeds are within the
proven broadcast bound, and hits are pre-aggregated per diagonal before they are.

Items of 10 to 12 tokens are found where they are copied whole and word for word. Missing and
empty texts and items of fewer than ten tokens give no seeds: shorter phrases cannot be told
from common ones. A repeated item id counts as one item with several texts.
Repeated documents are found each. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.tables import narrow, stored, table

# 1: the token must match, 0: it is ignored. Lossless for 13 matches at 75%.
MASKS = ("111111", "11100111", "11011011", "110001111", "101110101", "110110101")
SPAN = 10  # tokens that an item must have
MIN_MATCHED, MIN_PERCENT = 13, 75
MATCH, MISMATCH = 1, -2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[^\p{L}\p{N}]+"), "")


def _seeds(df: DataFrame, position: str) -> DataFrame:
    """One row per window and mask: the 1-based position and the hash of the kept tokens."""
    starts = F.sequence(F.lit(1), F.size("tokens") - (min(map(len, MASKS)) - 1))
    at = df.where(F.size("tokens") >= SPAN).withColumn(position, F.explode(starts))
    token = lambda i: F.get("tokens", F.col(position) + (i - 1))
    kept = lambda m, mask: F.xxhash64(F.lit(m), *[token(i) for i in range(len(mask)) if mask[i] == "1"])
    inside = lambda mask: F.col(position) + (len(mask) - 1) <= F.size("tokens")
    hashes = [F.when(inside(mask), kept(m, mask)) for m, mask in enumerate(MASKS)]
    return at.withColumn("seed", F.explode(F.array(*hashes))).where(F.col("seed").isNotNull())


def _best_stretch(matches: Column) -> Column:
    """The best-scoring run of a boolean array: score, 0-based start, end (exclusive), matched.

    The earliest end wins among equal scores, and the latest start for it."""
    zero = F.lit(0)
    begin = F.struct(*[zero.alias(c) for c in ("at", "score", "start", "hits", "best", "best_start", "best_end", "best_hits")])

    def step(s: Column, match: Column) -> Column:
        gain = F.when(match, MATCH).otherwise(MISMATCH)
        fresh = s["score"] <= 0
        score, start = F.when(fresh, gain).otherwise(s["score"] + gain), F.when(fresh, s["at"]).otherwise(s["start"])
        hits = F.when(fresh, zero).otherwise(s["hits"]) + match.cast("int")
        better = score > s["best"]
        return F.struct(
            (s["at"] + 1).alias("at"),
            score.alias("score"),
            start.alias("start"),
            hits.alias("hits"),
            F.when(better, score).otherwise(s["best"]).alias("best"),
            F.when(better, start).otherwise(s["best_start"]).alias("best_start"),
            F.when(better, s["at"] + 1).otherwise(s["best_end"]).alias("best_end"),
            F.when(better, hits).otherwise(s["best_hits"]).alias("best_hits"),
        )

    return F.aggregate(matches, begin, step)


def _widest_stretch(matches: Column) -> Column:
    """The run of a boolean array with the most matches of those that are three quarters
    matches: 0-based start, end (exclusive), matched. It begins and ends with a match.

    With 1 for a match and -3 for a mismatch such runs have sums of zero at least. For every
    end the earliest start whose prefix sum is no larger takes the most; ``firsts`` holds, for
    -1, -2 and so on, where the prefix sums first came down to it."""
    zero, place = F.lit(0), lambda at, hits: F.struct(at.alias("at"), hits.alias("hits"))
    names = ("at", "total", "hits", "best_start", "best_end", "best_hits")
    begin = F.struct(*[zero.alias(c) for c in names], F.array().cast("array<struct<at:int,hits:int>>").alias("firsts"))

    def step(s: Column, match: Column) -> Column:
        at, hits = s["at"] + 1, s["hits"] + match.cast("int")
        total = s["total"] + F.when(match, 1).otherwise(-3)
        deeper = -total - F.size(s["firsts"])
        firsts = F.when(deeper > 0, F.concat(s["firsts"], F.array_repeat(place(at, hits), deeper))).otherwise(s["firsts"])
        origin = F.when(total >= 0, place(zero, zero)).otherwise(F.get(firsts, -total - 1))
        more = hits - origin["hits"] > s["best_hits"]
        return F.struct(
            at.alias("at"),
            total.alias("total"),
            hits.alias("hits"),
            F.when(more, origin["at"]).otherwise(s["best_start"]).alias("best_start"),
            F.when(more, at).otherwise(s["best_end"]).alias("best_end"),
            F.when(more, hits - origin["hits"]).otherwise(s["best_hits"]).alias("best_hits"),
            firsts.alias("firsts"),
        )

    def trimmed(s: Column) -> Column:
        skipped = F.array_position(F.slice(matches, s["best_start"] + 1, F.size(matches)), True) - 1
        start = s["best_start"] + F.greatest(skipped, F.lit(0)).cast("int")
        return F.struct(start.alias("best_start"), s["best_end"].alias("best_end"), s["best_hits"].alias("best_hits"))

    return F.aggregate(matches, begin, step, trimmed)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every overlap of a document with a benchmark item, with its best diagonal.

    Returns ``doc_id, text_hash, item_id, doc_start, item_start, length, matched``; starts are
    0-based token positions. ``text_hash`` is ``xxhash64(text)``, which tells rows of a
    repeated or missing id apart.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("tokens")).distinct()
    items = stored(items.where(F.size("tokens") >= SPAN).withColumn("item_hash", F.xxhash64("tokens")), "items")
    wanted = _seeds(items, "item_at").select("seed", "item_id", "item_hash", "item_at", F.size("tokens").alias("item_length")).distinct()
    wanted = narrow(stored(wanted, "seeds"))

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens(F.col("text")).alias("tokens"))
    hits = _seeds(texts, "doc_at").join(wanted, "seed").withColumn("shift", F.col("doc_at") - F.col("item_at"))
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.col("item_length"), F.size("tokens") - F.col("shift"))
    diagonal = ["doc_id", "text_hash", "item_id", "item_hash", "shift"]
    lined = hits.select(*diagonal, first.alias("first"), F.slice("tokens", first + F.col("shift") + 1, last - first).alias("doc_tokens"))
    lined = lined.groupBy(*diagonal).agg(F.first("first").alias("first"), F.first("doc_tokens").alias("doc_tokens"))

    lined = lined.join(items, ["item_id", "item_hash"])
    item_tokens = F.slice("tokens", F.col("first") + 1, F.size("doc_tokens"))
    lined = lined.withColumn("matches", F.zip_with("doc_tokens", item_tokens, lambda x, y: x == y))
    needed = F.least(F.lit(MIN_MATCHED), F.size("tokens"))
    holds = lambda s: (s["best_hits"] >= needed) & (s["best_hits"] * 100 >= (s["best_end"] - s["best_start"]) * MIN_PERCENT)
    best = lined.withColumn("best", _best_stretch(F.col("matches"))).withColumn("scored", holds(F.col("best")))
    # Three quarters of matches leave a score of a third of them, so most chance hits end here.
    best = best.where(F.col("best.best") * 3 >= needed)
    stretch = F.when(F.col("scored"), F.struct("best.best_start", "best.best_end", "best.best_hits")).otherwise(_widest_stretch(F.col("matches")))
    best = best.withColumn("stretch", stretch).where(holds(F.col("stretch")))
    length, matched = F.col("stretch.best_end") - F.col("stretch.best_start"), F.col("stretch.best_hits")
    found = best.select(
        "doc_id",
        "text_hash",
        "item_id",
        "item_hash",
        (F.col("first") + F.col("shift") + F.col("stretch.best_start")).cast("long").alias("doc_start"),
        (F.col("first") + F.col("stretch.best_start")).cast("long").alias("item_start"),
        length.cast("long").alias("length"),
        matched.cast("long").alias("matched"),
        "scored",
        (MATCH * matched + MISMATCH * (length - matched)).alias("score"),
    )
    columns = ("doc_start", "item_start", "length", "matched")
    order = F.struct(F.col("scored"), F.col("score"), -F.col("doc_start"), -F.col("item_start"))
    top = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max_by(F.struct(*columns), order).alias("top"))
    return top.select("doc_id", "text_hash", "item_id", "top.*")


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item, all columns kept."""
    found = stored(overlaps(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "leaks")
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(narrow(found), match, "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


_TOKENS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _window_sql(source: str, key: str, position: str) -> str:
    parts = []
    for m, mask in enumerate(MASKS):
        kept = ", ".join(f"t[i + {i}]" for i in range(len(mask)) if mask[i] == "1")
        windows = f"SELECT *, unnest(range(1, len(t) - {len(mask) - 2})) AS i FROM {source} WHERE len(t) >= {SPAN}"
        parts.append(f"SELECT {key}, i AS {position}, concat_ws(' ', '{m}', {kept}) AS seed FROM ({windows})")
    return "\nUNION ALL\n".join(parts)


SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TOKENS} AS t FROM documents),
b AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
dw AS ({_window_sql("d", "doc_id, r", "da")}),
bw AS ({_window_sql("b", "item_id", "ba")}),
diagonals AS (SELECT DISTINCT doc_id, r, item_id, da - ba AS shift FROM dw JOIN bw USING (seed)),
cells AS (
    SELECT doc_id, r, item_id, shift, j, d_t[j + shift] = b_t[j] AS hit
    FROM (
        SELECT g.*, d.t AS d_t, b.t AS b_t, unnest(range(greatest(1, 1 - shift), least(len(b.t), len(d.t) - shift) + 1)) AS j
        FROM diagonals g JOIN d USING (r) JOIN b ON b.item_id = g.item_id
    )
),
sums AS (
    SELECT *, sum(CASE WHEN hit THEN {MATCH} ELSE {MISMATCH} END) OVER w AS s, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS h
    FROM cells WINDOW w AS (PARTITION BY r, item_id, shift ORDER BY j)
),
starts AS (
    SELECT r, item_id, shift, j AS i, s - CASE WHEN hit THEN {MATCH} ELSE {MISMATCH} END AS before, h - CASE WHEN hit THEN 1 ELSE 0 END AS hits_before FROM sums
),
ends AS (
    SELECT e.doc_id, e.r, e.item_id, e.shift, e.j, e.s - x.before AS score, x.i, e.h - x.hits_before AS matched
    FROM sums e JOIN starts x ON x.r = e.r AND x.item_id = e.item_id AND x.shift = e.shift AND x.i <= e.j
),
best AS (
    SELECT *, true AS scored FROM ends QUALIFY row_number() OVER (PARTITION BY r, item_id, shift ORDER BY score DESC, j, i DESC) = 1
),
needs AS (SELECT item_id, least({MIN_MATCHED}, len(t)) AS needed FROM b),
holding AS (SELECT x.* FROM best x JOIN needs USING (item_id) WHERE matched >= needed AND matched * 100 >= (j - i + 1) * {MIN_PERCENT}),
widest AS (
    SELECT doc_id, r, item_id, shift, j, i, matched FROM ends e ANTI JOIN holding h ON h.r = e.r AND h.item_id = e.item_id AND h.shift = e.shift
    WHERE matched * 100 >= (j - i + 1) * {MIN_PERCENT}
    QUALIFY row_number() OVER (PARTITION BY r, item_id, shift ORDER BY matched DESC, j, i) = 1
),
trimmed AS (
    SELECT w.doc_id, w.r, w.item_id, w.shift, w.j, min(c.j) AS i, any_value(w.matched) AS matched
    FROM widest w JOIN cells c ON c.r = w.r AND c.item_id = w.item_id AND c.shift = w.shift AND c.hit AND c.j BETWEEN w.i AND w.j
    GROUP BY ALL
),
long_enough AS (
    SELECT doc_id, r, item_id, shift, i, j, matched, scored FROM holding
    UNION ALL
    SELECT doc_id, r, item_id, shift, i, j, matched, false FROM trimmed JOIN needs USING (item_id) WHERE matched >= needed
)
SELECT doc_id, item_id, CAST(i - 1 + shift AS BIGINT) AS doc_start, CAST(i - 1 AS BIGINT) AS item_start,
    CAST(j - i + 1 AS BIGINT) AS length, CAST(matched AS BIGINT) AS matched
FROM long_enough
QUALIFY row_number() OVER (
    PARTITION BY r, item_id ORDER BY scored DESC, {MATCH} * matched + {MISMATCH} * (j - i + 1 - matched) DESC, i + shift, i
) = 1
"""
