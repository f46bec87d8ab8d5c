"""How filters interact: what each would remove at each step of every order of them.

A document's mask says which filters it fails. The corpus shrinks to one cell per part and mask
(at most ``2^k`` cells a part for ``k`` filters) with its counts of documents, good and toxic
ones. Each cell folds across the array of all orders: ``transform`` walks the orders,
``aggregate`` walks the steps of one order and remembers whether the cell is still there. That
gives one struct per order and step (600 for five filters), weighted by the cell's counts; the
arrays of a part's cells are merged by elementwise sums. The Shapley column sums what a filter
removes over all orders.

Whether a text equals that of a smaller id depends on the whole table. Equal texts have equal
masks otherwise, so rows are counted by (text digest, part, mask, labels) before any of them
meet: a text that is everywhere costs a row per part and task. Only its smallest id, and how
many rows carry that id, have to be known then. Digests are SHA-256.

Texts: a missing text is empty; an empty one fails A only (and E, if a smaller id is empty too).
A missing source and an empty one are one part. A row without an id has no labels, is no smaller
than any other and fails no E. Rows of one id are not smaller than each other. Several label
rows of one id count as one that is good (toxic) if any of them is. An empty table gives no
rows. Only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.tables import narrow, stored, table

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
LETTERS = "ABCDE"
MOST_FILTERS = 6  # 720 orders of six steps are still a small array
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_CAPITALS = "".join(map(chr, range(ord("A"), ord("Z") + 1)))


def quality_failures(text: Column) -> dict[str, Column]:
    """The conditions that need the text alone: too short, too repetitive, too many capitals,
    markup characters."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # The words are computed once: both sizes come out of one lambda.
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": sizes["all"] < MIN_WORDS,
        "B": 100 * sizes["distinct"] < MIN_DISTINCT * sizes["all"],
        "C": 100 * capitals > MAX_CAPITALS * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(failures: Sequence[Column]) -> Column:
    bits = [F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(failures)]
    return sum(bits[1:], bits[0])


def document_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, part, mask`` of every row, without the filter E."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    failures = quality_failures(F.col("text"))
    return rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "part", _mask([failures[x] for x in "ABCD"]).alias("mask"))


def label_flags(labels: DataFrame) -> DataFrame:
    """``doc_id, good, toxic`` (0 or 1), one row per id that is either."""
    flag = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    return flags.where("good + toxic > 0")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: the corpus by part and mask, with E as the fifth bit."""
    same = ["digest", "part", "mask"]
    rows = stored(document_masks(docs), "masks")
    # Repeated rows of an id meet its labels once; rows without an id have none to meet.
    known = rows.where("doc_id IS NOT NULL").groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    known = known.join(narrow(stored(label_flags(labels), "labels")), "doc_id", "left").fillna(0, ["good", "toxic"])
    lost = rows.where("doc_id IS NULL").groupBy(*same).agg(F.count("*").alias("n"))
    lost = lost.select(F.lit(None).cast("long").alias("doc_id"), *same, "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    # For each text, part and pair of labels: all rows, the smallest id, and the rows that carry it.
    first = [F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("rows")]
    with_id = stored(known.groupBy(*same, "good", "toxic").agg(F.sum("n").alias("n"), *first), "texts")
    least = with_id.groupBy("digest").agg(F.min("least").alias("smallest"))
    with_id = with_id.join(least, "digest").withColumn("unique", F.when(F.col("least") == F.col("smallest"), F.col("rows")).otherwise(0))
    repeated_bit = 1 << LETTERS.index("E")
    split = with_id.select(
        "part", "good", "toxic",
        F.inline(F.array(F.struct(F.col("mask"), F.col("unique").alias("n")), F.struct((F.col("mask") + repeated_bit).alias("mask"), (F.col("n") - F.col("unique")).alias("n")))),
    ).unionByName(lost.select("part", "good", "toxic", "mask", "n"))
    weight = lambda name: F.sum(F.col("n") * F.col(name)).alias(name)
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("total"), weight("good"), weight("toxic")).withColumnRenamed("total", "n")


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Fold ``cells (part, mask, n, good, toxic)`` across all orders of ``letters``; bit i of a
    mask says that the i-th letter's filter fails.

    Returns ``part, filter_order, step, filter``, the counts and ``shapley``.
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"between 1 and {MOST_FILTERS} different filters")
    bits = F.create_map(*[x for i, letter in enumerate(letters) for x in (F.lit(letter), F.lit(1 << i))])
    orders = F.array(*[F.lit("".join(order)) for order in permutations(letters)])
    none = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ">>")

    def walk(order: Column) -> Column:
        def step(held: Column, letter: Column) -> Column:
            bit = F.element_at(bits, letter)
            fails = F.col("mask").bitwiseAND(bit) != 0
            here, alone = fails & held["alive"], F.col("mask") == bit
            counts = F.struct(
                F.when(held["alive"] & ~fails, F.col("n")).otherwise(none).alias("kept"),
                F.when(here, F.col("n")).otherwise(none).alias("removed"),
                F.when(fails & ~held["alive"], F.col("n")).otherwise(none).alias("redundant"),
                F.when(alone, F.col("n")).otherwise(none).alias("unique_fails"),
                F.when(here, F.col("good")).otherwise(none).alias("good_lost"),
                F.when(here, F.col("toxic")).otherwise(none).alias("toxic_lost"),
            )
            return F.struct((held["alive"] & ~fails).alias("alive"), F.concat(held["steps"], F.array(counts)).alias("steps"))

        start = F.struct(F.lit(True).alias("alive"), empty.alias("steps"))
        return F.aggregate(F.split(order, ""), start, step, lambda held: held["steps"])

    def added(x: Column, y: Column) -> Column:
        return F.struct(*[(x[c] + y[c]).alias(c) for c in _COUNTS])

    long = cells.select("part", "mask", *[F.col(c).cast("long").alias(c) for c in ("n", "good", "toxic")])
    folded = long.select("part", F.flatten(F.transform(orders, walk)).alias("steps"))
    # At most 2^k arrays meet here.
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("all"))
    merged = merged.select("part", F.aggregate(F.slice("all", 2, 1 << len(letters)), F.col("all")[0], lambda a, b: F.zip_with(a, b, added)).alias("steps"))
    letter_at = lambda i: F.substring(F.get(orders, F.floor(i / len(letters)).cast("int")), (i % len(letters) + 1).cast("int"), F.lit(1))
    of_letter = lambda letter: F.aggregate(
        F.transform("steps", lambda s, i: F.when(letter_at(i) == letter, s["removed"]).otherwise(none)), none, lambda a, x: a + x
    )
    shapley = F.create_map(*[x for letter in letters for x in (F.lit(letter), of_letter(F.lit(letter)))])
    rows = merged.withColumn("shapley_of", shapley).select("part", "shapley_of", F.posexplode("steps").alias("at", "one"))
    return rows.select(
        "part",
        F.get(orders, F.floor(F.col("at") / len(letters)).cast("int")).alias("filter_order"),
        (F.col("at") % len(letters) + 1).cast("int").alias("step"),
        letter_at(F.col("at")).alias("filter"),
        *[F.col(f"one.{c}").alias(c) for c in _COUNTS],
        F.element_at("shapley_of", letter_at(F.col("at"))).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = f"""
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS smallest
    FROM documents
),
flags AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
),
failing AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        len(words) < {MIN_WORDS} AS "A",
        100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) AS "B",
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(text) AS "C",
        regexp_matches(text, '[#$%&*|]') AS "D",
        coalesce(smallest < d.doc_id, false) AS "E"
    FROM docs d LEFT JOIN flags f ON d.doc_id = f.doc_id
),
parts AS (
    SELECT part, concat(CASE WHEN "A" THEN 'A' ELSE '' END, CASE WHEN "B" THEN 'B' ELSE '' END, CASE WHEN "C" THEN 'C' ELSE '' END,
        CASE WHEN "D" THEN 'D' ELSE '' END, CASE WHEN "E" THEN 'E' ELSE '' END) AS fails,
        count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM failing GROUP BY ALL
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (
    SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) r(step)
),
met AS (
    SELECT part, filter_order, step, filter, n, good, toxic, contains(fails, filter) AS fails, fails = filter AS alone,
        earlier <> '' AND regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN 'x' ELSE earlier END || ']') AS gone
    FROM parts, steps
),
counted AS (
    SELECT part, filter_order, step, filter,
        sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
    FROM met GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""
