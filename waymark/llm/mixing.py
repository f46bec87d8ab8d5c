"""Mixing sources to target weights by temperature.

A source with the token share p gets the weight p^x / sum(p^x). The exponent x in [0, 1] is
found by bisection: the most even mix (smallest x) whose largest source repetition stays
within a limit, or the largest x whose entropy reaches a target share of the most even mix.
Sixty-three midpoints are tried per job, which is six halvings, and only sums over sources
come to the driver.

The weights become a plan of document copies. Each source is passed over in whole epochs and a
part of one more until its token quota is met; an epoch is a permutation of its documents by a
hash, and a copy takes part if the tokens in front of it are below what is left of the quota.
Positions are cut into as many blocks for every source, so every block holds the weights; a
hash orders the copies inside a block.

A permutation is never sorted in one task: hash prefixes cut it into buckets whose number
grows with the rows of the source, running sums are taken in a bucket and offset by the totals
of the buckets before it, in two levels.

A draw is a hash of id, text and the number of the row among equal rows, so rows without an id
are told apart by their texts and repeated rows are drawn each. ``mixed_documents`` moves no
text of a row that is there once: where a block begins in a bucket is a hash, so a row's own hash
says where it belongs. The table of these hashes is broadcast if it is small. Only repeated rows
are written down with a number and joined to their draws.

A missing source is a source, and so is an empty one. Texts without tokens are never drawn. An
empty table gives no rows. Everything is DataFrame expressions; only ``doc_id``, ``text`` and
``source`` are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.features.resample import repeated
from waymark.llm.tables import narrow, stored, table

HALVINGS, PER_JOB = 42, 6
SEED = 20
BUCKET_ROWS = 1000
LOOKUP_BUCKETS = 200_000  # buckets whose block hashes are broadcast
MAX_REPEATS = 2.0
BLOCK_TOKENS = 100_000


@dataclass(frozen=True)
class Target:
    """What the exponent has to meet: at most so many passes over any source, or at least
    this share of the largest possible entropy."""

    max_repeats: float | None = None
    entropy_share: float | None = None

    def met(self, entropy: float, repeats: float, sources: int) -> bool:
        if self.max_repeats is not None:
            return repeats <= self.max_repeats
        return entropy >= (self.entropy_share or 0.0) * math.log(sources)


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _measured(totals: DataFrame, all_tokens: int, budget: int, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Entropy and largest repetition of the mix at each exponent."""
    share = F.ln(F.col("tokens") / F.lit(float(all_tokens)))
    powers = totals.select("tokens", share.alias("log"), F.explode(F.array(*map(F.lit, exponents))).alias("x"))
    powers = powers.withColumn("power", F.exp(F.col("x") * F.col("log")))
    sums = powers.groupBy("x").agg(F.sum("power").alias("z"), F.sum(F.col("power") * F.col("log")).alias("m"), F.max(F.col("power") / F.col("tokens")).alias("r"))
    return {r.x: (math.log(r.z) - r.x * r.m / r.z, r.r * budget / r.z) for r in sums.collect()}


def _midpoints(low: float, high: float, levels: int) -> list[float]:
    return [low + (high - low) * i / 2**levels for i in range(1, 2**levels)]


def exponent(totals: DataFrame, all_tokens: int, sources: int, budget: int, target: Target) -> float:
    """Bisect the exponent. Repetition falls and so does entropy as the exponent grows, so a
    repetition limit asks for the smallest and an entropy target for the largest exponent."""
    falling = target.max_repeats is not None
    ends = _measured(totals, all_tokens, budget, [0.0, 1.0])
    best, other = (0.0, 1.0) if falling else (1.0, 0.0)
    if target.met(*ends[best], sources):
        return best
    if not target.met(*ends[other], sources):
        return other
    low, high = 0.0, 1.0
    for _ in range(HALVINGS // PER_JOB):
        found = _measured(totals, all_tokens, budget, _midpoints(low, high, PER_JOB))
        for _ in range(PER_JOB):
            middle = (low + high) / 2
            near = min(found, key=lambda x: abs(x - middle))
            met = target.met(*found[near], sources)
            low, high = (low, middle) if met == falling else (middle, high)
    return high if falling else low


_EQUAL = ["doc_id", "text_hash", "source"]


def _text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _stream(source: Column) -> Column:
    """A source as text that is never missing."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _draw(doc_id: Column, text_hash: Column, number: Column, epoch: Column) -> Column:
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), text_hash, number.cast("string"), epoch.cast("string"), F.lit(str(SEED))]
    return F.md5(F.concat_ws(":", *parts))


@dataclass
class _Plan:
    """``sized``: different rows with ``n_tokens`` and how often they are there; ``quotas``: per
    ``stream`` its tokens, its quota and the hash digits of its buckets; ``placed``: all copies with
    ``block``, which is missing behind the quota."""

    sized: DataFrame
    quotas: DataFrame
    placed: DataFrame


def _planned(docs: DataFrame, target: Target, budget: int | None, block_tokens: int) -> _Plan:
    sized = docs.select("doc_id", _text_hash(F.col("text")).alias("text_hash"), "source", token_count(F.col("text")).alias("n_tokens")).where("n_tokens > 0")
    sized = stored(sized.groupBy(*_EQUAL, "n_tokens").agg(F.count("*").alias("rows")), "sized")
    totals = sized.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("tokens"), F.sum("rows").alias("rows"))
    totals = stored(totals, "totals")
    all_tokens, rows, sources = totals.agg(F.sum("tokens"), F.sum("rows"), F.count("*")).first()
    all_tokens, rows = all_tokens or 0, rows or 0
    budget = all_tokens if budget is None else budget
    x = exponent(totals, all_tokens, sources, budget, target) if rows else 1.0

    power = F.exp(F.lit(x) * F.ln(F.col("tokens") / F.lit(float(max(all_tokens, 1)))))
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    quota = F.floor(F.round(power / F.lit(z), 9) * F.lit(float(budget))).cast("long")
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("rows") / BUCKET_ROWS))).cast("int")
    quotas = stored(totals.select(_stream(F.col("source")).alias("stream"), "tokens", quota.alias("quota"), digits.alias("digits")).where("quota > 0"), "quotas")

    drawn = sized.withColumn("stream", _stream(F.col("source"))).join(quotas, "stream")
    single = drawn.where("rows = 1").drop("rows").withColumn("number", F.lit(1).cast("long"))
    # A row that is there very often is repeated in chunks, by several tasks.
    copies = single.unionByName(repeated(drawn.where("rows > 1"), "rows", "number").drop("rows"))
    copies = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("tokens")))))
    copies = copies.withColumn("hash", _draw(F.col("doc_id"), F.col("text_hash"), F.col("number"), F.col("epoch")))
    copies = copies.withColumn("bucket", F.substring("hash", F.lit(1), F.col("digits")))

    at = ["stream", "epoch"]
    inside = Window.partitionBy(*at, "bucket").orderBy("hash", "doc_id", "number").rowsBetween(Window.unboundedPreceding, -1)
    local = copies.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = local.join(_offsets(copies, at), [*at, "bucket"]).withColumn("at", F.col("epoch") * F.col("tokens") + F.col("offset") + F.col("ahead"))
    blocks = max(1, math.ceil(budget / block_tokens))
    block = F.floor(F.col("at").cast("double") * F.lit(float(blocks)) / F.col("quota")).cast("long")
    return _Plan(sized, quotas, placed.withColumn("block", F.when(F.col("at") < F.col("quota"), block)))


def _offsets(copies: DataFrame, at: list[str]) -> DataFrame:
    """The tokens before each bucket. Buckets are summed inside groups of a shorter prefix, and
    these groups once more."""
    held = copies.groupBy(*at, "bucket", "digits").agg(F.sum("n_tokens").alias("held"))
    held = held.withColumn("group", F.substring("bucket", F.lit(1), F.floor(F.col("digits") / 2).cast("int")))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    local = held.withColumn("local", F.coalesce(F.sum("held").over(before([*at, "group"], "bucket")), zero))
    groups = held.groupBy(*at, "group").agg(F.sum("held").alias("sum"))
    groups = groups.withColumn("base", F.coalesce(F.sum("sum").over(before(at, "group")), zero))
    return local.join(groups, [*at, "group"]).select(*at, "bucket", (F.col("local") + F.col("base")).alias("offset"))


def _place(hash_: Column) -> Column:
    return F.md5(F.concat_ws(":", hash_, F.lit("block")))


def mixed(docs: DataFrame, target: Target, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix: one row per document copy, ``doc_id, text_hash, source, n_tokens, epoch, block,
    place``; ``text_hash`` is the md5 of the text.

    ``budget`` is the number of tokens of the mix (default: as many as there are), ``place``
    the order inside a block.
    """
    placed = _planned(docs, target, budget, block_tokens).placed.where("block IS NOT NULL")
    return placed.select("doc_id", "text_hash", "source", "n_tokens", "epoch", "block", _place(F.col("hash")).alias("place"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), Target(max_repeats=MAX_REPEATS)).drop("text_hash")


def mixed_documents(docs: DataFrame, target: Target = Target(max_repeats=MAX_REPEATS), budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents of the mix with all their columns, plus ``mix_epoch, mix_block`` and
    ``mix_place`` (which replace columns of these names)."""
    plan = _planned(docs, target, budget, block_tokens)
    placed = stored(plan.placed.select(*_EQUAL, "number", "stream", "epoch", "bucket", "hash", "block"), "placed")
    added = ["mix_epoch", "mix_block", "mix_place"]
    # Columns of the table stay inside a struct, apart from the names used here.
    rows = docs.drop(*added).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        F.struct("*").alias("row"), "doc_id", _text_hash(F.col("text")).alias("text_hash"), "source"
    )
    several = plan.sized.where("rows > 1").select(*[F.col(c).alias(f"s_{c}") for c in _EQUAL])
    several = narrow(stored(several, "several"))
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in _EQUAL]
    parts = [
        _looked_up(rows.join(several, same, "left_anti"), plan, placed),
        _numbered(rows.join(several, same, "left_semi"), placed),
    ]
    out = parts[0].unionByName(parts[1])
    found = {"mix_epoch": F.col("epoch"), "mix_block": F.col("block"), "mix_place": _place(F.col("hash"))}
    return out.select("row.*", *[c.alias(n) for n, c in found.items()])


def _looked_up(rows: DataFrame, plan: _Plan, placed: DataFrame) -> DataFrame:
    """``row, epoch, block, hash`` of the drawn copies of rows that are there once."""
    at = ["stream", "epoch", "bucket"]
    cuts = placed.groupBy(*at, F.coalesce("block", F.lit(-1)).alias("block")).agg(F.min("hash").alias("first"))
    cuts = cuts.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("first", "block"))).alias("cuts"))
    lookup = narrow(stored(cuts, "cuts"), LOOKUP_BUCKETS)
    copies = rows.withColumn("stream", _stream(F.col("source"))).join(narrow(plan.quotas, LOOKUP_BUCKETS), "stream")
    copies = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("tokens")))))
    copies = copies.withColumn("hash", _draw(F.col("doc_id"), F.col("text_hash"), F.lit(1), F.col("epoch")))
    copies = copies.withColumn("bucket", F.substring("hash", F.lit(1), F.col("digits"))).join(lookup, at)
    # Blocks begin in the order of hashes, and what is behind the quota comes last.
    passed = F.filter("cuts", lambda c: c["first"] <= F.col("hash"))
    return copies.withColumn("block", F.element_at(passed, -1)["block"]).where("block >= 0").select("row", "epoch", "block", "hash")


def _numbered(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """The same for repeated rows: they are written down once, numbered by the task that wrote
    them and then inside of it, and joined to their draws."""
    held = stored(rows.withColumn("task", F.spark_partition_id()), "repeated")
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col("text_hash"), _stream(F.col("source"))]
    held = held.withColumn("key", F.md5(F.concat_ws(":", *[k.cast("string") for k in key])))
    sums = held.groupBy("key", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("key", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "task").orderBy(F.xxhash64("row"))
    numbered = held.join(bases, ["key", "task"]).withColumn("number", F.row_number().over(inside) + F.col("base"))
    draws = placed.where("block IS NOT NULL").withColumn("key", F.md5(F.concat_ws(":", *[k.cast("string") for k in key])))
    return numbered.select("row", "key", "number").join(draws.select("key", "number", "epoch", "block", "hash"), ["key", "number"]).select("row", "epoch", "block", "hash")


SQL = f"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, md5(coalesce(text, '')) AS text_hash, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS number,
        CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
    FROM documents
),
totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sized WHERE n_tokens > 0 GROUP BY source),
total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t FROM totals),
at_zero AS (SELECT max(1.0 / tokens) * any_value(t) / count(*) <= {MAX_REPEATS} AS met FROM totals, total),
halving(step, low, high) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1, CASE WHEN met THEN low ELSE (low + high) / 2 END, CASE WHEN met THEN (low + high) / 2 ELSE high END
    FROM (
        SELECT step, low, high, (
            SELECT max(exp((low + high) / 2 * ln(tokens / t)) / tokens) * any_value(t) / sum(exp((low + high) / 2 * ln(tokens / t))) <= {MAX_REPEATS}
            FROM totals, total
        ) AS met
        FROM halving WHERE step < {HALVINGS}
    )
),
chosen AS (SELECT CASE WHEN (SELECT met FROM at_zero) THEN 0.0 ELSE high END AS x FROM halving WHERE step = {HALVINGS}),
powers AS (SELECT source, tokens, t, exp(x * ln(tokens / t)) AS power FROM totals, total, chosen),
quotas AS (
    SELECT source, tokens, CAST(floor(round(power / (SELECT sum(power) FROM powers), 9) * t) AS BIGINT) AS quota, t FROM powers
),
copies AS (
    SELECT s.*, q.tokens, q.quota, q.t, unnest(range(0, CAST(floor((quota - 1) / tokens) AS BIGINT) + 1)) AS epoch
    FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source WHERE n_tokens > 0 AND quota > 0
),
hashed AS (SELECT *, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), text_hash, number, epoch, {SEED})) AS hash FROM copies),
placed AS (
    SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (
        PARTITION BY source, epoch ORDER BY hash, doc_id, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM hashed
)
SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch,
    CAST(floor(CAST(ahead AS DOUBLE) * greatest(1, ceil(t / {BLOCK_TOKENS})) / quota) AS BIGINT) AS block, md5(concat_ws(':', hash, 'block')) AS place
FROM placed WHERE ahead < quota
"""
