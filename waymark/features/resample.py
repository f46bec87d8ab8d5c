"""Splits, folds, bootstrap and class balancing.

Random order comes from a hash of the row id and a seed, so the same rows are drawn under
any partitioning and after a lost task. Exact sizes per stratum come from a distributed
selection: rows are counted by hash prefix, the prefix that holds the wanted rank is
looked up, and only the rows of that prefix are ranked. No stratum is ever sorted in one
task, and the full rows are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.cluster import as_lookup, checkpointed, seeded_hash, seeded_integer

# Hash digits that form a bucket; 16**4 buckets per stratum.
PREFIX_DIGITS = 4
_S, _H, _B = "__stratum", "__hash", "__bucket"


def _stratum(strata: Sequence[str]) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in strata]
    return F.concat_ws("\u0001", *parts) if parts else F.lit("")


def _keyed(df: DataFrame, strata: Sequence[str], ids: Sequence[str], seed: int, digits: int) -> DataFrame:
    keyed = df.withColumns({_S: _stratum(strata), _H: seeded_hash(list(ids), seed)})
    return keyed.withColumn(_B, F.substring(_H, 1, digits))


def _bucket_sizes(narrow: DataFrame) -> DataFrame:
    """Rows per stratum and bucket with the running and total row count of the stratum.

    The window covers at most 16**digits rows of a stratum, whatever its size.
    """
    sizes = narrow.groupBy(_S, _B).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(_S).orderBy(_B).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.withColumns({"upto": F.sum("n").over(upto), "size": F.sum("n").over(Window.partitionBy(_S))})


def rank_cutoffs(
    df: DataFrame,
    strata: Sequence[str],
    ids: Sequence[str],
    seed: int,
    ranks: Callable[[Column], Sequence[Column]],
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """``(stratum, cuts)``: the hash at each wanted one-based rank of every stratum.

    A wanted rank of zero gives an empty text, below every hash.
    """
    narrow = _keyed(df, strata, ids, seed, digits).select(_S, _H, _B)
    sizes = checkpointed(_bucket_sizes(narrow))
    wanted = F.posexplode(F.array(*[r.cast("bigint") for r in ranks(F.col("size"))])).alias("which", "rank")
    targets = sizes.select(_S, _B, "n", "upto", wanted).where((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto")))
    places = targets.select(_S, _B, "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("place"))
    lookup = as_lookup(places)
    inside = Window.partitionBy(_S, _B).orderBy(_H)
    candidates = narrow.join(lookup.select(_S, _B).distinct(), [_S, _B], "left_semi")
    placed = candidates.withColumn("place", F.row_number().over(inside))
    found = placed.join(lookup, [_S, _B, "place"]).select(_S, "which", F.col(_H).alias("cut"))
    strata_seen = sizes.select(_S).distinct()
    n_cuts = len(ranks(F.lit(1)))
    cells = [F.coalesce(F.max(F.when(F.col("which") == i, F.col("cut"))), F.lit("")) for i in range(n_cuts)]
    return strata_seen.join(found, _S, "left").groupBy(_S).agg(F.array(*cells).alias("cuts"))


def _with_cuts(df: DataFrame, strata, ids, seed, ranks, digits) -> DataFrame:
    keyed = df.withColumns({_S: _stratum(strata), _H: seeded_hash(list(ids), seed)})
    return keyed.join(as_lookup(rank_cutoffs(df, strata, ids, seed, ranks, digits)), _S, "left")


def stratified_flag(
    df: DataFrame, strata: Sequence[str], ids: Sequence[str], p: float, seed: int, out: str = "in_train", digits: int = PREFIX_DIGITS
) -> DataFrame:
    """Mark exactly ceil(p n) rows of every stratum."""
    marked = _with_cuts(df, strata, ids, seed, lambda n: [F.ceil(n * F.lit(p))], digits)
    return marked.withColumn(out, F.col(_H) <= F.col("cuts")[0]).drop(_S, _H, "cuts")


def stratified_split(df: DataFrame, strata: Sequence[str], ids: Sequence[str], p: float, seed: int, **limits) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with the class proportions of the whole."""
    marked = stratified_flag(df, strata, ids, p, seed, "__in", **limits)
    return marked.where("__in").drop("__in"), marked.where("NOT __in").drop("__in")


def stratified_sample(df: DataFrame, strata: Sequence[str], ids: Sequence[str], p: float, seed: int, **limits) -> DataFrame:
    """Exactly ceil(p n) rows of every stratum."""
    return stratified_split(df, strata, ids, p, seed, **limits)[0]


def stratified_folds(
    df: DataFrame, strata: Sequence[str], ids: Sequence[str], folds: int, seed: int, out: str = "fold", digits: int = PREFIX_DIGITS
) -> DataFrame:
    """Assign every row to one of ``folds`` equal slices of its stratum."""

    def edges(n: Column) -> list[Column]:
        small, extra = F.floor(n / folds), F.pmod(n, F.lit(folds))
        return [small * j + F.least(F.lit(j), extra) for j in range(1, folds)]

    marked = _with_cuts(df, strata, ids, seed, edges, digits)
    passed = F.size(F.filter("cuts", lambda cut: cut < F.col(_H)))
    return marked.withColumn(out, passed).drop(_S, _H, "cuts")


def down_sample(df: DataFrame, label: str, ids: Sequence[str], seed: int, digits: int = PREFIX_DIGITS) -> DataFrame:
    """Cut every class to the size of the smallest one."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min("n")).first()[0] or 0
    marked = _with_cuts(df, [label], ids, seed, lambda n: [F.lit(smallest)], digits)
    return marked.where(F.col(_H) <= F.col("cuts")[0]).drop(_S, _H, "cuts")


def numbered(df: DataFrame, strata: Sequence[str], ids: Sequence[str], seed: int, out: str = "ordinal", digits: int = PREFIX_DIGITS) -> DataFrame:
    """One-based place of every row in the random order of its stratum.

    Rows meet the offset of their hash bucket; the window and the join share one
    partitioning by stratum and bucket.
    """
    keyed = _keyed(df, strata, ids, seed, digits)
    offsets = _bucket_sizes(keyed.select(_S, _B)).select(_S, _B, (F.col("upto") - F.col("n")).alias("__before"))
    inside = Window.partitionBy(_S, _B).orderBy(_H)
    placed = keyed.withColumn("__place", F.row_number().over(inside))
    return placed.join(offsets, [_S, _B]).withColumn(out, F.col("__place") + F.col("__before")).drop(_S, _H, _B, "__place", "__before")


def draws_with_replacement(totals: Mapping[str, tuple[int, int]], spark, seed: int) -> DataFrame:
    """``(stratum, ordinal, copies)``: how often each row number is drawn.

    ``totals`` maps a stratum to (rows, draws). Draws are generated in parallel and
    counted before they are shuffled.
    """
    ends, start = [], 0
    for stratum, (rows, draws) in sorted(totals.items()):
        if draws > 0 and rows > 0:
            ends.append((stratum, rows, start, start + draws))
            start += draws
    line = spark.range(start)
    passed = F.filter(F.lit([e[3] for e in ends]).cast("array<bigint>"), lambda end: end <= F.col("id"))
    line = line.withColumn("i", F.size(passed))
    pick = lambda k, kind: F.element_at(F.lit([e[k] for e in ends]).cast(f"array<{kind}>"), F.col("i") + 1)
    if not ends:
        return spark.createDataFrame([], "stratum string, ordinal bigint, copies bigint")
    number = F.col("id") - pick(2, "bigint")
    text = F.md5(F.concat_ws(":", pick(0, "string"), number.cast("string"), F.lit(str(seed))))
    drawn = line.select(pick(0, "string").alias("stratum"), (seeded_integer(text, pick(1, "bigint")) + 1).alias("ordinal"))
    return drawn.groupBy("stratum", "ordinal").agg(F.count(F.lit(1)).alias("copies"))


_CHUNK = 10_000


def repeated(df: DataFrame, copies: str, out: str = "copy", chunk: int = _CHUNK) -> DataFrame:
    """Repeat rows ``copies`` times, numbered from 1.

    A row with very many copies is cut into chunks that are moved to different tasks before
    they are repeated.
    """
    pieces = df.withColumn("__from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies).cast("bigint"), F.lit(chunk).cast("bigint"))))
    pieces = pieces.repartition(F.col("__from"), *[F.col(c) for c in df.columns])
    last = F.least(F.col("__from") + chunk - 1, F.col(copies))
    return pieces.withColumn(out, F.explode(F.sequence(F.col("__from"), last))).drop("__from")


def class_sizes(df: DataFrame, label: str) -> dict[str, int]:
    """Rows per class. Classes are few by definition; the bound is checked."""
    from waymark.cluster import LOOKUP_ROWS, bounded_rows

    rows = bounded_rows(df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")))
    if rows is None:
        raise ValueError(f"{label} has more than {LOOKUP_ROWS} classes")
    return {r["c"]: r["n"] for r in rows}


def up_sample(df: DataFrame, label: str, ids: Sequence[str], seed: int, out: str = "copy") -> DataFrame:
    """Add rows drawn with replacement until every class is as large as the largest.

    Original rows have ``copy`` 0, added ones are numbered from 1.
    """
    sizes = class_sizes(df, label)
    largest = max(sizes.values(), default=0)
    draws = draws_with_replacement({c: (n, largest - n) for c, n in sizes.items()}, df.sparkSession, seed)
    small = [c for c, n in sizes.items() if n < largest]
    minority = numbered(df.where(F.col(label).cast("string").isin(*small)), [label], ids, seed)
    hit = (minority[label].cast("string") == draws["stratum"]) & (minority["ordinal"] == draws["ordinal"])
    chosen = minority.join(draws, hit).drop(draws["ordinal"]).drop("stratum", "ordinal")
    added = repeated(chosen, "copies", out).drop("copies")
    return df.withColumn(out, F.lit(0).cast("bigint")).unionByName(added)


def bootstrap(df: DataFrame, ids: Sequence[str], times: int = 25, seed: int = 1, replicate: str = "replicate", weight: str = "weight") -> DataFrame:
    """Poisson bootstrap: every row once per replicate with its number of draws.

    Weight 0 marks the out-of-bag rows of a replicate.
    """
    each = df.withColumn(replicate, F.explode(F.sequence(F.lit(1), F.lit(times))))
    return each.withColumn(weight, bootstrap_draws(ids, F.col(replicate), seed))


def bootstrap_draws(ids: Sequence[str], replicate: Column, seed: int) -> Column:
    """How often a row is drawn in a replicate: a Poisson(1) number from the row's id."""
    # The top 60 bits of a text hash, so that other engines draw the same numbers.
    parts = [*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids], replicate.cast("string"), F.lit(str(seed))]
    u = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("double") / F.lit(float(2**60))
    # Cumulative Poisson(1) probabilities e^-1 (1 + 1 + 1/2 + 1/6 + ...).
    edges, term, total = [], 0.36787944117144233, 0.0
    for k in range(16):
        term = term if k == 0 else term / k
        total += term
        edges.append(total)
    return F.transform(F.array(u), lambda x: sum((F.when(x >= edge, 1).otherwise(0) for edge in edges), F.lit(0)))[0]


def rose(df: DataFrame, label: str, ids: Sequence[str], numeric: Sequence[str], seed: int, shrink: float = 1.0) -> DataFrame:
    """Smoothed bootstrap for two classes: as many rows as before, half of each class,
    drawn with replacement, with Gaussian noise added to the numeric columns.

    The noise of a column is its class standard deviation times (4 / ((d + 2) n))^(1/(d + 4)).
    """
    sizes = class_sizes(df, label)
    if len(sizes) != 2:
        raise ValueError("only for labels with two classes")
    total, d = sum(sizes.values()), len(numeric)
    first, second = sorted(sizes)
    quota = {first: total // 2, second: total - total // 2}
    stats = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"), *[F.stddev_samp(c).alias(f"__sd_{c}") for c in numeric])
    draws = draws_with_replacement({c: (sizes[c], quota[c]) for c in sizes}, df.sparkSession, seed)
    known = numbered(df.where(F.col(label).isNotNull()), [label], ids, seed)
    hit = (known[label].cast("string") == draws["stratum"]) & (known["ordinal"] == draws["ordinal"])
    chosen = repeated(known.join(draws, hit).drop(draws["ordinal"]).drop("stratum", "ordinal"), "copies").drop("copies")
    joined = chosen.join(F.broadcast(stats), label)  # two rows
    width = F.pow(F.lit(4.0 / (d + 2)) / F.col("__n"), F.lit(1.0 / (d + 4))) * shrink
    noisy = {
        c: F.col(c) + _gauss([*ids, "copy"], seed + 1 + i) * width * F.coalesce(F.col(f"__sd_{c}"), F.lit(0.0)) for i, c in enumerate(numeric)
    }
    return joined.withColumns(noisy).drop("__n", *[f"__sd_{c}" for c in numeric])


def _hash_share(ids: Sequence[str], seed: int) -> Column:
    """A double in [0, 1) from the top 60 bits of a text hash of ids, which other engines have too."""
    return F.conv(F.substring(seeded_hash(list(ids), seed), 1, 15), 16, 10).cast("double") / F.lit(float(2**60))


def _gauss(ids: Sequence[str], seed: int) -> Column:
    """Standard normal draw from the row id (Box-Muller on two seeded uniforms)."""
    u = F.greatest(_hash_share(ids, seed), F.lit(1e-12))
    v = _hash_share(ids, seed + 104729)
    return F.sqrt(-2 * F.ln(u)) * F.cos(v * 6.283185307179586)
