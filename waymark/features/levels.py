"""Level lists, lumping of rare levels, and level codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.cluster import LOOKUP_ROWS, as_lookup, bounded_rows, scratch_path
from waymark.features.base import FittedStep, FixedStep, Step
from waymark.operators.profile import level_counts
from waymark.operators.windows import top_n_ties


def discover_levels(df: DataFrame, columns: Sequence[str], extra: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``(column, level, n)`` of the observed levels plus declared extra ones with n = 0.

    Levels are ordered by falling count, then alphabetically.
    """
    seen = level_counts(df, columns).where(F.col("level").isNotNull())
    rows = [(c, v) for c, values in (extra or {}).items() for v in values]
    if not rows:
        return seen
    declared = df.sparkSession.createDataFrame(rows, "column string, level string").withColumn("n", F.lit(0).cast("bigint"))
    return seen.unionByName(declared).groupBy("column", "level").agg(F.sum("n").alias("n"))


def level_lists(levels: DataFrame) -> dict[str, list[str]]:
    """Level lists per column for coding; they are bounded before they are collected."""
    rows = bounded_rows(levels)
    if rows is None:
        raise ValueError(f"more than {LOOKUP_ROWS} levels")
    out: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["column"], -r["n"], r["level"])):
        out.setdefault(row["column"], []).append(row["level"])
    return out


def ordered_by(df: DataFrame, category: str, value: str, out: str = "position") -> DataFrame:
    """Distinct categories with their one-based position by falling mean value."""
    from waymark.operators.windows import running_totals

    means = df.groupBy(category).agg(F.avg(value).alias(value))
    ranked = running_totals(means, [], [-F.col(value), F.col(category)], {out: F.lit(1).cast("bigint")})
    return ranked


def kept_top(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The n most frequent levels of each column, ties kept; missing counts as a level."""
    return top_n_ties(level_counts(df, columns), ["column"], "n", n)


def kept_by_share(df: DataFrame, columns: Sequence[str], share: float, strict: bool, min_lumped: int) -> DataFrame:
    """Levels whose share of the non-missing rows is above (or at) a limit.

    A column keeps all its levels unless at least ``min_lumped`` of them would go.
    """
    seen = level_counts(df, columns).where(F.col("level").isNotNull())
    part = F.col("n") / F.col("__total")
    stays = part > share if strict else part >= share
    totals = seen.groupBy("column").agg(F.sum("n").alias("__total"))
    marked = seen.join(F.broadcast(totals), "column").withColumn("__stays", stays)  # one row per listed column
    lost = marked.groupBy("column").agg(F.count_if(~F.col("__stays")).alias("__lost"))
    return (
        marked.join(F.broadcast(lost), "column")
        .where(F.col("__stays") | (F.col("__lost") < min_lumped))
        .select("column", "level", "n")
    )


def lump(df: DataFrame, columns: Sequence[str], kept: DataFrame, other: str, null_is_level: bool) -> DataFrame:
    """Replace every level that is not kept by ``other``.

    Kept levels within the lookup bound become literal lists in one projection; larger
    sets are joined by column.
    """
    rows = bounded_rows(kept.select("column", "level"))
    if rows is not None:
        lists = {c: [r["level"] for r in rows if r["column"] == c] for c in columns}
        return df.withColumns({c: lumped(F.col(c), lists[c], other, null_is_level) for c in columns})
    for c in columns:
        levels = kept.where(F.col("column") == c).select(F.col("level").alias("__level"), F.lit(True).alias("__kept"))
        joined = df.join(as_lookup(levels), F.col(c).eqNullSafe(F.col("__level")), "left")
        stays = F.col("__kept") if null_is_level else F.col("__kept") | F.col(c).isNull()
        df = joined.withColumn(c, F.when(stays, F.col(c)).otherwise(other)).drop("__level", "__kept")
    return df


def lumped(column: Column, levels: Sequence[str | None], other: str, null_is_level: bool) -> Column:
    named = [v for v in levels if v is not None]
    stays = column.isin(*named) if named else F.lit(False)
    if not null_is_level or None in levels:
        stays = stays | column.isNull()
    return F.when(stays, column).otherwise(F.lit(other))


class _Lumper(Step):
    null_is_level = False

    def _kept(self, df: DataFrame, columns: list[str]) -> DataFrame:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> FittedLumper:
        columns = self.nominal(df)
        state = {"other": self.values["other"], "null_is_level": self.null_is_level}
        levels = self._kept(df, columns).select("column", "level") if columns else None
        rows = bounded_rows(levels) if columns else []
        if rows is None:  # very many levels stay a table in the shared folder
            path = scratch_path(df.sparkSession, "kept-levels")
            levels.write.parquet(path)
            return FittedLumper(columns=columns, table=path, **state)
        kept = {c: [r["level"] for r in rows if r["column"] == c] for c in columns}
        return FittedLumper(kept=kept, **state)


class FittedLumper(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values
        if "table" in v:
            return lump(df, v["columns"], df.sparkSession.read.parquet(v["table"]), v["other"], v["null_is_level"])
        return df.withColumns({c: lumped(F.col(c), levels, v["other"], v["null_is_level"]) for c, levels in v["kept"].items()})


class TopLevels(_Lumper):
    """Keep the n most frequent levels (ties kept), others become ``other``."""

    null_is_level = True

    def __init__(self, columns=None, n=5, other="other", **roles):
        super().__init__(columns, n=n, other=other, **roles)

    def _kept(self, df, columns):
        return kept_top(df, columns, self.values["n"])


class ShareLevels(_Lumper):
    """Keep levels above a share, if at least two levels would be lumped."""

    def __init__(self, columns=None, share=0.05, other="Other", **roles):
        super().__init__(columns, share=share, other=other, **roles)

    def _kept(self, df, columns):
        return kept_by_share(df, columns, self.values["share"], strict=True, min_lumped=2)


class CommonLevels(_Lumper):
    """Keep levels at or above a share of the training rows; unseen values are lumped too."""

    def __init__(self, columns=None, share=0.05, other="Others", **roles):
        super().__init__(columns, share=share, other=other, **roles)

    def _kept(self, df, columns):
        return kept_by_share(df, columns, self.values["share"], strict=False, min_lumped=1)


class Unknown(Step):
    """Missing category becomes ``unknown``; the columns are fixed at fit time."""

    def __init__(self, columns=None, label_text="unknown", **roles):
        super().__init__(columns, label_text=label_text, **roles)

    def _fit(self, df):
        return FittedUnknown(columns=self.nominal(df), label_text=self.values["label_text"])


class FittedUnknown(FittedStep):
    def _transform(self, df):
        v = self.values
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v["label_text"])) for c in v["columns"]})


class DropColumns(FixedStep):
    def __init__(self, *columns, **state):
        super().__init__(columns=list(columns) or state.get("columns", []))

    def _transform(self, df):
        return df.drop(*self.values["columns"])
