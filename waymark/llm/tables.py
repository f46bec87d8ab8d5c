"""Access to the corpus tables and the few column rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.cluster import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a missing id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def share_hash(columns: list[Column], seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the row's values and a seed only."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double") / F.lit(float(2**53))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    return scratch_path(spark, f"llm-{name}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts the lineage and outlives
    lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Ids (one or two longs a row) that a join may broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def narrow(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few longs per row, marked for broadcast if its row count is proven
    to be within ``limit``. A larger one is left to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
