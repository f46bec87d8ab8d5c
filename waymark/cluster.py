"""Session set-up and the few helpers that decide how data moves.

Everything that may broadcast, collect or cut lineage goes through this module, so the
size rules are in one place.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Largest lookup table (rows) that is brought to the driver and broadcast. Anything larger
# is joined by shuffle instead.
LOOKUP_ROWS = 20_000
# And its largest size, counted in characters of its printed values.
LOOKUP_CHARS = 8_000_000


def build_session(app: str = "waymark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. ``conf`` overrides any default."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application; they may not have it installed."""
    if spark.sparkContext.applicationId not in _SHIPPED:
        _SHIPPED.add(spark.sparkContext.applicationId)
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="waymark-package-"), "waymark")
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local master may
    fall back to a fresh temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="waymark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path next to the checkpoints, for a table that is written and read back."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize ``df`` once in the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, limit: int = LOOKUP_ROWS) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``limit`` of them, else ``None``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def as_lookup(df: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """``df`` ready to be joined as a lookup.

    A table whose rows and size are proven to be within the limits comes back as a broadcast
    local table; a larger one comes back unchanged, so that Spark joins it by shuffle and
    adaptive execution can split hot keys.
    """
    rows = bounded_rows(df, limit)
    if rows is None or sum(len(str(v)) for row in rows for v in row) > LOOKUP_CHARS:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on shared keys in which a missing key meets a missing key. The keys of the
    left side stay."""
    renamed = right.withColumnsRenamed({k: f"__join_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"__join_{k}")) for k in keys]
    return left.join(renamed, match, how).drop(*[f"__join_{k}" for k in keys])


def seeded_hash(ids: list[str], seed: int) -> Column:
    """Hex text that orders rows at random, from row ids alone.

    It does not depend on partitioning, so a lost task recomputes the same draw.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def seeded_integer(text: Column, modulus: Column | int) -> Column:
    """A non-negative integer below ``modulus`` from the first 15 digits of a hash."""
    modulus = F.lit(modulus) if isinstance(modulus, int) else modulus
    number = F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint")
    return F.pmod(number, modulus.cast("bigint"))


def seeded_uniform(ids: list[str], seed: int) -> Column:
    """A double in [0, 1) from row ids and a seed (the top 53 bits of a 64-bit hash)."""
    return F.shiftrightunsigned(F.xxhash64(*ids, F.lit(seed)), 11).cast("double") / F.lit(float(2**53))
