"""Connected components of an undirected graph, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.tables import stored


def _mapped(ids: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``ids`` with ``column`` replaced by its parent, if it has one."""
    lookup = parents.select(F.col("id").alias("__id"), F.col("parent").alias("__parent"))
    joined = ids.join(lookup, F.col(column) == F.col("__id"), "left")
    return joined.withColumn(column, F.coalesce("__parent", column)).drop("__id", "__parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every vertex of ``edges (a, b)``; the component is the smallest id.

    Each round every vertex hooks to its smallest neighbour, chains are shortened, and the
    graph is contracted; at least half of the vertices that still have edges go away. Rounds
    are written to the shared folder. Loops and repeated or missing ends do no harm.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = stored(edges.where(F.col("a") != F.col("b")).select(*ends).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("parent"))
        hooks = stored(hooks.withColumn("parent", F.least("id", "parent")), "hooks")
        hooks = stored(_mapped(_mapped(hooks, "parent", hooks), "parent", hooks), "hooks")
        labels = hooks if labels is None else stored(_mapped(labels, "parent", hooks), "labels")
        rest = _mapped(_mapped(edges, "a", hooks), "b", hooks).where(F.col("a") != F.col("b"))
        edges = stored(rest.select(*ends).distinct(), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("id"), F.col("b").alias("parent"))
    return labels.withColumnRenamed("parent", "component")
