"""Referential sweeps: which chunks are referenced, placed, orphaned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def referenced_chunks(*sources: DataFrame) -> DataFrame:
    """Distinct ``chunk_id`` over all sources that can hold a reference. Each
    source is reduced before the union, so the shuffle carries ids once."""
    return reduce(lambda a, b: a.unionByName(b), [s.select("chunk_id").distinct() for s in sources]).distinct()


def orphans(placed: DataFrame, referenced: DataFrame) -> DataFrame:
    """Placed rows whose chunk nothing references."""
    return placed.join(referenced, "chunk_id", "left_anti")


def reference_counts(volume_chunks: DataFrame) -> DataFrame:
    return volume_chunks.groupBy("chunk_id").agg(F.countDistinct("volume_id").alias("refs"))


def reconcile(desired: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """``key, action``: create, delete or keep, by a full outer join."""
    a, b = desired.select(key).distinct().withColumn("want", F.lit(True)), actual.select(key).distinct().withColumn("have", F.lit(True))
    action = F.when(F.col("have").isNull(), "create").when(F.col("want").isNull(), "delete").otherwise("keep")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def collect_garbage(placed: DataFrame, referenced: DataFrame, nodes: DataFrame) -> DataFrame:
    """One pass over all nodes: ``node_id, deleted, kept`` of each node's local
    chunks against the chunks that anything references. Fenced nodes
    (``fenced``) refuse, and are reported with nothing deleted."""
    marked = placed.select("node_id", "chunk_id").distinct().join(referenced.withColumn("live", F.lit(True)), "chunk_id", "left").join(nodes.select("node_id", "fenced"), "node_id")
    gone = F.col("live").isNull() & ~F.col("fenced")
    return marked.groupBy("node_id").agg(F.count(F.when(gone, 1)).alias("deleted"), F.count(F.when(~gone, 1)).alias("kept"), F.bool_or("fenced").alias("refused"))
