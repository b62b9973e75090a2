"""Ranks over a whole table without one task that sorts all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, block: Sequence[Column], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """``rows`` with their number, from 1, in the order of ``block`` and then
    ``order``. Blocks are counted, their counts summed in order, and rows
    numbered within their block: a window over all sees one row per block.
    Values of ``block`` are not null, and must be fine enough that a block fits
    a task."""
    keys = [f"_b{i}" for i in range(len(block))]
    marked = rows.withColumns(dict(zip(keys, block, strict=True)))
    sizes = marked.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = sizes.select(*keys, (F.sum("_n").over(Window.orderBy(*keys)) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return marked.withColumn("_local", local).join(before, keys).withColumn(name, F.col("_before") + F.col("_local")).drop(*keys, "_local", "_before")


def drain_overflow(entries: DataFrame, capacity: int, high_water: float = 0.75, block: int = 4096) -> DataFrame:
    """Oldest entries (``created``) of a cache to be drained, so that no more
    than the high-water share of its capacity is left."""
    counted = ranked(entries, [F.expr(f"created div {block}")], ["created"], "_age")
    spare = F.broadcast(entries.agg((F.count("*") - int(capacity * high_water)).alias("_over")))
    # one row: the number of entries to go
    return counted.join(spare, F.col("_age") <= F.col("_over")).drop("_age", "_over")
