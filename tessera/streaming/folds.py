"""Stateful operators on streams, equal to their batch forms.

Every micro-batch is reduced to one change per key before it meets the state,
so that a hot key sends one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranges import fold_log, highest_generation
from tessera.sources.scratch import file_system


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A change log that arrives as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Micro-batches whose changes are kept apart before they are merged.
COMPACT = 16


def _last(changes: DataFrame) -> DataFrame:
    """The last change of each key."""
    return changes.groupBy("key").agg(F.max_by(F.struct("op", "value"), "idx").alias("v"), F.max("idx").alias("idx")).select("key", "idx", "v.*")


def _versions(spark: SparkSession, state_path: str) -> dict[str, list[int]]:
    """Numbers of the finished bases and deltas of a state."""
    where, fs = file_system(spark, state_path)
    out: dict[str, list[int]] = {"base": [], "delta": []}
    for s in fs.listStatus(where) if fs.exists(where) else []:
        kind, _, n = s.getPath().getName().partition("-")
        if kind in out and fs.exists(file_system(spark, f"{state_path}/{kind}-{n}/_SUCCESS")[0]):
            out[kind].append(int(n))
    return out


def _parts(spark: SparkSession, state_path: str, upto: int) -> list[str]:
    """The latest base up to a micro-batch, and the deltas after it."""
    found = _versions(spark, state_path)
    base = max((n for n in found["base"] if n <= upto), default=-1)
    return [f"{state_path}/base-{base}"] * (base >= 0) + [f"{state_path}/delta-{n}" for n in sorted(found["delta"]) if base < n <= upto]


def upsert_fold(log: DataFrame, state_path: str, checkpoint: str, compact: int = COMPACT):
    """Last change per key, kept as Parquet: a micro-batch writes one row for
    each key it holds, under its own number, so that its cost follows the batch
    and a repeated one is harmless. Every ``compact`` batches a base merges what
    came since the last."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        _last(batch).write.mode("overwrite").parquet(f"{state_path}/delta-{epoch}")
        if epoch % compact == compact - 1:
            _last(spark.read.parquet(*_parts(spark, state_path, epoch))).write.mode("overwrite").parquet(f"{state_path}/base-{epoch}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, state_path: str, epoch: int = (1 << 62)) -> DataFrame:
    """Live keys after micro-batch ``epoch``, or after the last one."""
    return _last(spark.read.parquet(*_parts(spark, state_path, epoch))).where("op = 'put'").select("key", "value", "idx")


def generation_watch(log: DataFrame) -> DataFrame:
    """Stream of accepted changes: those whose generation is above all that the
    key has shown before."""

    def accept(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else -1
        out = []
        for pdf in batches:
            for row in pdf.sort_values("idx").itertuples():
                if row.generation > top:
                    top = row.generation
                    out.append((key[0], row.idx, row.generation))
        state.update((int(top),))
        yield pd.DataFrame(out, columns=["key", "idx", "generation"])

    return log.groupBy("key").applyInPandasWithState(accept, "key string, idx long, generation long", "top long", "append", "NoTimeout")


__all__ = ["current", "fold_log", "generation_watch", "highest_generation", "read_log", "upsert_fold"]
