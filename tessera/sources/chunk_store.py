"""A content-addressed chunk store and whole-state snapshots, as Parquet.

A store is a log of batches: each put or delete adds one, numbered in order,
and never changes files that are there, so a job that fails leaves the store as
it was. A chunk is held if its last batch is a put. ``compact`` rewrites the
log to one batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import file_system

SCHEMA = "chunk_id string, data binary, gone boolean"


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> list[int]:
        where, fs = file_system(self.spark, self.path)
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(file_system(self.spark, f"{self.path}/{n}/_SUCCESS")[0]))

    def _add(self, rows: DataFrame) -> None:
        have = self._batches()
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={have[-1] + 1 if have else 0}")

    def _log(self) -> DataFrame:
        have = self._batches()
        if not have:
            return self.spark.createDataFrame([], SCHEMA + ", batch int")
        return self.spark.read.schema(SCHEMA + ", batch int").option("basePath", self.path).parquet(*[f"{self.path}/batch={b}" for b in have])

    def _held(self) -> DataFrame:
        """``chunk_id, batch`` of the batch that holds each chunk's bytes; only
        narrow columns are read."""
        last = self._log().groupBy("chunk_id").agg(F.max_by("gone", "batch").alias("gone"), F.max(F.when(~F.col("gone"), F.col("batch"))).alias("batch"))
        return last.where("NOT gone").select("chunk_id", "batch")

    def put(self, chunks: DataFrame) -> None:
        """Add chunks (``data``) under their SHA-256; those that are held
        already are not written again."""
        named = chunks.select(F.sha2("data", 256).alias("chunk_id"), "data").where("data IS NOT NULL").dropDuplicates(["chunk_id"])
        self._add(named.join(self._held().select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "data", F.lit(False).alias("gone")))

    def delete(self, ids: DataFrame) -> None:
        """Drop chunks; ids that are not held are passed over."""
        known = ids.select("chunk_id").distinct().join(self._held().select("chunk_id"), "chunk_id", "left_semi")
        self._add(known.select("chunk_id", F.lit(None).cast("binary").alias("data"), F.lit(True).alias("gone")))

    def exists(self, ids: DataFrame) -> DataFrame:
        """``chunk_id, held`` of the asked ids."""
        return ids.select("chunk_id").distinct().join(self._held().select("chunk_id", F.lit(True).alias("held")), "chunk_id", "left").na.fill(False, ["held"])

    def chunks(self) -> DataFrame:
        """``chunk_id, data`` of all held chunks."""
        return self._log().where("NOT gone").join(self._held(), ["chunk_id", "batch"], "left_semi").select("chunk_id", "data")

    def get(self, ids: DataFrame) -> DataFrame:
        return self.chunks().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def stats(self) -> DataFrame:
        """One row: number of chunks and their bytes."""
        return self.chunks().agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("bytes"))

    def compact(self) -> ChunkStore:
        """A new store beside this one that holds the same chunks."""
        into = ChunkStore(self.spark, f"{self.path}-{uuid.uuid4().hex}")
        into._add(self.chunks().withColumn("gone", F.lit(False)))
        return into


def export_state(tables: dict[str, DataFrame], path: str) -> None:
    """Write every table of a state under a new version and then point
    ``CURRENT`` to it, by one rename: readers see the old state or the new one."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    fresh, fs = file_system(spark, f"{path}/{version}/CURRENT")
    out = fs.create(fresh, True)
    out.writeUTF(" ".join([version, *tables]))
    out.close()
    pointer, _ = file_system(spark, f"{path}/CURRENT")
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, pointer, how)


def import_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the state that ``CURRENT`` points to."""
    pointer, fs = file_system(spark, f"{path}/CURRENT")
    found = fs.open(pointer)
    version, *names = found.readUTF().split(" ")
    found.close()
    return {n: spark.read.parquet(f"{path}/{version}/{n}") for n in names}


def json_report(rows: DataFrame) -> DataFrame:
    """One JSON document per row, columns in order."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
