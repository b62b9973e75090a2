"""Helpers shared by the training-data operators: shared scratch tables, Arrow
row access and the word splitting that several contracts prescribe."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import shared_dir

#: Rows handled together inside a Python worker; bounds the worker's memory
#: whatever size of Arrow batch the JVM sends.
SLICE_ROWS = 256
#: A slice is also closed once its texts reach this many bytes.
SLICE_BYTES = 4 << 20

_SCRATCH: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_drop_scratch)
    _SCRATCH[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_scratch() -> None:
    for path, spark in _SCRATCH.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: its folder goes with the job
            return


def drop(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read again."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if any(path.endswith(p.rpartition("/")[2]) for p in _SCRATCH):
            _delete(table.sparkSession, path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back. This
    cuts the lineage, survives lost executors, and keeps a costly Python pass
    from running once for each consumer."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that go to a Python worker at once; several copies of a
    batch exist on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(8 * SLICE_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(batches: Iterable[pa.RecordBatch], text: str = "text", rows: int = 8192, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches into parts of bounded rows and text bytes (a longer
    text stands alone)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Small parts, each with its texts as UTF-8 bytes."""
    for part in parts(batches, text, SLICE_ROWS, SLICE_BYTES):
        texts = part.column(part.schema.get_field_index(text))
        yield part, texts.cast(pa.large_binary() if texts.type == pa.large_string() else pa.binary()).to_pylist()


def map_texts(df: DataFrame, rows: Callable[[pa.RecordBatch, list[bytes | None]], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose function gets bounded slices and returns a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield rows(part, texts)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns only: extra columns never reach an operator's own."""
    return docs.select(*[docs[n] for n in names])


def crc_mod(column: str, mod: int) -> F.Column:
    """``crc32`` of the id written as text, modulo ``mod`` (fold assignment)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))
