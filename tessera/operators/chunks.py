"""Content-addressed chunking: split, identify, deduplicate, reassemble,
erasure code."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import FRAME_BYTES, frame_fields, frame_header
from tessera.functions.udfs import PaddedReedSolomon, ReedSolomon, crc32c


def split_chunks(files: DataFrame, size: int, emit_empty: bool = False) -> DataFrame:
    """``file_id, position, data, chunk_id`` of binary ``data``; an empty file
    has no chunk, or one empty chunk."""
    n = F.ceil(F.octet_length("data") / F.lit(size)).cast("int")
    n = F.greatest(n, F.lit(1)) if emit_empty else n
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = files.select("file_id", "data", F.explode(at).alias("position")).select("file_id", "position", F.expr(f"substring(data, position * {size} + 1, {size})").alias("data"))
    return cut.withColumn("chunk_id", F.sha2("data", 256))


def deduplicate(chunks: DataFrame) -> DataFrame:
    """One row per content; the ratio of what is saved follows from counts."""
    return chunks.groupBy("chunk_id").agg(F.count("*").alias("refs"), F.max(F.octet_length("data")).alias("bytes"))


def reassemble(chunks: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("position", "data")))
    return chunks.groupBy("file_id").agg(F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"])).alias("data"))


def read_range(chunks: DataFrame, size: int, offset: int, length: int) -> DataFrame:
    """Bytes ``offset..offset+length`` of each file; only the chunks that the
    range touches are read."""
    first, last = offset // size, (offset + length - 1) // size
    part = reassemble(chunks.where(F.col("position").between(first, last)))
    return part.select("file_id", F.substring("data", offset - first * size + 1, length).alias("data"))


def corrupted(chunks: DataFrame, stored: str = "crc") -> DataFrame:
    """The chunks whose bytes do not have their stored CRC-32C."""
    return chunks.where(~crc32c("data").eqNullSafe(F.col(stored)))


def scrub(chunks: DataFrame, stored: str = "crc") -> DataFrame:
    """Chunks checked against their stored CRC-32C, and errors; ``corrupted``
    lists them."""
    return chunks.withColumn("now", crc32c("data")).agg(F.count("*").alias("checked"), F.count(F.when(~F.col("now").eqNullSafe(F.col(stored)), 1)).alias("errors"))


def erasure_encode(chunks: DataFrame, data: int, parity: int) -> DataFrame:
    """``chunk_id, shard_index, shard``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = ReedSolomon(data, parity)
        for pdf in batches:
            rows = [(c, i, s) for c, d in zip(pdf["chunk_id"], pdf["data"], strict=True) for i, s in enumerate(code.encode(bytes(d)))]
            yield pd.DataFrame(rows, columns=["chunk_id", "shard_index", "shard"])

    return chunks.select("chunk_id", "data").mapInPandas(run, "chunk_id string, shard_index int, shard binary")


def erasure_decode(shards: DataFrame, data: int, parity: int) -> DataFrame:
    """``chunk_id, data`` of chunks with enough shards; others are left out."""
    held = shards.groupBy("chunk_id").agg(F.collect_list(F.struct("shard_index", "shard")).alias("held")).where(F.size("held") >= data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = ReedSolomon(data, parity)
        for pdf in batches:
            out = []
            for c, held in zip(pdf["chunk_id"], pdf["held"], strict=True):
                have: list[bytes | None] = [None] * (data + parity)
                for x in held:
                    have[x["shard_index"]] = bytes(x["shard"])
                out.append((c, code.decode(have)))
            yield pd.DataFrame(out, columns=["chunk_id", "data"])

    return held.mapInPandas(run, "chunk_id string, data binary")


def frame_chunks(chunks: DataFrame) -> DataFrame:
    """``framed``: each chunk behind its header, which holds its CRC-32C."""
    return chunks.withColumn("framed", F.concat(frame_header(crc32c("data"), F.octet_length("data")), "data"))


def verify_frames(frames: DataFrame) -> DataFrame:
    """``verdict`` of each frame: ok, short, bad_magic, truncated or
    bad_checksum."""
    rows = frames.withColumn("_h", frame_fields(F.col("framed")))
    body = F.expr(f"substring(framed, {FRAME_BYTES + 1}, cast(_h.length AS int))")
    checked = rows.withColumn("_crc", crc32c(body))
    verdict = (
        F.when(F.col("_h").isNull(), "short").when(~F.col("_h.magic_ok"), "bad_magic").when(F.octet_length("framed") < FRAME_BYTES + F.col("_h.length"), "truncated")
        .when(F.col("_crc") != F.col("_h.checksum"), "bad_checksum").otherwise("ok")
    )
    return checked.withColumn("verdict", verdict).drop("_h", "_crc")


def write_at(chunks: DataFrame, writes: DataFrame, size: int) -> DataFrame:
    """Read, modify, write: ``writes`` (``file_id, offset, patch``, one for each
    file) replace bytes of the chunks they touch. Untouched chunks keep their
    rows. A write beyond the end of a file needs ``fill_sparse`` up to its
    offset first."""
    first, last = F.expr(f"cast(offset div {size} AS int)"), F.expr(f"cast((offset + octet_length(patch) - 1) div {size} AS int)")
    touched = writes.where(F.octet_length("patch") > 0).select("file_id", "offset", "patch", F.explode(F.sequence(first, last)).alias("position"))
    begin = F.col("offset") - F.col("position") * size  # of the patch, in the chunk
    piece = F.substring("patch", F.greatest(1 - begin, F.lit(1)).cast("int"), (F.lit(size) - F.greatest(begin, F.lit(0))).cast("int"))
    cut = touched.select("file_id", "position", F.greatest(begin, F.lit(0)).cast("int").alias("at"), piece.alias("piece"))
    joined = chunks.select("file_id", "position", "data").join(cut, ["file_id", "position"], "full_outer")
    old = F.coalesce("data", F.lit(b"").cast("binary"))
    head = F.rpad(F.substring(old, F.lit(1), F.col("at")), F.col("at"), F.lit(b"\0").cast("binary"))
    tail = F.substring(old, F.col("at") + F.octet_length("piece") + 1, F.lit(size))
    data = F.when(F.col("piece").isNull(), old).otherwise(F.concat(head, F.col("piece"), tail))
    out = joined.select("file_id", "position", data.alias("data"))
    return out.withColumn("chunk_id", F.sha2("data", 256))


def truncate(files: DataFrame, size: int) -> DataFrame:
    """``data`` cut, or extended with zeros, to ``size`` bytes."""
    return files.withColumn("data", F.rpad("data", size, F.lit(b"\0").cast("binary")))


def fill_sparse(chunks: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """All chunks of files of the given ``length``: those without a row are
    zeros, the last one is cut to the file's end."""
    n = F.ceil(F.col("length") / size).cast("int")
    every = lengths.where("length > 0").select("file_id", "length", F.explode(F.sequence(F.lit(0), n - 1)).alias("position"))
    want = F.least(F.lit(size), F.col("length") - F.col("position") * size).cast("int")
    held = every.join(chunks.select("file_id", "position", "data"), ["file_id", "position"], "left")
    return held.select("file_id", "position", F.rpad(F.coalesce("data", F.lit(b"").cast("binary")), want, F.lit(b"\0").cast("binary")).alias("data"))


def padded_encode(chunks: DataFrame, data: int, parity: int) -> DataFrame:
    """``chunk_id, length, shard_index, shard`` by the code without a length
    prefix; the length travels as a column, so that a short tail is not padded
    when read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = PaddedReedSolomon(data, parity)
        for pdf in batches:
            rows = [(c, len(d), i, s) for c, d in zip(pdf["chunk_id"], pdf["data"], strict=True) for i, s in enumerate(code.encode(bytes(d)))]
            yield pd.DataFrame(rows, columns=["chunk_id", "length", "shard_index", "shard"])

    return chunks.select("chunk_id", "data").where("data IS NOT NULL").mapInPandas(run, "chunk_id string, length long, shard_index int, shard binary")


def padded_decode(shards: DataFrame, data: int, parity: int) -> DataFrame:
    """``chunk_id, data`` of chunks with enough shards, at their true length."""
    held = shards.groupBy("chunk_id").agg(F.max("length").alias("length"), F.collect_list(F.struct("shard_index", "shard")).alias("held")).where(F.size(F.array_distinct(F.transform("held", lambda x: x["shard_index"]))) >= data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = PaddedReedSolomon(data, parity)
        for pdf in batches:
            out = []
            for c, n, held in zip(pdf["chunk_id"], pdf["length"], pdf["held"], strict=True):
                have: list[bytes | None] = [None] * (data + parity)
                for x in held:
                    have[x["shard_index"]] = bytes(x["shard"])
                out.append((c, code.decode(have, int(n))))
            yield pd.DataFrame(out, columns=["chunk_id", "data"])

    return held.mapInPandas(run, "chunk_id string, data binary")


def distribute_shards(shards: DataFrame, placed: DataFrame) -> DataFrame:
    """``chunk_id, shard_index, node_id``: shard ``i`` goes to the placement's
    slot ``i``; a cluster with fewer nodes than shards wraps around."""
    slots = placed.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("replica", "node_id"))), lambda x: x["node_id"]).alias("slots"))
    return shards.join(slots, shards["chunk_id"] == slots["key"]).select("chunk_id", "shard_index", F.get("slots", F.col("shard_index") % F.size("slots")).alias("node_id"))


def repair_shards(shards: DataFrame, data: int, parity: int) -> DataFrame:
    """``chunk_id, shard_index, shard`` of the shards that are gone, computed
    from any ``data`` of those left; chunks with fewer are left out."""
    lengths = shards.groupBy("chunk_id").agg(F.collect_set("shard_index").alias("have"))
    whole = padded_encode(padded_decode(shards, data, parity), data, parity).select("chunk_id", "shard_index", "shard")
    return whole.join(lengths, "chunk_id").where(~F.array_contains("have", F.col("shard_index"))).drop("have")
