"""Scalar expressions over chunks, offsets, bitmaps, placement and policy.

All are built-in column functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
SUB_BLOCK_BYTES = 64 << 10
SHARD_MARK = ":shard:"


def content_id(data: Column) -> Column:
    """SHA-256 id of a chunk's bytes."""
    return F.sha2(data, 256)


def etag(data: Column) -> Column:
    return F.md5(data)


def shard_id(parent: Column, index: Column) -> Column:
    """``parent:shard:index``; an id that holds the mark already is an error."""
    return F.when(F.contains(parent, F.lit(SHARD_MARK)), F.raise_error(F.lit("id holds the shard mark"))).otherwise(F.concat(parent, F.lit(SHARD_MARK), index.cast("string")))


def shard_parent(shard: Column) -> Column:
    """Parent of a shard id by its last mark; null for other ids."""
    return F.nullif(F.regexp_extract(shard, r"^(.+):shard:([0-9]+)$", 1), F.lit(""))


def shard_index(shard: Column) -> Column:
    return F.nullif(F.regexp_extract(shard, r"^(.+):shard:([0-9]+)$", 2), F.lit("")).cast("int")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def chunk_index(offset: Column) -> Column:
    return F.shiftright(offset, 22)


def sub_block_index(offset: Column) -> Column:
    return F.shiftright(offset % CHUNK_BYTES, 16)


def offset_in_sub_block(offset: Column) -> Column:
    return offset % SUB_BLOCK_BYTES


def backend_offset(base: Column, sub_block: Column) -> Column:
    """Byte of a sub-block on its backend, whose chunk begins at ``base``."""
    return base + sub_block.cast("long") * SUB_BLOCK_BYTES


def _bit(index: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), index.cast("int"))


def bitmap_set(bits: Column, index: Column) -> Column:
    return bits.bitwiseOR(_bit(index))


def bitmap_unset(bits: Column, index: Column) -> Column:
    return bits.bitwiseAND(F.bitwise_not(_bit(index)))


def bitmap_test(bits: Column, index: Column) -> Column:
    return F.bit_get(bits, index.cast("int")) == 1


def bitmap_full(bits: Column) -> Column:
    return bits == F.lit(-1).cast("long")


def array_add(values: Column, value: Column) -> Column:
    """``values`` with ``value`` at the end, unless it is there."""
    return F.when(F.array_contains(values, value), values).otherwise(F.array_append(values, value))


def array_drop(values: Column, value: Column) -> Column:
    """``values`` without ``value``, whether or not it was there."""
    return F.array_remove(values, value)


def bitmap_clear(bits: Column, kept: Column) -> Column:
    """``bits`` without those of ``kept``: what was set since a snapshot."""
    return bits.bitwiseAND(F.bitwise_not(kept))


def bitmap_count(bits: Column) -> Column:
    return F.bit_count(bits)


def bitmap_indices(bits: Column) -> Column:
    """Indices of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.bit_get(bits, i) == 1)


def placement_hash(*parts: Column) -> Column:
    """First four bytes of SHA-256 over the parts joined by colons."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def straw_draw(hashed: Column, weight: Column) -> Column:
    """``ln((h + 0.5) / 2^32) / weight``; the largest draw wins."""
    return F.log((hashed + F.lit(0.5)) / F.lit(4294967296.0)) / weight


def human_bytes(n: Column) -> Column:
    """``512 B``, ``1.5 KiB``, up to TiB. Tenths are rounded as ``printf`` does:
    a value halfway between two goes to the even one."""
    n = n.cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), start=1):
        bits = 10 * power
        part = n.bitwiseAND(F.lit((1 << bits) - 1)) * 10
        tenth, rest, half = F.shiftright(part, bits), part.bitwiseAND(F.lit((1 << bits) - 1)), F.lit(1 << (bits - 1))
        up = (rest > half) | ((rest == half) & (tenth % 2 == 1))
        tenths = F.shiftright(n, bits) * 10 + tenth + up.cast("long")
        shown = F.concat(F.shiftright(n, bits) + F.when(tenth + up.cast("long") == 10, 1).otherwise(0), F.lit("."), tenths % 10, F.lit(f" {unit}"))
        out = F.when(n >= F.lit(1 << bits), shown).otherwise(out)
    return out


def required_replicas(mode: Column, factor: Column, quorum: Column, data_shards: Column) -> Column:
    """Writes that must succeed: the quorum, or else a majority; for erasure
    coding the data shards."""
    return F.when(mode == "erasure_coding", data_shards).otherwise(F.coalesce(F.nullif(quorum, F.lit(0)), F.expr("1") + F.floor(factor / 2))).cast("int")


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open ranges meet; an end of -1 reaches to the end of the file."""
    top = F.lit((1 << 63) - 1)
    a, b = (F.when(e == -1, top).otherwise(e) for e in (e1, e2))
    return (s1 < b) & (s2 < a)


def backoff_seconds(retries: Column, base: int = 10) -> Column:
    return (F.lit(base) * F.pow(F.lit(2), retries)).cast("long")


#: Fixed values of the chunk frame: magic, version, header bytes.
FRAME_MAGIC, FRAME_VERSION, FRAME_BYTES = b"NVAC", 1, 16


def target_replicas(mode: Column, factor: Column, data_shards: Column, parity: Column) -> Column:
    """Replicas, or all shards, of full protection; one without a profile."""
    return F.when(mode == "erasure_coding", F.coalesce(data_shards + parity, F.lit(1))).when(mode == "replication", F.coalesce(factor, F.lit(1))).otherwise(F.lit(1)).cast("int")


def compliance_state(available: Column, required: Column, target: Column) -> Column:
    return F.when(available >= target, "compliant").when(available >= required, "degraded").otherwise("non_compliant")


def compliance_reason(available: Column, required: Column, target: Column) -> Column:
    n, r, t = (c.cast("string") for c in (available, required, target))
    short = F.concat(n, F.lit(" of "), t, F.lit(" replicas available (degraded)"))
    return F.when(available >= target, F.concat(F.lit("All "), t, F.lit(" replicas available"))).when(available >= required, short).otherwise(F.concat(F.lit("Only "), n, F.lit(" of "), r, F.lit(" required replicas available")))


def profile_error(mode: Column, factor: Column, quorum: Column, data_shards: Column, parity: Column) -> Column:
    """What is wrong with a protection profile; null for a valid one."""
    replication = (
        F.when(factor.isNull(), "replication profile missing").when(~factor.between(1, 5), F.concat(F.lit("replication factor must be between 1 and 5, got "), factor.cast("string")))
        .when(quorum < 0, F.concat(F.lit("write quorum cannot be negative, got "), quorum.cast("string"))).when(quorum > factor, "write quorum cannot exceed replication factor")
    )
    erasure = (
        F.when(data_shards.isNull() | parity.isNull(), "erasure coding profile missing").when(data_shards < 2, F.concat(F.lit("data shards must be at least 2, got "), data_shards.cast("string")))
        .when(parity < 1, F.concat(F.lit("parity shards must be at least 1, got "), parity.cast("string")))
    )
    unknown = F.concat(F.lit("unknown protection mode: "), F.coalesce(mode, F.lit("")))
    return F.when(mode == "replication", replication).when(mode == "erasure_coding", erasure).otherwise(unknown)


def profile_mode(replicas: Column, data_shards: Column, parity: Column) -> Column:
    """Mode that storage-class parameters ask for; null for a single copy."""
    return F.when((data_shards > 0) & (parity > 0), "erasure_coding").when(replicas > 1, "replication")


def required_nodes(replicas: Column, data_shards: Column, parity: Column) -> Column:
    return F.when((data_shards > 0) & (parity > 0), data_shards + parity).when(replicas > 0, replicas).otherwise(1).cast("int")


def capacity_text(n: Column) -> Column:
    """``3Gi``: whole units, truncated; plain bytes below 1 Ki."""
    out = n.cast("string")
    for power, unit in enumerate(("Ki", "Mi", "Gi", "Ti"), start=1):
        out = F.when(n >= F.lit(1 << (10 * power)), F.concat(F.shiftright(n, 10 * power).cast("string"), F.lit(unit))).otherwise(out)
    return out


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def health_class(elapsed: Column, suspect: int = 30, down: int = 60) -> Column:
    return F.when(elapsed > down, "down").when(elapsed > suspect, "suspect").otherwise("healthy")


def metadata_shard(volume: Column) -> Column:
    """Shard 0..255 of a volume id by its first two hex digits; else null."""
    return F.when(F.regexp_like(volume, F.lit("^[0-9A-Fa-f]{2}")), F.conv(F.substring(volume, 1, 2), 16, 10).cast("int"))


def _little_endian(n: Column) -> Column:
    big = F.lpad(F.hex(n), 8, "0")
    return F.concat(*[F.substring(big, at, 2) for at in (7, 5, 3, 1)])


def _from_little_endian(hexed: Column, start: int) -> Column:
    """Number of the four bytes from byte ``start`` of a hex text."""
    return F.conv(F.concat(*[F.substring(hexed, 2 * (start + i) + 1, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long")


def frame_header(checksum: Column, length: Column) -> Column:
    """Sixteen bytes: magic, version, flags, checksum and length in
    little-endian order, two spare bytes."""
    return F.unhex(F.concat(F.lit(FRAME_MAGIC.hex() + f"{FRAME_VERSION:02x}00"), _little_endian(checksum), _little_endian(length), F.lit("0000")))


def frame_fields(framed: Column) -> Column:
    """``magic_ok, version, checksum, length`` of a frame's header; null when
    it is shorter than a header."""
    hexed = F.hex(F.substring(framed, 1, FRAME_BYTES))
    fields = F.struct(
        (F.substring(hexed, 1, 8) == FRAME_MAGIC.hex().upper()).alias("magic_ok"), F.conv(F.substring(hexed, 9, 2), 16, 10).cast("int").alias("version"),
        _from_little_endian(hexed, 6).alias("checksum"), _from_little_endian(hexed, 10).alias("length"),
    )
    return F.when(F.octet_length(framed) >= FRAME_BYTES, fields)
