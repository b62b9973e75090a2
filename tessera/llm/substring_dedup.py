"""Repeated passages removed exactly, behind a count-min prefilter.

Two equal windows of ``WINDOW`` words have the same least hash of their
``GRAM``-word grams. The first pass counts these least hashes, about one for
ten windows, in count-min sketches: each task sends its counts by cell, and
they are merged by ranges of cells. A sketch never counts too little, so a
window whose estimate is one is unique. The second pass groups exactly (by 128
bits over the words in order) the windows estimated repeated: consecutive ones
of equal least hash go together as a run, and one by one only where runs
differ.

The merged sketch is kept as one bit a cell, "counted twice or more". It has
about two cells for each gram that is expected of the texts' bytes, up to
``MAX_WIDTH_LOG2`` (two rows of 2^29 cells: 128 MB), which bounds what is
broadcast. Beyond some 30 GB of text the cells fill up, and more windows go to
the second pass; none is lost at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop, map_texts, materialize, pick, slices, small_batches

WINDOW = 35
GRAM = 18
MIN_WIDTH_LOG2, MAX_WIDTH_LOG2 = 20, 29
#: Bytes of text to a least gram, about.
GRAM_BYTES = 48
DEPTH = 2
#: Cells of a sketch row are merged in this many ranges.
RANGES_LOG2 = 8
MEMO_WORDS = 400_000
PARTIAL_GRAMS = 1_000_000

_M1, _M2, _BASE1, _BASE2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """word -> 64-bit hash, remembered in bounded memory."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= MEMO_WORDS:
            self.clear()
        h = xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        size = 1 << max(12, n.bit_length())
        have = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)]), dtype=np.uint64) for b in (base, inverse))
        if size <= 1 << 18:
            _POWERS[int(base)] = have
    return have[0][:n], have[1][:n]


def rolling(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash modulo 2^64 of each ``k`` consecutive word hashes."""
    up, down = _powers(base, len(h))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    return (total[k:] - total[:-k]) * down[: len(h) - k + 1]


def window_minima(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """``(gram hashes, least gram hash of each window)``."""
    g = mix(rolling(h, gram, _BASE1))
    span, m, width = window - gram + 1, g, 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    return g, m


def cells(v: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cells of gram hashes in one sketch row."""
    return (mix(v * _M1 + np.uint64(row) * _M2) >> np.uint64(64 - width)).astype(np.int64)


def _sketch_parts(window: int, gram: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, found, size = WordHashes(), [], 0
        shift = width - RANGES_LOG2

        def flush() -> pa.RecordBatch:
            rows = []
            v = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.uint64)
            n = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
            for row in range(DEPTH):
                c, where = np.unique(cells(v, row, width), return_inverse=True)
                twice = np.bincount(where, weights=n, minlength=len(c)) > 1
                edges = np.searchsorted(c, np.arange((1 << RANGES_LOG2) + 1) << shift)
                for r in range(1 << RANGES_LOG2):
                    a, b = edges[r], edges[r + 1]
                    if b > a:
                        local = c[a:b] - (r << shift)
                        rows.append((row, r, np.diff(local, prepend=0).astype("<u4").tobytes(), np.packbits(twice[a:b]).tobytes()))
            found.clear()
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["row", "range", "steps", "twice"])

        for _, texts in slices(batches):
            for t in texts:
                words = t.split() if t else []
                if len(words) >= window:
                    g, m = window_minima(memo.of(words), window, gram)
                    v = np.unique(m)
                    g = np.sort(g)
                    found.append((v, np.minimum(2, np.searchsorted(g, v, "right") - np.searchsorted(g, v, "left"))))
                    size += len(v)
            if size > PARTIAL_GRAMS:
                yield flush()
                size = 0
        yield flush()

    return run


def _merge(width: int):
    """Merges parts sorted by (row, range): one range's cells are in memory at a
    time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, np.zeros(0, dtype=np.uint8)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], names=["row", "range", "bits"])

        for b in batches:
            for row, rng, steps, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (row, rng) != key:
                    if key:
                        yield close()
                    key, counts = (row, rng), np.zeros(1 << (width - RANGES_LOG2), dtype=np.uint8)
                at = np.cumsum(np.frombuffer(steps, dtype="<u4").astype(np.int64))
                counts[at] = np.minimum(2, counts[at] + 1 + np.unpackbits(np.frombuffer(twice, dtype=np.uint8), count=len(at)))
        if key:
            yield close()

    return run


class Sketch:
    """Bits "counted twice or more" of the merged rows."""

    def __init__(self, parts: list[tuple[int, int, bytes]], width: int):
        self.width = width
        size = (1 << width) >> 3
        step = size >> RANGES_LOG2
        self.rows = [bytearray(size) for _ in range(DEPTH)]
        for row, rng, bits in parts:
            self.rows[row][rng * step : (rng + 1) * step] = bits

    def repeated(self, v: np.ndarray) -> np.ndarray:
        """Whether each gram hash may have been counted twice."""
        out = np.ones(len(v), dtype=bool)
        for row, data in enumerate(self.rows):
            c = cells(v, row, self.width)
            bits = np.frombuffer(data, dtype=np.uint8)
            out &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return out


def sketch_width(docs: DataFrame) -> int:
    """Log of a sketch row's cells, by the texts' bytes."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MAX_WIDTH_LOG2, max(MIN_WIDTH_LOG2, (2 * size // GRAM_BYTES).bit_length()))


def build_sketch(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int | None = None) -> Sketch:
    """Count-min sketch of all texts. The driver gets ``DEPTH`` bit rows."""
    width = width or sketch_width(docs)
    parts = docs.select("text").mapInArrow(_sketch_parts(window, gram, width), "row int, range int, steps binary, twice binary")
    merged = parts.repartition("row", "range").sortWithinPartitions("row", "range").mapInArrow(_merge(width), "row int, range int, bits binary")
    return Sketch([(r["row"], r["range"], bytes(r["bits"])) for r in merged.collect()], width)


RUN_SCHEMA = "rid long, k0 long, k1 long, start int, n int, v long, a long, b long, self array<int>, again array<long>, hashes array<long>"


def candidate_runs(keyed: DataFrame, sketch, window: int, gram: int) -> DataFrame:
    """Runs of consecutive windows with one least gram hash ``v`` that is
    estimated repeated: first window, number, 128-bit hash (``a, b``) of all
    the run's words, windows that repeat inside the run (``self``) with their
    distinct hashes (``again``), and a hash of each other window, null for the
    former: a run of one word has one hash, however long it is."""
    memo = WordHashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rid = sketch.value, TaskContext.get().partitionId() << 40
        for part, texts in slices(batches):
            rows, cols, inner, twice, hashes, masks, sizes = [], [[] for _ in range(5)], [], [], [], [], []
            for i, t in enumerate(texts):
                words = t.split() if t else []
                if len(words) < window:
                    continue
                h = memo.of(words)
                _, m = window_minima(h, window, gram)
                edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                size = np.diff(np.append(edge, len(m)))
                again = known.repeated(m[edge])
                edge, size = edge[again], size[again]
                if not len(edge):
                    continue
                end = edge + size + window - 1
                whole = []
                for x, base in ((h, _BASE1), (mix(h), _BASE2)):
                    up, down = _powers(base, len(x))
                    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * up, dtype=np.uint64)])
                    whole.append(mix((total[end] - total[edge]) * down[edge]))
                at = np.repeat(edge - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                w = mix(rolling(mix(h), window, _BASE1))[at]
                rows.append(np.full(len(edge), i))
                for out, x in zip(cols, (edge, size, m[edge], *whole), strict=True):
                    out.append(x)
                hashes.append(w)
                sizes.append(size)
                mask = np.zeros(len(w), dtype=bool)
                masks.append(mask)
                found: list = [None] * len(edge)
                more: list = [None] * len(edge)
                if len(np.unique(w)) < len(w):
                    for j, (lo, k) in enumerate(zip((np.cumsum(size) - size).tolist(), size.tolist(), strict=True)):
                        own, where, count = np.unique(w[lo : lo + k], return_inverse=True, return_counts=True)
                        if len(count) < k:
                            mask[lo : lo + k] = count[where] > 1
                            found[j] = (edge[j] + np.flatnonzero(mask[lo : lo + k])).tolist()
                            more[j] = own[count > 1].view(np.int64).tolist()
                inner += found
                twice += more
            if rows:
                take = pa.array(np.concatenate(rows))
                k0, k1 = (part.column(part.schema.get_field_index(k)).take(take) for k in ("k0", "k1"))
                start, n, v, a, b = (np.concatenate(c) for c in cols)
                listed = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32), pa.array(np.concatenate(hashes).view(np.int64), mask=np.concatenate(masks)))
                ids = pa.array(np.arange(rid, rid + len(start)))
                rid += len(start)
                yield pa.RecordBatch.from_arrays([ids, k0, k1, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (v, a, b)), pa.array(inner, pa.list_(pa.int32())), pa.array(twice, pa.list_(pa.int64())), listed], names=["rid", "k0", "k1", "start", "n", "v", "a", "b", "self", "again", "hashes"])

    return keyed.mapInArrow(run, RUN_SCHEMA)


def repeated_windows(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int | None = None) -> DataFrame:
    """``k0, k1, found``: ranges ``(start, n)`` of windows whose words start
    anywhere else too, by document key (rows that repeat a key count each).

    Equal windows lie in runs of equal ``v``. A run that occurs twice as a
    whole is repeated as a whole; single windows, keyed by ``v`` and their own
    hash, are counted only where a ``v`` has different runs, each of them once
    with its number. All counts are aggregates with map-side parts, and the
    joins' large sides can be split.
    """
    spark = keyed.sparkSession
    small_batches(spark)
    sketch = spark.sparkContext.broadcast(build_sketch(keyed, window, gram, width))
    runs = materialize(candidate_runs(keyed, sketch, window, gram), "runs", compression="zstd")
    sketch.unpersist()
    same = ["v", "a", "b", "n"]
    kinds = materialize(runs.groupBy(*same).agg(F.count("*").alias("m"), F.min("rid").alias("rid")), "run-kinds")
    whole = runs.select("k0", "k1", "start", *same).join(kinds.where("m > 1").select(*same), same).select("k0", "k1", "start", "n")
    inside = runs.where("self is not null").select("k0", "k1", F.explode("self").alias("start"), F.lit(1).alias("n"))

    mixed = kinds.groupBy("v").agg(F.count("*").alias("d")).where("d > 1").select("v")
    chosen = kinds.select("rid", "m", "v").join(mixed, "v").select("rid", F.least("m", F.lit(2)).cast("int").alias("m"))
    shown = runs.select("rid", "v", "again", "hashes").join(chosen, "rid")
    each = shown.select("rid", "m", "v", F.posexplode("hashes").alias("i", "h")).where("h IS NOT NULL")
    # windows that repeat inside their run need no place, but count for others
    known = shown.select("rid", F.lit(2).alias("m"), "v", F.lit(-1).alias("i"), F.explode("again").alias("h"))
    single = materialize(each.unionByName(known), "single-windows", compression="zstd")
    twice = single.groupBy("v", "h").agg(F.sum("m").alias("c")).where("c > 1").select("v", "h")
    lone = single.where("m = 1").select("rid", "i", "v", "h").join(twice, ["v", "h"]).groupBy("rid").agg(F.collect_set("i").alias("at"))
    lone = runs.select("rid", "k0", "k1", "start").join(lone, "rid").select("k0", "k1", F.explode(F.expr("transform(at, i -> start + i)")).alias("start"), F.lit(1).alias("n"))
    found = whole.unionByName(inside).unionByName(lone).groupBy("k0", "k1").agg(F.collect_set(F.struct("start", "n")).alias("found"))
    found = materialize(found, "found", compression="zstd")
    for table in (runs, kinds, single):
        drop(table)
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int | None = None) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256, kept``.

    A null text has no words; a text of fewer than ``window`` words keeps all.
    Every copy of a repeated passage goes, repeated rows included; there is no
    first one to stay. A very long text is windowed whole. Extra columns are
    ignored; an empty table gives no rows.
    """
    keyed = pick(docs, "doc_id", "text").withColumns({"k0": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "k1": F.xxhash64("text")})
    found = repeated_windows(keyed, window, gram, width)
    joined = keyed.join(found, ["k0", "k1"], "left").select("doc_id", "text", "found.start", "found.n")

    def rows(part: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        starts, counts = part.column(2), part.column(3)
        out = []
        for i, t in enumerate(texts):
            words = t.split() if t else []
            kept, removed = words, 0
            if starts[i].is_valid:
                change = np.zeros(len(words) + 1, dtype=np.int64)
                at, n = np.array(starts[i].as_py()), np.array(counts[i].as_py())
                np.add.at(change, at, 1)
                np.add.at(change, at + n + window - 1, -1)
                covered = np.cumsum(change)[:-1] > 0
                removed = int(covered.sum())
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            text = b" ".join(kept)
            out.append((len(words), removed, hashlib.sha256(text).hexdigest(), text.decode()))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return map_texts(joined, rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that repeat anywhere."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
