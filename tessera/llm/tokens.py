"""Token ids of whole texts by a public tokenizer file, and their Parquet form.

The tokenizer drops white space and never joins text across it, so a text's ids
are the joined ids of its blank-separated chunks. Each worker keeps a bounded
memo of chunk -> packed ids; all unknown chunks of a slice are encoded by one
call of the library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import parts, pick, scratch_path, small_batches

#: Id appended to every document.
END_ID = 1
#: Words of one generation of a worker's memo.
MEMO_WORDS = 330_000
STOPS = (b".", b",")
#: Words encoded in one string.
JOINED = 30
MEMO_WORD_BYTES = 64
#: Bytes of text encoded together: more repeats are found in larger parts, at
#: the cost of a worker's memory.
PART_BYTES = 3 << 20


#: Texts that show whether a tokenizer keeps to white space, ignores case, and
#: takes zeros and stops as tokens of their own.
PROBES = ("", " ", "One two,  THREE four.\tfive\nsix", "a0b 10 0 007 0.5 x0,y0.", "Été ÉTÉ straße ñandú 日本語 тест", "it's don't x,y. ... ,, end.", "ABCdef GHI.jkl Mixed-Case_word #tag @you 50% $9 a.b.c, A.")


class ChunkEncoder:
    """Encodes bytes of UTF-8 text to packed little-endian uint32 ids."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        self.mark, self.mark_text = min((i, t.content) for i, t in added.items())
        #: what every special token's text begins with
        self.sign = os.path.commonprefix([t.content for t in added.values()]).encode()
        self.zero = int(self._ids("0")[-1])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.stops = [self._ids(x.decode()).tobytes() for x in STOPS]
        # what this class takes for granted of the tokenizer; else whole texts are encoded
        self.whole = False
        self.whole = any(self.encode([t.encode()])[0] != np.append(self._ids(t), np.uint32(END_ID)).astype("<u4").tobytes() for t in PROBES)
        self.young, self.old = {}, {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _apart(self, words: list[bytes], mark: int, between: str) -> list[bytes]:
        """Ids of words, ``JOINED`` to a string, each ended by the id ``mark``
        that ``between`` stands for and no word holds."""
        if not words:
            return []
        texts = b"\n".join(words).decode().split("\n")
        joined = [between.join([*texts[at : at + JOINED], ""]) for at in range(0, len(texts), JOINED)]
        ids = np.concatenate([np.array(enc.ids, dtype="<u4") for enc in self.tok.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(ids == mark)
        raw, stops = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *(4 * ends[:-1] + 4).tolist()], stops, strict=True)]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """A zero is a token of its own, and so parts words without zeros; a
        special token parts others."""
        sign = self.sign
        signed = [w for w in words if sign in w] if sign in b"\n".join(words) else []
        if signed:
            words = [w for w in words if sign not in w]
        zeros = [w for w in words if b"0" in w]
        plain = [w for w in words if b"0" not in w] if zeros else words
        got = dict(zip(plain, self._apart(plain, self.zero, " 0 "), strict=True))
        got.update(zip(zeros, self._apart(zeros, self.mark, self.mark_text), strict=True))
        got.update((w, self._ids(w.decode()).tobytes()) for w in signed)
        return got

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words in lower case. The memo has two generations:
        what has not been used since the last change is dropped."""
        out = list(map(self.young.get, words))
        new = [i for i, v in enumerate(out) if v is None]
        if new:
            missing = [words[i] for i in new]
            fresh = dict(zip(missing, map(self.old.get, missing), strict=True))
            fresh |= self._learn([w for w, v in fresh.items() if v is None])
            for i, v in zip(new, fresh.values(), strict=True):
                out[i] = v
            if len(self.young) + len(fresh) > MEMO_WORDS:
                self.old, self.young = self.young, {}
            self.young.update(fresh)
            if max(map(len, missing)) > MEMO_WORD_BYTES:
                for w in [w for w in missing if len(w) > MEMO_WORD_BYTES]:
                    del self.young[w]
        return out

    def _without_stops(self, words: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct words as they are looked up, the place of each of ``words``
        among them, and the stop cut from it (an index into ``STOPS``, or -1).
        The tokenizer splits a full stop or comma from the letter before it."""
        _, offsets, data = words.buffers()
        edges = np.frombuffer(offsets, dtype="<i4")[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
        begin, end = edges[:-1], edges[1:]
        stop = np.full(len(words), -1, dtype=np.int8)
        two = np.flatnonzero(end - begin > 1)
        before, last = data[end[two] - 2] | 32, data[end[two] - 1]
        letter = (before >= 97) & (before <= 122)
        for k, s in enumerate(STOPS):
            stop[two[letter & (last == s[0])]] = k
        cut = stop >= 0
        size = end - begin - cut
        keep = np.ones(len(data), dtype=bool)
        keep[end[cut] - 1] = False
        kept = data[edges[0] : edges[-1]][keep[edges[0] : edges[-1]]] if len(words) else data
        cores = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype("<i4")), pa.py_buffer(kept)]).dictionary_encode()
        return cores.dictionary.to_pylist(), cores.indices.to_numpy(zero_copy_only=False), stop

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts, ids per text)``, the end id of each included;
        null is empty."""
        if self.whole:
            found = [np.append(self._ids(t or ""), np.uint32(END_ID)) for t in texts.to_pylist()]
            return (np.concatenate(found) if found else np.zeros(0)).astype("<u4"), np.array([len(f) for f in found], dtype=np.int64)
        texts = pc.fill_null(texts, "")
        lowered, sign = pc.ascii_lower(texts), self.sign
        signed = pc.match_substring(texts, sign.decode()) if sign else pa.array([False] * len(texts))
        some = bool(pc.any(signed).as_py())
        # the tokenizer lower-cases too, but knows a special token by its case
        lists = pc.ascii_split_whitespace(pc.if_else(signed, texts, lowered) if some else lowered)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary())
        if some:
            distinct = pa.array([w if sign in w else w.lower() for w in distinct.to_pylist()], pa.binary())
        cores, place, stop = self._without_stops(distinct)
        known = self._look_up(cores)
        vals = [known[i] for i in place.tolist()]
        for i in np.flatnonzero(stop >= 0).tolist():
            vals[i] += self.stops[stop[i]]
        vals.append(np.array([END_ID], dtype="<u4").tobytes())
        flat, sizes = np.frombuffer(b"".join(vals), dtype="<u4"), np.fromiter(map(len, vals), dtype=np.int64, count=len(vals)) // 4
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # parts are bounded, so that 32 bits are enough but for one very long text
        kind = np.int32 if len(flat) + texts.nbytes < 1 << 30 else np.int64
        sizes = sizes.astype(kind)
        index = np.insert(words.indices.to_numpy(zero_copy_only=False), np.cumsum(counts), len(vals) - 1)
        lens = sizes[index]
        shift = (np.cumsum(sizes, dtype=kind) - sizes)[index] - (np.cumsum(lens, dtype=kind) - lens)
        take = np.repeat(shift, lens)
        take += np.arange(len(take), dtype=kind)
        ids = flat[take]
        first = np.cumsum(counts + 1) - counts - 1
        return ids, np.add.reduceat(lens.astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids of each text."""
        ids, sizes = self.encode_column(pa.array([None if t is None else t.decode() for t in texts], pa.string()))
        raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, delta: bool = True) -> None:
    """Encode whole texts and write them as Parquet in ascending ``doc_id``
    order (rows of one id by text hash). A very long text is one row.

    Columns: ``part`` (number of the file's range), ``local_start`` (ids before
    the row within its range), ``doc_id``, ``n_tokens``, ``ids`` (list of int).
    Ranges ascend with ``part``. Ids are delta (``delta=True``) or dictionary
    encoded; row-group and page sizes are set, and the page index is written,
    so that metadata or single documents can be read without the rest.
    """
    rows = pick(docs, "doc_id", "text").withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("_h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in parts(batches, size=PART_BYTES):
            flat, sizes = enc.encode_column(batch.column(1))
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat.view("<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(starts), batch.column(0).cast(pa.int64()), pa.array(sizes), ids], names=["part", "local_start", "doc_id", "n_tokens", "ids"])

    small_batches(docs.sparkSession)
    out = rows.mapInArrow(encode, "part int, local_start long, doc_id long, n_tokens long, ids array<int>")
    out.write.mode("overwrite").options(**{
        "compression": "zstd", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes),
        "parquet.enable.dictionary": str(not delta).lower(), "parquet.writer.version": "v2" if delta else "v1",
    }).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of ``write_token_files`` with their global ``start``. The sums
    of the ranges come from two narrow columns; ids are read once."""
    files = spark.read.schema("part int, local_start long, doc_id long, n_tokens long, ids array<int>").parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per written range, that is per task of the writing job
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def read_token_meta(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Only ids and lengths of documents ``first..last``; row groups and pages
    outside the range are skipped by their statistics."""
    return spark.read.parquet(path).where(F.col("doc_id").between(first, last)).select("doc_id", "n_tokens")


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows with an ``ids`` list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            ends = np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)).tolist()
            crcs = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the ids in Parquet, read the files back.

    Null and empty texts give the end id alone. Repeated rows are separate
    documents, ordered by text hash within an id; a null ``doc_id`` comes first.
    Empty tables give no rows. Extra columns are ignored.
    """
    path = scratch_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_tokenizer())
    return token_digests(read_token_files(spark, path))
