"""Sequence packing as a cutting-stock problem solved by column generation.

A document is cut into full sequences and a tail. The tails' length histogram
(at most ``capacity`` numbers, whatever the corpus) is the demand of a linear
program over patterns, a pattern being how many pieces of each length class
share one sequence. A knapsack dynamic program prices new columns. The rounded
patterns are then dealt to the pieces by their rank within their class.

Tails may be cut further, at multiples of a smaller unit, where whole tails
cannot be combined well; the coarsest cut whose plan needs at most
``SLACK`` times the least number of sequences is taken.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, materialize, parts, pick, small_batches
from tessera.llm.tokens import PART_BYTES, default_tokenizer, encoder

CAPACITY = 2048
#: Length classes are multiples of this many tokens.
UNIT = 8
#: Pieces of up to this many tokens are bundled to about 64 tokens.
TINY = 32
BUNDLE = 64
#: Tail cuts tried, coarsest first.
CUTS = (2048, 1024, 512, 256)
SLACK = 1.01
#: Columns are priced until the plan is within this share of the bound.
TOLERANCE = 0.0005
MAX_COLUMNS = 3000


@dataclass
class Plan:
    """Patterns (rows: pieces per unit size) and how many sequences use each."""

    sizes: np.ndarray
    patterns: np.ndarray
    counts: np.ndarray

    @property
    def sequences(self) -> int:
        return int(self.counts.sum())


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(sizes, c, side="right"))
        best[c], choice[c] = best[c - 1], -1
        if k:
            v = best[c - sizes[:k]] + values[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], choice[c] = v[i], i
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), pattern


def fill(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Largest-first patterns for what rounding leaves; each is used as often
    as the remaining demand allows."""
    rest, out = demand.copy(), []
    while rest.any():
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            if rest[i] and sizes[i] <= room:
                pattern[i] = min(rest[i], room // sizes[i])
                room -= int(pattern[i] * sizes[i])
        used = pattern > 0
        times = int((rest[used] // pattern[used]).min())
        rest -= pattern * times
        out.append((pattern, times))
    return out


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, by element-wise steps: the matrix is at
    most 256 wide, and the driver need not start a threaded solver for it."""
    n = len(matrix)
    a = np.concatenate([matrix, np.eye(n)], axis=1)
    for i in range(n):
        p = i + int(np.abs(a[i:, i]).argmax())
        a[[i, p]] = a[[p, i]]
        a[i] /= a[i, i]
        col = a[:, i].copy()
        col[i] = 0
        a -= np.outer(col, a[i])
    return a[:, n:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> Plan:
    """Gilmore-Gomory: revised simplex over generated patterns, floors of the
    optimum, and a largest-first fill of the rest. Exact in demand: every piece
    has one place."""
    keep = demand > 0
    sizes, demand = sizes[keep].astype(np.int64), demand[keep].astype(np.int64)
    n = len(sizes)
    if not n:
        return Plan(sizes, np.zeros((0, 0), dtype=np.int64), np.zeros(0, dtype=np.int64))
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    # a slight, fixed perturbation keeps degenerate steps from cycling
    aim = demand + 0.02 * np.modf(np.arange(1, n + 1) * 0.6180339887)[0]
    x = (inverse * aim).sum(axis=1)
    for step in range(MAX_COLUMNS):
        value, column = knapsack(sizes, inverse.sum(axis=0), capacity)
        # x.sum() / value is a lower bound of the optimum (Farley)
        if x.sum() * (1 - 1 / max(value, 1)) <= max(0.5, TOLERANCE * x.sum()):
            break
        d = (inverse * column).sum(axis=1)
        up = d > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * d
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        basis[:, out] = column
        if step % 200 == 199:  # anew, against rounding errors
            inverse = inverted(basis)
            x = np.maximum((inverse * aim).sum(axis=1), 0)
        else:
            row = inverse[out] / d[out]
            inverse -= np.outer(d, row)
            inverse[out] = row
    whole = np.floor(x + 1e-9).astype(np.int64)
    patterns = basis.T.round().astype(np.int64)
    # what the floors give beyond the demand, and what they lack
    rest = demand - patterns.T @ whole
    while (rest < 0).any():
        i = int(np.flatnonzero(rest < 0)[0])
        p = int(np.flatnonzero((patterns[:, i] > 0) & (whole > 0))[0])
        whole[p] -= 1
        rest += patterns[p]
    more = fill(sizes, rest, capacity)
    used = whole > 0
    rows = [*patterns[used], *(p for p, _ in more)]
    counts = np.array([*whole[used], *(t for _, t in more)], dtype=np.int64)
    return Plan(sizes, np.array(rows, dtype=np.int64).reshape(-1, n), counts)


def cut_tail(tail: int, cut: int) -> list[int]:
    return [cut] * (tail // cut) + ([tail % cut] if tail % cut else [])


def classes(capacity: int) -> list[tuple[int, int, int]]:
    """(largest length, pieces per unit item, size in units) of each class. A
    capacity between two units has a last class that fills a sequence."""
    tiny = [(length, BUNDLE // length, -(-(BUNDLE // length) * length // UNIT)) for length in range(1, TINY + 1)]
    rest = [(top, 1, top // UNIT) for top in range(TINY + UNIT, capacity + 1, UNIT)]
    return tiny + rest + ([(capacity, 1, capacity // UNIT)] if capacity % UNIT else [])


def cuts_of(capacity: int) -> list[int]:
    """Tail cuts of a capacity, coarsest (none) first."""
    return [capacity, *(c for c in CUTS if c < capacity)]


def class_of(length: int) -> int:
    """Index into ``classes`` of a piece."""
    return length - 1 if length <= TINY else TINY + -(-(length - TINY) // UNIT) - 1


def plan_packing(tails: dict[int, int], full: int, capacity: int = CAPACITY) -> tuple[int, list[tuple[int, int, int, int, int, int, int]]]:
    """Choose the cut and place every class.

    Returns the cut and slots ``(cls, lo, hi, per, base, slot, bundle)``: the
    pieces of class ``cls`` ranked ``lo..hi-1`` go, ``per`` to a sequence, to
    the sequences from ``base`` on, in slot order.
    """
    kinds = classes(capacity)
    least = max(1, -(-(sum(n * c for n, c in tails.items()) + full * capacity) // capacity))
    best: tuple[int, int, Plan, np.ndarray] | None = None
    for cut in cuts_of(capacity):
        count = np.zeros(len(kinds), dtype=np.int64)
        count[class_of(capacity)] += full
        for tail, c in tails.items():
            for piece in cut_tail(tail, cut):
                count[class_of(piece)] += c
        demand = np.zeros(capacity // UNIT + 1, dtype=np.int64)
        for (_, bundle, size), c in zip(kinds, count, strict=True):
            demand[size] += -(-int(c) // bundle)
        plan = column_generation(np.arange(len(demand)), demand, capacity // UNIT)
        if best is None or plan.sequences < best[1]:
            best = (cut, plan.sequences, plan, count)
        if plan.sequences <= SLACK * least + 1:
            break
    cut, _, plan, count = best
    queue: dict[int, list[list[int]]] = {}  # by unit size: [class, first rank, items left]
    at = dict.fromkeys(range(len(kinds)), 0)
    for k, c in enumerate(count):
        if c:
            queue.setdefault(kinds[k][2], []).append([k, 0, -(-int(c) // kinds[k][1])])
    slots, base = [], 0
    for pattern, times in zip(plan.patterns, plan.counts, strict=True):
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            size, per = int(plan.sizes[i]), int(pattern[i])
            need, into = per * int(times), 0  # items, dealt to the sequences in order
            for entry in queue[size]:
                take = min(need, entry[2])
                if take:
                    k = entry[0]
                    slots.append((k, at[k], at[k] + take, per, base, slot, into))
                    at[k] += take
                    entry[2] -= take
                    need -= take
                    into += take
                if not need:
                    break
            slot += 1
        base += int(times)
    return cut, slots


def piece_table(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Per document: ``doc_id, doc_tokens``, the crc32 of each full sequence's
    ids, and for each possible cut those of the tail's pieces. Its width
    follows a document's length in sequences, not in ids."""
    cuts = cuts_of(capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, size=PART_BYTES):
            ids, sizes = encoder(tokenizer).encode_column(part.column(1))
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            full, tails, at = [], [[] for _ in cuts], 0
            for n in sizes.tolist():
                edge, end = at + n // capacity * capacity, at + n
                full.append([zlib.crc32(raw[4 * i : 4 * (i + capacity)]) for i in range(at, edge, capacity)])
                for out, cut in zip(tails, cuts, strict=True):
                    out.append([zlib.crc32(raw[4 * i : 4 * min(i + cut, end)]) for i in range(edge, end, cut)])
                at = end
            cols = [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(full, pa.list_(pa.int64())), *(pa.array(t, pa.list_(pa.int64())) for t in tails)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc_tokens", "full", *(f"cut{c}" for c in cuts)])

    small_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, full array<long>, " + ", ".join(f"cut{c} array<long>" for c in cuts))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` of all documents.

    Every id lies in one piece; a sequence holds at most ``capacity`` (64 or
    more). Null and empty texts hold the end id. Repeated rows are packed as
    documents of their own; pieces of one class are ranked by id, start and
    checksum. A very long text fills sequences of its own up to its tail. Extra
    columns are ignored. Empty tables give no rows.
    """
    if capacity < BUNDLE:
        raise ValueError(f"a sequence holds at least {BUNDLE} ids")
    spark = docs.sparkSession
    table = materialize(piece_table(docs, tokenizer, capacity), "pieces")
    # at most `capacity` rows, each a sum
    counts = {r["tail"]: (r["n"], r["full"]) for r in table.groupBy((F.col("doc_tokens") % capacity).alias("tail")).agg(F.count("*").alias("n"), F.sum(F.expr(f"doc_tokens div {capacity}")).alias("full")).collect()}
    cut, slots = plan_packing({t: n for t, (n, _) in counts.items() if t}, sum(f for _, f in counts.values()), capacity)

    edge = F.expr(f"doc_tokens - doc_tokens % {capacity}")
    pieces = table.select("doc_id", "doc_tokens", edge.alias("edge"), F.expr(f"concat(transform(full, (c, i) -> struct(i * {capacity}L AS start, c AS crc)), transform(cut{cut}, (c, i) -> struct(doc_tokens - doc_tokens % {capacity} + i * {cut}L AS start, c AS crc)))").alias("p"))
    pieces = pieces.select("doc_id", "doc_tokens", "edge", F.explode("p").alias("p")).select("doc_id", "doc_tokens", F.col("p.start").alias("start"), F.col("p.crc").alias("ids_crc32"), F.least(F.when(F.col("p.start") < F.col("edge"), F.lit(capacity)).otherwise(F.lit(cut)), F.col("doc_tokens") - F.col("p.start")).alias("length"))
    cls = F.when(F.col("length") <= TINY, F.col("length") - 1).otherwise(TINY + F.ceil((F.col("length") - TINY) / UNIT) - 1).cast("int")
    # a class may hold most pieces: ranks are counted within parts of it
    spread = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces.withColumn("cls", cls).withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(spread)).cast("int"))
    sizes = pieces.groupBy("cls", "part").agg(F.count("*").alias("n"))
    before = sizes.select("cls", "part", (F.sum("n").over(Window.partitionBy("cls").orderBy("part")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("cls", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("local", local).join(before, ["cls", "part"]).withColumn("rank", F.col("before") + F.col("local"))

    # slots: at most a few per class and pattern, whatever the corpus
    kinds = classes(capacity)
    rows = [(k, lo, hi, per, base, slot, into, kinds[k][1]) for k, lo, hi, per, base, slot, into in slots]
    table = F.broadcast(spark.createDataFrame(rows, "cls int, lo long, hi long, per long, base long, slot int, into long, bundle int"))
    item = F.expr("rank div bundle")
    placed = ranked.join(table, (ranked["cls"] == table["cls"]) & (item >= F.col("lo")) & (item < F.col("hi"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot", "rank", (F.col("base") + F.expr("(into + rank div bundle - lo) div per")).alias("sequence_id"), ranked["cls"].alias("cls")
    )
    order = Window.partitionBy("sequence_id").orderBy("slot", "cls", "rank")
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer: str) -> DataFrame:
    """The packed token lists themselves: ``sequence_id, ids``. Pieces are
    joined to their documents' ids and gathered by sequence (at most
    ``capacity`` ids each). ``doc_id`` must be unique here."""

    def run(part: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        ids = [np.frombuffer(p, dtype="<i4") for p in encoder(tokenizer).encode(texts)]
        return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    tokens = map_texts(pick(docs, "doc_id", "text"), run, "doc_id long, ids array<int>")
    cut = pieces.join(tokens, "doc_id").select("sequence_id", "offset", F.expr("slice(ids, cast(start + 1 as int), cast(length as int))").alias("ids"))
    return cut.groupBy("sequence_id").agg(F.expr("flatten(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids))").alias("ids"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed to sequences of at most 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
