"""Near-duplicates by SimHash fingerprints linked through BK-trees.

Fingerprints at ``radius`` 2 or less agree in one of three blocks of bits, and
in what remains of them again in one of three: each fingerprint goes to nine
shards whose members share some 35 of 64 bits. A shard holds distinct
fingerprints only. Its BK-tree (children keyed by Hamming distance to the
parent) is built and asked in one task; edges outside the radius are never
followed. A shard gives a forest of links, not pairs. Components come from
distributed star contraction. Trees are not broadcast: together they hold every
fingerprint, and so have no bound, while a shard's members meet in its task
without them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop, map_texts, materialize, pick

BITS = 64
RADIUS = 2
SHINGLE = 3
#: Larger shards are divided again by further blocks before trees are built.
SPLIT_FROM = 20_000
#: (query, node) pairs asked together, at most.
FRONTIER = 500_000


def fingerprint(words: list[bytes], k: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of the k-word shingles."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    joined = [b" ".join(words)] if len(words) < k else list(map(b" ".join, zip(*(words[i : i + n] for i in range(k)), strict=True)))
    h = np.array([xxh64_intdigest(s, 42) for s in joined], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


class BKTree:
    """Children keyed by integer Hamming distance to the parent. All members
    are asked at once: a frontier of (query, node) pairs goes down the tree by
    the edges within the radius."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint64)
        self.child = np.full((len(values), BITS + 1), -1, dtype=np.int32)
        plain = self.values.tolist()
        child = [{} for _ in plain]
        for i in range(1, len(plain)):
            at = 0
            while True:
                d = (plain[at] ^ plain[i]).bit_count()
                if d not in child[at]:
                    child[at][d] = i
                    break
                at = child[at][d]
        for i, kids in enumerate(child):
            for d, j in kids.items():
                self.child[i, d] = j

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, member) within ``radius``."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        out = []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            out.append((q[hit], node[hit]))
            nexts = []
            for e in range(-radius, radius + 1):
                edge = d + e
                kid = np.where((edge >= 1) & (edge <= BITS), self.child[node, np.clip(edge, 0, BITS)], -1)
                go = kid >= 0
                nexts.append((q[go], kid[go].astype(np.int64)))
            q, node = (np.concatenate(x) for x in zip(*nexts, strict=True))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def link_shard(values: list[int], free: list[int], radius: int) -> list[tuple[int, int]]:
    """Forest of the links within one shard; ``free`` are the bits that its
    members don't share by construction."""
    if len(values) == 2:
        return [(values[0], values[1])] if (values[0] ^ values[1]).bit_count() <= radius else []
    root, out = list(range(len(values))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(a: int, b: int) -> None:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((values[a], values[b]))

    if len(values) > SPLIT_FROM and len(free) > 12:
        index = {v: i for i, v in enumerate(values)}
        for keys, rest in blocks(free, radius):
            mask = sum(1 << b for b in keys)
            groups: dict[int, list[int]] = {}
            for v in values:
                groups.setdefault(v & mask, []).append(v)
            for g in groups.values():
                if len(g) > 1:
                    for a, b in link_shard(g, rest, radius):
                        join(index[a], index[b])
        return out
    members = np.array(values, dtype=np.uint64)
    tree = BKTree(members)
    step = max(1, FRONTIER // len(values))
    for at in range(0, len(values), step):
        q, node = tree.near(members[at : at + step], radius)
        top = np.array([find(i) for i in range(len(values))])
        differ = top[q + at] != top[node]
        q, node = q[differ] + at, node[differ]
        # one pair for each two roots is enough
        _, first = np.unique(top[q] * len(values) + top[node], return_index=True)
        for a, b in zip(q[first].tolist(), node[first].tolist(), strict=True):
            join(a, b)
    return out


def blocks(bits: list[int], radius: int) -> list[tuple[list[int], list[int]]]:
    """``radius + 1`` blocks of ``bits``, each with the bits outside it."""
    edges = [len(bits) * i // (radius + 1) for i in range(radius + 2)]
    return [(bits[a:b], bits[:a] + bits[b:]) for a, b in zip(edges, edges[1:], strict=False)]


def shard_masks(radius: int) -> list[tuple[int, list[int]]]:
    """(mask of the shared bits, free bits) of each shard family."""
    out = []
    for first, rest in blocks(list(range(BITS)), radius):
        for second, free in blocks(rest, radius):
            out.append((sum(1 << b for b in first + second), free))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *longs: str) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) per row, and
    the named columns of longs."""

    def rows(part: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.lower().split()) if t else 0 for t in texts], dtype="<u8").view("<i8")
        return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps), *part.columns[2:]], names=["doc_id", "fp", *longs])

    return map_texts(pick(docs, "doc_id", "text", *longs), rows, ", ".join(f"{c} long" for c in ("doc_id", "fp", *longs)))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that join the same components as all pairs of distinct
    fingerprints (column ``fp``) within ``radius``."""
    families = shard_masks(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("family"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shard")) for i, (m, _) in enumerate(families)])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("k.family", "k.shard", "fp")
    dealt = dealt.repartition("family", "shard").sortWithinPartitions("family", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, members = None, []

        def close() -> list[tuple[int, int]]:
            return link_shard(members, families[open_key[0]][1], radius) if len(members) > 1 else []

        for b in batches:
            family, shard, fp = (b.column(i).to_numpy() for i in range(3))
            if not len(fp):
                continue
            edges = np.flatnonzero((family[1:] != family[:-1]) | (shard[1:] != shard[:-1])) + 1
            out = []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)], strict=True):
                key = (int(family[lo]), int(shard[lo]))
                if key != open_key:
                    out += close()
                    open_key, members = key, []
                if hi - lo > 1 or members or hi == len(fp):
                    members += fp[lo:hi].astype(np.uint64).tolist()
                else:
                    open_key = None
            if out:
                yield _pairs(out)
        if members:
            yield _pairs(close())

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge; ``root`` is the component's
    least node. Alternates large-star and small-star steps (each node's
    neighbours are re-hung to their least one) until nothing changes. Hubs are
    handled by aggregates with map-side parts and joins that can be split."""
    spark = edges.sparkSession
    edges = materialize(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    if not edges.take(1):
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        # large star: every larger neighbour of u hangs on u's least neighbour or u
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # u > v throughout: m <= u < the larger neighbour
        large = materialize(large.distinct(), "large-star")
        # small star: u and its smaller neighbours hang on the least of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        after = materialize(small.distinct(), "small-star")
        drop(edges)
        drop(large)
        # done once the edges are stars: no node is both a leaf and a centre, and no leaf has two
        leaves = after.groupBy("u").agg(F.count("*").alias("n"))
        if not leaves.where("n > 1").take(1) and not after.select(F.col("v").alias("u")).join(after.select("u"), "u", "left_semi").take(1):
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = after


def _roots(rows: DataFrame, radius: int) -> DataFrame:
    """``fp, least, root``: each fingerprint's least id and its component."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return materialize(named, "roots")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``.

    Null and empty texts have fingerprint zero, linked like any other. A null
    ``doc_id`` takes part but names no component unless all of its are null.
    Repeated rows are rows of their own. A shingle hash that sets a bit in just
    half the shingles leaves it unset. A very long text has one fingerprint,
    counted in parts. Extra columns are ignored. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    named = _roots(rows, radius)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def _one_of_each(docs: DataFrame, prints, roots) -> DataFrame:
    """``docs`` with one row of each component: that of the least id (nulls
    last), and of these the first by hash of the whole row. ``prints(hashed,
    h)`` gives ``doc_id, node, h`` per row, ``roots(rows)`` ``node, root``. Only
    rows that are repeated as a whole are gathered to drop all but one."""
    h = "_h"
    while h in {c.lower() for c in docs.columns}:
        h += "_"
    hashed = docs.withColumn(h, F.xxhash64(*docs.columns))
    rows = materialize(prints(hashed, h), "fingerprints")
    # rows that agree in the hash are alike, so they share a component
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("h"))
    counted = rows.groupBy("node", "doc_id", "h").agg(F.count("*").alias("n"))
    best = counted.join(roots(rows), "node").groupBy("root").agg(F.min(F.struct(order.alias("o"), "n")).alias("k"))
    best = materialize(best.select(F.col("k.o.doc_id").alias("_id"), F.col("k.o.h").alias("_key"), F.col("k.n").alias("_times")), "survivors")
    same = lambda b: (hashed[h] == b["_key"]) & hashed["doc_id"].eqNullSafe(b["_id"])
    single, repeated = (best.where(c) for c in ("_times = 1", "_times > 1"))
    found = hashed.join(single, same(single), "left_semi")
    if repeated.take(1):
        found = found.unionByName(hashed.join(repeated, same(repeated), "left_semi").dropDuplicates([h]))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``; all
    columns, whatever their names, unchanged."""
    prints = lambda hashed, h: fingerprints(hashed, h).select("doc_id", F.col("fp").alias("node"), F.col(h).alias("h"))
    return _one_of_each(docs, prints, lambda rows: _roots(rows.select("doc_id", F.col("node").alias("fp")), radius).select(F.col("fp").alias("node"), "root"))


# --- similarity of longer shingles -------------------------------------------
#
# At 64 bits, texts that share four fifths of their five-word shingles differ in
# some ten bits, where no exact search is cheap. With four times the bits a
# distance tells such pairs apart from others, and shards keyed by random bits
# find them.

WIDE = 256
SIMILAR, SIMILAR_SHINGLE = 0.8, 5
#: Share of the pairs at the least similarity whose distance may be too large,
#: in standard deviations, and that may meet in no shard.
DEVIATIONS, MISSED = 1.65, 0.03
#: Shards of up to this many members are compared directly, larger ones by a tree.
DIRECT = 32
TREE_MEMBERS = 50_000


def wide_fingerprint(words: list[bytes], k: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Majority bits, four words of 64, over hashes of the k-word shingles."""
    from xxhash import xxh64_intdigest

    out = np.zeros(WIDE // 64, dtype=np.uint64)
    if not words:
        return out
    n = max(1, len(words) - k + 1)
    joined = [b" ".join(words)] if len(words) < k else map(b" ".join, zip(*(words[i : i + n] for i in range(k)), strict=True))
    h = np.fromiter((xxh64_intdigest(s, 42) for s in joined), dtype=np.uint64, count=n)
    for j in range(len(out)):
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * j)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(29))).astype("<u8")
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 1 << 14):
            ones += np.unpackbits(x[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[j] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def flip_share(similarity: float) -> float:
    """Share of the bits in which texts differ whose shingle sets have this
    Jaccard similarity: their angle by its cosine."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_radius(similarity: float) -> int:
    p = flip_share(similarity)
    return int(np.ceil(WIDE * p + DEVIATIONS * np.sqrt(WIDE * p * (1 - p))))


def shard_bits(members: int, similarity: float) -> list[np.ndarray]:
    """Bit positions that key each family of shards: as many bits that a shard
    holds a few unrelated members, and as many families that all but ``MISSED``
    of the pairs at the least similarity meet, at any number of members."""
    bits = max(8, int(members).bit_length() - 2)
    meet = (1 - flip_share(similarity)) ** bits
    families = int(np.ceil(np.log(MISSED) / np.log1p(-meet)))
    draw, out = np.random.default_rng(17), []
    while len(out) < families:
        order = draw.permutation(WIDE)
        out += [np.sort(order[i : i + bits]) for i in range(0, WIDE - bits + 1, bits)]
    return out[:families]


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class WideTree:
    """BK-tree of wide fingerprints; children keyed by the integer distance."""

    def __init__(self, values: np.ndarray):
        self.values = values
        plain = [int.from_bytes(v.astype("<u8").tobytes(), "little") for v in values]
        child: list[dict[int, int]] = [{} for _ in plain]
        for i in range(1, len(plain)):
            at = 0
            while (d := (plain[at] ^ plain[i]).bit_count()) in child[at]:
                at = child[at][d]
            child[at][d] = i
        # edges by parent, in order of distance
        self.first = np.concatenate([[0], np.cumsum([len(c) for c in child])])
        pairs = [sorted(c.items()) for c in child]
        self.edge = np.array([d for c in pairs for d, _ in c], dtype=np.int64)
        self.kid = np.array([k for c in pairs for _, k in c], dtype=np.int64)

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, member) within ``radius``: from a node at
        distance d only edges from d - radius to d + radius are followed."""
        q, node, out = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64), []
        while len(q):
            d = _far(queries[q], self.values[node])
            hit = d <= radius
            out.append((q[hit], node[hit]))
            n = self.first[node + 1] - self.first[node]
            own = np.repeat(np.arange(len(q)), n)
            edges = np.repeat(self.first[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            go = np.abs(self.edge[edges] - d[own]) <= radius
            q, node = q[own[go]], self.kid[edges[go]]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def link_wide(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that join the same components as all pairs within
    ``radius``. Members near one pivot are joined to it; only what is left asks
    the trees, so that a shard full of near copies costs one pass."""
    centre = 2 * np.unpackbits(values.view(np.uint8).reshape(len(values), -1), axis=1).sum(axis=0, dtype=np.int64) > len(values)
    pivot = int(_far(values, np.packbits(centre).view(values.dtype)).argmin())
    close = _far(values, values[pivot]) <= radius
    out = [(pivot, i) for i in np.flatnonzero(close).tolist() if i != pivot]
    rest = np.flatnonzero(~close)
    for at in range(0, len(values), TREE_MEMBERS):
        if not len(rest):
            break
        tree = WideTree(values[at : at + TREE_MEMBERS])
        step = max(1, FRONTIER // len(tree.values))
        for lo in range(0, len(rest), step):
            q, node = tree.near(values[rest[lo : lo + step]], radius)
            a, b = rest[lo + q], node + at
            # of a query's partners in the pivot's ball one is enough
            ball = np.flatnonzero(close[b])
            one = ball[np.unique(a[ball], return_index=True)[1]]
            keep = np.concatenate([one, np.flatnonzero(~close[b] & (a < b))])
            out += zip(a[keep].tolist(), b[keep].tolist(), strict=True)
    return out


def wide_links(prints: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` between nodes of ``prints`` (``node, f0 .. f3``, distinct)
    whose fingerprints are within the radius of ``similarity`` and meet in a
    shard."""
    radius, words = wide_radius(similarity), [f"f{j}" for j in range(WIDE // 64)]
    families = shard_bits(prints.count(), similarity)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns]
            bits = np.unpackbits(np.stack(cols[1:], axis=1).astype("<i8").view(np.uint8), axis=1, bitorder="little")
            keys = np.concatenate([(np.int64(i) << 40) | (bits[:, at].astype(np.int64) << np.arange(len(at))).sum(axis=1) for i, at in enumerate(families)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.tile(c, len(families))) for c in cols)], names=["shard", "node", *words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            """Link all shards that are whole; the last one may go on."""
            key, node, *f = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            stop = len(key) if last else int(np.searchsorted(key, key[-1]))
            if stop < len(key):
                held.append([key[stop:], node[stop:], *(x[stop:] for x in f)])
            key, node, values = key[:stop], node[:stop], np.stack(f, axis=1)[:stop].view(np.uint64)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if stop else np.zeros(0, dtype=np.int64)
            size = np.diff(np.append(begin, stop))
            of = np.repeat(size, size)
            pairs = []
            for lag in range(1, DIRECT):
                i = np.flatnonzero((key[lag:] == key[:-lag]) & (of[:-lag] <= DIRECT)) if stop > lag else np.zeros(0, dtype=np.int64)
                if not len(i):
                    break
                i = i[_far(values[i], values[i + lag]) <= radius]
                pairs.append((i, i + lag))
            for lo, n in zip(begin[size > DIRECT].tolist(), size[size > DIRECT].tolist(), strict=True):
                found = np.array(link_wide(np.ascontiguousarray(values[lo : lo + n]), radius), dtype=np.int64).reshape(-1, 2) + lo
                pairs.append((found[:, 0], found[:, 1]))
            a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64) for k in (0, 1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy() for c in b.columns])
                # only once more than one shard is there
                if sum(len(x[0]) for x in held) > 20_000 and held[0][0][0] != held[-1][0][-1]:
                    yield from close(False)
        if held:
            yield from close(True)

    shape = ", ".join(f"{w} long" for w in ("node", *words))
    dealt = prints.select("node", *words).mapInArrow(deal, f"shard long, {shape}").repartition("shard").sortWithinPartitions("shard", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def keep_one_similar(docs: DataFrame, similarity: float = SIMILAR, k: int = SIMILAR_SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of texts whose sets of ``k``-word
    shingles are ``similarity`` alike or more, as SimHash estimates it; groups
    are the components of such links.

    The least id of a group stays (nulls last). Null and empty texts form a
    group, texts of fewer than ``k`` words are one shingle. Rows that agree in
    all columns are one. A fingerprint stands for its text, so equal texts cost
    one. Columns of any name pass unchanged. An empty table gives no rows.
    """
    words = [f"f{j}" for j in range(WIDE // 64)]

    def prints(hashed: DataFrame, h: str) -> DataFrame:
        def rows(part: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            fps = np.array([wide_fingerprint(t.lower().split(), k) if t else np.zeros(len(words), np.uint64) for t in texts], dtype=np.uint64).reshape(-1, len(words)).view(np.int64)
            return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), *(pa.array(np.ascontiguousarray(fps[:, j])) for j in range(len(words)))], names=["doc_id", "h", *words])

        wide = map_texts(pick(hashed, "doc_id", "text", h), rows, "doc_id long, h long, " + ", ".join(f"{w} long" for w in words))
        return wide.withColumn("node", F.xxhash64(*words))

    def roots(rows: DataFrame) -> DataFrame:
        distinct = materialize(rows.select("node", *words).dropDuplicates(["node"]), "wide-prints")
        named = components(wide_links(distinct, similarity))
        out = distinct.select("node").join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        return materialize(out, "wide-roots")

    return _one_of_each(docs, prints, roots)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
