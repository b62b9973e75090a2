"""Literal cases and properties of the core operators."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs, straw
from tessera.functions.udfs import ReedSolomon, crc32c, crc32c_bytes, fnv1a, node_hashes
from tessera.operators import chunks, compliance, listing, namespace, placement, policy, ranges, refs
from tessera.plans import registry
from tessera.sources.fixtures import table
from tessera.streaming import folds


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_crc32c_and_fnv_known_values(spark):
    assert crc32c_bytes(b"123456789") == 0xE3069283
    assert fnv1a(b"") == 0xCBF29CE484222325 and fnv1a(b"a") == 0xAF63DC4C8601EC8C
    df = spark.createDataFrame([(bytearray(b"123456789"),), (None,)], "d binary")
    assert [r[0] for r in df.select(crc32c("d")).collect()] == [0xE3069283, None]


def test_erasure_code_recovers_and_fails():
    code, r = ReedSolomon(4, 2), random.Random(1)
    for size in (0, 1, 7, 1000):
        data = r.randbytes(size)
        shards = code.encode(data)
        assert len({len(s) for s in shards}) == 1
        for lost in ((0, 3), (4, 5), (1, 4), ()):
            assert code.decode([None if i in lost else s for i, s in enumerate(shards)]) == data
        with pytest.raises(ValueError):
            code.decode([None, None, None, *shards[3:]])


def test_offsets_and_bitmaps(spark):
    df = spark.createDataFrame([(4 * 1048576 + 100 * 1024, 0b10100001)], "o long, b long")
    got = df.select(exprs.chunk_index(F.col("o")), exprs.sub_block_index(F.col("o")), exprs.offset_in_sub_block(F.col("o")), exprs.bitmap_indices(F.col("b"))).first()
    assert tuple(got) == (1, 1, 36864, [0, 5, 7])


def test_shard_ids(spark):
    df = spark.createDataFrame([("a:b", 3)], "id string, i int").select(exprs.shard_id(F.col("id"), F.col("i")).alias("s"))
    assert tuple(df.select("s", exprs.shard_parent(F.col("s")), exprs.shard_index(F.col("s"))).first()) == ("a:b:shard:3", "a:b", 3)


def test_orphan_sweep(spark):
    vols = spark.createDataFrame([("vol-1", "chunk-1"), ("vol-1", "chunk-2"), ("vol-2", "chunk-3")], "volume_id string, chunk_id string")
    snaps = vols.where("volume_id = 'vol-1'")
    placed = spark.createDataFrame([(c, n) for c in ("chunk-1", "chunk-2", "chunk-3", "chunk-orphan") for n in "abc"], "chunk_id string, node_id string")
    assert {r[0] for r in refs.orphans(placed, refs.referenced_chunks(vols, snaps)).select("chunk_id").collect()} == {"chunk-orphan"}


def test_delimiter_listing(spark):
    keys = ["photos/2024/jan.jpg", "photos/2024/feb.jpg", "photos/2025/mar.jpg", "photos/top.jpg", "other"]
    df = spark.createDataFrame([("b", k) for k in keys], "bucket string, key string")
    assert rows(listing.list_objects(df, "b", "photos/", "/")) == [("photos/2024/", True), ("photos/2025/", True), ("photos/top.jpg", False)]
    first = [r[0] for r in listing.list_objects(df, "b", limit=2).collect()]
    rest = [r[0] for r in listing.list_objects(df, "b", after=first[-1]).collect()]
    assert first + rest == sorted(keys)


def test_recovery_and_actions(spark):
    p = spark.createDataFrame([("many", n, i) for i, n in enumerate("xabc")] + [("few", n, i) for i, n in enumerate("xa")], "chunk_id string, node_id string, slot int")
    assert rows(compliance.recovery_plan(p, "x")) == [("few", 1), ("many", 3)]
    assert rows(compliance.action_states(p, 3)) == [("few", "under", 1, ""), ("many", "over", 0, "c")]


def test_half_open_locks(spark):
    lock = lambda i, s, e, k="write", x=100: (f"l{i}", i, 1, f"o{i}", s, e, k, x)
    schema = "lease_id string, event_id long, ino long, owner string, start_off long, end_off long, kind string, expires_at long"
    assert rows(ranges.lock_conflicts(spark.createDataFrame([lock(1, 0, 50), lock(2, 50, 100)], schema), 10)) == []
    got = ranges.lock_conflicts(spark.createDataFrame([lock(1, 0, 9000), lock(2, 4000, -1), lock(3, 8999, 9001, "read"), lock(4, 0, 9999, "write", 1), lock(5, 5, 6, "read")], schema), 10)
    assert rows(got) == [(1, "l1", "l2"), (1, "l1", "l3"), (1, "l1", "l5"), (1, "l2", "l3")]


def test_clamped_counter_is_the_ordered_fold(spark):
    r = random.Random(2)
    log = [(k, i, r.randint(-900, 500)) for k in range(20) for i in range(30)]
    want = {}
    for k, _, d in log:
        want[k] = max(0, want.get(k, 0) + d)
    got = ranges.clamped_usage(spark.createDataFrame(log, "name long, event_id long, delta long"), "name")
    assert {x["name"]: x["used"] for x in got.collect()} == want


def test_latency_average_is_the_ordered_fold(spark):
    r = random.Random(3)
    log = [(f"k{k}", i, r.randint(0, 9999)) for k in range(9) for i in range(25)]
    want = {}
    for k, _, v in log:
        want[k] = (9 * want[k] + v) // 10 if k in want else v
    got = ranges.latency_average(spark.createDataFrame(log, "key string, idx long, value long"), "key", "value", "idx")
    assert {x["key"]: x["average"] for x in got.collect()} == want


@pytest.mark.parametrize("size", [1, 5, 64])
def test_split_and_reassemble(spark, size):
    files = spark.createDataFrame([(1, bytearray(b"x" * 64)), (2, bytearray(b"abcdefg")), (3, bytearray(b""))], "file_id long, data binary")
    cut = chunks.split_chunks(files, size)
    assert {r["file_id"]: bytes(r["data"]) for r in chunks.reassemble(cut).collect()} == {1: b"x" * 64, 2: b"abcdefg"}
    assert chunks.split_chunks(files, size, emit_empty=True).where("file_id = 3").count() == 1
    assert {r["file_id"]: bytes(r["data"]) for r in chunks.read_range(cut, size, 2, 3).collect()}[2] == b"cde"
    ok = cut.withColumn("crc", crc32c("data"))
    assert tuple(chunks.scrub(ok).first()) == (ok.count(), 0)
    assert chunks.scrub(ok.withColumn("crc", F.col("crc") + (F.col("file_id") == 2).cast("int"))).first()["errors"] == cut.where("file_id = 2").count()


def test_placement_properties(spark):
    nodes = spark.createDataFrame([("light-1", 1, "ready"), ("light-2", 1, "ready"), ("heavy", 4, "ready"), ("zero", 0, "ready")], "node_id string, weight long, status string")
    keys = spark.range(10_000).select(F.concat(F.lit("k-"), F.col("id")).alias("key"))
    share = {r["node_id"]: r["n"] / 10_000 for r in placement.place(keys, nodes, 1).groupBy("node_id").agg(F.count("*").alias("n")).collect()}
    assert abs(share["heavy"] - 0.667) < 0.1 and abs(share["light-1"] - 0.167) < 0.1 and "zero" not in share
    few = placement.place(keys.limit(200), nodes, 3)
    assert few.groupBy("key").agg(F.countDistinct("node_id").alias("n")).where("n <> 3").count() == 0
    ten = spark.createDataFrame([(f"n{i}", 1, "ready") for i in range(11)], "node_id string, weight long, status string")
    some = keys.limit(5000)
    moved = placement.moved(placement.place(some, ten.where("node_id <> 'n10'"), 1), placement.place(some, ten, 1)).count()
    assert 0 < moved < 1250


@pytest.mark.parametrize("compact", [2, 16])
def test_stream_fold_equals_batch(spark, sf_dir, tmp_path, compact):
    log = table(spark, sf_dir, "change_log")
    log.repartitionByRange(5, "idx").write.parquet(f"file://{tmp_path}/log")
    stream = folds.read_log(spark, f"file://{tmp_path}/log", log.schema)
    run = folds.upsert_fold(stream, f"file://{tmp_path}/state", f"file://{tmp_path}/ck", compact)
    run.awaitTermination(120)
    assert rows(folds.current(spark, f"file://{tmp_path}/state")) == rows(ranges.fold_log(log))
    names = {p.name for p in (tmp_path / "state").iterdir()}
    assert {f"delta-{i}" for i in range(5)} <= names and ({"base-1", "base-3"} <= names) == (compact == 2)


def test_generations_on_a_stream(spark, tmp_path):
    """Only generations above all that a key has shown are let through."""
    log = [(i, f"k{i % 3}", (i * 37) % 50) for i in range(90)]
    top, want = {}, []
    for i, k, g in log:
        if g > top.get(k, -1):
            top[k] = g
            want.append((k, i, g))
    for at in range(0, 90, 30):
        spark.createDataFrame(log[at : at + 30], "idx long, key string, generation long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    seen = folds.generation_watch(folds.read_log(spark, f"file://{tmp_path}/log", "idx long, key string, generation long"))
    run = seen.writeStream.format("memory").queryName("generations").option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert rows(spark.table("generations")) == sorted(want)


def fnv_hash(key: str, node: str) -> int:
    """The 64-bit placement hash, one number at a time."""
    mask, h = (1 << 64) - 1, 0xCBF29CE484222325
    for b in [*key.encode(), 0xFF, *node.encode()]:
        h = ((h ^ b) * 0x100000001B3) & mask
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ (h >> 33)) * m) & mask
    return h ^ (h >> 33)


def test_node_hashes():
    keys, nodes = ["", "k", "key-12", "é"], ["a", "", "node-77"]
    assert node_hashes(keys, nodes).tolist() == [[fnv_hash(k, n) for n in nodes] for k in keys]


@pytest.mark.parametrize("domain", ["node_id", "zone"])
def test_placement_by_domain_is_the_greedy_choice(spark, domain):
    r = random.Random(5)
    nodes = [(f"n{i:02d}", r.choice([0, 1, 1, 3]), f"z{i % 3 if i < 9 else 0}") for i in range(12)]
    keys = [f"k{i}" for i in range(60)]
    got = placement.place_by_domain(spark.createDataFrame([(k,) for k in [*keys, None]], "key string"), spark.createDataFrame(nodes, "node_id string, weight int, zone string"), 5, domain)
    want = []
    for k in keys:
        draw = {n: (-math.log(float(fnv_hash(k, n) | 1) / float(2**64 - 1)) / w if w else 1e308) for n, w, _ in nodes}
        groups = {}
        for n, _, z in sorted(nodes, key=lambda x: (draw[x[0]], x[0])):
            groups.setdefault(n if domain == "node_id" else z, []).append(n)
        order = sorted(groups, key=lambda g: draw[groups[g][0]])
        picked = [groups[g][i] for i in range(12) for g in order if i < len(groups[g])][:5]
        want += [(k, i, n) for i, n in enumerate(picked)]
    assert rows(got) == sorted(want)
    none = spark.createDataFrame([], "node_id string, weight int, zone string")
    assert placement.place_by_domain(spark.createDataFrame([("k",)], "key string"), none, 2).count() == 0


def test_frames_and_their_faults(spark):
    good = chunks.frame_chunks(spark.createDataFrame([("a", bytearray(b"hello")), ("e", bytearray(b""))], "chunk_id string, data binary"))
    framed = {r["chunk_id"]: bytes(r["framed"]) for r in good.collect()}
    assert framed["a"] == b"NVAC\x01\x00" + crc32c_bytes(b"hello").to_bytes(4, "little") + (5).to_bytes(4, "little") + b"\0\0hello"
    a = framed["a"]
    cases = {"ok": a, "ok2": framed["e"], "short": a[:9], "bad_magic": b"X" + a[1:], "truncated": a[:-1], "bad_checksum": a[:-1] + b"!"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "chunk_id string, framed binary")
    assert {r["chunk_id"]: r["verdict"] for r in chunks.verify_frames(df).collect()} == {k: k.rstrip("2") for k in cases}


def test_padded_code_keeps_the_length(spark):
    r = random.Random(8)
    data = {str(n): r.randbytes(n) for n in (0, 1, 4, 7, 1000)}
    shards = chunks.padded_encode(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "chunk_id string, data binary"), 4, 2)
    for lost in ("0, 3", "4, 5", "1"):
        left = shards.where(f"shard_index NOT IN ({lost})")
        assert {x["chunk_id"]: bytes(x["data"]) for x in chunks.padded_decode(left, 4, 2).collect()} == data
    gone = chunks.repair_shards(shards.where("shard_index NOT IN (2, 4)"), 4, 2)
    assert rows(gone) == rows(shards.where("shard_index IN (2, 4)").select("chunk_id", "shard_index", "shard"))
    assert chunks.padded_decode(shards.where("shard_index < 3"), 4, 2).count() == 0


def test_writes_inside_and_beyond(spark):
    r = random.Random(4)
    files = {i: bytearray(r.randbytes(r.randrange(60))) for i in range(30)}
    patches = {i: (r.randrange(70), r.randbytes(r.randrange(1, 30))) for i in range(0, 30, 2)}
    df = spark.createDataFrame(list(files.items()), "file_id long, data binary")
    lengths = spark.createDataFrame([(i, max(len(d), patches[i][0] if i in patches else 0)) for i, d in files.items()], "file_id long, length long")
    whole = chunks.fill_sparse(chunks.split_chunks(df, 16), lengths, 16)
    got = chunks.reassemble(chunks.write_at(whole, spark.createDataFrame([(i, *p) for i, p in patches.items()], "file_id long, offset long, patch binary"), 16))
    want = {}
    for i, d in files.items():
        if i in patches:
            at, p = patches[i]
            d = d.ljust(at, b"\0")
            d[at : at + len(p)] = p
        if d:
            want[i] = bytes(d)
    assert {x["file_id"]: bytes(x["data"]) for x in got.collect()} == want


def test_truncate_cuts_and_extends(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdef")), (2, bytearray(b"a")), (3, bytearray(b""))], "file_id long, data binary")
    assert [bytes(r["data"]) for r in chunks.truncate(df, 3).orderBy("file_id").collect()] == [b"abc", b"a\0\0", b"\0\0\0"]


def test_file_log_fold_is_the_sequential_one(spark):
    r = random.Random(6)
    log, want = [], {}
    for i in range(600):
        op = r.choice(["create", "link", "unlink", "rename"])
        parent, name, ino, to, new = r.randrange(4), f"f{r.randrange(5)}", r.randrange(50), r.randrange(4), f"f{r.randrange(5)}"
        log.append((i, op, parent, name, ino, to, new))
        if op in ("create", "link"):
            want[parent, name] = ino
        else:
            want.pop((parent, name), None)
            if op == "rename":
                want[to, new] = ino
    df = spark.createDataFrame(log, "idx long, op string, parent long, name string, ino long, new_parent long, new_name string")
    assert rows(namespace.directory_entries(df)) == sorted((p, n, i) for (p, n), i in want.items())


def test_directory_pages_join(spark):
    entries = spark.createDataFrame([(7, f"f{i}", i) for i in range(5)] + [(8, "x", 9)], "parent long, name string, ino long")
    whole = rows(namespace.read_directory(entries, 7, 0, 100))
    assert [n for _, n, _ in whole] == [".", "..", "f0", "f1", "f2", "f3", "f4"]
    assert sum((rows(namespace.read_directory(entries, 7, c, 3)) for c in (0, 3, 6)), []) == whole


def test_sparse_map_sweeps(spark):
    r = random.Random(9)
    have = {m: {b for b in range(40) if r.random() < 0.6} for m in range(3)}
    blocks = spark.createDataFrame([(m, b) for m, bs in have.items() for b in bs], "map long, block long")
    asks = [(m, o) for m in range(4) for o in range(0, 450, 7)]
    at = spark.createDataFrame(asks, "map long, offset long")
    data = {(m, o): min((max(o, b * 10) for b in have.get(m, ()) if b >= o // 10), default=None) for m, o in asks}
    hole = {(m, o): next(max(o, b * 10) for b in range(o // 10, 99) if b not in have.get(m, ())) for m, o in asks}
    assert {(x["map"], x["offset"]): x["next"] for x in ranges.next_data(blocks, at, "map", 10).collect()} == data
    assert {(x["map"], x["offset"]): x["next"] for x in ranges.next_hole(blocks, at, "map", 10).collect()} == hole


def test_gaps_complete_the_ranges(spark):
    merged = spark.createDataFrame([("a", 2, 5), ("a", 7, 30), ("b", 0, 20), ("c", 25, 30), ("d", 3, 4)], "f string, start_off long, end_off long")
    assert rows(ranges.range_gaps(merged, "f", 20)) == [("a", 0, 2), ("a", 5, 7), ("c", 0, 20), ("d", 0, 3), ("d", 4, 20)]
    assert rows(ranges.coverage_complete(merged, "f", 20)) == [("a", False), ("b", True), ("c", False), ("d", False)]


def test_repairs_follow_slots(spark):
    shards = spark.createDataFrame([("c", i, f"n{i}") for i in (0, 2, 3, 5, 9)] + [("lost", 0, "n0")], "chunk_id string, shard_index int, node_id string")
    health = policy.shard_health(shards, None, 4, 2)
    assert {r["chunk_id"]: (r["present"], r["missing"], r["state"]) for r in health.collect()} == {"c": (4, [1, 4], "degraded"), "lost": (1, [1, 2, 3, 4, 5], "unrecoverable")}
    placed = spark.createDataFrame([("c", i, f"p{i}") for i in range(3)], "key string, replica int, node_id string")
    assert rows(policy.shard_repairs(health, placed)) == [("c", 1, "p1"), ("c", 4, "p0")]


def test_topology_falls_back_to_all(spark):
    nodes, some = (spark.createDataFrame([(n,) for n in ns], "node_id string") for ns in ("abc", "bx"))
    assert rows(policy.within_topology(nodes, some)) == [("b",)]
    assert rows(policy.within_topology(nodes, some.where("node_id = 'x'"))) == [("a",), ("b",), ("c",)]


def test_profiles(spark):
    cases = [("replication", 3, 2, None, None), ("replication", 9, 1, None, None), ("replication", 3, 4, None, None), ("replication", 3, -1, None, None), ("replication", None, None, None, None), ("erasure_coding", None, None, 1, 1), ("erasure_coding", None, None, 4, 0), ("erasure_coding", None, None, 4, 2), (None, 1, 1, 1, 1)]
    df = spark.createDataFrame(cases, "m string, f int, q int, d int, p int")
    got = [r[0] for r in df.select(exprs.profile_error(*[F.col(c) for c in "mfqdp"])).collect()]
    assert [g is None for g in got] == [True, False, False, False, False, False, False, True, False]
    assert [r[0] for r in df.select(exprs.target_replicas(*[F.col(c) for c in "mfdp"])).collect()] == [3, 9, 3, 3, 1, 2, 4, 6, 1]


SMALL = "/root/testdata/sf0.01"


def test_placements_see_every_node(spark):
    nodes = [(r["node_id"], r["weight"]) for r in table(spark, SMALL, "nodes").where("status <> 'offline' AND weight > 0").collect()]
    got = {(r["key"], r["replica"]): r["node_id"] for r in registry.queries()["c2_placement"](spark, SMALL).where(F.crc32(F.col("key").cast("binary")) % 100 == 0).collect()}
    assert len(got) > 100
    for key in {k for k, _ in got}:
        taken = []
        for r in range(3):
            draw = lambda n: (math.log((int(hashlib.sha256(f"{key}:{n[0]}:{r}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32) / n[1], n[0])  # noqa: B023, E731
            taken.append(max((n for n in nodes if n[0] not in taken), key=draw)[0])
            assert got[key, r] == taken[r]


@pytest.mark.parametrize("name, column", [("c1_place_by_domain", "node_id"), ("c3_movement", "new_node"), ("c6_shard_repairs", None), ("b14_shard_nodes", None)])
def test_placed_on_high_nodes(spark, name, column):
    found = registry.queries()[name](spark, SMALL)
    column = F.col(column) if column else F.concat_ws(" ", *[F.col(c).cast("string") for c in found.columns])
    assert found.where(column.rlike("node-([6-9][0-9]|100)( |$)")).take(1)


def test_scrub_checks_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    parts = {r["doc_id"]: -(-len((r["text"] or "").encode()) // 4096) for r in docs}
    got = registry.queries()["ag20_scrub"](spark, sf_dir).first()
    assert (got["checked"], got["errors"]) == (sum(parts.values()), sum(n for i, n in parts.items() if i % 50 == 7))
    assert 0 < got["errors"] < got["checked"]


def drawn(keys, weights, count):
    """``key, replica, node_id`` by one digest at a time."""
    out = []
    for key in keys:
        taken = []
        for r in range(count):
            draw = lambda n: (math.log((int(hashlib.sha256(f"{key}:{n}:{r}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32) / weights[n], n)  # noqa: B023, E731
            taken.append(max((n for n in weights if n not in taken), key=draw))
            out.append((key, r, taken[r]))
    return sorted(out)


def test_placement_over_many_nodes(spark):
    weights = {f"node-{i}": i % 4 + 1 for i in range(12_000)}
    nodes = spark.createDataFrame([(n, w, "ready") for n, w in weights.items()], "node_id string, weight int, status string")
    keys = ["k", "chunk-12", "vol-123456", ""]
    got = placement.place(spark.createDataFrame([(k,) for k in keys], "key string"), nodes, 3)
    assert rows(got) == drawn(keys, weights, 3)


def test_placement_of_short_lists_and_long_names(spark):
    """Every length of a key around a block of SHA-256, fewer nodes than
    replicas, and a weight that outdoes all shares."""
    keys = ["x" * n for n in range(70)] + ["é" * 9]
    for weights in ({"a": 1, "b": 1e9, "é" * 20: 0.5}, {f"n{i}": 1 for i in range(300)} | {"y" * 60: 2}):
        nodes = spark.createDataFrame([(n, float(w), "ready") for n, w in weights.items()], "node_id string, weight double, status string")
        frame = spark.createDataFrame([(k,) for k in keys], "key string")
        got = rows(placement.place(frame, nodes, 4))
        assert got == drawn(keys, weights, min(4, len(weights)))
        names = sorted(weights)
        assert rows(placement.place_singly(frame.withColumn("_count", F.lit(min(4, len(names)))), names, np.array([float(weights[n]) for n in names]))) == got


def test_placement_by_blocks_and_by_vectors(spark):
    """Draws alternate between the two ways at first; the JVM's block function
    can be reached, and both give the same."""
    weights = {f"node-{i}": float(i % 4 + 1) for i in range(600)}
    nodes = spark.createDataFrame([(n, w, "ready") for n, w in weights.items()], "node_id string, weight double, status string")
    frame = spark.createDataFrame([(f"vol-{i}",) for i in range(300)], "key string").coalesce(1)
    loader = straw._load(spark, "Straw").getClassLoader()
    direct = spark._jvm.java.lang.Class.forName("tessera.Straw$Direct", True, loader).getDeclaredMethod("open", None)
    direct.setAccessible(True)
    assert direct.invoke(None, None) is not None
    names = sorted(weights)
    singly = placement.place_singly(frame.withColumn("_count", F.lit(3)), names, np.array([weights[n] for n in names]))
    assert rows(placement.place(frame, nodes, 3)) == rows(singly)


def test_blocks_are_written_ahead_of_their_digests(spark):
    """Each block of a ring has a state of its own; node lists that end before,
    at and behind the ring's end are drawn whole, at every alignment of a key."""
    kind = spark._jvm.java.lang.Class.forName("tessera.Straw$Direct", True, straw._load(spark, "Straw").getClassLoader())
    opener, states = kind.getDeclaredMethod("open", None), kind.getDeclaredField("words")
    opener.setAccessible(True)
    states.setAccessible(True)
    ring = states.get(opener.invoke(None, None))
    assert len(ring) == 32 and all(len(x) == 8 for x in ring)
    keys = ["x" * n for n in range(20)]
    frame = spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1)
    for n in (31, 32, 33, 65):
        weights = {f"node-{i}": float(i % 4 + 1) for i in range(n)}
        nodes = spark.createDataFrame([(x, w, "ready") for x, w in weights.items()], "node_id string, weight double, status string")
        assert rows(placement.place(frame, nodes, 2)) == drawn(keys, weights, 2)


def test_keys_are_dealt_in_shares(spark):
    """Each slot gets several tasks of like size, so that a slow core does not
    hold up the rest; the placement is the same."""
    weights = {f"node-{i}": i % 3 + 1 for i in range(20)}
    nodes = spark.createDataFrame([(n, w, "ready") for n, w in weights.items()], "node_id string, weight int, status string")
    keys = [f"vol-{i}" for i in range(640)]
    got = placement.place(spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1), nodes, 2)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 * 4 and max(sizes) <= 2 * min(sizes)
    assert rows(got) == drawn(keys, weights, 2)


def test_human_bytes_rounds_as_printf(spark):
    sizes = [0, 1023, 1024, 1280, 1331, 1792, 2304, 2432, 9472, 1048575, 1310720, 1 << 20, 5 * (1 << 28), (1 << 40) * 7 // 4, (1 << 53) + 1] + [1024 + 51 * i for i in range(300)]
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    want = []
    for n in sizes:
        p = max(i for i in range(5) if i == 0 or n >= 1 << (10 * i))
        want.append((n, f"{n} B" if not p else f"{n / 2 ** (10 * p):.1f} {units[p]}"))
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", exprs.human_bytes(F.col("n")))
    assert rows(got) == sorted(want) and (2304, "2.2 KiB") in want and (1792, "1.8 KiB") in want


def many(spark, count=10_500):
    weights = {f"node-{i}": i % 4 + 1 for i in range(count)}
    return weights, spark.createDataFrame([(n, w, "ready", f"z{int(n[5:]) % 5}") for n, w in weights.items()], "node_id string, weight int, status string, zone string")


def test_domains_over_many_nodes(spark):
    weights, nodes = many(spark)
    got = rows(placement.place_by_domain(spark.createDataFrame([("k",)], "key string"), nodes, 3, "zone"))
    draw = {n: -math.log(float(v | 1) / float(2**64 - 1)) / weights[n] for n, v in zip(weights, node_hashes(["k"], list(weights))[0].tolist(), strict=True)}
    best = sorted((min((draw[n], n) for n in weights if int(n[5:]) % 5 == z) for z in range(5)))[:3]
    assert got == [("k", i, n) for i, (_, n) in enumerate(best)]


def test_domains_are_drawn_as_singly(spark):
    """Ids of all shapes, copies of ids, weights that draw alike, domains of one
    node to all nodes; the hashes are taken in the JVM, not by a Python worker."""
    keys = spark.createDataFrame([(f"vol-{i}",) for i in range(120)] + [("",), ("é" * 9,), (None,)], "key string")
    weights = [1.0, 2.0, 2.1, 0.0, -1.0, 3.5, math.inf, 1e-300, 1e300, 7.0]
    lists = (
        [(f"node-{i}", i % 4 + 1.0, f"z{i % 5}") for i in range(1300)],
        [(n, weights[i % 10], f"z{i % 3}") for i, n in enumerate(["", "", "a", "a", "ab", "abc", "b", "é", "日本", "x" * 60] * 3)],
        [(f"n{i}", 0.0, "z") for i in range(6)], [("one", 1.0, None)],
    )
    for nodes in lists:
        frame = spark.createDataFrame(nodes, "node_id string, weight double, zone string")
        for domain, count in (("zone", 3), ("zone", 0), ("zone", 7), ("node_id", 4)):
            found = placement.place_by_domain(keys, frame, count, domain)
            assert "MapInPandas" not in found._jdf.queryExecution().toString()
            listed = placement.listed(frame.select("node_id", "weight", F.col(domain).alias("domain")))
            names = [r["node_id"] for r in listed]
            codes = np.unique([str(r["domain"]) for r in listed], return_inverse=True)[1]
            singly = placement.by_domain_singly(keys.where("key IS NOT NULL"), names, np.array([r["weight"] for r in listed]), codes, count)
            assert rows(found) == rows(singly) and (len(rows(found)) > 0) == (count > 0)


def test_movement_is_what_moved_between_placements(spark):
    before = spark.createDataFrame([(f"n{i}", i % 3, "ready" if i % 5 else "offline") for i in range(1, 40)], "node_id string, weight int, status string")
    after = spark.createDataFrame([(f"n{i}", i % 4, "ready" if i % 7 else "offline") for i in range(5, 45)], "node_id string, weight int, status string")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(200)] + [(None,)], "key string")
    for count in (0, 1, 3):
        want = rows(placement.moved(placement.place(keys, before, count), placement.place(keys, after, count)).select("key", "replica", "node_id", "new_node"))
        assert rows(placement.movement(keys, before, after, count)) == want and bool(want) == bool(count)
    got = placement.movement(keys, before, after, 3)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("tessera_straw_") == 1


def test_movement_by_the_nodes_that_differ(spark):
    """One node more, one less, another weight, none, a node that outdoes all;
    keys within and beyond a block: what moved is as between whole placements."""
    base = {f"node-{i}": float(i % 4 + 1) for i in range(300)}
    listed = lambda x: spark.createDataFrame([(n, w, "ready") for n, w in x.items()], "node_id string, weight double, status string")
    keys = spark.createDataFrame([(f"vol-{i}",) for i in range(3000)] + [("x" * i,) for i in range(70)] + [(None,)], "key string")
    less = {n: w for n, w in base.items() if n != "node-7"}
    for other, count in ((less, 2), (base | {"new": 3.0}, 3), (base | {"node-9": 4.5}, 1), (base, 2), (base | {"node-2": 1e9}, 2), (less | {"node-8": 0.5, "é": 1.0}, 2)):
        before, after = listed(base), listed(other)
        want = rows(placement.moved(placement.place(keys, before, count), placement.place(keys, after, count)).select("key", "replica", "node_id", "new_node"))
        assert rows(placement.movement(keys, before, after, count)) == want and bool(want) == (other != base)


def test_keys_that_stay_are_not_drawn(spark):
    """With one node more among many, a key that stays costs some digests, not one
    for each node; it is null."""
    weights = {f"node-{i}": float(i % 4 + 1) for i in range(2000)}
    names, sets = sorted(weights), ({n: w for n, w in weights.items() if n != "node-3"}, weights)
    placed = [drawn(["vol-1"], x, 2) for x in sets]
    assert placed[0] == placed[1]
    table = struct.pack(">ii", len(names), 2) + b"".join(struct.pack(">2di", sets[0].get(n, 0.0), sets[1][n], len(n)) + n.encode() for n in names)
    kind = straw._load(spark, "Straw")
    draws, word = kind.newInstance().over(bytearray(table)), kind.getDeclaredField("drawn")
    word.setAccessible(True)
    assert draws.call("vol-1", 2, None, None) is None
    assert len(word.get(draws)) >= 2000 and not any(word.get(draws))


def test_shard_repairs_over_many_nodes(spark):
    weights, nodes = many(spark)
    shards = spark.createDataFrame([("c", i, "node-1") for i in (0, 2, 3, 5)], "chunk_id string, shard_index int, node_id string")
    health = policy.shard_health(shards, None, 4, 2)
    placed = placement.place(health.selectExpr("chunk_id AS key", "array_max(missing) + 1 AS wanted"), nodes, 6, F.col("wanted"))
    want = drawn(["c"], weights, 5)
    assert rows(placed) == want
    assert rows(policy.shard_repairs(health, placed)) == [("c", 1, want[1][2]), ("c", 4, want[4][2])]


def test_misplaced_over_many_nodes(spark):
    weights, nodes = many(spark)
    held = spark.createDataFrame([("v", 0, 3), ("v", 1, 2)], "volume_id string, position int, wanted int")
    want = {i: [n for _, _, n in drawn([f"v:{i}"], weights, w)] for i, w in ((0, 3), (1, 2))}
    assert rows(placement.misplaced(held, nodes, "none")) == [("v", i, want[i][0]) for i in (0, 1)]
    assert rows(placement.misplaced(held, nodes, want[0][2])) == [("v", 1, want[1][0])]


def test_recovery_over_many_nodes(spark):
    weights, nodes = many(spark)
    ring = sorted(set(weights) - {"node-4"})
    held = spark.createDataFrame([("c1", "node-4", 0), ("c1", ring[0], 1), ("c2", ring[2], 0), ("c2", "node-4", 1), ("c3", "node-4", 0)], "chunk_id string, node_id string, slot int")
    moves = compliance.recover_node(held, "node-4", nodes)
    assert rows(moves) == [("c1", ring[0], ring[1], 1), ("c2", ring[2], ring[3], 1)]
    assert rows(compliance.update_placements(held, moves, "node-4")) == [("c1", f"{ring[1]},{ring[0]}"), ("c2", f"{ring[2]},{ring[3]}"), ("c3", "node-4")]


def test_actions_over_many_nodes(spark):
    weights, nodes = many(spark)
    held = spark.createDataFrame([("c", "node-9999", 0)], "chunk_id string, node_id string, slot int")
    targets = [n for _, _, n in drawn(["c"], weights, 3) if n != "node-9999"][:2]
    assert rows(compliance.actions(held, nodes, 3)) == sorted(("c", "replicate", "node-9999", n) for n in targets)


def test_short_chunks_are_placed_to_their_last_target(spark):
    """A chunk that lacks one replica costs one round of draws, unless its holder
    is drawn first; both ways of drawing end there, and the actions are those of
    whole placements."""
    weights = {f"node-{i}": float(i % 4 + 1) for i in range(5)}
    names = sorted(weights)
    nodes = spark.createDataFrame([(n, w, "ready") for n, w in weights.items()], "node_id string, weight double, status string")
    held = {f"c{i}": names[i % 5 :][: 1 + i // 5 % 2] for i in range(60)}
    whole = {k: [n for _, _, n in drawn([k], weights, 3)] for k in held}
    want = {k: next(r for r in range(4) if r == 3 or sum(n not in h for n in whole[k][:r]) == 3 - len(h)) for k, h in held.items()}
    assert {want[k] for k in held if len(held[k]) == 1} == {2, 3} and {1, 2} <= {want[k] for k in held if len(held[k]) == 2}
    frame = spark.createDataFrame([(k, h, 3 - len(h)) for k, h in held.items()], "key string, held array<string>, lack int")
    got = rows(placement.place(frame, nodes, 3, F.col("lack"), F.col("held")))
    assert got == sorted((k, r, whole[k][r]) for k in held for r in range(want[k]))
    dealt = frame.select("key", F.lit(3).alias("_count"), F.col("held").alias("_held"), F.col("lack").alias("_others"))
    assert rows(placement.place_singly(dealt, names, np.array([weights[n] for n in names]))) == got
    listed = spark.createDataFrame([(k, n, i) for k, h in held.items() for i, n in enumerate(h)], "chunk_id string, node_id string, slot int")
    targets = {k: [n for n in whole[k] if n not in h][: 3 - len(h)] for k, h in held.items()}
    assert rows(compliance.actions(listed, nodes, 3)) == sorted((k, "replicate", held[k][0], n) for k in held for n in targets[k])


def test_backends_over_many_nodes(spark):
    weights = {f"node-{i}": i % 4 + 1 for i in range(10_500)}
    nodes = spark.createDataFrame([(n, w, "ready") for n, w in weights.items()], "node_id string, weight int, status string")
    backends = nodes.select("node_id", F.concat("node_id", F.lit("-b")).alias("backend_id"), "weight")
    got = placement.pick_backend(placement.place(spark.createDataFrame([("a",), ("b",)], "key string"), nodes, 2), backends)
    assert rows(got.select("key", "replica", "backend_id")) == [(k, r, f"{n}-b") for k, r, n in drawn(["a", "b"], weights, 2)]
