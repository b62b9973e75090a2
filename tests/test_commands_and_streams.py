"""Commands, folds, stores, placement and streams against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.udfs import _CRC, crc32c_many
from tessera.operators import compliance, namespace, ordering, placement, ranges, refs
from tessera.sources.chunk_store import ChunkStore, export_state, import_state
from tessera.sources.scratch import shared_dir
from tessera.streaming import buffers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_crc_of_many_sizes():
    def plain(data):
        c = 0xFFFFFFFF
        for b in data:
            c = (c >> 8) ^ _CRC[(c ^ b) & 255]
        return c ^ 0xFFFFFFFF

    r = random.Random(4)
    values = [r.randbytes(n) for n in (0, 1, 2, 3, 4, 63, 64, 65, 128, 129, 3000)]
    assert crc32c_many(values).tolist() == [plain(v) for v in values]
    assert crc32c_many([]).tolist() == []


LOCK = "lease_id string, event_id long, ino long, owner string, start_off long, end_off long, kind string, expires_at long"


def test_locks_far_out(spark):
    far = 10 * 1024**3
    got = ranges.lock_conflicts(spark.createDataFrame([("a", 1, 1, "x", 0, -1, "write", 9), ("b", 2, 1, "y", 10 * 1024**2, 10 * 1024**2 + 1, "write", 9), ("c", 3, 1, "z", far, far + 5, "read", 9), ("d", 4, 2, "y", far, -1, "write", 9)], LOCK), 5)
    assert rows(got) == [(1, "a", "b"), (1, "a", "c")]


@pytest.mark.parametrize("seed", range(3))
def test_locks_against_all_pairs(spark, seed):
    r = random.Random(seed)
    locks = []
    for i in range(150):
        s = r.choice((0, 1, r.randrange(100), r.randrange(1 << 20), r.randrange(1 << 40), (1 << 63) - 3))
        locks.append((f"l{i:03}", i, r.randrange(3), f"o{r.randrange(4)}", s, r.choice((-1, s, min((1 << 63) - 1, s + r.randrange(1, 90)), min((1 << 63) - 1, s + r.randrange(1, 1 << 45)))), r.choice(("read", "write")), r.randrange(10)))
    top = lambda e: (1 << 63) - 1 if e == -1 else e
    want = sorted((a[2], a[0], b[0]) for a in locks for b in locks if a[1] < b[1] and a[2] == b[2] and a[3] != b[3] and "write" in (a[6], b[6]) and min(a[7], b[7]) >= 5 and a[4] < top(b[5]) and b[4] < top(a[5]))
    df = spark.createDataFrame(locks, LOCK)
    assert want and rows(ranges.lock_conflicts(df, 5)) == want
    count = {a[0]: sum(a[0] in pair[1:] for pair in want) for a in locks if a[7] >= 5}
    assert {r["lease_id"]: r["conflicts"] for r in ranges.lock_conflict_counts(df, 5).collect()} == count


def test_lease_fold(spark):
    log = [
        (1, "acquire", "a", 1, "x", 0, -1, "write", 10, 20), (2, "acquire", "b", 1, "y", 5_000_000_000, 5_000_000_001, "read", 11, 99),  # refused
        (3, "renew", "a", 1, "x", 0, 0, "write", 20, 30), (4, "acquire", "c", 1, "y", 7, 8, "write", 31, 40),  # the first has expired
        (5, "release", "c", 1, "x", 0, 0, "write", 32, 0), (6, "renew", "a", 1, "x", 0, 0, "write", 33, 90), (7, "acquire", "d", 1, "z", 8, 9, "write", 34, 50), (8, "acquire", "e", 2, "z", 0, 9, "read", 34, 50), (9, "release", "e", 2, "z", 0, 0, "read", 35, 0),
    ]
    df = spark.createDataFrame(log, "idx long, op string, lease string, ino long, owner string, start_off long, end_off long, kind string, moment long, expires_at long")
    assert rows(ranges.fold_leases(df)) == [(1, "c", "y", 7, 8, "write", 40), (1, "d", "z", 8, 9, "write", 50)]


def test_ranks_and_drain(spark):
    df = spark.createDataFrame([(i * 37 % 1001,) for i in range(1001)], "created long")
    assert rows(ordering.ranked(df, [F.expr("created div 64")], ["created"])) == [(i, i + 1) for i in range(1001)]
    assert rows(ordering.drain_overflow(df, 1000, block=64)) == [(i,) for i in range(251)]
    assert rows(ordering.drain_overflow(df, 2000)) == []


def test_inodes_are_numbered_over_all_parents(spark):
    made = namespace.created_inodes(spark.createDataFrame([(9, "create", 1, "b"), (3, "mkdir", 2, "a"), (70_000, "symlink", 2, "c"), (5, "unlink", 2, "a")], "idx long, op string, parent long, name string"))
    assert rows(made) == [(3, 2, "a", 3, "dir", 2), (9, 1, "b", 4, "file", 1), (70_000, 2, "c", 5, "symlink", 1)]


def test_links_displace(spark):
    log = [(1, "create", 1, "a", 10), (2, "create", 1, "b", 11), (3, "link", 1, "b", 10), (4, "link", 2, "c", 10), (5, "link", 2, "c", 10), (6, "unlink", 1, "a", 10)]
    assert rows(namespace.link_accounting(spark.createDataFrame(log, "idx long, op string, parent long, name string, ino long"))) == [(10, 3)]


def test_reservations_are_the_ordered_fold(spark):
    r = random.Random(6)
    log = [(k, i, r.randint(-90, 120)) for k in range(12) for i in range(40)]
    limits = [(k, k * 40) for k in range(12)]
    want = {}
    for k, hard in limits:
        used = refused = 0
        for _, _, b in (x for x in log if x[0] == k):
            if b > 0 and hard > 0 and used + b > hard:
                refused += 1
            else:
                used = max(0, used + b)
        want[k] = (used, refused)
    got = namespace.reservations(spark.createDataFrame(log, "k long, idx long, bytes long"), spark.createDataFrame(limits, "k long, hard long"), "k")
    assert {x["k"]: (x["used"], x["refused"]) for x in got.collect()} == want


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_recovery_is_the_running_cursor(spark, block):
    r = random.Random(8)
    ring = [f"n{i}" for i in range(7)]
    held = {f"chunk-{i:03}": r.sample([*ring, "down"], r.randint(1, 6)) for i in range(60)}
    want, cursor = [], 0
    healthy = ring[:5]
    for c in sorted(held):
        alive = [x for x in held[c] if x != "down"]
        if "down" not in held[c] or not alive:
            continue
        for i in range(len(healthy)):
            n = healthy[(cursor + i) % len(healthy)]
            if n not in held[c]:
                want.append((c, alive[0], n, len(alive)))
                cursor = (cursor + i + 1) % len(healthy)
                break
    p = spark.createDataFrame([(c, n, s) for c, ns in held.items() for s, n in enumerate(ns)], "chunk_id string, node_id string, slot int")
    moves = compliance.recover_node(p, "down", spark.createDataFrame([(n,) for n in healthy], "node_id string"), block)
    assert rows(moves) == want
    after = {r["chunk_id"]: r["nodes"].split(",") for r in compliance.update_placements(p, moves, "down").collect()}
    for c, _, n, _ in want:
        assert after[c] == [n if x == "down" else x for x in held[c]]
    assert rows(compliance.recover_node(p, "down", spark.createDataFrame([], "node_id string"))) == []


def test_actions_name_targets(spark):
    p = spark.createDataFrame([("short", "a", 0), ("long", "b", 0), ("long", "a", 1), ("long", "c", 2)], "chunk_id string, node_id string, slot int")
    nodes = spark.createDataFrame([("a", 1, "ready"), ("b", 1, "ready"), ("off", 9, "offline")], "node_id string, weight long, status string")
    assert sorted(compliance.actions(p, nodes, 2).collect(), key=str) == [("long", "remove", "c", None), ("short", "replicate", "a", "b")]


def test_corrupted_chunks_come_first(spark):
    health = spark.createDataFrame([("v", "ok", 3), ("v", "bad", 3), ("v", "few", 1)], "volume_id string, chunk_id string, live long")
    vols = spark.createDataFrame([("v", "p", "replication")], "volume_id string, pool string, mode string")
    got = compliance.repair_queue(health, vols, 3, 4, 2, spark.createDataFrame([("bad",)], "chunk_id string"))
    assert rows(got.select("priority", "chunk_id", "status")) == [(-1, "bad", "corrupted"), (1, "few", "under_replicated")]


def test_a_snapshot_alone_keeps_a_chunk(spark):
    ids = lambda *c: spark.createDataFrame([(x,) for x in c], "chunk_id string")
    live = refs.referenced_chunks(ids("a"), ids(), ids(), ids(), ids("snap"))
    placed = spark.createDataFrame([("n1", c) for c in ("a", "snap", "gone")] + [("n2", "gone")], "node_id string, chunk_id string")
    nodes = spark.createDataFrame([("n1", False), ("n2", True)], "node_id string, fenced boolean")
    assert rows(refs.collect_garbage(placed, live, nodes)) == [("n1", 1, 2, False), ("n2", 0, 1, True)]


def test_misplaced_follows_placement(spark):
    nodes = spark.createDataFrame([(f"n{i}", 1, "ready") for i in range(6)], "node_id string, weight long, status string")
    held = spark.createDataFrame([("v", i, 2) for i in range(40)], "volume_id string, position long, wanted int")
    at = {}
    for r in placement.place(held.select(F.concat_ws(":", "volume_id", "position").alias("key")), nodes, 2).orderBy("key", "replica").collect():
        at.setdefault(r["key"], []).append(r["node_id"])
    want = sorted(("v", int(k[2:]), n[0]) for k, n in at.items() if "n3" not in n)
    assert 0 < len(want) < 40 and rows(placement.misplaced(held, nodes, "n3")) == want


def test_chunk_store(spark, tmp_path):
    data = lambda *d: spark.createDataFrame([(bytearray(x),) for x in d], "data binary")
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    assert store.stats().first() == (0, 0)
    store.put(data(b"one", b"two", b"two"))
    store.put(data(b"two", b"three"))
    assert tuple(store.stats().first()) == (3, 11)
    ids = {bytes(r["data"]): r["chunk_id"] for r in store.chunks().collect()}
    store.delete(spark.createDataFrame([(ids[b"two"],), ("unknown",)], "chunk_id string"))
    asked = spark.createDataFrame([(ids[b"two"],), (ids[b"one"],)], "chunk_id string")
    assert {r["chunk_id"]: r["held"] for r in store.exists(asked).collect()} == {ids[b"two"]: False, ids[b"one"]: True}
    assert [bytes(r["data"]) for r in store.get(asked).collect()] == [b"one"]
    store.put(data(b"two"))
    small = store.compact()
    assert len(small._batches()) == 1 and sorted(bytes(r["data"]) for r in small.chunks().collect()) == [b"one", b"three", b"two"]


def test_state_is_replaced_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    one, two = (spark.createDataFrame([(x,)], "x int") for x in (1, 2))
    export_state({"a": one, "b": one}, path)
    old = import_state(spark, path)
    export_state({"a": two}, path)
    assert [r.x for r in old["b"].collect()] == [1]
    assert {n: [r.x for r in df.collect()] for n, df in import_state(spark, path).items()} == {"a": [2]}


def test_shared_folder_is_needed_off_local(spark):
    class Cluster:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = spark.conf, Cluster()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            shared_dir(Session())
    assert shared_dir(spark)


def _stream(spark, tmp_path, parts, schema):
    """A stream over one file per part, in order; the last one only moves the
    watermark."""
    folder = tmp_path / "in"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        time.sleep(0.05 * (i < len(parts)))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}").withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", "0 seconds")


def _run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.table(name)


def test_buffers_as_a_stream(spark, tmp_path):
    r = random.Random(3)
    writes = sorted((f"v{r.randrange(2)}", r.randrange(2), r.randrange(0, 3000), i, 10) for i in range(120))
    writes = [(v, c, ms, i, n) for i, (v, c, ms, _, n) in enumerate(sorted(writes, key=lambda w: w[2]))]
    schema = "volume_id string, chunk long, ms long, idx long, len long"
    want = rows(buffers.buffer_flushes(spark.createDataFrame(writes, schema), 100))
    live = _stream(spark, tmp_path, [writes[:50], writes[50:], [("zz", 9, 90_000, 999, 1)]], schema)
    got = _run(buffers.buffer_stream(live, 100), tmp_path, "flushed")
    assert rows(got.where("volume_id <> 'zz'")) == want and sum(w[3] for w in want) == 120


def test_heartbeats_as_a_stream(spark, tmp_path):
    # a stream's watermark begins at zero, and drops what is not after it
    beats = [("a", 1), ("a", 20_000), ("b", 20_000), ("a", 55_000), ("b", 56_000), ("c", 56_000), ("a", 120_000), ("b", 130_000)]
    schema = "node_id string, ms long"
    # the last row moves the watermark so that all silence is told
    want = rows(buffers.node_transitions(spark.createDataFrame(beats, schema), until=500_000))
    live = _stream(spark, tmp_path, [beats[:3], beats[3:6], beats[6:], [("z", 500_000)]], schema)
    got = _run(buffers.node_state_stream(live), tmp_path, "states")
    assert rows(got.where("node_id <> 'z'")) == want
    assert ("c", 86_000, "suspect") in want and ("c", 116_000, "down") in want


def test_flush_batches(spark, tmp_path):
    log = [(i, i // 25) for i in range(100)]
    got = buffers.flush_batches(spark.createDataFrame(log, "idx long, ms long"), 2, 20)
    parts = {}
    for idx, tick, part in rows(got):
        parts.setdefault((tick, part), []).append(idx)
    assert {k: len(v) for k, v in parts.items()} == {(0, 0): 20, (0, 1): 20, (0, 2): 10, (1, 0): 20, (1, 1): 20, (1, 2): 10}
    spark.createDataFrame(log, "idx long, ms long").coalesce(1).write.parquet(f"file://{tmp_path}/log")
    seen = []
    q = buffers.flush_stream(spark.readStream.schema("idx long, ms long").parquet(f"file://{tmp_path}/log"), lambda df, epoch, part: seen.append((epoch, part, df.count())), f"file://{tmp_path}/cp2", 200, 30)
    try:
        for _ in range(300):
            if sum(n for *_, n in seen) >= 100:
                break
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted(seen) == [(0, 0, 30), (0, 1, 30), (0, 2, 30), (0, 3, 10)]
