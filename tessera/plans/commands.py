"""Queries of placement, recovery, commands, stores, buffers and byte
operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.functions.udfs import crc32c, node_hash_text, volume_hash
from tessera.operators import chunks, compliance, listing, namespace, ordering, placement, policy, ranges, refs
from tessera.sources.chunk_store import ChunkStore, export_state, import_state, json_report
from tessera.sources.fixtures import DATA_SHARDS, FACTOR, PARITY_SHARDS, duck, query, table
from tessera.sources.scratch import scratch
from tessera.streaming import buffers

SHARDS = DATA_SHARDS + PARITY_SHARDS
SOURCES = ("volume_chunks", "object_chunks", "multipart_chunks", "inode_chunks", "snapshot_chunks")
_ALL = " UNION ".join(f"SELECT chunk_id FROM {x}" for x in SOURCES)
CACHE = 1000
Frame = Callable[[SparkSession, str], DataFrame]


def _with(*names: str) -> str:
    return duck("", *names).rstrip()


# --- placement as SQL -------------------------------------------------------


def rounds(count: int, keys: str, nodes: str, tag: str) -> str:
    """Tables ``{tag}0 .. (key, node_id)``: one round per replica over the nodes
    not taken, and ``{tag}`` with all of them."""
    out = []
    for r in range(count):
        taken = "".join(f" JOIN {tag}{p} ON {tag}{p}.key = k.key" for p in range(r))
        free = "".join(f" AND n.node_id <> {tag}{p}.node_id" for p in range(r))
        draw = f"ln((cast(concat('0x', substring(sha256(concat(k.key, ':', n.node_id, ':{r}')), 1, 8)) AS bigint) + 0.5) / 4294967296.0) / n.weight"
        out.append(f"{tag}{r} AS MATERIALIZED (SELECT k.key, max_by(n.node_id, struct_pack(d := {draw}, i := n.node_id)) AS node_id FROM {keys} k{taken}, {nodes} n WHERE n.status <> 'offline' AND n.weight > 0{free} GROUP BY k.key)")
    out.append(f"{tag} AS (" + " UNION ALL ".join(f"SELECT key, {r} AS replica, node_id FROM {tag}{r}" for r in range(count)) + ")")
    return ", ".join(out)


_VOLUME_KEYS = "keys AS (SELECT volume_id AS key FROM volumes)"


def _keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "volumes").select(F.col("volume_id").alias("key"))


def _shard_places(s: SparkSession, d: str) -> DataFrame:
    """Slots of each chunk, up to its last shard."""
    keys = table(s, d, "shards").groupBy(F.col("chunk_id").alias("key")).agg((F.max("shard_index") + 1).alias("wanted"))
    return placement.place(keys, table(s, d, "nodes"), SHARDS, F.col("wanted"))


def _shard_repairs(s: SparkSession, d: str) -> DataFrame:
    """Only chunks that can be repaired are placed, up to the last slot lost."""
    health = policy.shard_health(table(s, d, "shards"), None, DATA_SHARDS, PARITY_SHARDS)
    keys = health.where("state = 'degraded'").select(F.col("chunk_id").alias("key"), (F.array_max("missing") + 1).alias("wanted"))
    return policy.shard_repairs(health, placement.place(keys, table(s, d, "nodes"), SHARDS, F.col("wanted")))


_SHARD_KEYS = "keys AS (SELECT DISTINCT chunk_id AS key FROM shards)"
#: FNV-1a over a text from a state, and the finaliser, in 128-bit arithmetic.
_FNV = "list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(substring({text}, cast(i AS int), 1))::uhugeint), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) & 18446744073709551615::uhugeint, {state})"
_KEY_STATE = "((xor(" + _FNV.format(text="volume_id", state="14695981039346656037::uhugeint") + ", 255::uhugeint) * 1099511628211::uhugeint) & 18446744073709551615::uhugeint)"


def _finaliser(h: str) -> str:
    """Steps as nested selects over column ``h``."""
    step = "SELECT * EXCLUDE (h), (xor(h, h >> 33) * {m}::uhugeint) & 18446744073709551615::uhugeint AS h FROM ({q}) x"
    for m in (18397679294719823053, 14181476777654086739):
        h = step.format(m=m, q=h)
    return f"SELECT * EXCLUDE (h), xor(h, h >> 33) AS h FROM ({h}) y"


_HASHED = _finaliser("SELECT k.volume_id AS key, n.node_id, n.weight, n.zone AS domain, " + _FNV.format(text="n.node_id", state="k.h0") + f" AS h FROM (SELECT volume_id, {_KEY_STATE} AS h0 FROM volumes) k, nodes n")
#: CRC-32C of a blob column ``b``, from its hex digits.
_CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_value(" + ", ".join("0" for _ in range(8)) + "), lambda c, z: xor(c >> 1, 2197175160 * (c & 1)), cast(i AS bigint)) AS c FROM (SELECT unnest(range(256)) AS i) a) b)"


def _crc_sql(blob: str) -> str:
    return f"xor(list_reduce(list_transform(range(octet_length({blob})), lambda i: cast(concat('0x', substring(hex({blob}), cast(2 * i + 1 AS int), 2)) AS bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"


# --- fixtures ---------------------------------------------------------------


def _files(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("data"))


def _pieces(size: int) -> str:
    """Chunks of the documents' bytes."""
    return f"pieces AS (SELECT doc_id AS file_id, cast(i AS int) AS position, array_slice(encode(text), i * {size} + 1, (i + 1) * {size}) AS data FROM (SELECT doc_id, text, unnest(range(cast(ceil(octet_length(encode(text)) / {size}.0) AS bigint))) AS i FROM documents) c)"


def _stored(cut: DataFrame) -> DataFrame:
    """Chunks with their stored CRC-32C; one in fifty files has damaged values."""
    return cut.withColumn("crc", crc32c("data").bitwiseXOR(F.when(F.col("file_id") % 50 == 7, 1).otherwise(0)))


def _frames_with_faults(s: SparkSession, d: str) -> DataFrame:
    """Framed documents, some with a wrong byte, a short body, another magic or
    less than a header."""
    framed = chunks.frame_chunks(_files(s, d).select(F.col("file_id").alias("chunk_id"), "data"))
    kind, n = F.col("chunk_id") % 9, F.octet_length("framed")
    flipped = F.concat(F.expr("substring(framed, 1, octet_length(framed) - 1)"), F.unhex(F.lpad(F.hex(F.bitwise_not(F.conv(F.hex(F.expr("substring(framed, octet_length(framed), 1)")), 16, 10).cast("long")).bitwiseAND(F.lit(255))), 2, "0")))
    hurt = (
        F.when((kind == 1) & (n > 16), flipped).when((kind == 2) & (n > 16), F.expr("substring(framed, 1, octet_length(framed) - 1)"))
        .when(kind == 3, F.concat(F.lit(b"XXXX"), F.expr("substring(framed, 5)"))).when(kind == 4, F.expr("substring(framed, 1, 7)")).otherwise(F.col("framed"))
    )
    return chunks.verify_frames(framed.select("chunk_id", hurt.alias("framed"))).select("chunk_id", "verdict")


def _moves(s: SparkSession, d: str) -> DataFrame:
    return compliance.recover_node(table(s, d, "placements"), "node-4", table(s, d, "nodes").where("status = 'ready'"))


_MOVES = """ring AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS n, count(*) OVER () AS total FROM nodes WHERE status = 'ready' AND node_id <> 'node-4'),
    hit AS (SELECT chunk_id, min_by(node_id, slot) FILTER (WHERE node_id <> 'node-4') AS source, count(*) FILTER (WHERE node_id <> 'node-4') AS priority FROM placements GROUP BY chunk_id HAVING bool_or(node_id = 'node-4') AND bool_or(node_id <> 'node-4')),
    free AS (SELECT h.chunk_id, h.source, h.priority, (SELECT list(r.n) FROM ring r WHERE r.node_id NOT IN (SELECT p.node_id FROM placements p WHERE p.chunk_id = h.chunk_id)) AS f FROM hit h),
    folded AS (SELECT list_reduce((SELECT list({'c': chunk_id, 's': source, 'p': priority, 'f': f} ORDER BY chunk_id) FROM free WHERE len(f) > 0),
        lambda a, x: {'cursor': (a.cursor + 1 + list_min(list_transform(x.f, lambda n: (n - a.cursor + a.total) % a.total))) % a.total, 'total': a.total,
            'out': list_append(a.out, {'c': x.c, 's': x.s, 'p': x.p, 't': (a.cursor + list_min(list_transform(x.f, lambda n: (n - a.cursor + a.total) % a.total))) % a.total})},
        {'cursor': 0::bigint, 'total': (SELECT max(total) FROM ring), 'out': []::STRUCT(c VARCHAR, s VARCHAR, p BIGINT, t BIGINT)[]}) AS z),
    moves AS (SELECT o.c AS chunk_id, o.s AS source, r.node_id AS target, o.p AS priority FROM (SELECT unnest(z.out) AS o FROM folded) q JOIN ring r ON r.n = o.t)"""


def _store(s: SparkSession, d: str) -> DataFrame:
    """Put all documents' chunks, drop a third of them, put some again."""
    cut = chunks.split_chunks(_files(s, d), 4096)
    store = ChunkStore(s, scratch(s, "chunk-store"))
    store.put(cut)
    store.delete(cut.where("file_id % 3 = 0").select("chunk_id"))
    store.put(cut.where("file_id % 6 = 0"))
    return store.compact().chunks().select("chunk_id", F.octet_length("data").alias("bytes"), (F.sha2("data", 256) == F.col("chunk_id")).alias("intact"))


_STATE = ("volumes", "nodes", "placements", "snapshots", "quotas")


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    """Export a state, replace it by another, and read that back."""
    path = scratch(s, "state")
    export_state({n: table(s, d, n) for n in _STATE}, path)
    before = import_state(s, path)
    export_state({n: df.where("volume_no % 2 = 0") if n == "volumes" else df for n, df in before.items()}, path)
    parts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in import_state(s, path).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _object_log(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    key = F.concat(F.lit("k-"), (F.col("doc_id") % 700).cast("string"))
    put = docs.select(F.col("doc_id").alias("idx"), F.col("source").alias("bucket"), key.alias("key"), F.when(F.col("doc_id") % 9 == 0, "delete").otherwise("put").alias("op"), body.alias("data"))
    return namespace.object_rows(put, 4096)


_OBJECTS = """WITH log AS (SELECT doc_id AS idx, source AS bucket, concat('k-', doc_id % 700) AS key, CASE WHEN doc_id % 9 = 0 THEN 'delete' ELSE 'put' END AS op, coalesce(text, '') AS body FROM documents),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY idx DESC) AS rn FROM log) x WHERE rn = 1 AND op = 'put')
    SELECT bucket, key, octet_length(encode(body)) AS size, md5(body) AS etag, list_transform(range(cast(ceil(octet_length(encode(body)) / 4096.0) AS bigint)), lambda i: sha256(array_slice(encode(body), i * 4096 + 1, (i + 1) * 4096))) AS chunk_list FROM last"""


def _creates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fs_log").where("op = 'create'").select("idx", "parent", "name", F.element_at(F.array(*[F.lit(k) for k in namespace.CREATED]), (F.col("idx") % 4 + 1).cast("int")).alias("op"))


_ENTRY_LOG = "entry_log AS (SELECT idx, op, parent, name, ino FROM fs_log WHERE op <> 'rename')"


def _bucket_requests(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("idx"), F.concat(F.lit("bucket-"), (F.col("user_id") % 40).cast("string")).alias("bucket"), F.when(F.col("event_id") % 6 == 0, "delete").otherwise("put").alias("op"), F.element_at(F.array(*[F.lit(x) for x in ("AES256", "aws:kms", "DES")]), (F.col("event_id") % 3 + 1).cast("int")).alias("algorithm"))


_REQUESTS = "requests AS (SELECT event_id AS idx, concat('bucket-', user_id % 40) AS bucket, CASE WHEN event_id % 6 = 0 THEN 'delete' ELSE 'put' END AS op, ['AES256', 'aws:kms', 'DES'][event_id % 3 + 1] AS algorithm FROM events)"
_JUDGED = "judged AS (SELECT *, CASE WHEN cast(substring(bucket, 8) AS int) >= 30 THEN 'NoSuchBucket' WHEN op = 'put' AND algorithm NOT IN ('AES256', 'aws:kms') THEN 'MalformedXML' ELSE 'ok' END AS outcome FROM requests)"


def _known_buckets(s: SparkSession) -> DataFrame:
    return s.range(30).select(F.concat(F.lit("bucket-"), F.col("id").cast("string")).alias("bucket"))


def _commands(s: SparkSession, d: str) -> DataFrame:
    """Create and delete commands on volumes and snapshots."""
    v = table(s, d, "volumes")
    made = v.select(F.col("volume_no").alias("idx"), F.lit("create").alias("verb"), F.lit("volumes").alias("bucket"), F.col("volume_id").alias("key"), F.struct("volume_id", "pool", "size_bytes").alias("value"))
    gone = v.where("volume_no % 5 = 0").select((F.col("volume_no") + 100_000_000).alias("idx"), F.lit("delete").alias("verb"), F.lit("volumes").alias("bucket"), F.col("volume_id").alias("key"), F.struct("volume_id", "pool", "size_bytes").alias("value"))
    return namespace.command_rows(made.unionByName(gone))


def _gc_nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nodes").select("node_id", (F.col("node_no") % 9 == 0).alias("fenced"))


def _held_map(s: SparkSession, d: str) -> DataFrame:
    """Rows of the chunk map that node-4 holds, with the copies they want."""
    wanted = F.when(F.col("mode") == "erasure_coding", SHARDS).otherwise(FACTOR)
    here = table(s, d, "placements").where("node_id = 'node-4'").select("chunk_id").distinct()
    return table(s, d, "volume_chunks").join(here, "chunk_id", "left_semi").join(table(s, d, "volumes"), "volume_id").select("volume_id", "position", wanted.alias("wanted"))


_HELD = f"held AS (SELECT c.volume_id, c.position, CASE WHEN v.mode = 'erasure_coding' THEN {SHARDS} ELSE {FACTOR} END AS wanted FROM volume_chunks c JOIN volumes v ON c.volume_id = v.volume_id WHERE c.chunk_id IN (SELECT chunk_id FROM placements WHERE node_id = 'node-4')), keys AS (SELECT concat(volume_id, ':', position) AS key FROM held)"
_ENTRIES = "entries AS (SELECT volume_id, off, max(event_id) AS created FROM writes GROUP BY volume_id, off)"
_LEASE_STEP = """CASE e.op
    WHEN 'acquire' THEN CASE WHEN len(list_filter(h, lambda l: l.expires_at >= e.moment AND l.owner <> e.owner AND NOT (l.kind = 'read' AND e.kind = 'read') AND l.start_off < CASE WHEN e.end_off = -1 THEN 9223372036854775807 ELSE e.end_off END AND e.start_off < CASE WHEN l.end_off = -1 THEN 9223372036854775807 ELSE l.end_off END)) > 0
        THEN list_filter(h, lambda l: l.expires_at >= e.moment)
        ELSE list_append(list_filter(h, lambda l: l.expires_at >= e.moment AND l.lease <> e.lease), {'lease': e.lease, 'owner': e.owner, 'start_off': e.start_off, 'end_off': e.end_off, 'kind': e.kind, 'expires_at': e.expires_at}) END
    WHEN 'renew' THEN list_transform(h, lambda l: CASE WHEN l.lease = e.lease AND l.expires_at >= e.moment THEN {'lease': l.lease, 'owner': l.owner, 'start_off': l.start_off, 'end_off': l.end_off, 'kind': l.kind, 'expires_at': e.expires_at} ELSE l END)
    ELSE list_filter(h, lambda l: NOT (l.lease = e.lease AND l.owner = e.owner)) END"""
_LEASE = "STRUCT(lease VARCHAR, owner VARCHAR, start_off BIGINT, end_off BIGINT, kind VARCHAR, expires_at BIGINT)"
_LEASES = f"""folded AS (SELECT ino, list_reduce(list({{'idx': idx, 'op': op, 'lease': lease, 'owner': owner, 'start_off': start_off, 'end_off': end_off, 'kind': kind, 'moment': moment, 'expires_at': expires_at}} ORDER BY idx), lambda h, e: {_LEASE_STEP}, []::{_LEASE}[]) AS held FROM leases GROUP BY ino)"""


def _buffer_writes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "writes").select("volume_id", F.expr("off div 4194304").alias("chunk"), (F.col("event_id") * 3).alias("ms"), F.col("event_id").alias("idx"), "len")


def _frames() -> dict[str, tuple[Frame, str | None]]:
    t = table
    return {
        # scalars
        "p2_crc32c": (lambda s, d: t(s, d, "objects").select("page_id", crc32c(F.concat("bucket", F.lit("/"), "key").cast("binary")).alias("crc")), f"{_with('objects')}, {_CRC_TABLE} SELECT page_id, {_crc_sql('b')} AS crc FROM (SELECT page_id, encode(concat(bucket, '/', key)) AS b FROM objects) o, crc_table"),
        "p13_backend_offset": (lambda s, d: t(s, d, "bitmaps").select("chunk_index", exprs.backend_offset(F.col("chunk_index") * exprs.CHUNK_BYTES, F.col("chunk_index") % 64).alias("off")).distinct(), duck("SELECT DISTINCT chunk_index, chunk_index * 4194304 + chunk_index % 64 * 65536 AS off FROM bitmaps", "bitmaps")),
        "p14_bitmap_bits": (
            lambda s, d: (lambda i: t(s, d, "bitmaps").select("chunk_index", exprs.bitmap_set(F.col("live"), i).alias("put"), exprs.bitmap_unset(F.col("live"), i).alias("cleared"), exprs.bitmap_test(F.col("live"), i).alias("was"), exprs.bitmap_full(F.col("live").bitwiseOR(F.bitwise_not(F.col("live")))).alias("whole")))(F.col("chunk_index") % 62),
            duck("SELECT chunk_index, live | (1::bigint << cast(chunk_index % 62 AS int)) AS put, live & ~(1::bigint << cast(chunk_index % 62 AS int)) AS cleared, (live >> cast(chunk_index % 62 AS int)) & 1 = 1 AS was, true AS whole FROM bitmaps", "bitmaps"),
        ),
        "p17_volume_hash": (lambda s, d: t(s, d, "volumes").select("volume_id", volume_hash("volume_id").alias("hash")), f"{_with('volumes')}, {_CRC_TABLE} SELECT volume_id, printf('%08x%08x', a, b) AS hash FROM (SELECT volume_id, {_crc_sql('encode(volume_id)')} AS a, {_crc_sql('encode(reverse(volume_id))')} AS b FROM volumes, crc_table) x"),
        "p19_node_hash": (lambda s, d: t(s, d, "placements").select("chunk_id", "node_id", node_hash_text("chunk_id", "node_id").alias("hash")), _with("placements") + " SELECT key AS chunk_id, node_id, lpad(lower(to_hex(h)), 16, '0') AS hash FROM (" + _finaliser("SELECT chunk_id AS key, node_id, " + _FNV.format(text="node_id", state="h0") + " AS h FROM (SELECT chunk_id, node_id, " + _KEY_STATE.replace("volume_id", "chunk_id") + " AS h0 FROM placements) k") + ") z"),
        "u4_ordered_distinct": (
            lambda s, d: t(s, d, "placements").join(t(s, d, "nodes").select("node_id", "rack"), "node_id").groupBy("chunk_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("slot", "rack"))), lambda x: x["rack"])), ",").alias("racks")),
            duck("SELECT chunk_id, string_agg(rack, ',' ORDER BY slot) AS racks FROM (SELECT p.chunk_id, n.rack, min(p.slot) AS slot FROM placements p JOIN nodes n ON p.node_id = n.node_id GROUP BY p.chunk_id, n.rack) x GROUP BY chunk_id", "placements", "nodes"),
        ),
        "u6_array_add_drop": (
            lambda s, d: t(s, d, "placements").groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "node_id"))), lambda x: x["node_id"]).alias("l")).select("chunk_id", F.array_join(exprs.array_add(F.col("l"), F.lit("node-7")), ",").alias("added"), F.array_join(exprs.array_drop(F.col("l"), F.lit("node-7")), ",").alias("dropped")),
            duck("SELECT chunk_id, concat(string_agg(node_id, ',' ORDER BY slot), CASE WHEN bool_or(node_id = 'node-7') THEN '' ELSE ',node-7' END) AS added, coalesce(string_agg(node_id, ',' ORDER BY slot) FILTER (WHERE node_id <> 'node-7'), '') AS dropped FROM placements GROUP BY chunk_id", "placements"),
        ),
        "ag22_source_nodes": (lambda s, d: t(s, d, "shards").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("node_id")), ",").alias("sources")), duck("SELECT chunk_id, string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS sources FROM shards GROUP BY chunk_id", "shards")),
        "ag23_latency_average": (
            lambda s, d: ranges.latency_average(t(s, d, "change_log"), "key", "value", "idx"),
            duck("SELECT key, list_reduce(v, lambda a, x: (9 * a + x) // 10) AS average FROM (SELECT key, list(value ORDER BY idx) AS v FROM change_log GROUP BY key) x", "change_log"),
        ),
        # orders
        "t6_repair_queue_order": (lambda s, d: ordering.ranked(t(s, d, "heal_tasks").where("status = 'pending'"), [F.col("priority"), F.expr("created_at div 4096")], ["created_at", "task_id"]).select("task_id", "priority", "rank"), duck("SELECT task_id, priority, row_number() OVER (ORDER BY priority, created_at, task_id) AS rank FROM heal_tasks WHERE status = 'pending'", "heal_tasks")),
        "t7_recovery_order": (
            lambda s, d: ordering.ranked(t(s, d, "placements").where("node_id <> 'node-4'").groupBy("chunk_id").agg(F.count("*").alias("surviving")), [F.col("surviving"), F.substring("chunk_id", 1, 8)], ["chunk_id"]),
            duck("SELECT chunk_id, surviving, row_number() OVER (ORDER BY surviving, chunk_id) AS rank FROM (SELECT chunk_id, count(*) AS surviving FROM placements WHERE node_id <> 'node-4' GROUP BY chunk_id) x", "placements"),
        ),
        "t8_task_order": (lambda s, d: ordering.ranked(t(s, d, "heal_tasks").where("status IN ('pending', 'in-progress')"), [F.col("priority"), F.expr("created_at div 4096")], ["created_at", "task_id"]).select("task_id", "status", "priority", "rank"), duck("SELECT task_id, status, priority, row_number() OVER (ORDER BY priority, created_at, task_id) AS rank FROM heal_tasks WHERE status IN ('pending', 'in-progress')", "heal_tasks")),
        "t9_overflow_drain": (
            lambda s, d: ordering.drain_overflow(query(s, d, "SELECT volume_id, off, max(event_id) AS created FROM writes GROUP BY volume_id, off", "writes"), CACHE).select("volume_id", "off"),
            f"{_with('writes')}, {_ENTRIES} SELECT volume_id, off FROM (SELECT *, row_number() OVER (ORDER BY created) AS age, count(*) OVER () AS n FROM entries) x WHERE age <= n - {CACHE * 3 // 4}",
        ),
        # placement and recovery
        "c2_placement": (lambda s, d: placement.place(_keys(s, d), t(s, d, "nodes"), 3), f"{_with('nodes', 'volumes')}, {_VOLUME_KEYS}, {rounds(3, 'keys', 'nodes', 'r')} SELECT * FROM r"),
        "c1_place_by_domain": (
            lambda s, d: placement.place_by_domain(_keys(s, d), t(s, d, "nodes"), 3, "zone"),
            f"{_with('nodes', 'volumes')}, hashed AS ({_HASHED}), draws AS (SELECT key, node_id, domain, -ln(CASE WHEN h % 2 = 0 THEN h + 1 ELSE h END::double / 18446744073709551615.0::double) / weight AS d FROM hashed),"
            " ranked AS (SELECT *, row_number() OVER (PARTITION BY key, domain ORDER BY d, node_id) AS turn, min(d) OVER (PARTITION BY key, domain) AS best FROM draws)"
            " SELECT key, replica, node_id FROM (SELECT key, node_id, row_number() OVER (PARTITION BY key ORDER BY turn, best, domain) - 1 AS replica FROM ranked) x WHERE replica < 3",
        ),
        "c3_movement": (
            lambda s, d: placement.movement(_keys(s, d), t(s, d, "nodes").where("node_no <> 3"), t(s, d, "nodes"), 2),
            f"{_with('nodes', 'volumes')}, {_VOLUME_KEYS}, fewer AS (SELECT * FROM nodes WHERE node_no <> 3), {rounds(2, 'keys', 'fewer', 'f')}, {rounds(2, 'keys', 'nodes', 'r')} SELECT f.key, f.replica, f.node_id, r.node_id AS new_node FROM f JOIN r ON f.key = r.key AND f.replica = r.replica WHERE f.node_id <> r.node_id",
        ),
        "w10_backend": (
            lambda s, d: placement.pick_backend(placement.place(_keys(s, d), t(s, d, "nodes"), 2), t(s, d, "backends")),
            f"{_with('nodes', 'volumes', 'backends')}, {_VOLUME_KEYS}, {rounds(2, 'keys', 'nodes', 'r')} SELECT r.key, r.replica, r.node_id, max_by(b.backend_id, struct_pack(d := ln((cast(concat('0x', substring(sha256(concat(r.key, ':', b.backend_id, ':', r.replica)), 1, 8)) AS bigint) + 0.5) / 4294967296.0) / b.weight, i := b.backend_id)) AS backend_id FROM r JOIN backends b ON r.node_id = b.node_id GROUP BY r.key, r.replica, r.node_id",
        ),
        "j20_misplaced": (
            lambda s, d: placement.misplaced(_held_map(s, d), t(s, d, "nodes"), "node-4"),
            f"{_with('nodes', 'volumes', 'volume_chunks', 'placements')}, {_HELD}, {rounds(SHARDS, 'keys', 'nodes', 'r')} SELECT h.volume_id, h.position, min_by(r.node_id, r.replica) AS target FROM held h JOIN r ON r.key = concat(h.volume_id, ':', h.position) AND r.replica < h.wanted GROUP BY h.volume_id, h.position HAVING NOT bool_or(r.node_id = 'node-4')",
        ),
        "c5_actions": (
            lambda s, d: compliance.actions(t(s, d, "placements"), t(s, d, "nodes"), FACTOR),
            f"""{_with("nodes", "placements")}, held AS (SELECT chunk_id, count(*) AS n, min_by(node_id, slot) AS source FROM placements GROUP BY chunk_id), keys AS (SELECT chunk_id AS key FROM held WHERE n < {FACTOR}), {rounds(FACTOR, "keys", "nodes", "r")},
            named AS (SELECT r.key AS chunk_id, h.source, r.node_id AS target, h.n, row_number() OVER (PARTITION BY r.key ORDER BY r.replica) AS turn FROM r JOIN held h ON h.chunk_id = r.key WHERE NOT EXISTS (SELECT 1 FROM placements p WHERE p.chunk_id = r.key AND p.node_id = r.node_id))
            SELECT chunk_id, 'replicate' AS action, source, target FROM named WHERE turn <= {FACTOR} - n UNION ALL SELECT chunk_id, 'remove', node_id, NULL FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY slot) AS rn FROM placements) p WHERE rn > {FACTOR}""",
        ),
        "c6_shard_repairs": (
            _shard_repairs,
            f"""{_with("nodes", "shards")}, {_SHARD_KEYS}, {rounds(SHARDS, "keys", "nodes", "r")}, lost AS (SELECT k.key AS chunk_id, i AS shard_index FROM keys k, (SELECT unnest(range({SHARDS})) AS i) x WHERE NOT EXISTS (SELECT 1 FROM shards s WHERE s.chunk_id = k.key AND s.shard_index = x.i)
                AND (SELECT count(DISTINCT shard_index) FROM shards s WHERE s.chunk_id = k.key) >= {DATA_SHARDS}) SELECT l.chunk_id, l.shard_index, r.node_id AS target FROM lost l JOIN r ON r.key = l.chunk_id AND r.replica = l.shard_index""",
        ),
        "b14_shard_nodes": (lambda s, d: chunks.distribute_shards(t(s, d, "shards").select("chunk_id", "shard_index"), _shard_places(s, d)), f"{_with('nodes', 'shards')}, {_SHARD_KEYS}, {rounds(SHARDS, 'keys', 'nodes', 'r')} SELECT s.chunk_id, s.shard_index, r.node_id FROM shards s JOIN r ON r.key = s.chunk_id AND r.replica = s.shard_index"),
        "c10_recovery_plan": (_moves, f"{_with('nodes', 'placements')}, {_MOVES} SELECT * FROM moves"),
        "c11_update_placements": (
            lambda s, d: compliance.update_placements(t(s, d, "placements"), _moves(s, d), "node-4"),
            f"{_with('nodes', 'placements')}, {_MOVES} SELECT p.chunk_id, string_agg(CASE WHEN p.slot = x.hit AND m.target IS NOT NULL THEN m.target ELSE p.node_id END, ',' ORDER BY p.slot) AS nodes FROM placements p LEFT JOIN moves m ON p.chunk_id = m.chunk_id LEFT JOIN (SELECT chunk_id, min(slot) AS hit FROM placements WHERE node_id = 'node-4' GROUP BY chunk_id) x ON p.chunk_id = x.chunk_id GROUP BY p.chunk_id",
        ),
        "j11_destinations": (
            lambda s, d: _moves(s, d).select("chunk_id", "target").join(t(s, d, "placements").select("chunk_id", F.col("node_id").alias("target"), F.lit(1).alias("held")), ["chunk_id", "target"], "left").where("held IS NULL").select("chunk_id", "target"),
            f"{_with('nodes', 'placements')}, {_MOVES} SELECT chunk_id, target FROM moves",
        ),
        "g20_gc_run": (
            lambda s, d: refs.collect_garbage(t(s, d, "placements"), refs.referenced_chunks(*[t(s, d, x) for x in SOURCES]), _gc_nodes(s, d)),
            f"{_with('placements', 'nodes', *SOURCES)}, live AS ({_ALL}), marked AS (SELECT p.node_id, p.chunk_id, n.node_no % 9 = 0 AS fenced, l.chunk_id IS NOT NULL AS keep FROM (SELECT DISTINCT node_id, chunk_id FROM placements) p JOIN nodes n ON p.node_id = n.node_id LEFT JOIN live l ON p.chunk_id = l.chunk_id) SELECT node_id, count(CASE WHEN NOT keep AND NOT fenced THEN 1 END) AS deleted, count(CASE WHEN keep OR fenced THEN 1 END) AS kept, bool_or(fenced) AS refused FROM marked GROUP BY node_id",
        ),
        # folds and buffers
        "st6_leases": (lambda s, d: ranges.fold_leases(t(s, d, "leases")), f"{_with('leases')}, {_LEASES} SELECT ino, l.* FROM (SELECT ino, unnest(held) AS l FROM folded) x"),
        "st14_new_inodes": (lambda s, d: namespace.allocate_inodes(t(s, d, "fs_log").where("op = 'create'"), 512).select("idx", "parent", "new_ino"), duck("SELECT idx, parent, row_number() OVER (ORDER BY idx) + 2 AS new_ino FROM fs_log WHERE op = 'create'", "fs_log")),
        "st3_flush_batches": (
            lambda s, d: buffers.flush_batches(t(s, d, "writes").select(F.col("event_id").alias("idx"), (F.col("event_id") * 3).alias("ms")), 100, 10),
            duck("SELECT idx, tick, (n - 1) // 10 AS part FROM (SELECT event_id AS idx, event_id * 3 // 100 AS tick, row_number() OVER (PARTITION BY event_id * 3 // 100 ORDER BY event_id) AS n FROM writes) x", "writes"),
        ),
        "st4_buffer_flushes": (
            lambda s, d: buffers.buffer_flushes(_buffer_writes(s, d), 2000),
            _with("writes") + """, w AS (SELECT volume_id, off // 4194304 AS chunk, list({'ms': event_id * 3, 'len': len} ORDER BY event_id) AS e FROM writes GROUP BY 1, 2),
            f AS (SELECT volume_id, chunk, list_reduce(e, lambda a, x: CASE WHEN len(a) > 0 AND x.ms < a[-1].opened + 2000 THEN list_append(a[:len(a) - 1], {'opened': a[-1].opened, 'writes': a[-1].writes + 1, 'bytes': a[-1].bytes + x.len}) ELSE list_append(a, {'opened': x.ms, 'writes': 1::bigint, 'bytes': x.len}) END, []::STRUCT(opened BIGINT, writes BIGINT, bytes BIGINT)[]) AS b FROM w)
            SELECT volume_id, chunk, b.* FROM (SELECT volume_id, chunk, unnest(b) AS b FROM f) x""",
        ),
        "st5_node_transitions": (
            lambda s, d: buffers.node_transitions(t(s, d, "heartbeats"), 30_000, 60_000, 10**10),
            _with("heartbeats") + """, g AS (SELECT node_id, ms, coalesce(lead(ms) OVER w, 10000000000) - ms AS gap, ms - lag(ms) OVER w AS before FROM (SELECT DISTINCT * FROM heartbeats) h WINDOW w AS (PARTITION BY node_id ORDER BY ms))
            SELECT node_id, ms, 'healthy' AS state FROM g WHERE before IS NULL OR before > 30000 UNION ALL SELECT node_id, ms + 30000, 'suspect' FROM g WHERE gap > 30000 UNION ALL SELECT node_id, ms + 60000, 'down' FROM g WHERE gap > 60000""",
        ),
        # commands
        "g2_created_inodes": (
            lambda s, d: namespace.created_inodes(_creates(s, d)),
            duck("SELECT idx, parent, name, row_number() OVER (ORDER BY idx) + 2 AS ino, ['file', 'dir', 'symlink', 'special'][idx % 4 + 1] AS kind, [1, 2, 1, 1][idx % 4 + 1] AS links FROM fs_log WHERE op = 'create'", "fs_log"),
        ),
        "g6_link_accounting": (
            lambda s, d: namespace.link_accounting(t(s, d, "fs_log").where("op <> 'rename'")),
            f"{_with('fs_log')}, {_ENTRY_LOG}, c AS (SELECT *, CASE WHEN op <> 'unlink' THEN ino END AS now FROM entry_log), w AS (SELECT *, lag(now) OVER (PARTITION BY parent, name ORDER BY idx) AS was FROM c) SELECT ino, cast(sum(d) AS bigint) AS links FROM (SELECT now AS ino, 1 AS d FROM w WHERE now IS NOT NULL UNION ALL SELECT was, -1 FROM w WHERE was IS NOT NULL AND was IS DISTINCT FROM now) x GROUP BY ino HAVING sum(d) > 0",
        ),
        "g7_objects": (lambda s, d: namespace.object_state(_object_log(s, d)).select("bucket", "key", "size", "etag", F.array_join("chunks", ",").alias("chunks")), f"SELECT bucket, key, size, etag, coalesce(array_to_string(chunk_list, ','), '') AS chunks FROM ({_OBJECTS}) o"),
        "g10_encryption": (lambda s, d: namespace.encryption_configs(_bucket_requests(s, d), _known_buckets(s)), f"WITH {_REQUESTS}, {_JUDGED} SELECT idx, bucket, op, outcome, algorithm FROM judged"),
        "g10_encryption_state": (
            lambda s, d: namespace.encryption_state(namespace.encryption_configs(_bucket_requests(s, d), _known_buckets(s))),
            f"WITH {_REQUESTS}, {_JUDGED} SELECT bucket, algorithm FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY idx DESC) AS rn FROM judged WHERE outcome = 'ok') x WHERE rn = 1 AND op = 'put'",
        ),
        "g12_reservations": (
            lambda s, d: namespace.reservations(t(s, d, "usage_log").select("name_no", F.col("event_id").alias("idx"), F.col("delta").alias("bytes")), t(s, d, "usage_log").select("name_no").distinct().withColumn("hard", F.col("name_no") % 500), "name_no"),
            _with("usage_log") + """ SELECT name_no, s.used, s.refused FROM (SELECT name_no, list_reduce(list(delta ORDER BY event_id), lambda a, x: CASE WHEN x > 0 AND name_no % 500 > 0 AND a.used + x > name_no % 500 THEN {'used': a.used, 'refused': a.refused + 1} ELSE {'used': greatest(a.used + x, 0), 'refused': a.refused} END, {'used': 0::bigint, 'refused': 0::bigint}) AS s FROM usage_log GROUP BY name_no) x""",
        ),
        "g23_command_rows": (
            _commands,
            duck("SELECT volume_no AS idx, 'put' AS op, 'volumes' AS bucket, volume_id AS key, to_json({'volume_id': volume_id, 'pool': pool, 'size_bytes': size_bytes})::varchar AS value FROM volumes UNION ALL SELECT volume_no + 100000000, 'delete', 'volumes', volume_id, NULL FROM volumes WHERE volume_no % 5 = 0", "volumes"),
        ),
        # stores and reports
        "sc12_chunk_store": (
            _store,
            f"WITH {_pieces(4096)}, kept AS (SELECT sha256(data) AS chunk_id, max(octet_length(data)) AS bytes, bool_or(file_id % 6 = 0) AS again, bool_or(file_id % 3 = 0) AS gone FROM pieces GROUP BY 1) SELECT chunk_id, bytes, true AS intact FROM kept WHERE again OR NOT gone",
        ),
        "sc16_state_round_trip": (_round_trip, f"{_with(*_STATE)} SELECT 'volumes' AS name, count(*) AS n FROM volumes WHERE volume_no % 2 = 0 UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', count(*) FROM {n}" for n in _STATE[1:])),
        "sc19_json_report": (lambda s, d: json_report(t(s, d, "volumes").groupBy("pool").agg(F.count("*").alias("volumes"), F.sum("size_bytes").alias("bytes"))), duck("SELECT to_json({'pool': pool, 'volumes': count(*), 'bytes': cast(sum(size_bytes) AS bigint)})::varchar AS json FROM volumes GROUP BY pool", "volumes")),
        "sc20_listing_rows": (
            lambda s, d: listing.listing_rows(t(s, d, "objects"), "bucket-3", "e", "/", 20),
            duck("""SELECT row_number() OVER (ORDER BY name) AS position, * FROM (SELECT CASE WHEN is_prefix THEN 'CommonPrefixes' ELSE 'Contents' END AS element, name, max(CASE WHEN NOT is_prefix THEN size END) AS size, count(*) AS keys FROM (
                SELECT size, strpos(substring(key, 2), '/') > 0 AS is_prefix, CASE WHEN strpos(substring(key, 2), '/') > 0 THEN substring(key, 1, 1 + strpos(substring(key, 2), '/')) ELSE key END AS name FROM objects WHERE bucket = 'bucket-3' AND starts_with(key, 'e')) x GROUP BY is_prefix, name ORDER BY name LIMIT 20) y""", "objects"),
        ),
        # bytes
        "b1_chunk_ids": (
            lambda s, d: chunks.split_chunks(_files(s, d), 4096).select("file_id", "position", "chunk_id", crc32c("data").alias("crc")),
            f"WITH {_pieces(4096)}, {_CRC_TABLE} SELECT file_id, position, sha256(data) AS chunk_id, {_crc_sql('data')} AS crc FROM pieces, crc_table",
        ),
        "b4_dedup": (lambda s, d: chunks.deduplicate(chunks.split_chunks(_files(s, d), 512)), f"WITH {_pieces(512)} SELECT sha256(data) AS chunk_id, count(*) AS refs, max(octet_length(data)) AS bytes FROM pieces GROUP BY 1"),
        "b6_read_range": (lambda s, d: chunks.read_range(chunks.split_chunks(_files(s, d), 256), 256, 300, 40).select("file_id", F.hex("data").alias("bytes")), "SELECT doc_id AS file_id, hex(array_slice(encode(text), 301, 340)) AS bytes FROM documents WHERE octet_length(encode(text)) > 256"),
        "b8_truncate": (lambda s, d: chunks.truncate(_files(s, d), 500).select("file_id", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("sha")), "SELECT doc_id AS file_id, 500 AS bytes, sha256(array_slice(encode(text) || unhex(repeat('00', 500)), 1, 500)) AS sha FROM documents WHERE text IS NOT NULL"),
        "p9_verify_frames": (_frames_with_faults, "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 9 = 1 AND n > 0 THEN 'bad_checksum' WHEN doc_id % 9 = 2 AND n > 0 THEN 'truncated' WHEN doc_id % 9 = 3 THEN 'bad_magic' WHEN doc_id % 9 = 4 THEN 'short' ELSE 'ok' END AS verdict FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) d"),
        "ag20_scrub": (
            lambda s, d: chunks.scrub(_stored(chunks.split_chunks(_files(s, d), 4096))),
            f"WITH {_pieces(4096)} SELECT count(*) AS checked, count(CASE WHEN file_id % 50 = 7 THEN 1 END) AS errors FROM pieces",
        ),
        "ag20_corrupted": (lambda s, d: chunks.corrupted(_stored(chunks.split_chunks(_files(s, d), 4096))).select("file_id", "position", "chunk_id"), f"WITH {_pieces(4096)} SELECT file_id, position, sha256(data) AS chunk_id FROM pieces WHERE file_id % 50 = 7"),
    }


def queries() -> dict[str, Frame]:
    return {n: f for n, (f, _) in _frames().items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _frames().items() if sql}
