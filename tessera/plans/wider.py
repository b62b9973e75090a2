"""Queries of policy, namespace, sparse-map and codec operators, with their
SQL. As in ``registry``, ``BOTH`` runs one text on both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators import chunks, compliance, listing, namespace, placement, policy, ranges, refs
from tessera.sources.fixtures import DATA_SHARDS, FACTOR, PARITY_SHARDS, T0, duck, query, table

TTL = 60
SHARDS = DATA_SHARDS + PARITY_SHARDS

#: name -> (SQL, tables it reads)
BOTH: dict[str, tuple[str, tuple[str, ...]]] = {
    "sc2_bucket_scan": ("SELECT page_id, bucket, key, size FROM objects", ("objects",)),
    "sc10_volume_ids": ("SELECT volume_id FROM volumes", ("volumes",)),
    "sc11_locations": ("SELECT chunk_id, node_id, slot FROM placements", ("placements",)),
    "sc14_chunk_ids": ("SELECT DISTINCT chunk_id FROM placements", ("placements",)),
    "f1_bucket_prefix": ("SELECT page_id, key FROM objects WHERE bucket = 'bucket-3' AND key LIKE 'e%'", ("objects",)),
    "f2_directory": ("SELECT name, ino FROM dirents WHERE parent = 7", ("dirents",)),
    "f9_shards_of_chunk": ("SELECT shard_index, node_id FROM shards WHERE chunk_id = 'chunk-9'", ("shards",)),
    "f10_keys_after": ("SELECT page_id, key FROM objects WHERE key > 'es'", ("objects",)),
    "f11_parts_after": ("SELECT volume_id, position + 1 AS part_number FROM volume_chunks WHERE position + 1 > 2", ("volume_chunks",)),
    "f13_devices": ("SELECT device, bytes FROM devices WHERE kind = 'ECONOMY' AND bytes >= 21474836480", ("devices",)),
    "f18_dead_owners": (f"SELECT node_id FROM nodes WHERE {T0} - last_heartbeat >= 5 OR status = 'offline'", ("nodes",)),
    "f21_healthy_replicas": ("SELECT p.chunk_id, p.node_id FROM placements p JOIN nodes n ON p.node_id = n.node_id WHERE n.status = 'ready'", ("placements", "nodes")),
    "p1_content_id": ("SELECT doc_id, sha256(text) AS id FROM documents", ("documents",)),
    "p4_etag": ("SELECT doc_id, md5(text) AS etag FROM documents", ("documents",)),
    "p7_is_shard": ("SELECT chunk_id, chunk_id LIKE '%:shard:%' AS is_shard FROM placements", ("placements",)),
    "j16_owner_node": ("SELECT o.ino, o.address, min(n.node_id) AS node_id FROM (SELECT DISTINCT user_id % 50 AS ino, concat('10.0.0.', cast(user_id % 40 AS varchar(20))) AS address FROM events) o JOIN (SELECT node_id, concat('10.0.0.', cast(node_no % 25 AS varchar(20))) AS address FROM nodes) n ON o.address = n.address GROUP BY o.ino, o.address", ("events", "nodes")),
    "ag12_node_weight": ("SELECT node_id, cast(sum(weight) AS bigint) AS weight, count(*) AS backends FROM backends GROUP BY node_id", ("backends",)),
    "ag5_all_pools": ("SELECT x.pool, count(v.volume_id) AS volumes, coalesce(cast(sum(v.size_bytes) AS bigint), 0) AS bytes FROM (SELECT DISTINCT pool FROM volumes UNION SELECT 'empty' AS pool) x LEFT JOIN volumes v ON x.pool = v.pool GROUP BY x.pool", ("volumes",)),
    "ag10_rack_capacity": ("SELECT rack, cast(sum(total_capacity) AS bigint) AS total, cast(sum(available_capacity) AS bigint) AS available FROM nodes WHERE status = 'ready' GROUP BY rack", ("nodes",)),
    "ag17_replica_totals": ("SELECT volume_id, count(*) AS writes, cast(sum(len) AS bigint) AS bytes, max(event_id) AS latest FROM writes GROUP BY volume_id", ("writes",)),
    "t10_drain_volume": ("SELECT off, max(event_id) AS event_id FROM writes WHERE volume_id = 'vol-3' GROUP BY off", ("writes",)),
    "st12_last_write": ("SELECT volume_id, off, max(event_id) AS event_id FROM writes GROUP BY volume_id, off", ("writes",)),
    "g21_bucket_list": ("SELECT bucket, count(*) AS objects, cast(sum(size) AS bigint) AS bytes FROM objects GROUP BY bucket", ("objects",)),
    "g22_node_get": ("SELECT node_id, zone, rack, status FROM nodes WHERE node_id = 'node-2'", ("nodes",)),
}

_LIVE = f"(SELECT node_id FROM nodes WHERE last_heartbeat >= {T0 - TTL} AND status <> 'offline')"
_HEALTH = f"""health AS (SELECT vc.volume_id, vc.chunk_id, coalesce(h.live, 0) AS live FROM volume_chunks vc LEFT JOIN
    (SELECT p.chunk_id, count(l.node_id) AS live FROM placements p LEFT JOIN {_LIVE} l ON p.node_id = l.node_id GROUP BY p.chunk_id) h ON vc.chunk_id = h.chunk_id)"""
_BASE = ("nodes", "volumes", "volume_chunks", "placements")
_SPREAD = f"""WITH {{with_}}, ring AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS n, count(*) OVER () AS total FROM nodes WHERE status = 'ready'),
    hit AS (SELECT chunk_id, min_by(CASE WHEN node_id <> 'node-4' THEN node_id END, CASE WHEN node_id <> 'node-4' THEN slot END) AS source, cast(concat('0x', substring(sha256(concat(chunk_id, ':rotate')), 1, 8)) AS bigint) AS h FROM placements GROUP BY chunk_id HAVING count(CASE WHEN node_id = 'node-4' THEN 1 END) > 0)
    SELECT chunk_id, source, min_by(node_id, turn) AS target FROM (SELECT h.chunk_id, h.source, r.node_id, (r.n - h.h % r.total + r.total) % r.total AS turn FROM hit h, ring r
    WHERE NOT EXISTS (SELECT 1 FROM placements p WHERE p.chunk_id = h.chunk_id AND p.node_id = r.node_id)) x WHERE source IS NOT NULL GROUP BY chunk_id, source"""
_CHANGES = """changes AS (SELECT idx, parent, name, CASE WHEN op = 'unlink' THEN NULL ELSE ino END AS ino FROM fs_log WHERE op <> 'rename'
    UNION ALL SELECT idx, parent, name, NULL FROM fs_log WHERE op = 'rename' AND NOT (parent = new_parent AND name = new_name)
    UNION ALL SELECT idx, new_parent, new_name, ino FROM fs_log WHERE op = 'rename'),
    entries AS (SELECT parent, name, ino FROM (SELECT *, row_number() OVER (PARTITION BY parent, name ORDER BY idx DESC) AS rn FROM changes) x WHERE rn = 1 AND ino IS NOT NULL)"""
_MERGED = """merged AS (SELECT file_id, min(start_off) AS start_off, max(end_off) AS end_off FROM (
    SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY start_off, end_off ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN start_off <= max(end_off) OVER (PARTITION BY file_id ORDER BY start_off, end_off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ranges) a) b
    GROUP BY file_id, island)"""
#: Every table that can hold a reference to a chunk.
SOURCES = ("volume_chunks", "object_chunks", "multipart_chunks", "inode_chunks", "snapshot_chunks")
_ALL = " UNION ".join(f"SELECT chunk_id FROM {x}" for x in SOURCES)
_SHARD_HAVE = f"have AS (SELECT chunk_id, count(DISTINCT shard_index) AS present FROM shards WHERE shard_index < {SHARDS} GROUP BY chunk_id)"
_PARTS = "parts AS (SELECT volume_id AS upload_id, position + 1 AS part_number, chunk_id, md5(chunk_id) AS etag, 100 + position AS size FROM volume_chunks)"


def _live(s: SparkSession, d: str) -> DataFrame:
    return compliance.live_nodes(table(s, d, "nodes"), T0, TTL)


def _health(s: SparkSession, d: str) -> DataFrame:
    return compliance.volume_chunk_health(table(s, d, "volume_chunks"), table(s, d, "placements"), _live(s, d))


def _referenced(s: SparkSession, d: str) -> DataFrame:
    return refs.referenced_chunks(*[table(s, d, x) for x in SOURCES])


def _files(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("data"))


def _bytes(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d).select(F.col("file_id").cast("string").alias("chunk_id"), "data")


def _parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "volume_chunks").select(F.col("volume_id").alias("upload_id"), (F.col("position") + 1).alias("part_number"), "chunk_id", F.md5(F.col("chunk_id").cast("binary")).alias("etag"), (F.col("position") + 100).alias("size"))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bitmaps").select((F.col("chunk_index") % 50).alias("map"), F.explode(exprs.bitmap_indices(F.col("live"))).alias("bit"), "chunk_index").select("map", (F.expr("chunk_index div 50") * 64 + F.col("bit")).alias("block")).distinct()


def _asks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "writes").select((F.col("event_id") % 50).alias("map"), (F.col("event_id") * 7777).alias("offset")).distinct()


_BLOCKS = "blocks AS (SELECT DISTINCT chunk_index % 50 AS map, (chunk_index // 50) * 64 + b AS block FROM bitmaps, (SELECT unnest(range(64)) AS b) r WHERE (live >> b) & 1 = 1), asks AS (SELECT DISTINCT event_id % 50 AS map, event_id * 7777 AS \"offset\" FROM writes)"


def _scalars(s: SparkSession, d: str) -> DataFrame:
    """One row per volume with the policy columns."""
    c = F.col
    v = table(s, d, "volumes").select("volume_id", "mode", (c("volume_no") % 7).cast("int").alias("factor"), (c("volume_no") % 5 - 1).cast("int").alias("quorum"), (c("volume_no") % 6).cast("int").alias("ds"), (c("volume_no") % 3).cast("int").alias("ps"), (c("volume_no") % 8).cast("int").alias("n"))
    need = exprs.required_replicas(c("mode"), F.lit(FACTOR), F.lit(None).cast("int"), F.lit(DATA_SHARDS))
    want = exprs.target_replicas(c("mode"), F.lit(FACTOR), F.lit(DATA_SHARDS), F.lit(PARITY_SHARDS))
    return v.select(
        "volume_id", want.alias("target"), exprs.compliance_state(c("n"), need, want).alias("state"), exprs.compliance_reason(c("n"), need, want).alias("reason"),
        exprs.profile_error(c("mode"), c("factor"), c("quorum"), c("ds"), c("ps")).alias("error"), exprs.profile_mode(c("factor"), c("ds"), c("ps")).alias("asked"), exprs.required_nodes(c("factor"), c("ds"), c("ps")).alias("nodes"),
    )


_SCALARS = f"""SELECT volume_id, want AS target, CASE WHEN n >= want THEN 'compliant' WHEN n >= need THEN 'degraded' ELSE 'non_compliant' END AS state,
    CASE WHEN n >= want THEN concat('All ', want, ' replicas available') WHEN n >= need THEN concat(n, ' of ', want, ' replicas available (degraded)') ELSE concat('Only ', n, ' of ', need, ' required replicas available') END AS reason,
    CASE WHEN mode = 'replication' THEN CASE WHEN f < 1 OR f > 5 THEN concat('replication factor must be between 1 and 5, got ', f) WHEN q < 0 THEN concat('write quorum cannot be negative, got ', q) WHEN q > f THEN 'write quorum cannot exceed replication factor' END
    ELSE CASE WHEN ds < 2 THEN concat('data shards must be at least 2, got ', ds) WHEN ps < 1 THEN concat('parity shards must be at least 1, got ', ps) END END AS error,
    CASE WHEN ds > 0 AND ps > 0 THEN 'erasure_coding' WHEN f > 1 THEN 'replication' END AS asked, cast(CASE WHEN ds > 0 AND ps > 0 THEN ds + ps WHEN f > 0 THEN f ELSE 1 END AS int) AS nodes
    FROM (SELECT volume_id, mode, volume_no % 7 AS f, volume_no % 5 - 1 AS q, volume_no % 6 AS ds, volume_no % 3 AS ps, volume_no % 8 AS n, CASE WHEN mode = 'erasure_coding' THEN {SHARDS} ELSE {FACTOR} END AS want, CASE WHEN mode = 'erasure_coding' THEN {DATA_SHARDS} ELSE {FACTOR // 2 + 1} END AS need FROM volumes) v"""


def _patches(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d).select("file_id", (F.col("file_id") % 700).alias("offset"), F.expr("encode(concat('patch-', cast(file_id AS string)), 'UTF-8')").alias("patch"))



def _frames() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    t = table
    return {
        # scalars
        "p24_policy_scalars": (_scalars, duck(_SCALARS, "volumes")),
        "p8_frame_headers": (
            lambda s, d: chunks.frame_chunks(_bytes(s, d)).select("chunk_id", exprs.frame_fields(F.col("framed")).alias("h")).select("chunk_id", "h.magic_ok", "h.version", "h.length"),
            "SELECT cast(doc_id AS varchar) AS chunk_id, true AS magic_ok, 1 AS version, cast(octet_length(encode(text)) AS bigint) AS length FROM documents",
        ),
        "p16_dirty_indices": (lambda s, d: t(s, d, "bitmaps").select("chunk_index", F.explode(exprs.bitmap_indices(F.col("live"))).alias("bit")).distinct(), duck("SELECT DISTINCT chunk_index, b AS bit FROM bitmaps, (SELECT unnest(range(64)) AS b) r WHERE (live >> b) & 1 = 1", "bitmaps")),
        "p18_metadata_shard": (lambda s, d: t(s, d, "volumes").select("volume_id", exprs.metadata_shard(F.sha2("volume_id", 256)).alias("shard")), duck("SELECT volume_id, cast(concat('0x', substring(sha256(volume_id), 1, 2)) AS int) AS shard FROM volumes", "volumes")),
        "p30_capacity_text": (
            lambda s, d: t(s, d, "volumes").select("volume_id", exprs.capacity_text(F.col("size_bytes") * F.col("volume_no")).alias("shown")),
            duck("SELECT volume_id, CASE WHEN b >= 1099511627776 THEN concat(b // 1099511627776, 'Ti') WHEN b >= 1073741824 THEN concat(b // 1073741824, 'Gi') WHEN b >= 1048576 THEN concat(b // 1048576, 'Mi') WHEN b >= 1024 THEN concat(b // 1024, 'Ki') ELSE cast(b AS varchar) END AS shown FROM (SELECT volume_id, size_bytes * volume_no AS b FROM volumes) v", "volumes"),
        ),
        "p31_split_path": (
            lambda s, d: t(s, d, "objects").select("page_id", F.concat(F.lit("/"), "bucket", F.lit("/"), "key").alias("p")).select("page_id", F.split(F.substring("p", 2, 1 << 30), "/", 2).alias("x")).select("page_id", F.get("x", F.lit(0)).alias("bucket"), F.coalesce(F.get("x", F.lit(1)), F.lit("")).alias("key")),
            duck("SELECT page_id, bucket, key FROM objects", "objects"),
        ),
        "p32_rfc3339": (lambda s, d: t(s, d, "nodes").select("node_id", exprs.rfc3339(F.col("last_heartbeat")).alias("seen")), duck("SELECT node_id, strftime(make_timestamp(last_heartbeat * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS seen FROM nodes", "nodes")),
        "p35_node_classes": (lambda s, d: policy.node_classes(t(s, d, "nodes"), T0), duck(f"SELECT node_id, CASE WHEN status <> 'ready' OR {T0} - last_heartbeat > 60 THEN 'down' WHEN {T0} - last_heartbeat > 30 THEN 'suspect' ELSE 'healthy' END AS class FROM nodes", "nodes")),
        "p36_chunk_names": (
            lambda s, d: t(s, d, "volumes").select("volume_id", F.explode(F.sequence(F.lit(0), (F.col("volume_no") % 5).cast("int"))).alias("i")).select("volume_id", F.format_string("%s-chunk-%04d", F.col("volume_id"), F.col("i")).alias("chunk")),
            duck("SELECT volume_id, printf('%s-chunk-%04d', volume_id, i) AS chunk FROM (SELECT volume_id, unnest(range(volume_no % 5 + 1)) AS i FROM volumes) v", "volumes"),
        ),
        # filters with state
        "f12_object_tags": (
            lambda s, d: namespace.object_tags(t(s, d, "objects").select("page_id", F.create_map(F.lit("tag:bucket"), F.col("bucket"), F.lit("size"), F.col("size").cast("string")).alias("meta"))),
            duck("SELECT page_id, 'bucket' AS tag, bucket AS value FROM objects", "objects"),
        ),
        "f14_topology": (
            lambda s, d: policy.within_topology(t(s, d, "nodes"), t(s, d, "nodes").where("rack = 'FRANCE'")).select("node_id"),
            duck("SELECT node_id FROM nodes WHERE rack = 'FRANCE' OR NOT EXISTS (SELECT 1 FROM nodes WHERE rack = 'FRANCE')", "nodes"),
        ),
        "f20_label_selector": (
            lambda s, d: t(s, d, "nodes").select("node_id", F.create_map(F.lit("zone"), "zone", F.lit("rack"), "rack").alias("labels")).where((F.try_element_at("labels", F.lit("zone")) == "ASIA") & F.map_contains_key("labels", "rack")).select("node_id"),
            duck("SELECT node_id FROM nodes WHERE zone = 'ASIA'", "nodes"),
        ),
        # joins
        "j2_local_orphans": (
            lambda s, d: refs.orphans(t(s, d, "placements").where("node_id = 'node-3'"), _referenced(s, d)).select("chunk_id", "slot"),
            duck(f"SELECT chunk_id, slot FROM placements WHERE node_id = 'node-3' AND chunk_id NOT IN ({_ALL})", "placements", *SOURCES),
        ),
        "j6_availability": (
            lambda s, d: policy.availability(t(s, d, "volume_chunks"), t(s, d, "placements"), _live(s, d)),
            duck("", *_BASE).rstrip() + f""", held AS (SELECT p.chunk_id, coalesce(string_agg(CASE WHEN l.node_id IS NOT NULL THEN p.node_id END, ',' ORDER BY p.node_id), '') AS available, coalesce(string_agg(CASE WHEN l.node_id IS NULL THEN p.node_id END, ',' ORDER BY p.node_id), '') AS failed, count(l.node_id) AS n
            FROM placements p LEFT JOIN {_LIVE} l ON p.node_id = l.node_id GROUP BY p.chunk_id) SELECT v.volume_id, v.chunk_id, coalesce(h.available, '') AS available, coalesce(h.failed, '') AS failed, coalesce(h.n, 0) AS n_available FROM volume_chunks v LEFT JOIN held h ON v.chunk_id = h.chunk_id""",
        ),
        "j7_shard_availability": (
            lambda s, d: policy.shard_health(t(s, d, "shards"), _live(s, d), DATA_SHARDS, PARITY_SHARDS).select("chunk_id", "present", "state"),
            duck("", "nodes", "shards").rstrip() + f", have AS (SELECT s.chunk_id, count(DISTINCT CASE WHEN l.node_id IS NOT NULL THEN s.shard_index END) AS n FROM shards s LEFT JOIN {_LIVE} l ON s.node_id = l.node_id GROUP BY s.chunk_id) SELECT chunk_id, n AS present, CASE WHEN n >= {SHARDS} THEN 'healthy' WHEN n >= {DATA_SHARDS} THEN 'degraded' ELSE 'unrecoverable' END AS state FROM have",
        ),
        "ag16_shard_status": (
            lambda s, d: policy.shard_health(t(s, d, "shards"), None, DATA_SHARDS, PARITY_SHARDS).select("chunk_id", "present", "can_read", "can_write", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing")),
            duck("", "shards").rstrip() + f", {_SHARD_HAVE} SELECT h.chunk_id, h.present, h.present >= {DATA_SHARDS} AS can_read, h.present = {SHARDS} AS can_write, (SELECT coalesce(string_agg(cast(i AS varchar), ',' ORDER BY i), '') FROM (SELECT unnest(range({SHARDS})) AS i) r WHERE NOT EXISTS (SELECT 1 FROM shards s WHERE s.chunk_id = h.chunk_id AND s.shard_index = r.i)) AS missing FROM have h",
        ),
        "j9_first_policy": (lambda s, d: policy.first_policy(t(s, d, "volume_chunks"), t(s, d, "volumes")), duck("SELECT f.chunk_id, v.volume_id, v.pool, v.mode FROM (SELECT chunk_id, min(volume_id) AS volume_id FROM volume_chunks GROUP BY chunk_id) f JOIN volumes v ON f.volume_id = v.volume_id", "volume_chunks", "volumes")),
        "j10_shards_of_parent": (
            lambda s, d: t(s, d, "shards").select(exprs.shard_id(F.col("chunk_id"), F.col("shard_index")).alias("shard")).groupBy(exprs.shard_parent(F.col("shard")).alias("parent")).agg(F.count("*").alias("shards")).join(t(s, d, "placements").select(F.col("chunk_id").alias("parent")).distinct(), "parent"),
            duck("SELECT chunk_id AS parent, count(*) AS shards FROM shards WHERE chunk_id IN (SELECT chunk_id FROM placements) GROUP BY chunk_id", "shards", "placements"),
        ),
        "w6_spread_destinations": (lambda s, d: policy.spread_destinations(t(s, d, "placements"), "node-4", t(s, d, "nodes").where("status = 'ready'")), _SPREAD.format(with_=duck("", "placements", "nodes").removeprefix("WITH ").rstrip())),
        "j14_pool_members": (
            lambda s, d: refs.reconcile(t(s, d, "nodes").where("zone = 'ASIA'"), t(s, d, "placements").where("slot = 4"), "node_id"),
            duck("SELECT coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN b.node_id IS NULL THEN 'create' WHEN a.node_id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM (SELECT node_id FROM nodes WHERE zone = 'ASIA') a FULL OUTER JOIN (SELECT DISTINCT node_id FROM placements WHERE slot = 4) b ON a.node_id = b.node_id", "nodes", "placements"),
        ),
        "j17_lookup": (lambda s, d: namespace.resolve(t(s, d, "dirents"), t(s, d, "inodes")).select("parent", "name", "ino", "kind", "size"), duck("SELECT e.parent, e.name, e.ino, i.kind, i.size FROM dirents e JOIN inodes i ON e.ino = i.ino", "dirents", "inodes")),
        # reports
        "ag7_heal_status": (
            lambda s, d: policy.heal_status(t(s, d, "volumes"), _health(s, d), policy.node_classes(t(s, d, "nodes"), T0), FACTOR),
            duck("", *_BASE).rstrip() + f""", {_HEALTH}, v AS (SELECT volume_id, min(live) AS least FROM health GROUP BY volume_id), c AS (SELECT CASE WHEN status <> 'ready' OR {T0} - last_heartbeat > 60 THEN 'down' WHEN {T0} - last_heartbeat > 30 THEN 'suspect' ELSE 'healthy' END AS class FROM nodes),
            n AS (SELECT count(CASE WHEN class = 'healthy' THEN 1 END) AS healthy_nodes, count(CASE WHEN class = 'suspect' THEN 1 END) AS suspect_nodes, count(CASE WHEN class = 'down' THEN 1 END) AS down_nodes FROM c),
            w AS (SELECT count(CASE WHEN least = 0 THEN 1 END) AS failed_volumes, count(CASE WHEN least > 0 AND least < {FACTOR} THEN 1 END) AS degraded_volumes FROM v)
            SELECT *, CASE WHEN failed_volumes > 0 OR down_nodes > 0 THEN 'critical' WHEN degraded_volumes > 0 OR suspect_nodes > 0 THEN 'healing' ELSE 'healthy' END AS status FROM n, w""",
        ),
        "ag8_missing_replicas": (lambda s, d: policy.missing_replicas(_health(s, d), FACTOR), duck("", *_BASE).rstrip() + f", {_HEALTH} SELECT volume_id, cast(sum(greatest({FACTOR} - live, 0)) AS bigint) AS missing, count(CASE WHEN live < {FACTOR} THEN 1 END) AS affected FROM health GROUP BY volume_id HAVING count(CASE WHEN live < {FACTOR} THEN 1 END) > 0"),
        "ag15_multipart": (
            lambda s, d: namespace.assemble_parts(_parts(s, d)),
            duck("", "volume_chunks").rstrip() + f", {_PARTS} SELECT upload_id, cast(sum(size) AS bigint) AS size, concat(md5(string_agg(etag, '' ORDER BY part_number)), '-', count(*)) AS etag, count(*) AS parts, string_agg(chunk_id, ',' ORDER BY part_number) AS chunks FROM parts GROUP BY upload_id",
        ),
        # placement and policy
        "c7_evaluate_all": (
            lambda s, d: policy.evaluate_all(t(s, d, "placements"), policy.first_policy(t(s, d, "volume_chunks"), t(s, d, "volumes")), FACTOR),
            duck(f"SELECT p.chunk_id, p.n AS replicas, CASE WHEN g.mode IS NULL THEN 'unreferenced' WHEN g.mode = 'erasure_coding' THEN 'by_shards' WHEN p.n < {FACTOR} THEN 'under' WHEN p.n > {FACTOR} THEN 'over' ELSE 'healthy' END AS state FROM (SELECT chunk_id, count(*) AS n FROM placements GROUP BY chunk_id) p LEFT JOIN (SELECT f.chunk_id, v.mode FROM (SELECT chunk_id, min(volume_id) AS volume_id FROM volume_chunks GROUP BY chunk_id) f JOIN volumes v ON f.volume_id = v.volume_id) g ON p.chunk_id = g.chunk_id", "placements", "volume_chunks", "volumes"),
        ),
        "c9_replace_failed": (
            lambda s, d: policy.replace_node(t(s, d, "placements"), t(s, d, "nodes").where("status = 'offline'"), F.lit("node-new")),
            duck("SELECT p.chunk_id, concat(string_agg(CASE WHEN p.slot = x.hit THEN 'node-new' ELSE p.node_id END, ',' ORDER BY p.slot), CASE WHEN max(x.hit) IS NULL THEN ',node-new' ELSE '' END) AS nodes FROM placements p LEFT JOIN (SELECT a.chunk_id, min(a.slot) AS hit FROM placements a JOIN nodes n ON a.node_id = n.node_id WHERE n.status = 'offline' GROUP BY a.chunk_id) x ON p.chunk_id = x.chunk_id GROUP BY p.chunk_id", "placements", "nodes"),
        ),
        "c12_locality": (
            lambda s, d: policy.locality_scores(t(s, d, "volumes").select(F.concat(F.lit("pod-"), (F.col("volume_no") % 97).cast("string")).alias("pod"), "volume_id"), t(s, d, "volume_chunks").join(t(s, d, "placements"), "chunk_id").select("volume_id", "node_id").distinct(), t(s, d, "nodes"), 10, 2),
            duck("SELECT concat('pod-', v.volume_no % 97) AS pod, h.node_id, least(100, 12 * count(DISTINCT v.volume_id)) AS score FROM volumes v JOIN (SELECT DISTINCT c.volume_id, p.node_id FROM volume_chunks c JOIN placements p ON c.chunk_id = p.chunk_id) h ON v.volume_id = h.volume_id WHERE h.node_id IN (SELECT node_id FROM nodes) GROUP BY 1, 2", "volumes", "volume_chunks", "placements", "nodes"),
        ),
        "c13_regenerate": (
            lambda s, d: policy.shard_to_regenerate(t(s, d, "shards"), "node-1", SHARDS),
            duck("SELECT chunk_id, coalesce(min(CASE WHEN own = 0 AND other = 1 THEN shard_index END), 0) AS shard_index FROM (SELECT chunk_id, shard_index, max(CASE WHEN node_id = 'node-1' THEN 1 ELSE 0 END) AS own, max(CASE WHEN node_id <> 'node-1' THEN 1 ELSE 0 END) AS other FROM shards GROUP BY chunk_id, shard_index) x GROUP BY chunk_id", "shards"),
        ),
        "c14_may_delete": (
            lambda s, d: policy.may_delete(t(s, d, "placements").select("chunk_id", F.lit(-1).alias("shard_index")).unionByName(t(s, d, "shards").select("chunk_id", "shard_index"))),
            duck("SELECT chunk_id, shard_index, count(*) AS copies, count(*) > CASE WHEN shard_index >= 0 THEN 1 ELSE 2 END AS allowed FROM (SELECT chunk_id, -1 AS shard_index FROM placements UNION ALL SELECT chunk_id, shard_index FROM shards) x GROUP BY chunk_id, shard_index", "placements", "shards"),
        ),
        "c15_quorum": (lambda s, d: policy.has_quorum(t(s, d, "placements").join(_live(s, d).select("node_id", F.lit(1).alias("up")), "node_id", "left"), "chunk_id", F.col("up") == 1), duck(f"SELECT p.chunk_id, count(l.node_id) >= count(*) // 2 + 1 AS quorum FROM placements p LEFT JOIN {_LIVE} l ON p.node_id = l.node_id GROUP BY p.chunk_id", "placements", "nodes")),
        "w7_round_robin": (
            lambda s, d: placement.round_robin(t(s, d, "volumes").select(F.col("volume_id").alias("key"), F.col("volume_no").alias("n")), 10, 3).select("key", "i", "node"),
            duck("SELECT volume_id AS key, i, (volume_no * 3 + i) % 10 AS node FROM volumes, (SELECT unnest([0, 1, 2]) AS i) r", "volumes"),
        ),
        "w8_domain_rounds": (
            lambda s, d: policy.round_by_domain(t(s, d, "shards").join(t(s, d, "nodes"), "node_id").select(F.col("chunk_id").alias("key"), "node_id", F.col("zone").alias("domain"), F.col("shard_index").alias("draw")), 4),
            duck("SELECT key, node_id, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round, best, domain) AS n FROM (SELECT s.chunk_id AS key, s.node_id, n.zone AS domain, row_number() OVER (PARTITION BY s.chunk_id, n.zone ORDER BY s.shard_index, s.node_id) AS round, min(s.shard_index) OVER (PARTITION BY s.chunk_id, n.zone) AS best FROM shards s JOIN nodes n ON s.node_id = n.node_id) a) b WHERE n <= 4", "shards", "nodes"),
        ),
        # sparse maps and ranges
        "w5_coverage": (lambda s, d: ranges.coverage_complete(ranges.merge_ranges(t(s, d, "ranges"), "file_id"), "file_id", 60), duck("", "ranges").rstrip() + f", {_MERGED} SELECT file_id, coalesce(bool_or(start_off <= 0 AND end_off >= 60), false) AS complete FROM merged GROUP BY file_id"),
        "b17_base_gaps": (
            lambda s, d: ranges.range_gaps(ranges.merge_ranges(t(s, d, "ranges"), "file_id"), "file_id", 5000),
            duck("", "ranges").rstrip() + f", {_MERGED} SELECT * FROM (SELECT file_id, coalesce(lag(end_off) OVER (PARTITION BY file_id ORDER BY start_off), 0) AS start_off, start_off AS end_off FROM merged UNION ALL SELECT file_id, max(end_off), 5000 FROM merged GROUP BY file_id) x WHERE start_off < end_off",
        ),
        "w11_next_data": (
            lambda s, d: ranges.next_data(_blocks(s, d), _asks(s, d), "map", exprs.SUB_BLOCK_BYTES),
            duck("", "bitmaps", "writes").rstrip() + f', {_BLOCKS} SELECT a.map, a."offset", greatest(a."offset", min(b.block) * 65536) AS next FROM asks a LEFT JOIN blocks b ON a.map = b.map AND b.block >= a."offset" // 65536 GROUP BY a.map, a."offset"',
        ),
        "w11_next_hole": (
            lambda s, d: ranges.next_hole(_blocks(s, d), _asks(s, d), "map", exprs.SUB_BLOCK_BYTES),
            duck("", "bitmaps", "writes").rstrip() + f', {_BLOCKS}, ends AS (SELECT map, block FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM blocks c WHERE c.map = b.map AND c.block = b.block + 1)) SELECT a.map, a."offset", CASE WHEN EXISTS (SELECT 1 FROM blocks b WHERE b.map = a.map AND b.block = a."offset" // 65536) THEN ((SELECT min(e.block) FROM ends e WHERE e.map = a.map AND e.block >= a."offset" // 65536) + 1) * 65536 ELSE a."offset" END AS next FROM asks a',
        ),
        "w12_read_streaks": (
            lambda s, d: ranges.read_streaks(t(s, d, "writes"), "volume_id").select("event_id", "streak"),
            duck("SELECT event_id, row_number() OVER (PARTITION BY volume_id, run ORDER BY event_id) AS streak FROM (SELECT *, sum(new) OVER (PARTITION BY volume_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(off + len) OVER (PARTITION BY volume_id ORDER BY event_id) = off THEN 0 ELSE 1 END AS new FROM writes) a) b", "writes"),
        ),
        "w13_weighted_pick": (
            lambda s, d: ranges.weighted_pick(t(s, d, "placements").join(t(s, d, "nodes").select("node_id", "node_no"), "node_id").select("chunk_id", "slot", "node_id", (F.col("node_no") % 6 * 100).alias("latency")), t(s, d, "placements").select("chunk_id").distinct().select("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("read")), "chunk_id"),
            duck("""SELECT chunk_id, read, node_id FROM (SELECT w.chunk_id, r.read, w.node_id, w.stop, w.stop - w.weight AS start, w.total FROM (SELECT *, sum(weight) OVER (PARTITION BY chunk_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS stop, sum(weight) OVER (PARTITION BY chunk_id) AS total FROM (
                SELECT p.chunk_id, p.slot, p.node_id, CASE WHEN n.node_no % 6 = 0 THEN 1 ELSE max(n.node_no % 6 * 100) OVER (PARTITION BY p.chunk_id) // (n.node_no % 6 * 100) END AS weight FROM placements p JOIN nodes n ON p.node_id = n.node_id) a) w, (SELECT unnest(range(5)) AS read) r) x WHERE read % total >= start AND read % total < stop""", "placements", "nodes"),
        ),
        # listings
        "t2_list_versions": (lambda s, d: namespace.list_versions(t(s, d, "versions"), "obj-", "obj-1", 40), duck("SELECT key, turn, size FROM versions WHERE key >= 'obj-1' ORDER BY key, turn DESC LIMIT 40", "versions")),
        "t3_list_parts": (lambda s, d: namespace.list_parts(_parts(s, d), "vol-3", 1, 2), duck("", "volume_chunks").rstrip() + f", {_PARTS}, page AS (SELECT part_number, etag, size FROM parts WHERE upload_id = 'vol-3' AND part_number > 1 ORDER BY part_number LIMIT 2) SELECT *, (SELECT max(part_number) FROM page) AS next_marker FROM page"),
        "t5_read_directory": (lambda s, d: namespace.read_directory(t(s, d, "dirents"), 7, 1, 6), duck("SELECT * FROM (SELECT 1 AS cookie, '.' AS name, 7 AS ino UNION ALL SELECT 2, '..', 1 UNION ALL SELECT row_number() OVER (ORDER BY name) + 2, name, ino FROM dirents WHERE parent = 7) x WHERE cookie > 1 AND cookie <= 7", "dirents")),
        # sets
        "u2_agent_references": (lambda s, d: refs.referenced_chunks(*[t(s, d, x) for x in ("volume_chunks", "object_chunks", "inode_chunks")]), duck("SELECT chunk_id FROM volume_chunks UNION SELECT chunk_id FROM object_chunks UNION SELECT chunk_id FROM inode_chunks", "volume_chunks", "object_chunks", "inode_chunks")),
        # bytes
        "b2_split_with_empty": (lambda s, d: chunks.split_chunks(_files(s, d), 4096, emit_empty=True).groupBy("file_id").agg(F.count("*").alias("n")), "SELECT doc_id AS file_id, greatest(1, cast(ceil(octet_length(encode(text)) / 4096.0) AS bigint)) AS n FROM documents WHERE text IS NOT NULL"),
        "b7_write_range": (
            lambda s, d: chunks.reassemble(chunks.write_at(chunks.fill_sparse(chunks.split_chunks(_files(s, d), 128), _files(s, d).select("file_id", F.greatest(F.octet_length("data"), (F.col("file_id") % 700).cast("int")).alias("length")), 128), _patches(s, d), 128)).select("file_id", F.octet_length("data").alias("bytes"), (F.expr("substring(data, file_id % 700 + 1, 6 + length(cast(file_id AS string)))") == F.expr("encode(concat('patch-', cast(file_id AS string)), 'UTF-8')")).alias("found")),
            "SELECT doc_id AS file_id, greatest(octet_length(encode(text)), doc_id % 700 + 6 + length(cast(doc_id AS varchar))) AS bytes, true AS found FROM documents",
        ),
        "b9_fill_sparse": (
            lambda s, d: chunks.fill_sparse(chunks.split_chunks(_files(s, d), 64).where("position % 2 = 0"), _files(s, d).select("file_id", F.octet_length("data").alias("length")), 64).groupBy("file_id").agg(F.sum(F.octet_length("data")).alias("bytes"), F.count("*").alias("n")),
            "SELECT doc_id AS file_id, cast(octet_length(encode(text)) AS bigint) AS bytes, cast(ceil(octet_length(encode(text)) / 64.0) AS bigint) AS n FROM documents WHERE octet_length(encode(text)) > 0",
        ),
        "b12_padded_code": (lambda s, d: chunks.padded_decode(chunks.padded_encode(_bytes(s, d), DATA_SHARDS, PARITY_SHARDS).where("shard_index NOT IN (1, 2)"), DATA_SHARDS, PARITY_SHARDS).select("chunk_id", F.sha2("data", 256).alias("sha")), "SELECT cast(doc_id AS varchar) AS chunk_id, sha256(text) AS sha FROM documents"),
        "b16_repair_shards": (
            lambda s, d: (lambda sh: chunks.repair_shards(sh.where("shard_index NOT IN (0, 5)"), DATA_SHARDS, PARITY_SHARDS).join(sh.select("chunk_id", "shard_index", F.col("shard").alias("was")), ["chunk_id", "shard_index"]).select("chunk_id", "shard_index", (F.col("shard") == F.col("was")).alias("equal")))(chunks.padded_encode(_bytes(s, d), DATA_SHARDS, PARITY_SHARDS)),
            "SELECT cast(doc_id AS varchar) AS chunk_id, i AS shard_index, true AS equal FROM documents, (SELECT unnest([0, 5]) AS i) r",
        ),
        # namespace
        "g5_directory_fold": (lambda s, d: namespace.directory_entries(t(s, d, "fs_log")), duck("", "fs_log").rstrip() + f", {_CHANGES} SELECT * FROM entries"),
        "g3_link_counts": (lambda s, d: namespace.link_counts(namespace.directory_entries(t(s, d, "fs_log"))), duck("", "fs_log").rstrip() + f", {_CHANGES} SELECT ino, count(*) AS links FROM entries GROUP BY ino"),
        "g4_empty_directories": (lambda s, d: namespace.removable_directories(t(s, d, "inodes").where("kind = 'dir'").select("ino"), t(s, d, "dirents").select((F.col("parent") * 18 + 64).alias("parent"))), duck("SELECT ino FROM inodes WHERE kind = 'dir' AND ino NOT IN (SELECT parent * 18 + 64 FROM dirents)", "inodes", "dirents")),
        "g8_copy_object": (lambda s, d: namespace.copy_object(t(s, d, "volume_chunks").withColumnRenamed("volume_id", "key"), "vol-3", "vol-3-copy").select("key", "chunk_id", "position"), duck("SELECT 'vol-3-copy' AS key, chunk_id, position FROM volume_chunks WHERE volume_id = 'vol-3'", "volume_chunks")),
        "g9_expired_objects": (
            lambda s, d: namespace.expired_objects(t(s, d, "objects").withColumn("modified", T0 - F.col("page_id") % 90 * 86400), t(s, d, "objects").select("bucket").distinct().withColumn("prefix", F.lit("e")).withColumn("days", F.lit(30)), T0),
            duck("SELECT DISTINCT bucket, key FROM objects WHERE key LIKE 'e%' AND page_id % 90 > 30", "objects"),
        ),
        "g13_object_quota": (
            lambda s, d: namespace.quota_phase(t(s, d, "usage").select("c_custkey", F.col("objects").alias("used")), t(s, d, "quotas").select("c_custkey", (F.col("c_custkey") % 25).alias("hard"), (F.col("c_custkey") % 15).alias("soft")), "c_custkey"),
            duck("SELECT q.c_custkey, coalesce(u.objects, 0) AS used, CASE WHEN q.c_custkey % 25 > 0 AND coalesce(u.objects, 0) > q.c_custkey % 25 THEN 'exceeded' WHEN q.c_custkey % 15 > 0 AND coalesce(u.objects, 0) > q.c_custkey % 15 THEN 'warning' ELSE 'active' END AS phase, q.c_custkey % 25 <= 0 OR coalesce(u.objects, 0) < q.c_custkey % 25 AS admit FROM quotas q LEFT JOIN usage u ON q.c_custkey = u.c_custkey", "quotas", "usage"),
        ),
        "g14_quota_phase": (
            lambda s, d: namespace.quota_phase(t(s, d, "usage"), t(s, d, "quotas"), "c_custkey"),
            duck("SELECT q.c_custkey, coalesce(u.used, 0) AS used, CASE WHEN hard > 0 AND coalesce(u.used, 0) > hard THEN 'exceeded' WHEN soft > 0 AND coalesce(u.used, 0) > soft THEN 'warning' ELSE 'active' END AS phase, hard <= 0 OR coalesce(u.used, 0) < hard AS admit FROM quotas q LEFT JOIN usage u ON q.c_custkey = u.c_custkey", "quotas", "usage"),
        ),
        "g16_snapshot": (lambda s, d: namespace.snapshot_volume(t(s, d, "volume_chunks"), t(s, d, "volumes").where("volume_no % 17 = 0")), duck("SELECT concat('snap-of-', c.volume_id) AS snapshot_id, c.chunk_id, c.position FROM volume_chunks c JOIN volumes v ON c.volume_id = v.volume_id WHERE v.volume_no % 17 = 0", "volume_chunks", "volumes")),
        "g17_delete_cascade": (
            lambda s, d: namespace.delete_cascade(t(s, d, "volume_chunks"), t(s, d, "volumes").where("volume_no % 40 <> 0"), *[t(s, d, x) for x in SOURCES[1:]]),
            duck(f"SELECT DISTINCT chunk_id FROM volume_chunks WHERE volume_id IN (SELECT volume_id FROM volumes WHERE volume_no % 40 <> 0) AND chunk_id NOT IN (SELECT chunk_id FROM volume_chunks WHERE volume_id NOT IN (SELECT volume_id FROM volumes WHERE volume_no % 40 <> 0)) AND chunk_id NOT IN ({' UNION '.join(f'SELECT chunk_id FROM {x}' for x in SOURCES[1:])})", *SOURCES, "volumes"),
        ),
        "g19_node_garbage": (lambda s, d: refs.orphans(t(s, d, "placements").where("node_id = 'node-5'"), _referenced(s, d)).select("chunk_id"), duck(f"SELECT chunk_id FROM placements WHERE node_id = 'node-5' AND chunk_id NOT IN ({_ALL})", "placements", *SOURCES)),
        "g1_stat": (lambda s, d: t(s, d, "inodes").where("ino = 109").select("ino", "kind", "size"), duck("SELECT ino, kind, size FROM inodes WHERE ino = 109", "inodes")),
        "t1_list_page": (lambda s, d: listing.list_objects(t(s, d, "objects"), "bucket-3", after="d", limit=5), duck("SELECT key AS name, false AS is_prefix FROM objects WHERE bucket = 'bucket-3' AND key > 'd' ORDER BY key LIMIT 5", "objects")),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: (lambda s, d, q=sql, t=names: query(s, d, q.replace("sha256(text)", "sha2(text, 256)"), *t)) for n, (sql, names) in BOTH.items()}
    return found | {n: f for n, (f, _) in _frames().items()}


def oracle_sql() -> dict[str, str]:
    found = {n: duck(sql, *names) for n, (sql, names) in BOTH.items()}
    return found | {n: sql for n, (_, sql) in _frames().items() if sql}
