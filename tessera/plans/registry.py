"""Queries of the core operators and their SQL.

``BOTH`` are queries whose SQL text runs on Spark and on DuckDB alike. The
others are DataFrame operators with a SQL counterpart of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators import chunks, compliance, listing, ranges, refs
from tessera.plans import commands, wider
from tessera.sources.fixtures import DATA_SHARDS, FACTOR, PARITY_SHARDS, T0, duck, query, table

TTL = 60
NEED = DATA_SHARDS + PARITY_SHARDS
#: Every table that can hold a reference to a chunk.
SOURCES = ("volume_chunks", "object_chunks", "multipart_chunks", "inode_chunks", "snapshot_chunks")

#: name -> (SQL, derived tables it reads)
BOTH: dict[str, tuple[str, tuple[str, ...]]] = {
    # scans and filters
    "sc1_point_get": ("SELECT * FROM volumes WHERE volume_id = 'vol-7'", ("volumes",)),
    "sc3_prefix_scan": ("SELECT volume_id, pool FROM volumes WHERE volume_id LIKE 'vol-12%'", ("volumes",)),
    "sc4_list_volumes": ("SELECT volume_id, pool, mode, size_bytes FROM volumes", ("volumes",)),
    "sc5_list_placements": ("SELECT chunk_id, count(*) AS replicas FROM placements GROUP BY chunk_id", ("placements",)),
    "sc6_list_nodes": ("SELECT node_id, zone, rack, weight, status FROM nodes", ("nodes",)),
    "sc7_list_buckets": ("SELECT DISTINCT bucket FROM objects", ("objects",)),
    "sc8_list_snapshots": ("SELECT snapshot_id, source_volume_id FROM snapshots", ("snapshots",)),
    "sc9_chunk_map_range": ("SELECT chunk_id, position FROM volume_chunks WHERE volume_id = 'vol-3'", ("volume_chunks",)),
    "f3_live_nodes": (f"SELECT node_id FROM nodes WHERE last_heartbeat >= {T0} - {TTL}", ("nodes",)),
    "f4_stale_nodes": (f"SELECT node_id FROM nodes WHERE (status <> 'offline' AND last_heartbeat < {T0} - 45) OR (status = 'offline' AND last_heartbeat < {T0} - 80)", ("nodes",)),
    "f5_active_locks": (f"SELECT lease_id, ino, owner FROM locks WHERE expires_at >= {T0}", ("locks",)),
    "f6_expired_locks": (f"SELECT lease_id FROM locks WHERE expires_at < {T0}", ("locks",)),
    "f7_pending_heal_tasks": (f"SELECT task_id, CASE WHEN status = 'in-progress' AND updated_at < {T0} - 300 THEN 'pending' ELSE status END AS status, priority FROM heal_tasks WHERE status = 'pending' OR (status = 'in-progress' AND updated_at < {T0} - 300)", ("heal_tasks",)),
    "f8_tasks_by_volume": ("SELECT task_id, status FROM heal_tasks WHERE volume_id = 'vol-11'", ("heal_tasks",)),
    "f15_snapshots_of_volume": ("SELECT snapshot_id FROM snapshots WHERE source_volume_id = 'vol-17'", ("snapshots",)),
    "f16_chunks_on_node": ("SELECT DISTINCT chunk_id FROM placements WHERE node_id = 'node-2'", ("placements",)),
    "f17_online_weighted": ("SELECT node_id, weight FROM nodes WHERE status <> 'offline' AND weight > 0", ("nodes",)),
    "f19_changed_dirty": ("SELECT DISTINCT chunk_index, live FROM bitmaps WHERE live <> synced AND live <> 0", ("bitmaps",)),
    # joins
    "j8_volumes_by_pool": ("SELECT pool, mode, count(*) AS volumes, sum(size_bytes) AS bytes FROM volumes GROUP BY pool, mode", ("volumes",)),
    "j12_healthy_without_chunk": ("SELECT n.node_id FROM nodes n WHERE n.status <> 'offline' AND NOT EXISTS (SELECT 1 FROM placements p WHERE p.node_id = n.node_id AND p.chunk_id = 'chunk-5')", ("nodes", "placements")),
    "j18_task_volumes": ("SELECT t.task_id, v.pool FROM heal_tasks t JOIN volumes v ON t.volume_id = v.volume_id WHERE t.status = 'failed'", ("heal_tasks", "volumes")),
    # aggregates
    "ag1_cluster_status": ("SELECT count(*) AS nodes, count(CASE WHEN status = 'ready' THEN 1 END) AS ready, cast(sum(total_capacity) AS bigint) AS total, cast(sum(available_capacity) AS bigint) AS available FROM nodes", ("nodes",)),
    "ag2_pool_usage": ("SELECT count(*) AS nodes, count(CASE WHEN status = 'ready' THEN 1 END) AS ready, cast(sum(total_capacity) AS bigint) AS total, cast(sum(available_capacity) AS bigint) AS available, round(CASE WHEN sum(total_capacity) > 0 THEN 100.0 * cast(sum(total_capacity - available_capacity) AS double) / cast(sum(total_capacity) AS double) ELSE 0 END, 6) AS used_pct FROM nodes", ("nodes",)),
    "ag2_zone_usage": ("SELECT zone, cast(sum(total_capacity) AS bigint) AS total, round(CASE WHEN sum(total_capacity) > 0 THEN 100.0 * cast(sum(total_capacity - available_capacity) AS double) / cast(sum(total_capacity) AS double) ELSE 0 END, 6) AS used_pct FROM nodes GROUP BY zone", ("nodes",)),
    "ag9_available_capacity": ("SELECT cast(floor(cast(sum(available_capacity) AS double) / 3) AS bigint) AS available FROM nodes WHERE status <> 'offline' AND available_capacity > 0", ("nodes",)),
    "ag12_rack_weight": ("SELECT rack, cast(sum(weight) AS bigint) AS weight, cast(sum(total_capacity) AS bigint) AS capacity FROM nodes GROUP BY rack", ("nodes",)),
    "ag14_replica_count": ("SELECT replicas, count(*) AS chunks FROM (SELECT chunk_id, count(*) AS replicas FROM placements GROUP BY chunk_id) r GROUP BY replicas", ("placements",)),
    "ag18_active_lock_count": (f"SELECT ino, count(*) AS locks FROM locks WHERE expires_at >= {T0} GROUP BY ino", ("locks",)),
    "g11_quota_check": ("SELECT c.name, CASE WHEN coalesce(u.used, 0) > c.hard THEN 'exceeded' WHEN coalesce(u.used, 0) > c.soft THEN 'warning' ELSE 'active' END AS phase FROM quotas c LEFT JOIN (SELECT o_custkey, sum(cast(floor(o_totalprice) AS bigint)) AS used FROM orders GROUP BY o_custkey) u ON c.c_custkey = u.o_custkey", ("quotas",)),
    "g18_since_generation": ("SELECT key, idx, generation FROM change_log WHERE generation > 50", ("change_log",)),
    "st8_owner_generation": ("SELECT key, max(generation) AS generation FROM change_log GROUP BY key", ("change_log",)),
    "st9_stale_rejected": ("SELECT idx FROM (SELECT idx, generation, max(generation) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM change_log) x WHERE generation <> 0 AND generation <= top", ("change_log",)),
    "st13_bitmap_clear": ("SELECT chunk_index, live & ~synced AS kept FROM bitmaps", ("bitmaps",)),
}

_HEALTH = f"""health AS (SELECT vc.volume_id, vc.chunk_id, coalesce(h.replicas, 0) AS replicas, coalesce(h.live, 0) AS live FROM volume_chunks vc LEFT JOIN
    (SELECT p.chunk_id, count(*) AS replicas, count(l.node_id) AS live FROM placements p LEFT JOIN (SELECT node_id FROM nodes WHERE last_heartbeat >= {T0 - TTL} AND status <> 'offline') l ON p.node_id = l.node_id GROUP BY p.chunk_id) h ON vc.chunk_id = h.chunk_id)"""
_WANTED = f"CASE WHEN v.mode = 'erasure_coding' THEN {NEED} ELSE {FACTOR} END"
_COMPLIANCE = f"""per_volume AS (SELECT v.volume_id, v.pool, v.mode, count(h.chunk_id) AS chunks, count(CASE WHEN h.live >= {_WANTED} THEN 1 END) AS compliant,
    count(CASE WHEN h.live < {_WANTED} AND h.live > 0 THEN 1 END) AS under_replicated, count(CASE WHEN h.live = 0 THEN 1 END) AS unavailable
    FROM volumes v LEFT JOIN health h ON v.volume_id = h.volume_id GROUP BY v.volume_id, v.pool, v.mode)"""
_BASE = ("nodes", "volumes", "volume_chunks", "placements")


def _health(spark: SparkSession, d: str) -> DataFrame:
    live = compliance.live_nodes(table(spark, d, "nodes"), T0, TTL)
    return compliance.volume_chunk_health(table(spark, d, "volume_chunks"), table(spark, d, "placements"), live)


def _per_volume(spark: SparkSession, d: str) -> DataFrame:
    return compliance.volume_compliance(table(spark, d, "volumes"), _health(spark, d), FACTOR, DATA_SHARDS, PARITY_SHARDS)


def _referenced(spark: SparkSession, d: str) -> DataFrame:
    return refs.referenced_chunks(*[table(spark, d, t) for t in SOURCES])


_ALL = " UNION ".join(f"SELECT chunk_id FROM {x}" for x in SOURCES)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("data"))


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 100003 + F.col("l_partkey") * 17).alias("o")).distinct()
    return rows.select("o", exprs.chunk_index(o).alias("chunk"), exprs.sub_block_index(o).alias("block"), exprs.offset_in_sub_block(o).alias("within"))


_MERGED = """SELECT file_id, min(start_off) AS start_off, max(end_off) AS end_off, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY start_off, end_off ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN start_off <= max(end_off) OVER (PARTITION BY file_id ORDER BY start_off, end_off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ranges) a) b
    GROUP BY file_id, island"""


def _frames() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    t = table
    return {
        "p5_shard_ids": (
            lambda s, d: (lambda x: x.select("shard", exprs.shard_parent(F.col("shard")).alias("parent"), exprs.shard_index(F.col("shard")).alias("idx")))(t(s, d, "placements").select(exprs.shard_id(F.col("chunk_id"), F.col("slot")).alias("shard"))),
            duck("SELECT concat(chunk_id, ':shard:', cast(slot AS varchar)) AS shard, chunk_id AS parent, slot AS idx FROM placements", "placements"),
        ),
        "p10_offsets": (_offsets, "SELECT DISTINCT o, o // 4194304 AS chunk, (o % 4194304) // 65536 AS block, o % 65536 AS within FROM (SELECT l_orderkey * 100003 + l_partkey * 17 AS o FROM lineitem) x"),
        "p15_bitmap_count": (lambda s, d: t(s, d, "bitmaps").select("chunk_index", exprs.bitmap_count(F.col("live")).cast("long").alias("bits")), duck("SELECT chunk_index, cast(bit_count(live) AS bigint) AS bits FROM bitmaps", "bitmaps")),
        "p23_required_replicas": (
            lambda s, d: t(s, d, "volumes").select("volume_id", exprs.required_replicas(F.col("mode"), F.lit(FACTOR), F.lit(None).cast("int"), F.lit(DATA_SHARDS)).alias("required")),
            duck(f"SELECT volume_id, CASE WHEN mode = 'erasure_coding' THEN {DATA_SHARDS} ELSE {FACTOR // 2 + 1} END AS required FROM volumes", "volumes"),
        ),
        "p29_human_bytes": (
            lambda s, d: t(s, d, "objects").select("page_id", exprs.human_bytes(F.col("size")).alias("shown")),
            duck("SELECT page_id, CASE WHEN size >= 1048576 THEN printf('%.1f MiB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.1f KiB', size / 1024.0) ELSE concat(cast(size AS varchar), ' B') END AS shown FROM objects", "objects"),
        ),
        "u1_referenced": (_referenced, duck(_ALL, *SOURCES)),
        "j1_orphans": (lambda s, d: refs.orphans(t(s, d, "placements"), _referenced(s, d)).select("chunk_id").distinct(), duck(f"SELECT DISTINCT chunk_id FROM placements WHERE chunk_id NOT IN ({_ALL})", "placements", *SOURCES)),
        "ag13_reference_counts": (lambda s, d: refs.reference_counts(t(s, d, "volume_chunks")), duck("SELECT chunk_id, count(DISTINCT volume_id) AS refs FROM volume_chunks GROUP BY chunk_id", "volume_chunks")),
        "j13_reconcile": (
            lambda s, d: refs.reconcile(t(s, d, "volume_chunks"), t(s, d, "placements"), "chunk_id"),
            duck("SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'create' WHEN a.chunk_id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM (SELECT DISTINCT chunk_id FROM volume_chunks) a FULL OUTER JOIN (SELECT DISTINCT chunk_id FROM placements) b ON a.chunk_id = b.chunk_id", "volume_chunks", "placements"),
        ),
        "j3_volume_health": (_health, f"{duck('', *_BASE).rstrip()}, {_HEALTH} SELECT chunk_id, volume_id, replicas, live FROM health"),
        "ag3_volume_compliance": (_per_volume, f"{duck('', *_BASE).rstrip()}, {_HEALTH}, {_COMPLIANCE} SELECT * FROM per_volume"),
        "ag4_pool_compliance": (
            lambda s, d: compliance.pool_compliance(_per_volume(s, d)),
            f"""{duck("", *_BASE).rstrip()}, {_HEALTH}, {_COMPLIANCE} SELECT pool, count(*) AS volumes, cast(sum(chunks) AS bigint) AS chunks, cast(sum(compliant) AS bigint) AS compliant, cast(sum(under_replicated) AS bigint) AS under_replicated,
            cast(sum(unavailable) AS bigint) AS unavailable, count(CASE WHEN under_replicated + unavailable > 0 THEN 1 END) AS bad_volumes, min_by(mode, volume_id) AS mode FROM per_volume GROUP BY pool""",
        ),
        "ag6_volume_status": (
            lambda s, d: compliance.volume_status(t(s, d, "volumes"), _health(s, d), FACTOR),
            f"{duck('', *_BASE).rstrip()}, {_HEALTH} SELECT v.volume_id, CASE WHEN coalesce(x.bad, 0) = 0 THEN 'OK' WHEN x.ok > 0 THEN 'DEGRADED' ELSE 'FAILED' END AS status FROM volumes v LEFT JOIN (SELECT volume_id, count(CASE WHEN live >= {FACTOR} THEN 1 END) AS ok, count(CASE WHEN live < {FACTOR} THEN 1 END) AS bad FROM health GROUP BY volume_id) x ON v.volume_id = x.volume_id",
        ),
        "c8_repair_queue": (
            lambda s, d: compliance.repair_queue(_health(s, d), t(s, d, "volumes"), FACTOR, DATA_SHARDS, PARITY_SHARDS, t(s, d, "corrupted")),
            f"""{duck('', *_BASE, "corrupted").rstrip()}, {_HEALTH}, due AS (SELECT h.*, v.pool, {_WANTED} AS wanted, c.chunk_id IS NOT NULL AS bad FROM health h JOIN volumes v ON h.volume_id = v.volume_id LEFT JOIN corrupted c ON h.chunk_id = c.chunk_id)
            SELECT volume_id, pool, chunk_id, CASE WHEN bad THEN 'corrupted' WHEN live >= wanted THEN 'compliant' WHEN live > 0 THEN 'under_replicated' ELSE 'unavailable' END AS status, CASE WHEN bad THEN -1 ELSE live END AS priority, greatest(wanted - live, 0) AS missing FROM due WHERE bad OR live < wanted""",
        ),
        "c10_surviving": (lambda s, d: compliance.recovery_plan(t(s, d, "placements"), "node-4"), duck("SELECT chunk_id, count(CASE WHEN node_id <> 'node-4' THEN 1 END) AS surviving FROM placements WHERE chunk_id IN (SELECT chunk_id FROM placements WHERE node_id = 'node-4') GROUP BY chunk_id", "placements")),
        "c4_action_states": (
            lambda s, d: compliance.action_states(t(s, d, "placements"), FACTOR),
            duck(f"SELECT chunk_id, CASE WHEN count(*) < {FACTOR} THEN 'under' WHEN count(*) > {FACTOR} THEN 'over' ELSE 'healthy' END AS state, greatest({FACTOR} - count(*), 0) AS needed, coalesce(string_agg(CASE WHEN rn > {FACTOR} THEN node_id END, ',' ORDER BY slot), '') AS remove FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY slot) AS rn FROM placements) p GROUP BY chunk_id", "placements"),
        ),
        "t1_list_objects": (
            lambda s, d: listing.list_objects(t(s, d, "objects"), "bucket-3", "e", "/"),
            duck("SELECT DISTINCT CASE WHEN strpos(substring(key, 2), '/') > 0 THEN substring(key, 1, 1 + strpos(substring(key, 2), '/')) ELSE key END AS name, strpos(substring(key, 2), '/') > 0 AS is_prefix FROM objects WHERE bucket = 'bucket-3' AND starts_with(key, 'e')", "objects"),
        ),
        "t4_volume_page": (lambda s, d: listing.page_after(t(s, d, "volumes").select("volume_id", "pool"), "volume_id", "vol-3", 40), duck("SELECT volume_id, pool FROM volumes WHERE volume_id > 'vol-3' ORDER BY volume_id LIMIT 40", "volumes")),
        "w1_latest_version": (lambda s, d: listing.latest_versions(t(s, d, "versions")), duck("SELECT key, turn, role, size, versions FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn DESC) AS rn, count(*) OVER (PARTITION BY key) AS versions FROM versions) v WHERE rn = 1", "versions")),
        "w2_ranked_versions": (lambda s, d: listing.ranked_versions(t(s, d, "versions")), duck("SELECT key, turn, row_number() OVER (PARTITION BY key ORDER BY turn) AS n, lag(turn) OVER (PARTITION BY key ORDER BY turn) AS previous FROM versions", "versions")),
        "ag11_bucket_stats": (lambda s, d: listing.bucket_stats(t(s, d, "objects")), duck("SELECT bucket, count(*) AS objects, cast(sum(size) AS bigint) AS bytes FROM objects GROUP BY bucket", "objects")),
        "w4_merge_ranges": (lambda s, d: ranges.merge_ranges(t(s, d, "ranges"), "file_id"), duck(_MERGED, "ranges")),
        "w3_coalesce_writes": (
            lambda s, d: ranges.coalesce_writes(t(s, d, "writes"), exprs.CHUNK_BYTES),
            duck("""SELECT volume_id, chunk, min(off) AS off, cast(sum(len) AS bigint) AS len, count(*) AS blocks FROM (SELECT *, sum(new) OVER (PARTITION BY volume_id, chunk ORDER BY off ROWS UNBOUNDED PRECEDING) AS run FROM (
                SELECT *, CASE WHEN lag(off + len) OVER (PARTITION BY volume_id, chunk ORDER BY off) = off THEN 0 ELSE 1 END AS new FROM (SELECT volume_id, off, off // 4194304 AS chunk, max_by(len, event_id) AS len FROM writes GROUP BY volume_id, off) a) b) c GROUP BY volume_id, chunk, run""", "writes"),
        ),
        "j15_lock_conflicts": (
            lambda s, d: ranges.lock_conflicts(t(s, d, "locks"), T0),
            duck(f"SELECT a.ino, a.lease_id AS lease_a, b.lease_id AS lease_b FROM locks a JOIN locks b ON a.ino = b.ino AND a.event_id < b.event_id AND a.owner <> b.owner AND NOT (a.kind = 'read' AND b.kind = 'read') AND a.expires_at >= {T0} AND b.expires_at >= {T0} AND (b.end_off = -1 OR a.start_off < b.end_off) AND (a.end_off = -1 OR b.start_off < a.end_off)", "locks"),
        ),
        "j15_conflict_counts": (
            lambda s, d: ranges.lock_conflict_counts(t(s, d, "locks"), T0),
            duck(f"SELECT a.lease_id, a.ino, count(b.lease_id) AS conflicts FROM locks a LEFT JOIN locks b ON a.ino = b.ino AND a.event_id <> b.event_id AND a.owner <> b.owner AND NOT (a.kind = 'read' AND b.kind = 'read') AND b.expires_at >= {T0} AND (b.end_off = -1 OR a.start_off < b.end_off) AND (a.end_off = -1 OR b.start_off < a.end_off) WHERE a.expires_at >= {T0} GROUP BY a.lease_id, a.ino", "locks"),
        ),
        "ag19_clamped_usage": (
            lambda s, d: ranges.clamped_usage(t(s, d, "usage_log"), "name_no"),
            duck("SELECT name_no, cast(max_by(s, event_id) - least(min(s), 0) AS bigint) AS used, count(*) AS changes FROM (SELECT name_no, event_id, sum(delta) OVER (PARTITION BY name_no ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM usage_log) x GROUP BY name_no", "usage_log"),
        ),
        "st1_log_fold": (lambda s, d: ranges.fold_log(t(s, d, "change_log")), duck("SELECT key, value, idx FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS rn FROM change_log) x WHERE rn = 1 AND op = 'put'", "change_log")),
        "st2_highest_generation": (lambda s, d: ranges.highest_generation(t(s, d, "change_log")), duck("SELECT key, generation, idx, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY generation DESC, idx) AS rn FROM change_log) x WHERE rn = 1", "change_log")),
        "st10_backoff": (lambda s, d: t(s, d, "heal_tasks").where("status = 'failed' AND retry_count < 5").select("task_id", exprs.backoff_seconds(F.col("retry_count")).alias("wait")), duck("SELECT task_id, cast(10 * pow(2, retry_count) AS bigint) AS wait FROM heal_tasks WHERE status = 'failed' AND retry_count < 5", "heal_tasks")),
        "b5_reassemble": (lambda s, d: chunks.reassemble(chunks.split_chunks(_files(s, d), 1024)).select("file_id", F.sha2("data", 256).alias("sha")), "SELECT doc_id AS file_id, sha256(text) AS sha FROM documents"),
        "b10_erasure_round_trip": (
            lambda s, d: (lambda c: chunks.erasure_decode(chunks.erasure_encode(c, DATA_SHARDS, PARITY_SHARDS).where("shard_index NOT IN (0, 3)"), DATA_SHARDS, PARITY_SHARDS).select("chunk_id", F.sha2("data", 256).alias("sha")))(_files(s, d).select(F.col("file_id").cast("string").alias("chunk_id"), "data")),
            "SELECT cast(doc_id AS varchar) AS chunk_id, sha256(text) AS sha FROM documents",
        ),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: (lambda s, d, q=sql, t=names: query(s, d, q, *t, *(["orders"] if "orders" in q else []))) for n, (sql, names) in BOTH.items()}
    return found | {n: f for n, (f, _) in _frames().items()} | wider.queries() | commands.queries()


def oracle_sql() -> dict[str, str]:
    found = {n: duck(sql, *names) for n, (sql, names) in BOTH.items()}
    return found | {n: sql for n, (_, sql) in _frames().items() if sql} | wider.oracle_sql() | commands.oracle_sql()
