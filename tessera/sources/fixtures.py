"""Metadata tables of a chunk-based storage cluster, derived from the driver's
tables. Every derivation exists twice: as SQL that Spark and DuckDB both run
(``TABLES``), and as a DataFrame through ``table``. ``T0`` is a fixed instant.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

T0 = 1_700_000_000
#: Replicas a volume wants, unless it is erasure coded (4+2).
FACTOR = 3
DATA_SHARDS, PARITY_SHARDS = 4, 2

#: name -> SQL over the driver's tables and tables named before it
TABLES: dict[str, str] = {
    "nodes": f"""
        SELECT concat('node-', cast(s.s_suppkey AS varchar(20))) AS node_id, s.s_suppkey AS node_no,
               n.n_name AS rack, r.r_name AS zone, s.s_suppkey % 4 + 1 AS weight,
               CASE WHEN s.s_suppkey % 7 = 0 THEN 'offline' ELSE 'ready' END AS status,
               {T0} - s.s_suppkey % 90 AS last_heartbeat,
               cast((s.s_suppkey % 50 + 1) * 1000 AS bigint) AS total_capacity,
               cast((s.s_suppkey % 50 + 1) * (s.s_suppkey % 11) * 100 AS bigint) AS available_capacity
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "volumes": """
        SELECT concat('vol-', cast(o_orderkey AS varchar(20))) AS volume_id, o_orderkey AS volume_no, o_orderpriority AS pool,
               CASE WHEN o_orderstatus = 'P' THEN 'erasure_coding' ELSE 'replication' END AS mode,
               cast(floor(o_totalprice) AS bigint) AS size_bytes
        FROM orders""",
    "volume_chunks": """
        SELECT concat('vol-', cast(l_orderkey AS varchar(20))) AS volume_id, concat('chunk-', cast(l_partkey AS varchar(20))) AS chunk_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS position
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 13 <> 0) d""",
    "placements": """
        SELECT concat('chunk-', cast(p.p_partkey AS varchar(20))) AS chunk_id, concat('node-', cast((p.p_partkey + 3 * i.i) % c.n AS varchar(20))) AS node_id, cast(i.i AS int) AS slot
        FROM part p CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) i
        CROSS JOIN (SELECT count(*) AS n FROM supplier) c
        WHERE p.p_partkey % 11 <> 0 AND i.i <= p.p_partkey % 5""",
    "objects": """
        SELECT page_id, concat('bucket-', cast(page_id % 7 AS varchar(20))) AS bucket,
               substring(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 2) AS key,
               cast(length(html) AS bigint) AS size
        FROM pages""",
    "snapshots": """
        SELECT concat('snap-', cast(o_orderkey AS varchar(20))) AS snapshot_id, concat('vol-', cast(o_orderkey AS varchar(20))) AS source_volume_id
        FROM orders WHERE o_orderkey % 17 = 0""",
    "object_chunks": """
        SELECT concat('chunk-', cast(p_partkey AS varchar(20))) AS chunk_id FROM part WHERE p_partkey % 91 = 0""",
    "multipart_chunks": """
        SELECT concat('chunk-', cast(p_partkey AS varchar(20))) AS chunk_id FROM part WHERE p_partkey % 143 = 0""",
    "snapshot_chunks": """
        SELECT DISTINCT concat('snap-', cast(l_orderkey AS varchar(20))) AS snapshot_id, concat('chunk-', cast(l_partkey AS varchar(20))) AS chunk_id FROM lineitem WHERE l_orderkey % 17 = 0""",
    "backends": """
        SELECT concat('node-', cast(s.s_suppkey AS varchar(20))) AS node_id, concat('node-', cast(s.s_suppkey AS varchar(20)), '-b', cast(i.i AS varchar(20))) AS backend_id, (s.s_suppkey + i.i) % 4 + 1 AS weight
        FROM supplier s CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) i WHERE i.i <= s.s_suppkey % 3""",
    "corrupted": """
        SELECT concat('chunk-', cast(p_partkey AS varchar(20))) AS chunk_id FROM part WHERE p_partkey % 37 = 0""",
    "heartbeats": """
        SELECT concat('node-', cast(user_id % 20 AS varchar(20))) AS node_id, event_id * 2500 AS ms FROM events""",
    "inode_chunks": """
        SELECT concat('chunk-', cast(p_partkey AS varchar(20))) AS chunk_id FROM part WHERE p_partkey % 169 = 0""",
    "locks": f"""
        SELECT concat('lease-', cast(event_id AS varchar(20))) AS lease_id, event_id, user_id % 50 AS ino, concat('owner-', cast(event_id % 7 AS varchar(20))) AS owner,
               cast(floor(value * 10) AS bigint) + event_id % 5 * 3000000000 AS start_off,
               CASE WHEN event_id % 19 = 0 THEN cast(-1 AS bigint) WHEN event_id % 101 = 0 THEN cast(floor(value * 10) AS bigint) + 20000000000
                    ELSE cast(floor(value * 10) AS bigint) + event_id % 5 * 3000000000 + event_id % 40 + 1 END AS end_off,
               CASE WHEN event_id % 3 = 0 THEN 'write' ELSE 'read' END AS kind, {T0} + event_id % 60 - 20 AS expires_at
        FROM events""",
    "heal_tasks": f"""
        SELECT concat('task-', cast(event_id AS varchar(20))) AS task_id, concat('vol-', cast(user_id % 200 AS varchar(20))) AS volume_id, event_id % 5 AS priority,
               CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in-progress' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
               {T0} - event_id % 900 AS updated_at, event_id AS created_at, event_id % 7 AS retry_count
        FROM events""",
    "change_log": """
        SELECT event_id AS idx, concat('key-', cast(user_id AS varchar(20))) AS key,
               CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'put' END AS op, cast(floor(value) AS bigint) AS value, event_id % 97 AS generation
        FROM events""",
    "writes": """
        SELECT concat('vol-', cast(user_id % 40 AS varchar(20))) AS volume_id, (event_id * 7919 % 512) * 65536 AS off, cast(65536 AS bigint) AS len, event_id
        FROM events""",
    "ranges": """
        SELECT concat('file-', cast(user_id % 60 AS varchar(20))) AS file_id, event_id * 613 % 4000 AS start_off, event_id * 613 % 4000 + event_id % 23 + 1 AS end_off, event_id
        FROM events""",
    "bitmaps": """
        SELECT l_orderkey * 8 + l_linenumber AS chunk_index, l_orderkey * 2654435761 % 4611686018427387904 AS live, l_partkey * 40503 % 4611686018427387904 AS synced FROM lineitem""",
    "quotas": """
        SELECT c_custkey, c_name AS name, cast(floor(abs(c_acctbal)) AS bigint) * 20 AS hard, cast(floor(abs(c_acctbal)) AS bigint) * 15 AS soft FROM customer""",
    "usage_log": """
        SELECT event_id, user_id AS name_no, CASE WHEN event_id % 3 = 0 THEN -cast(floor(value * 2) AS bigint) ELSE cast(floor(value) AS bigint) END AS delta FROM events""",
    "versions": """
        SELECT conv_id, turn, concat('obj-', cast(conv_id AS varchar(20))) AS key, role, cast(length(text) AS bigint) AS size FROM conversations""",
    "dirents": """
        SELECT p_partkey % 40 + 2 AS parent, concat('f-', cast(p_partkey AS varchar(20))) AS name, p_partkey - p_partkey % 3 + 100 AS ino FROM part""",
    "inodes": """
        SELECT p_partkey + 100 AS ino, CASE WHEN p_partkey % 9 = 0 THEN 'dir' ELSE 'file' END AS kind, cast(p_size AS bigint) * 1000 AS size FROM part WHERE p_partkey % 3 = 0""",
    "shards": """
        SELECT concat('chunk-', cast(p.p_partkey AS varchar(20))) AS chunk_id, cast(i.i AS int) AS shard_index, concat('node-', cast((p.p_partkey + 7 * i.i) % c.n AS varchar(20))) AS node_id
        FROM part p CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) i
        CROSS JOIN (SELECT count(*) AS n FROM supplier) c
        WHERE p.p_partkey % 4 = 1 AND (p.p_partkey + i.i * i.i) % 7 <> 0 AND (p.p_partkey * 3 + i.i) % 5 <> 0""",
    "fs_log": """
        SELECT event_id AS idx, CASE event_id % 7 WHEN 0 THEN 'unlink' WHEN 1 THEN 'rename' WHEN 2 THEN 'link' ELSE 'create' END AS op,
               user_id % 20 + 2 AS parent, concat('f-', cast(event_id * 31 % 23 AS varchar(20))) AS name, event_id % 211 + 100 AS ino,
               event_id % 20 + 2 AS new_parent, concat('f-', cast(event_id * 17 % 23 AS varchar(20))) AS new_name
        FROM events""",
    "devices": """
        SELECT p_partkey AS device, p_type AS kind, cast(p_size AS bigint) * 1073741824 AS bytes FROM part""",
    "leases": """
        SELECT event_id AS idx, user_id % 30 AS ino, concat('owner-', cast(event_id % 5 AS varchar(20))) AS owner, concat('owner-', cast(event_id % 5 AS varchar(20)), '-', cast(event_id % 2 AS varchar(20))) AS lease,
               CASE event_id % 4 WHEN 0 THEN 'release' WHEN 1 THEN 'renew' ELSE 'acquire' END AS op, event_id % 13 * 1000000000 AS start_off,
               CASE WHEN event_id % 23 = 0 THEN cast(-1 AS bigint) ELSE event_id % 13 * 1000000000 + 2500000000 END AS end_off,
               CASE WHEN event_id % 3 = 0 THEN 'write' ELSE 'read' END AS kind, event_id AS moment, event_id + 600 AS expires_at
        FROM events""",
    "usage": """
        SELECT o_custkey AS c_custkey, cast(sum(cast(floor(o_totalprice) AS bigint)) AS bigint) AS used, count(*) AS objects FROM orders GROUP BY o_custkey""",
}

#: Tables of the driver that each table is derived from.
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "conversations", "documents")


def duck(sql: str, *names: str) -> str:
    """``sql`` for DuckDB, with the named tables as common table expressions."""
    names = tuple(n for n in names if n in TABLES)
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in names) + " " + sql if names else sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a driver table by its name."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASE if re.search(rf"\b(?:FROM|JOIN)\s+{b}\b", TABLES[name])}
    return spark.sql(_placeholders(TABLES[name], used), **used)


def query(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Spark SQL over the named derived or driver tables."""
    used = {n: table(spark, sf_dir, n) for n in names}
    return spark.sql(_placeholders(sql, used), **used)


def _placeholders(sql: str, tables: dict[str, DataFrame]) -> str:
    """Table names after FROM, JOIN or a comma become ``{name}``."""
    for name in tables:
        sql = re.sub(rf"(\b(?:FROM|JOIN)\s+){name}\b", rf"\1{{{name}}}", sql)
    return sql
