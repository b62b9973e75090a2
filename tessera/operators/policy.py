"""Policy evaluation: availability of replicas and shards, repairs, guards.

Shards are rows ``chunk_id, shard_index, node_id``; placements ``chunk_id,
node_id, slot``. Node tables are small beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import health_class, placement_hash


def _names(found: Column) -> Column:
    return F.array_join(F.array_sort(found), ",")


def availability(volume_chunks: DataFrame, placements: DataFrame, live: DataFrame) -> DataFrame:
    """Nodes of each volume's chunk, split into available and failed, as sorted
    comma lists. Placements are gathered once per chunk, whatever the number of
    volumes that share it."""
    up = live.select("node_id", F.lit(True).alias("up"))
    held = placements.join(up, "node_id", "left").groupBy("chunk_id").agg(
        _names(F.collect_list(F.when(F.col("up"), F.col("node_id")))).alias("available"), _names(F.collect_list(F.when(F.col("up").isNull(), F.col("node_id")))).alias("failed"), F.count("up").alias("n_available")
    )
    return volume_chunks.select("volume_id", "chunk_id").join(held, "chunk_id", "left").na.fill("", ["available", "failed"]).na.fill(0, ["n_available"])


def shard_health(shards: DataFrame, live: DataFrame | None, data: int, parity: int) -> DataFrame:
    """``chunk_id, present, missing, state, can_read, can_write``: distinct
    shard indices present (on live nodes, if given), those missing, and whether
    enough are left."""
    rows = shards.where(F.col("shard_index").between(0, data + parity - 1))
    if live is not None:
        rows = rows.join(live.select("node_id", F.lit(True).alias("up")), "node_id", "left")
    else:
        rows = rows.withColumn("up", F.lit(True))
    every = F.sequence(F.lit(0), F.lit(data + parity - 1))
    have = rows.groupBy("chunk_id").agg(F.collect_set(F.when(F.col("up"), F.col("shard_index").cast("int"))).alias("have"))
    n = F.size("have")
    state = F.when(n >= data + parity, "healthy").when(n >= data, "degraded").otherwise("unrecoverable")
    return have.select("chunk_id", n.alias("present"), F.array_except(every, F.col("have")).alias("missing"), state.alias("state"), (n >= data).alias("can_read"), (n == data + parity).alias("can_write"))


def shard_repairs(health: DataFrame, placed: DataFrame) -> DataFrame:
    """``chunk_id, shard_index, target``: each missing shard of a recoverable
    chunk goes to the node that the placement names for its slot; a slot
    beyond the placement goes to its first node. ``placed`` has ``key,
    replica, node_id``."""
    lost = health.where(F.col("state") == "degraded").select("chunk_id", F.explode("missing").alias("shard_index"))
    slots = placed.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("replica", "node_id"))).alias("slots"))
    target = F.coalesce(F.try_element_at("slots", F.col("shard_index")), F.try_element_at("slots", F.lit(0)))
    return lost.join(slots, lost["chunk_id"] == slots["key"]).select("chunk_id", "shard_index", target.alias("target"))


def first_policy(volume_chunks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Policy that governs a chunk shared by volumes: that of the first one by
    id. An aggregate over ids, then one join."""
    first = volume_chunks.groupBy("chunk_id").agg(F.min("volume_id").alias("volume_id"))
    return first.join(volumes.select("volume_id", "pool", "mode"), "volume_id").select("chunk_id", "volume_id", "pool", "mode")


def evaluate_all(placements: DataFrame, policies: DataFrame, factor: int) -> DataFrame:
    """State of every placed chunk under its governing policy; erasure-coded
    chunks are judged by their shards elsewhere, unreferenced ones by none."""
    n = placements.groupBy("chunk_id").agg(F.count("*").alias("replicas"))
    by = F.when(F.col("mode") == "erasure_coding", "by_shards").when(F.col("replicas") < factor, "under").when(F.col("replicas") > factor, "over").otherwise("healthy")
    return n.join(policies, "chunk_id", "left").select("chunk_id", "replicas", F.when(F.col("mode").isNull(), "unreferenced").otherwise(by).alias("state"))


def node_classes(nodes: DataFrame, now: int, suspect: int = 30, down: int = 60) -> DataFrame:
    """Health class; a node that is not ready counts as down."""
    return nodes.select("node_id", F.when(F.col("status") != "ready", "down").otherwise(health_class(F.lit(now) - F.col("last_heartbeat"), suspect, down)).alias("class"))


def heal_status(volumes: DataFrame, health: DataFrame, classes: DataFrame, factor: int) -> DataFrame:
    """One row: nodes by class, degraded and failed volumes, overall status.
    ``health`` holds live replicas per volume and chunk."""
    v = health.groupBy("volume_id").agg(F.min("live").alias("least")).join(volumes.select("volume_id"), "volume_id", "left_semi")
    vols = v.agg(F.count(F.when(F.col("least") == 0, 1)).alias("failed_volumes"), F.count(F.when((F.col("least") > 0) & (F.col("least") < factor), 1)).alias("degraded_volumes"))
    ns = classes.agg(*[F.count(F.when(F.col("class") == c, 1)).alias(f"{c}_nodes") for c in ("healthy", "suspect", "down")])
    status = F.when((F.col("failed_volumes") > 0) | (F.col("down_nodes") > 0), "critical").when((F.col("degraded_volumes") > 0) | (F.col("suspect_nodes") > 0), "healing").otherwise("healthy")
    # one row meets one row
    return ns.join(F.broadcast(vols), F.lit(True)).withColumn("status", status)


def missing_replicas(health: DataFrame, factor: int) -> DataFrame:
    """Volumes with chunks short of replicas: how many chunks and replicas."""
    short = F.greatest(F.lit(factor) - F.col("live"), F.lit(0))
    return health.groupBy("volume_id").agg(F.sum(short).alias("missing"), F.count(F.when(short > 0, 1)).alias("affected")).where("affected > 0")


def locality_scores(claims: DataFrame, holders: DataFrame, nodes: DataFrame, weight: int, bonus: int, top: int = 100) -> DataFrame:
    """``pod, node_id, score``: ``weight`` for each claimed volume that a node
    holds and ``bonus`` for each, capped at ``top`` where a bonus is given.
    Pairs with data come from a join on volumes; other nodes score zero and are
    not listed."""
    local = claims.join(holders, "volume_id").join(nodes.select("node_id"), "node_id", "left_semi").groupBy("pod", "node_id").agg(F.countDistinct("volume_id").alias("n"))
    raw = F.col("n") * (weight + max(bonus, 0))
    return local.select("pod", "node_id", (F.least(F.lit(top), raw) if bonus > 0 else raw).cast("long").alias("score"))


def shard_to_regenerate(shards: DataFrame, dest: str, total: int) -> DataFrame:
    """Lowest shard index that another node has and ``dest`` lacks, by chunk;
    zero when there is none."""
    own = F.max(F.when(F.col("node_id") == dest, 1).otherwise(0))
    other = F.max(F.when(F.col("node_id") != dest, 1).otherwise(0))
    by = shards.where(F.col("shard_index") < total).groupBy("chunk_id", "shard_index").agg(own.alias("own"), other.alias("other"))
    return by.groupBy("chunk_id").agg(F.coalesce(F.min(F.when((F.col("own") == 0) & (F.col("other") == 1), F.col("shard_index"))), F.lit(0)).alias("shard_index"))


def may_delete(replicas: DataFrame) -> DataFrame:
    """Whether one more copy can go: replicated chunks (index -1) keep two,
    a shard keeps one."""
    n = replicas.groupBy("chunk_id", "shard_index").agg(F.count("*").alias("copies"))
    return n.withColumn("allowed", F.col("copies") > F.when(F.col("shard_index") >= 0, 1).otherwise(2))


def has_quorum(writes: DataFrame, key: str, ok: Column) -> DataFrame:
    """A majority of a key's replicas answered."""
    return writes.groupBy(key).agg((F.count(F.when(ok, 1)) >= F.floor(F.count("*") / 2) + 1).alias("quorum"))


def replace_node(placements: DataFrame, failed: DataFrame, target: Column) -> DataFrame:
    """Each chunk's first failed holder, in slot order, becomes ``target``; a
    chunk of ``failed`` whose holders all live gets the target as one more."""
    down = placements.join(failed.select("node_id", F.lit(True).alias("down")), "node_id", "left")
    lists = down.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("slot", "node_id", F.coalesce("down", F.lit(False)).alias("down")))).alias("p"))
    nodes, at = F.transform("p", lambda x: x["node_id"]), F.array_position(F.transform("p", lambda x: x["down"]), True)
    put = F.transform(nodes, lambda x, i: F.when(i == at - 1, target).otherwise(x))
    return lists.select("chunk_id", F.array_join(F.when(at > 0, put).otherwise(F.array_append(nodes, target)), ",").alias("nodes"))


def spread_destinations(placements: DataFrame, down: str, healthy: DataFrame) -> DataFrame:
    """``chunk_id, source, target`` for the chunks of a failed node: the first
    healthy node in a rotation that does not hold the chunk. Each chunk starts
    the rotation at its own hash, so chunks spread evenly and no cursor runs
    through them one by one. Chunks without a survivor or target are left out."""
    hit = placements.where(F.col("node_id") == down).select("chunk_id").distinct()
    held = placements.join(hit, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("slot", "node_id"))).alias("p"))
    ring = F.broadcast(healthy.agg(F.array_sort(F.collect_list("node_id")).alias("ring")))
    nodes = F.transform("p", lambda x: x["node_id"])
    start = (placement_hash(F.col("chunk_id"), F.lit("rotate")) % F.size("ring")).cast("int")
    turned = F.concat(F.slice("ring", start + 1, F.size("ring")), F.slice("ring", F.lit(1), start))
    rows = held.join(ring, F.lit(True)).where(F.size("ring") > 0)
    picked = rows.select("chunk_id", F.get(F.filter(nodes, lambda x: x != down), F.lit(0)).alias("source"), F.get(F.array_except(turned, nodes), F.lit(0)).alias("target"))
    return picked.where("source IS NOT NULL AND target IS NOT NULL")


def within_topology(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes of the wanted topology, or all nodes when none matches. One pass:
    a window over one broadcast flag, no count on the driver."""
    marked = nodes.join(F.broadcast(wanted.select("node_id").distinct().withColumn("hit", F.lit(True))), "node_id", "left")
    some = F.broadcast(marked.agg(F.count("hit").alias("hits")))
    return marked.join(some, F.lit(True)).where(F.col("hit") | (F.col("hits") == 0)).drop("hit", "hits")


def round_by_domain(draws: DataFrame, count: int) -> DataFrame:
    """``key, node_id, n``: nodes picked by lowest draw, one of each domain
    first, then the next of each in turn. ``draws`` has ``key, node_id,
    domain, draw``."""
    by = Window.partitionBy("key", "domain")
    rows = draws.withColumn("round", F.row_number().over(by.orderBy("draw", "node_id"))).withColumn("best", F.min("draw").over(by))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("round", "best", "domain")))
    return ranked.where(F.col("n") <= count).select("key", "node_id", "n")
