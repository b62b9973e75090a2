"""Data-protection compliance and repair planning.

Liveness of nodes is joined by broadcast: a cluster's node list is small next
to its chunks, and its size is checked by the planner's threshold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import ranked
from tessera.operators.placement import listed, place


def live_nodes(nodes: DataFrame, now: int, ttl: int) -> DataFrame:
    return nodes.where((F.col("last_heartbeat") >= now - ttl) & (F.col("status") != "offline"))


def chunk_health(placements: DataFrame, live: DataFrame) -> DataFrame:
    """``chunk_id, replicas, live`` per placed chunk."""
    marked = placements.join(live.select("node_id", F.lit(1).alias("up")), "node_id", "left")
    return marked.groupBy("chunk_id").agg(F.count("*").alias("replicas"), F.count("up").alias("live"))


def volume_chunk_health(volume_chunks: DataFrame, placements: DataFrame, live: DataFrame) -> DataFrame:
    """Health of every chunk of every volume; unplaced chunks have none."""
    return volume_chunks.select("chunk_id", "volume_id").join(chunk_health(placements, live), "chunk_id", "left").na.fill(0, ["replicas", "live"])


def chunk_state(live: F.Column, wanted: F.Column) -> F.Column:
    return F.when(live >= wanted, "compliant").when(live > 0, "under_replicated").otherwise("unavailable")


def volume_compliance(volumes: DataFrame, health: DataFrame, factor: int, data_shards: int, parity: int) -> DataFrame:
    """Counts of a volume's chunks by state, by the volume's own protection.
    Begins at the volumes, so that volumes without chunks are reported."""
    wanted = F.when(F.col("mode") == "erasure_coding", data_shards + parity).otherwise(factor)
    joined = volumes.join(health, "volume_id", "left").withColumn("state", F.when(F.col("chunk_id").isNotNull(), chunk_state(F.col("live"), wanted)))
    counts = [F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("compliant", "under_replicated", "unavailable")]
    return joined.groupBy("volume_id", "pool", "mode").agg(F.count("chunk_id").alias("chunks"), *counts)


def volume_status(volumes: DataFrame, health: DataFrame, factor: int) -> DataFrame:
    """OK, DEGRADED or FAILED at one factor for all: failed with none
    compliant is FAILED."""
    v = health.groupBy("volume_id").agg(F.count(F.when(F.col("live") >= factor, 1)).alias("ok"), F.count(F.when(F.col("live") < factor, 1)).alias("bad"))
    status = F.when(F.coalesce("bad", F.lit(0)) == 0, "OK").when(F.col("ok") > 0, "DEGRADED").otherwise("FAILED")
    return volumes.select("volume_id").join(v, "volume_id", "left").select("volume_id", status.alias("status"))


def pool_compliance(per_volume: DataFrame) -> DataFrame:
    bad = (F.col("under_replicated") + F.col("unavailable")) > 0
    return per_volume.groupBy("pool").agg(
        F.count("*").alias("volumes"), F.sum("chunks").alias("chunks"), F.sum("compliant").alias("compliant"), F.sum("under_replicated").alias("under_replicated"),
        F.sum("unavailable").alias("unavailable"), F.count(F.when(bad, 1)).alias("bad_volumes"), F.min_by("mode", "volume_id").alias("mode"),
    )


def repair_queue(health: DataFrame, volumes: DataFrame, factor: int, data_shards: int, parity: int, corrupted: DataFrame) -> DataFrame:
    """A task for each chunk of each volume that is not compliant under the
    volume's protection, or that is corrupted: its priority is the number of
    live replicas, -1 for a corrupted one; lower goes first."""
    wanted = F.when(F.col("mode") == "erasure_coding", data_shards + parity).otherwise(factor)
    bad = corrupted.select("chunk_id").distinct().withColumn("bad", F.lit(True))
    rows = health.join(volumes.select("volume_id", "pool", "mode"), "volume_id").join(bad, "chunk_id", "left").withColumn("wanted", wanted)
    due = rows.where(F.col("bad").isNotNull() | (F.col("live") < F.col("wanted")))
    priority = F.when(F.col("bad"), F.lit(-1)).otherwise(F.col("live"))
    status = F.when(F.col("bad"), "corrupted").otherwise(chunk_state(F.col("live"), F.col("wanted")))
    return due.select("volume_id", "pool", "chunk_id", status.alias("status"), priority.cast("long").alias("priority"), F.greatest(F.col("wanted") - F.col("live"), F.lit(0)).alias("missing"))


def _holders(placements: DataFrame) -> DataFrame:
    return placements.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "node_id"))), lambda x: x["node_id"]).alias("nodes"))


def actions(placements: DataFrame, nodes: DataFrame, factor: int) -> DataFrame:
    """``chunk_id, action, source, target``: a chunk short of replicas is
    replicated from its first holder to the nodes that placement names and that
    lack it; one with too many loses the last ones of its list. Only short
    chunks are placed, and no further than to the last target."""
    held = _holders(placements).withColumn("n", F.size("nodes"))
    short = held.where(F.col("n") < factor)
    named = place(short.select(F.col("chunk_id").alias("key"), "n", "nodes"), nodes, factor, F.lit(factor) - F.col("n"), F.col("nodes")).join(short, F.col("key") == F.col("chunk_id")).where(~F.array_contains("nodes", F.col("node_id")))
    turn = F.row_number().over(Window.partitionBy("chunk_id").orderBy("replica"))
    copies = named.withColumn("turn", turn).where(F.col("turn") <= factor - F.col("n")).select("chunk_id", F.lit("replicate").alias("action"), F.get("nodes", F.lit(0)).alias("source"), F.col("node_id").alias("target"))
    extra = held.where(F.col("n") > factor).select("chunk_id", F.lit("remove").alias("action"), F.explode(F.slice("nodes", F.lit(factor + 1), F.col("n") - factor)).alias("source"))
    return copies.unionByName(extra.withColumn("target", F.lit(None).cast("string")))


def recover_node(placements: DataFrame, down: str, healthy: DataFrame, block: int = 4096, prefix: int = 9) -> DataFrame:
    """``chunk_id, source, target, priority`` for the chunks of a failed node,
    in order of id: the source is the first survivor, the target the next node
    of a rotation over the healthy ones that lacks the chunk, and the cursor
    goes on behind it. Chunks without a survivor or a target are left out.

    One chunk maps each cursor to the next one, so a block of chunks does too.
    Blocks are folded side by side for all cursors; their maps, as long as the
    node list, are chained in order, and then each block is walked from its own
    start. Blocks are ranges of a chunk's rank, which is counted within the ids
    that share ``prefix`` characters.
    """
    ring = [r["node_id"] for r in listed(healthy.where(F.col("node_id") != down).select("node_id"))]
    hit = placements.where(F.col("node_id") == down).select("chunk_id").distinct()
    held = _holders(placements.join(hit, "chunk_id", "left_semi"))
    n = len(ring)
    schema = "chunk_id string, source string, target string, priority long"
    if not n:
        return held.sparkSession.createDataFrame([], schema)
    held = ranked(held.where(F.exists("nodes", lambda x: x != down)), [F.substring("chunk_id", 1, prefix)], ["chunk_id"])
    held = held.withColumn("block", F.expr(f"(rank - 1) div {block}"))
    at = {name: i for i, name in enumerate(ring)}

    def nexts(nodes) -> np.ndarray:
        """Position of the next free node from each cursor; -1 for none."""
        free = np.ones(n, dtype=bool)
        free[[at[x] for x in nodes if x in at]] = False
        where = np.flatnonzero(free)
        return where[np.searchsorted(where, np.arange(n)) % len(where)] if len(where) else np.full(n, -1)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        cursor = np.arange(n)
        for nodes in pdf.sort_values("rank")["nodes"]:
            got = nexts(nodes)[cursor]
            cursor = np.where(got >= 0, (got + 1) % n, cursor)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ends": [cursor.tolist()]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, cursor = [], 0
        for ends in pdf["ends"]:
            starts.append(cursor)
            cursor = int(ends[cursor])
        return pd.DataFrame({"block": pdf["block"], "start": starts})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        cursor, out = int(pdf["start"].iloc[0]), []
        for c, nodes in zip(*(pdf.sort_values("rank")[k] for k in ("chunk_id", "nodes")), strict=True):
            got = int(nexts(nodes)[cursor])
            if got >= 0:
                alive = [x for x in nodes if x != down]
                out.append((c, alive[0], ring[got], len(alive)))
                cursor = (got + 1) % n
        return pd.DataFrame(out, columns=["chunk_id", "source", "target", "priority"])

    ends = held.groupBy("block").applyInPandas(maps, "block long, ends array<int>")
    # one row per block of chunks
    starts = ends.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(lambda pdf: chain(pdf.sort_values("block")), "block long, start int")
    return held.join(starts, "block").groupBy("block").applyInPandas(walk, schema)


def update_placements(placements: DataFrame, moves: DataFrame, old: str) -> DataFrame:
    """``chunk_id, nodes``: the first entry of ``old`` becomes the move's
    ``target`` in each moved chunk's list; a chunk that ``old`` does not hold
    stays as it is."""
    rows = _holders(placements).join(moves.select("chunk_id", "target"), "chunk_id", "left")
    at = F.array_position("nodes", F.lit(old))
    put = F.transform("nodes", lambda x, i: F.when((i == at - 1) & F.col("target").isNotNull(), F.col("target")).otherwise(x))
    return rows.select("chunk_id", F.array_join(put, ",").alias("nodes"))


def recovery_plan(placements: DataFrame, down: str) -> DataFrame:
    """Chunks of a failed node with their surviving replicas, fewest first."""
    hit = placements.where(F.col("node_id") == down).select("chunk_id").distinct()
    return placements.join(hit, "chunk_id").groupBy("chunk_id").agg(F.count(F.when(F.col("node_id") != down, 1)).alias("surviving"))


def action_states(placements: DataFrame, factor: int) -> DataFrame:
    """Under-, over- or healthy, the replicas a chunk lacks, and those beyond
    the factor, last ones of the list first to go."""
    held = _holders(placements)
    n = F.size("nodes")
    state = F.when(n < factor, "under").when(n > factor, "over").otherwise("healthy")
    excess = F.when(n > factor, F.array_join(F.slice("nodes", F.lit(factor + 1), F.greatest(n - factor, F.lit(0))), ",")).otherwise("")
    return held.select("chunk_id", state.alias("state"), F.greatest(F.lit(factor) - n, F.lit(0)).alias("needed"), excess.alias("remove"))
