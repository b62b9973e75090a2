"""Directories, inodes, object versions and multipart uploads.

Changes are log rows in order of ``idx``; state is their fold, so nothing is
updated in place and each key folds by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import ranked

#: Inode of the root, and the first that is given out.
ROOT, FIRST_INO = 1, 3


def entry_changes(log: DataFrame) -> DataFrame:
    """``idx, parent, name, ino`` (null: removed) of a file log with the ops
    ``create``, ``link``, ``unlink``, ``rename``. A rename removes one entry
    and blindly overwrites another."""
    gone = F.struct("parent", "name", F.lit(None).cast("long").alias("ino"))
    put = F.struct("parent", "name", F.col("ino").cast("long").alias("ino"))
    move = F.struct(F.col("new_parent").alias("parent"), F.col("new_name").alias("name"), F.col("ino").cast("long").alias("ino"))
    same = (F.col("parent") == F.col("new_parent")) & (F.col("name") == F.col("new_name"))
    rows = F.when(F.col("op") == "unlink", F.array(gone)).when((F.col("op") == "rename") & same, F.array(put)).when(F.col("op") == "rename", F.array(gone, move)).otherwise(F.array(put))
    return log.select("idx", F.explode(rows).alias("c")).select("idx", "c.parent", "c.name", "c.ino")


def directory_entries(log: DataFrame) -> DataFrame:
    """Live entries after the whole log: the last change of each name counts."""
    last = entry_changes(log).groupBy("parent", "name").agg(F.max_by(F.struct("ino"), "idx").alias("v"))
    return last.where("v.ino IS NOT NULL").select("parent", "name", "v.ino")


def link_counts(entries: DataFrame) -> DataFrame:
    """Links of each inode; an inode without a link is gone."""
    return entries.groupBy("ino").agg(F.count("*").alias("links"))


def removable_directories(directories: DataFrame, entries: DataFrame) -> DataFrame:
    """Directories that hold no entry."""
    return directories.join(entries.select(F.col("parent").alias("ino")).distinct(), "ino", "left_anti")


def resolve(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    """Entries with the attributes of their inodes."""
    return entries.join(inodes, "ino")


def read_directory(entries: DataFrame, ino: int, cookie: int, limit: int) -> DataFrame:
    """``cookie, name, ino``: a page of a directory after a cookie, the entries
    ``.`` and ``..`` first. The page's rows are a top-k by name."""
    spark = entries.sparkSession
    own = spark.range(2).select((F.col("id") + 1).alias("cookie"), F.when(F.col("id") == 0, ".").otherwise("..").alias("name"), F.when(F.col("id") == 0, ino).otherwise(ROOT).cast("long").alias("ino"))
    page = entries.where(F.col("parent") == ino).orderBy("name").limit(max(0, cookie + limit - 2))
    listed = page.agg(F.array_sort(F.collect_list(F.struct("name", F.col("ino").cast("long").alias("ino")))).alias("l")).select(F.posexplode("l")).select((F.col("pos") + 3).cast("long").alias("cookie"), "col.name", "col.ino")
    return own.unionByName(listed).where((F.col("cookie") > cookie) & (F.col("cookie") <= cookie + limit))


def allocate_inodes(commands: DataFrame, block: int = 65_536) -> DataFrame:
    """``commands`` with ``new_ino``: numbers from ``FIRST_INO`` on in order of
    arrival, over all parents."""
    return ranked(commands, [F.expr(f"idx div {block}")], ["idx"], "new_ino").withColumn("new_ino", F.col("new_ino") + FIRST_INO - 1)


#: Inode type and first link count of each command.
CREATED = {"create": ("file", 1), "mkdir": ("dir", 2), "symlink": ("symlink", 1), "mknod": ("special", 1)}


def created_inodes(commands: DataFrame) -> DataFrame:
    """Change-log rows of ``create``, ``mkdir``, ``symlink`` and ``mknod``
    commands (``idx, op, parent, name``): the new inode with its type and link
    count, and the entry that names it."""
    kind, links = (F.coalesce(*[F.when(F.col("op") == op, F.lit(v[i])) for op, v in CREATED.items()]) for i in (0, 1))
    return allocate_inodes(commands.where(F.col("op").isin(*CREATED))).select("idx", "parent", "name", F.col("new_ino").alias("ino"), kind.alias("kind"), links.alias("links"))


def link_accounting(log: DataFrame) -> DataFrame:
    """``ino, links`` after a log of ``create``, ``link`` and ``unlink`` (``idx,
    op, parent, name, ino``). A new entry displaces the one of its name, whose
    inode loses a link if it is another one; an entry linked to its own inode
    again counts once more, as nothing is taken away. Inodes without a link are
    left out."""
    w = Window.partitionBy("parent", "name").orderBy("idx")
    put = F.col("op") != "unlink"
    last = log.withColumn("now", F.when(put, F.col("ino"))).withColumn("was", F.lag("now").over(w))
    gain = F.when(F.col("now").isNotNull(), F.struct(F.col("now").alias("ino"), F.lit(1).alias("d")))
    loss = F.when(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("now")), F.struct(F.col("was").alias("ino"), F.lit(-1).alias("d")))
    return last.select(F.explode(F.filter(F.array(gain, loss), lambda x: x.isNotNull())).alias("x")).groupBy("x.ino").agg(F.sum("x.d").alias("links")).where("links > 0")


def list_versions(versions: DataFrame, prefix: str, marker: str, limit: int) -> DataFrame:
    """Versions whose key starts with ``prefix`` and is not below ``marker``
    (inclusive), in order of key, latest first."""
    rows = versions.where(F.col("key").startswith(prefix) & (F.col("key") >= marker))
    return rows.orderBy("key", F.desc("turn")).limit(limit).select("key", "turn", "size")


def list_parts(parts: DataFrame, upload: str, marker: int, limit: int) -> DataFrame:
    """Parts after a marker, with the marker of the next page."""
    page = parts.where((F.col("upload_id") == upload) & (F.col("part_number") > marker)).orderBy("part_number").limit(limit)
    return page.join(F.broadcast(page.agg(F.max("part_number").alias("next_marker"))), F.lit(True)).select("part_number", "etag", "size", "next_marker")


def assemble_parts(parts: DataFrame) -> DataFrame:
    """``upload_id, size, etag, parts, chunks``: the object of each upload; its
    tag is the MD5 of the parts' tags in order, a dash and their number."""
    ordered = F.array_sort(F.collect_list(F.struct("part_number", "etag", "size", "chunk_id")))
    rows = parts.groupBy("upload_id").agg(ordered.alias("p"))
    tag = F.md5(F.array_join(F.transform("p", lambda x: x["etag"]), "").cast("binary"))
    return rows.select(
        "upload_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("size"), F.concat(tag, F.lit("-"), F.size("p").cast("string")).alias("etag"),
        F.size("p").alias("parts"), F.array_join(F.transform("p", lambda x: x["chunk_id"]), ",").alias("chunks"),
    )


def object_tags(objects: DataFrame, prefix: str = "tag:") -> DataFrame:
    """``page_id, tag, value`` of the metadata keys that begin with ``prefix``."""
    own = F.map_filter("meta", lambda k, _: k.startswith(prefix))
    return objects.select("page_id", F.explode(own).alias("k", "value")).select("page_id", F.substring("k", len(prefix) + 1, 1 << 30).alias("tag"), "value")


def copy_object(object_chunks: DataFrame, source: str, target: str) -> DataFrame:
    """Rows of a server-side copy: the same chunk ids under another key."""
    return object_chunks.where(F.col("key") == source).withColumn("key", F.lit(target))


def snapshot_volume(volume_chunks: DataFrame, volumes: DataFrame) -> DataFrame:
    """``snapshot_id, chunk_id, position``: snapshots copy chunk lists, no data."""
    return volume_chunks.join(volumes.select("volume_id"), "volume_id", "left_semi").select(F.concat(F.lit("snap-of-"), "volume_id").alias("snapshot_id"), "chunk_id", "position")


def delete_cascade(volume_chunks: DataFrame, deleted: DataFrame, *kept: DataFrame) -> DataFrame:
    """Chunks that go with deleted volumes: theirs, less what other volumes or
    the ``kept`` sources still refer to."""
    gone = volume_chunks.join(deleted.select("volume_id"), "volume_id", "left_semi").select("chunk_id").distinct()
    rest = volume_chunks.join(deleted.select("volume_id"), "volume_id", "left_anti").select("chunk_id")
    for k in kept:
        rest = rest.unionByName(k.select("chunk_id"))
    return gone.join(rest, "chunk_id", "left_anti")


def object_rows(puts: DataFrame, chunk: int) -> DataFrame:
    """Rows that putting objects (``idx, bucket, key, op, data``) writes: size,
    MD5 tag and ids of the body's chunks in order; an empty body has none. A
    delete carries no body."""
    n = F.ceil(F.octet_length("data") / F.lit(chunk)).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sha2(F.substring("data", i * chunk + 1, F.lit(chunk)), 256))).otherwise(F.array().cast("array<string>"))
    return puts.select("idx", "bucket", "key", "op", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("etag"), ids.alias("chunks"))


def object_state(rows: DataFrame) -> DataFrame:
    """Objects after the log: the last put of each key that no delete follows."""
    last = rows.groupBy("bucket", "key").agg(F.max_by(F.struct("op", "size", "etag", "chunks"), "idx").alias("v"))
    return last.where("v.op = 'put'").select("bucket", "key", "v.size", "v.etag", "v.chunks")


#: The encryption algorithms that a bucket may name.
ALGORITHMS = ("AES256", "aws:kms")


def encryption_configs(log: DataFrame, buckets: DataFrame) -> DataFrame:
    """``idx, bucket, outcome, algorithm``: each request for a bucket's
    encryption is stored or refused; the last stored one is in force."""
    known = log.join(buckets.select("bucket").distinct().withColumn("known", F.lit(True)), "bucket", "left")
    outcome = F.when(F.col("known").isNull(), "NoSuchBucket").when((F.col("op") == "put") & ~F.col("algorithm").isin(*ALGORITHMS), "MalformedXML").otherwise("ok")
    return known.select("idx", "bucket", "op", outcome.alias("outcome"), "algorithm")


def encryption_state(outcomes: DataFrame) -> DataFrame:
    last = outcomes.where("outcome = 'ok'").groupBy("bucket").agg(F.max_by(F.struct("op", "algorithm"), "idx").alias("v"))
    return last.where("v.op = 'put'").select("bucket", "v.algorithm")


def reservations(log: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Usage after reserving and releasing bytes in order (``idx, bytes``;
    negative: released): a reservation is refused if it would pass the hard
    limit (zero: none), a release stops at zero. A refusal depends on all
    before it, so each key's log is folded in order."""
    events = F.array_sort(F.collect_list(F.struct("idx", F.col("bytes").cast("long").alias("bytes"))))
    rows = log.groupBy(key).agg(events.alias("e")).join(limits.select(key, F.col("hard").cast("long").alias("hard")), key, "left")
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("refused"))

    def step(s: Column, e: Column) -> Column:
        after = s["used"] + e["bytes"]
        refuse = (e["bytes"] > 0) & (F.coalesce("hard", F.lit(0)) > 0) & (after > F.col("hard"))
        return F.struct(F.when(refuse, s["used"]).otherwise(F.greatest(after, F.lit(0).cast("long"))).alias("used"), (s["refused"] + refuse.cast("long")).alias("refused"))

    return rows.select(key, F.aggregate("e", zero, step).alias("s")).select(key, "s.used", "s.refused")


def command_rows(commands: DataFrame) -> DataFrame:
    """Change-log rows of create and delete commands (``idx, verb, bucket, key``
    and a struct ``value``): a create puts the value as JSON, a delete puts
    nothing in its place."""
    made = F.col("verb") == "create"
    return commands.select("idx", F.when(made, "put").otherwise("delete").alias("op"), "bucket", "key", F.when(made, F.to_json("value")).alias("value"))


def quota_phase(usage: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """``phase`` and ``admit`` of each limited key: active, warning above the
    soft limit, exceeded above the hard one; an addition is admitted while the
    total stays within the hard limit. Limits of zero do not bind."""
    rows = limits.join(usage, key, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    phase = F.when((F.col("hard") > 0) & (F.col("used") > F.col("hard")), "exceeded").when((F.col("soft") > 0) & (F.col("used") > F.col("soft")), "warning").otherwise("active")
    return rows.select(key, "used", phase.alias("phase"), ((F.col("hard") <= 0) | (F.col("used") < F.col("hard"))).alias("admit"))


def expired_objects(objects: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """Objects past a bucket's lifecycle rule (``bucket, prefix, days``). The
    rules are only stored where they come from; judging them is our extension."""
    due = objects.join(rules, "bucket").where(F.col("key").startswith(F.col("prefix")) & (F.col("modified") + F.col("days") * 86400 < now))
    return due.select("bucket", "key").distinct()
