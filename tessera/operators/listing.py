"""Object and version listings with deterministic paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def list_objects(objects: DataFrame, bucket: str, prefix: str = "", delimiter: str = "", after: str = "", limit: int | None = None) -> DataFrame:
    """``name, is_prefix``: keys and rolled-up prefixes in name order. Bucket,
    prefix and marker reach the scan as filters; the limit is a top-k."""
    rows = objects.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix) & (F.col("key") > after))
    if delimiter:
        rest = F.substring(F.col("key"), len(prefix) + 1, 1 << 30)
        at = F.instr(rest, delimiter)
        name = F.when(at > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), at + len(delimiter) - 1))).otherwise(F.col("key"))
        rows = rows.select(name.alias("name"), (at > 0).alias("is_prefix")).distinct()
    else:
        rows = rows.select(F.col("key").alias("name"), F.lit(False).alias("is_prefix"))
    rows = rows.where(F.col("name") > after)
    return rows.orderBy("name").limit(limit) if limit else rows


def listing_rows(objects: DataFrame, bucket: str, prefix: str, delimiter: str, limit: int) -> DataFrame:
    """Rows of a listing response in order: ``position, element, name, size,
    keys``. Keys that share a part up to the delimiter stand as one prefix; the
    limit counts keys and prefixes alike."""
    rest = F.substring(F.col("key"), len(prefix) + 1, 1 << 30)
    at = F.instr(rest, delimiter)
    name = F.when(at > 0, F.concat(F.lit(prefix), F.substring(rest, F.lit(1), at + len(delimiter) - 1))).otherwise(F.col("key"))
    rows = objects.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix)).select(name.alias("name"), (at > 0).alias("rolled"), "size")
    rolled = rows.groupBy("name", "rolled").agg(F.max(F.when(~F.col("rolled"), F.col("size"))).alias("size"), F.count("*").alias("keys"))
    page = rolled.orderBy("name").limit(limit)
    # a page of at most `limit` rows
    listed = page.agg(F.array_sort(F.collect_list(F.struct("name", "rolled", "size", "keys"))).alias("l")).select(F.posexplode("l"))
    return listed.select((F.col("pos") + 1).cast("long").alias("position"), F.when(F.col("col.rolled"), "CommonPrefixes").otherwise("Contents").alias("element"), "col.name", "col.size", "col.keys")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The highest turn per key; an aggregate, so no key is sorted in one task."""
    top = F.max_by(F.struct("turn", "role", "size"), "turn")
    return versions.groupBy("key").agg(top.alias("v"), F.count("*").alias("versions")).select("key", "v.*", "versions")


def ranked_versions(versions: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy("turn")
    return versions.select("key", "turn", F.row_number().over(w).alias("n"), F.lag("turn").over(w).alias("previous"))


def page_after(rows: DataFrame, key: str, token: str, size: int) -> DataFrame:
    """Keyset paging: rows after the token, so that no row is lost between pages."""
    return rows.where(F.col(key) > token).orderBy(key).limit(size)


def bucket_stats(objects: DataFrame) -> DataFrame:
    return objects.groupBy("bucket").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))
