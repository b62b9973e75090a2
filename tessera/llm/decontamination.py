"""Benchmark decontamination by a prefix-filtered set join, in DataFrame
operations only.

A window of an item is a set of word shingles that must all occur. Shingles are
ordered by rarity in the documents; as containment is whole, one necessary
prefix token, a window's rarest shingle, is enough to find candidates. Their
positions give the window's start, bounded by the document's length, and the
words there are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, pick

WINDOW = 10
SHINGLE = 3
#: Benchmark tables are broadcast up to this many bytes, joined by shuffles
#: beyond; the result is the same.
BROADCAST_BYTES = 48 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: F.Column) -> F.Column:
    """Words of a text with A-Z lower-cased; none for null."""
    parts = F.split(F.translate(text, UPPER, LOWER), SEPARATORS, -1)
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def _shingles(n: str, k: int) -> F.Column:
    """``array<struct<pos, sh>>`` of the k-word shingles of column ``words``."""
    parts = ", ".join(f"words[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN {n} >= {k} THEN transform(sequence(0, {n} - {k}), i -> struct(i AS pos, xxhash64({parts}) AS sh)) ELSE cast(array() AS array<struct<pos:int,sh:bigint>>) END")


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``win`` (words joined by blanks), ``len``, ``items``."""
    items = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    items = items.withColumn("n", F.size("words")).where("n > 0").withColumn("len", F.least(F.col("n"), F.lit(window)))
    cut = items.select("item", "len", "words", F.explode(F.expr("sequence(0, n - len)")).alias("at"))
    return cut.select("item", "len", F.expr("array_join(slice(words, at + 1, len), ' ')").alias("win")).groupBy("win", "len").agg(F.collect_set("item").alias("items"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, items, hits`` (covered word positions) and ``row``, the whole
    row as a struct.

    Null texts have no words; items without words have no windows; repeated
    items count once by id; repeated rows get equal results; windows that share
    words may overlap, and count their words once. A text is one row whatever
    its length, as are its words. Extra columns are ignored; an empty benchmark
    leaves every document clean; no documents give no rows.
    """
    spark = docs.sparkSession
    windows = materialize(windows_of(benchmark, window), "windows")
    # window lengths present, at most `window` numbers
    sizes = sorted({min(r["len"], shingle) for r in windows.select("len").distinct().collect()})
    parts = windows.select("win", "len", "items", F.split("win", " ").alias("words"))
    parts = parts.withColumn("all", F.coalesce(*[F.when(F.least(F.col("len"), F.lit(shingle)) == k, _shingles("len", k)) for k in sizes]) if sizes else _shingles("len", shingle))
    grams = materialize(parts.select("win", "len", "items", F.explode("all").alias("g")).select("win", "len", "items", F.col("g.pos").alias("off"), F.col("g.sh").alias("sh")), "window-shingles")
    tokens = grams.select("sh").distinct()
    # what a row of windows, of which prefix is a part, and of tokens takes in memory
    width = F.octet_length("win") + F.aggregate("items", F.lit(96), lambda a, x: a + F.octet_length(x) + 16)
    size = (windows.agg(F.sum(width)).first()[0] or 0, 32 * grams.count())
    fit = lambda df, n: F.broadcast(df) if n <= BROADCAST_BYTES else df

    # the row's columns travel under numbers, so that none can clash
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(*[docs[c].alias(n) for c, n in own.items()]).withColumns({"k0": F.coalesce(F.col(own["doc_id"]).cast("long"), F.lit(-(1 << 63))), "k1": F.xxhash64(own["text"])})
    text = F.col(own["text"])
    split = keyed.select("k0", "k1", words_of(text).alias("words")).withColumn("n", F.size("words"))
    found = split.select("k0", "k1", "n", F.explode(F.concat(*[_shingles("n", k) for k in sizes or [shingle]])).alias("g")).select("k0", "k1", "n", F.col("g.pos").alias("pos"), F.col("g.sh").alias("sh"))
    found = materialize(found.join(fit(tokens, size[1]), "sh"), "shingle-hits")

    # rarity over all documents, then one prefix token for each window
    rarity = found.groupBy("sh").agg(F.count("*").alias("df"))
    ranked = grams.join(rarity, "sh", "left").groupBy("win", "len", "items").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "sh", "off")).alias("p"))
    prefix = ranked.where("p.df > 0").select("win", "len", "items", F.col("p.sh").alias("sh"), F.col("p.off").alias("off"))
    near = found.join(fit(prefix, size[0]), "sh").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0 AND start + len <= n")
    near = near.groupBy("k0", "k1").agg(F.collect_set(F.struct("start", "len", "win", "items")).alias("near"))

    rows = keyed.join(near, ["k0", "k1"], "left").select(F.struct(*[F.col(n).alias(c) for c, n in own.items()]).alias("row"), F.col(own["doc_id"]).alias("doc_id"), words_of(text).alias("words"), "near")
    real = F.expr("filter(coalesce(near, cast(array() AS array<struct<start:int,len:int,win:string,items:array<string>>>)), c -> array_join(slice(words, c.start + 1, c.len), ' ') = c.win)")
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), real.alias("real"))
    hits = F.expr("array_distinct(flatten(transform(real, c -> sequence(c.start, c.start + c.len - 1))))")
    items = F.expr("array_sort(array_distinct(flatten(transform(real, c -> c.items))))")
    rows = rows.select("row", "doc_id", "n_words", hits.alias("hits"), items.alias("items"))
    return rows.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "items", "hits", "row")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns kept."""
    return contaminated(docs, benchmark).where(~F.col("contaminated")).select("row.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all windows of ``benchmark``."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).drop("items", "hits", "row")
