"""URL filters: host and path rules, then logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pick

#: (host, path, verdict), as the contract fixes them.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Names of the labelled table: a host label that marks a site, by verdict.
#: The words are those that such sites commonly use; no name is taken from the
#: urls that are to be judged.
BLOCKED_NAMES = "casino-royal online-casino free-casino casino77 best-bets sportbets bet-now live-betting buy-pills pills-online diet-pills cheap-meds cheap-watch adult-video adult-dating hot-adult xxx-video linkfarm link-farm link-spam spam-links spammer click-ads ads-click adserver ad-tracker track-clicks popup-ads win-money free-money jackpot-win easy-loan payday-loan poker-win slot-win fake-watch replica-bags content-farm".split()
ALLOWED_NAMES = "library school university museum garden recipes history science weather travel-notes city-news morning-news open-data archive research journal cookbook astronomy botany music-review film-review book-review chess-club hiking cycling theatre poetry language-lab maps health-advice farmers-market free-software track-and-field windsurf bakery painter threads hashing orchard northern".split()
PATHS = ("/", "/en/12", "/de/index.html", "/fr/a-page", "/es/2021/05/notes", "/about", "/en/345/", "")
HOSTS = ("{}.com", "www.{}.org", "blog.{}.net", "m.{}.info", "{}.example")


def labelled_urls() -> list[tuple[str, str, int]]:
    """The small labelled table: (host, path, 1 for block)."""
    return [(host.format(name), path, label) for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)) for i, name in enumerate(names) for host in HOSTS for path in (PATHS[i % len(PATHS)], PATHS[(i + 3) % len(PATHS)])]


def ngrams(host: str, path: str, dims: int) -> np.ndarray:
    """Hashed 3- to 5-grams of the two parts, each marked by its part."""
    out = []
    for mark, part in ((b"h", b"^" + host.encode() + b"$"), (b"p", b"^" + path.encode() + b"$")):
        out += [zlib.crc32(mark + part[i : i + n]) % dims for n in (3, 4, 5) for i in range(len(part) - n + 1)]
    return np.unique(np.array(out, dtype=np.int64))


class UrlModel:
    """Logistic regression over ``dims`` hashed indicator features."""

    def __init__(self, dims: int = 1 << 14):
        self.dims, self.weights, self.bias = dims, np.zeros(dims), 0.0

    def score(self, host: str, path: str) -> float:
        return float(1 / (1 + np.exp(-(self.weights[ngrams(host, path, self.dims)].sum() + self.bias))))

    def fit(self, rows: list[tuple[str, str, int]], epochs: int = 30, rate: float = 0.05, decay: float = 1e-3) -> UrlModel:
        feats = [ngrams(h, p, self.dims) for h, p, _ in rows]
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                g = rows[i][2] - 1 / (1 + np.exp(-(self.weights[feats[i]].sum() + self.bias)))
                self.weights[feats[i]] += rate * (g - decay * self.weights[feats[i]])
                self.bias += 0.1 * rate * g
        return self


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: F.Column, path: F.Column, rules: tuple = RULES) -> F.Column:
    """The longest fitting rule as ``struct<rule, verdict>``, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(pages: DataFrame, model: UrlModel, rules: tuple = RULES, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    Null urls and urls without ``://`` have empty parts and go to the model. Of
    rules of equal length the one listed last wins. Repeated rows are judged
    alike; a very long url is judged whole; only ``page_id`` and ``url`` are
    read; an empty table gives no rows.
    """
    rows = pick(pages, "page_id", "url")
    host, path = split_url(F.col("url"))
    rows = rows.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", match_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    scores = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [scores.score(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            verdict = [v or ("block" if x >= threshold else "allow") for v, x in zip(b.column(4).to_pylist(), s, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(verdict, pa.string()), pa.array(s, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), UrlModel().fit(labelled_urls()))
