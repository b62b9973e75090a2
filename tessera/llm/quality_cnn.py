"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Filters of
six bytes run at every second byte; a filter is six learned tables over byte
values. Each filter's maximum is taken in every chunk, then the mean and the
maximum over the chunks, and a logistic layer combines them into one
probability. For scoring, tables of two neighbouring bytes are merged, so that
a filter costs three look-ups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, map_texts, pick

WIDTH = 6
#: Bytes a chunk begins after the previous one; chunks overlap by ``WIDTH - 2``.
STEP = 512
FILTERS = 12
#: Bounds of the labelled sample the network is fitted on: rows of each label,
#: bytes in all, and bytes of a text (a longer one is no sample, but is scored).
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 96 << 20
SAMPLE_TEXT_BYTES = 4 << 20
FOLDS = 5


def pairs_of(text: bytes) -> np.ndarray:
    """Two-byte values at every second byte, padded with zeros to whole chunks;
    an empty text is one chunk of zeros."""
    chunks = max(1, -(-len(text) // STEP))
    size = chunks * STEP + WIDTH - 2
    b = np.zeros(size, dtype=np.uint8)
    b[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return b.view("<u2").astype(np.int64)


class ByteCnn:
    def __init__(self, filters: int = FILTERS, seed: int = 11):
        r = np.random.default_rng(seed)
        self.table = (r.normal(size=(WIDTH, 256, filters)) * 0.3).astype(np.float32)
        self.mean = np.zeros(filters, dtype=np.float32) + (r.normal(size=filters) * 0.3).astype(np.float32)
        self.peak = (r.normal(size=filters) * 0.3).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)
        self._merged: np.ndarray | None = None

    def merged(self) -> np.ndarray:
        """``[3, 65536, filters]``: low byte first."""
        if self._merged is None:
            t = self.table
            self._merged = np.stack([(t[2 * j][None, :, :] + t[2 * j + 1][:, None, :]).reshape(1 << 16, -1) for j in range(WIDTH // 2)])
        return self._merged

    def pooled(self, text: bytes, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima ``[chunks, filters]``; with ``places`` also where they are."""
        m, p = self.merged(), pairs_of(text)
        out, where = [], []
        per = STEP // 2
        for at in range(0, len(p) - 2, 64 * per):  # 64 chunks at a time bound the memory
            q = p[at : at + 64 * per + 2]
            s = m[0][q[:-2]]
            s += m[1][q[1:-1]]
            s += m[2][q[2:]]
            s = s.reshape(-1, per, s.shape[1])
            out.append(s.max(axis=1))
            if places:
                where.append(at + s.argmax(axis=1) + per * np.arange(len(s))[:, None])
        return np.concatenate(out), np.concatenate(where) if places else None

    def score(self, text: bytes) -> float:
        h = np.tanh(self.pooled(text)[0])
        z = float(h.mean(axis=0) @ self.mean + h.max(axis=0) @ self.peak + self.bias[0])
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    def fit(self, rows: list[tuple[bytes, int]], epochs: int = 6, rate: float = 0.02, batch: int = 32, seed: int = 3) -> ByteCnn:
        """Adam on the log loss, classes weighted alike; gradients reach the
        tables at the maxima's places."""
        share = max(1e-9, sum(y for _, y in rows) / max(1, len(rows)))
        weight = {1: 0.5 / max(share, 1e-3), 0: 0.5 / max(1 - share, 1e-3)}
        params = [self.table, self.mean, self.peak, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order, step = np.random.default_rng(seed), 0
        for _ in range(epochs):
            perm = order.permutation(len(rows))
            for at in range(0, len(rows), batch):
                grads = [np.zeros_like(p) for p in params]
                for i in perm[at : at + batch]:
                    text, y = rows[i]
                    s, where = self.pooled(text, places=True)
                    h = np.tanh(s)
                    top = h.argmax(axis=0)
                    f = np.arange(h.shape[1])
                    z = h.mean(axis=0) @ self.mean + h[top, f] @ self.peak + self.bias[0]
                    g = weight[y] * (y - 1 / (1 + np.exp(-np.clip(z, -50, 50))))
                    grads[1] += g * h.mean(axis=0)
                    grads[2] += g * h[top, f]
                    grads[3] += g
                    dh = np.repeat((g * self.mean / len(h))[None, :], len(h), axis=0)
                    dh[top, f] += g * self.peak
                    ds = dh * (1 - h * h)
                    p = pairs_of(text)
                    cols = np.broadcast_to(f, where.shape)
                    for j in range(WIDTH // 2):
                        q = p[where + j]
                        np.add.at(grads[0][2 * j], (q & 255, cols), ds)
                        np.add.at(grads[0][2 * j + 1], (q >> 8, cols), ds)
                step += 1
                for p, g, a, b in zip(params, grads, first, second, strict=True):
                    g /= batch
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)
                self._merged = None
        return self


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled texts of each label, outside the held-out
    fold, by hash order of the id; ids and labels choose rows only."""
    known = pick(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(crc_mod("doc_id", FOLDS) != 0)
    ids = None
    for y in (0, 1):
        part = known.where(F.col("quality") == y).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        ids = part if ids is None else ids.unionByName(part)
    # at most 2 * rows ids
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES
    found = pick(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").where(short).select("doc_id", "text", "quality").withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "text").limit(2 * rows)
    # running bytes over at most 2 * rows lengths
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.orderBy("_h", "text").rowsBetween(Window.unboundedPreceding, 0))
    bounded = found.withColumn("_upto", upto).where(F.col("_upto") <= SAMPLE_BYTES).select("text", "quality", "_upto")
    return [((r["text"] or "").encode(), r["quality"]) for r in sorted(bounded.collect(), key=lambda r: r["_upto"])]


def classify(docs: DataFrame, model: ByteCnn, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its bytes only.

    Null and empty texts score as a chunk of zeros; a very long text is walked
    64 chunks at a time, to its end. Repeated rows score alike, and equal texts
    under other ids; extra columns are ignored; a null ``doc_id`` is not held
    out. An empty table gives no rows.
    """

    def rows(part: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        scores = [model.score(t or b"") for t in texts]
        cols = [part.column(0).cast(pa.int64()), part.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    held = pick(docs, "doc_id", "text").withColumn("held_out", F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False)))
    return map_texts(held, rows, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a network fitted outside the held-out fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, ByteCnn().fit(training_sample(docs, labels)))
