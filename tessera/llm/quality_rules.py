"""Quality rules by distribution divergence.

A document's histograms of character classes and of its language's common words
are compared with references of that language by Jensen-Shannon distance. The
references come from all documents: word counts are summed, and a character
class has its median share, which junk does not move. Fixed rules on repetition
and length come first; guards keep short texts out of tests they are too small for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, materialize, pick, slices, small_batches

#: A language has references of its own from this many words on, which keep
#: its histogram of ``COMPARED_WORDS`` stable, whatever its share of the corpus.
#: Others have none, and only the base rules judge their documents.
LANGUAGE_WORDS = 10_000
#: A word is common in a language from this share of its words on.
COMMON_SHARE = 1 / 2000
#: Common words compared one by one; the others count together.
COMPARED_WORDS = 40
PARTIAL_WORDS = 300_000
#: Resolution of a document's class shares.
SHARE_BINS = 4096

#: Digits count as plain, so that numbers in prose don't tell against it.
CLASSES = ("plain", "upper", "space", "line", "stop", "symbol", "other", "beyond")
SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte; continuation bytes have none."""
    table = np.full(256, CLASSES.index("other"))
    for chars, name in ((range(97, 123), "plain"), (range(48, 58), "plain"), (range(65, 91), "upper"), (b" \t\v\f", "space"), (b"\r\n", "line"), (b".,;:!?'\"-", "stop"), (SYMBOLS, "symbol"), (range(192, 256), "beyond")):
        table[list(chars)] = CLASSES.index(name)
    table[128:192] = len(CLASSES)
    return table


_TABLE = _class_table()


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(_TABLE[np.frombuffer(text, dtype=np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence to base 2; 0 to 1."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a, b = p > 0, q > 0
    d = (p[a] * np.log2(p[a] / m[a])).sum() + (q[b] * np.log2(q[b] / m[b])).sum()
    return float(np.sqrt(min(1.0, max(0.0, d / 2))))


@dataclass
class Reference:
    chars: np.ndarray
    #: Slot of each compared word; the last slot is every other word.
    slots: dict[bytes, int]
    words: np.ndarray


@dataclass(frozen=True)
class Limits:
    """Fixed limits. The distance tests apply from ``min_words`` words on."""

    base_words: int = 50
    max_char_distance: float = 0.155
    char_min_words: int = 50
    max_word_distance: float = 0.36
    word_min_words: int = 200


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts by language, and counts of documents by class and share."""
    words: dict[str, Counter] = {}
    shares: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, w.decode(), None, None, n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, None, k, b, n) for lang, c in shares.items() for (k, b), n in c.items()]
        words.clear()
        shares.clear()
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["lang", "word", "cls", "bin", "n"])

    for batch, texts in slices(batches):
        for lang, text in zip(batch.column(1).to_pylist(), texts, strict=True):
            if text:
                words.setdefault(lang or "", Counter()).update(text.split())
                c = class_counts(text)
                shares.setdefault(lang or "", Counter()).update(enumerate((c * SHARE_BINS // max(1, c.sum())).tolist()))
        if sum(map(len, words.values())) > PARTIAL_WORDS:
            yield flush()
    yield flush()


def language_references(docs: DataFrame) -> dict[str, Reference]:
    """References over all of ``docs`` (``text``, ``lang``) of every language
    with ``LANGUAGE_WORDS`` words. They are made by groups and joins; a language
    sends its compared words and a median share of each class to the driver."""
    small_batches(docs.sparkSession)
    counts = pick(docs, "text", "lang").mapInArrow(_partial_counts, "lang string, word string, cls int, bin int, n long")
    summed = materialize(counts.groupBy("lang", "word", "cls", "bin").agg(F.sum("n").alias("n")), "word-counts")
    words = summed.where("word is not null")
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= LANGUAGE_WORDS), "language-words")
    # a language has at most 1 / COMMON_SHARE common words
    common = words.join(totals, "lang").where(F.col("n") >= F.col("total") * COMMON_SHARE)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common = common.withColumn("rank", rank).where(F.col("rank") <= COMPARED_WORDS)
    # and at most SHARE_BINS bins of each class
    of = Window.partitionBy("lang", "cls")
    bins = summed.where("word is null").join(totals.select("lang"), "lang")
    bins = bins.withColumn("seen", F.sum("n").over(of.orderBy("bin"))).withColumn("docs", F.sum("n").over(of))
    medians = bins.where(F.col("seen") >= F.col("docs") / 2).groupBy("lang", "cls").agg(F.min("bin").alias("bin"))
    chars: dict[str, np.ndarray] = {}
    for r in medians.collect():
        chars.setdefault(r["lang"], np.zeros(len(CLASSES)))[r["cls"]] = (r["bin"] + 0.5) / SHARE_BINS if r["bin"] else 0.0
    tops: dict[str, list[tuple[int, bytes]]] = {}
    for r in common.select("lang", "word", "n").collect():
        tops.setdefault(r["lang"], []).append((-r["n"], r["word"].encode()))
    out = {}
    for lang, n in totals.collect():
        top = sorted(tops.get(lang, []))
        hist = np.array([-c for c, _ in top] + [n + sum(c for c, _ in top)], dtype=float)
        out[lang] = Reference(chars[lang] + 1e-9, {w: i for i, (_, w) in enumerate(top)}, hist)
    return out


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    voc: dict[bytes, int] = {}
    ids = np.array([voc.setdefault(w, len(voc)) for w in words], dtype=np.int64)
    pairs = ids[:-1] * len(voc) + ids[1:]
    if len(voc) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(voc) + ids[2:]
    _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k : k + n - 2] |= twice
    return int(hit.sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += bool(line.split())
        else:
            seen.add(line)
    return n


_SPACE = b" \t\n\v\f\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(text: bytes | None, lang: str | None, refs: dict[str, Reference], limits: Limits) -> tuple:
    """One document's row after ``doc_id``."""
    text = text or b""
    words = text.split()
    n = len(words)
    points = len(text) - int(((np.frombuffer(text, dtype=np.uint8) & 0xC0) == 0x80).sum())
    chars = points - sum(text.count(bytes([c])) for c in _SPACE)
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    repeated = repeat_words(words)
    failed = n < limits.base_words or 100 * repeated > 50 * n
    ref = refs.get(lang or "")
    by_chars = by_words = None
    if ref is not None and n >= limits.char_min_words:
        by_chars = js_distance(class_counts(text).astype(float), ref.chars)
    if ref is not None and n >= limits.word_min_words:
        hist = np.zeros(len(ref.words))
        hits = Counter(w for w in words if w in ref.slots)
        for w, c in hits.items():
            hist[ref.slots[w]] = c
        hist[-1] = n - sum(hits.values())
        by_words = js_distance(hist, ref.words)
    kept = not failed and not (by_chars is not None and by_chars > limits.max_char_distance) and not (by_words is not None and by_words > limits.max_word_distance)
    return n, chars, symbols, dup_lines(text), repeated, failed, kept, by_chars, by_words


def quality_rules(docs: DataFrame, refs: dict[str, Reference], limits: Limits = Limits()) -> DataFrame:
    """One verdict per row of ``docs`` (``doc_id, text, lang``).

    A null text has no words and fails the base rules. Rows of a null language
    are a language of their own; without a reference only the base rules apply.
    Repeated rows get equal verdicts. A very long text is judged whole; words
    of equal count are ranked by themselves. Extra columns are ignored; an
    empty table gives no rows.
    """

    def rows(part: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        found = [judge(t, lang, refs, limits) for t, lang in zip(texts, part.column(2).to_pylist(), strict=True)]
        cols = list(zip(*found, strict=True))
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return map_texts(pick(docs, "doc_id", "text", "lang"), rows, SCHEMA)


def keep_good(docs: DataFrame, refs: dict[str, Reference], limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""

    def rows(part: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        langs = part.column(part.schema.get_field_index("lang")).to_pylist()
        return part.filter(pa.array([judge(t, lang, refs, limits)[6] for t, lang in zip(texts, langs, strict=True)]))

    return map_texts(docs, rows, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged against references from all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, language_references(docs))
