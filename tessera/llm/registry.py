"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontamination import op5_decontamination
from tessera.llm.language_model import op9_language_model
from tessera.llm.packing import op1_packing
from tessera.llm.quality_cnn import op4_quality_cnn
from tessera.llm.quality_rules import op2_quality_rules
from tessera.llm.secret_scan import op3_secret_scan
from tessera.llm.simhash import op6_simhash
from tessera.llm.substring_dedup import op10_substring_dedup
from tessera.llm.tokens import op8_token_files
from tessera.llm.url_filters import op7_url_filters


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's final rows."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_secret_scan, op4_quality_cnn, op5_decontamination, op6_simhash, op7_url_filters, op8_token_files, op9_language_model, op10_substring_dedup, pipeline)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every window of every document against every window of every item.
_OP5 = rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT coalesce(cast(item_id AS varchar), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    c AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM c) x),
    cut AS (SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) s WHERE len(w) >= n) x),
    found AS (SELECT c.k, c.i, c.n, w.item FROM cut c JOIN windows w ON c.n = w.n AND c.win = w.win),
    hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM found) x GROUP BY k),
    items AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM found GROUP BY k)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.listed, '')) AS items_sha256, h.k IS NOT NULL AS contaminated
    FROM d LEFT JOIN hit h ON d.k = h.k LEFT JOIN items t ON d.k = t.k"""

#: Every window of 35 words, grouped by its text.
_OP10 = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    cut AS (SELECT k, i, array_to_string(w[i : i + 34], ' ') AS win FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) x),
    again AS (SELECT k, i FROM cut WHERE win IN (SELECT win FROM cut GROUP BY win HAVING count(*) > 1)),
    gone AS (SELECT k, list(DISTINCT p) AS ps FROM (SELECT k, unnest(range(i, i + 35)) AS p FROM again) x GROUP BY k),
    words AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    hit AS (SELECT k, unnest(ps) AS p FROM gone),
    kept AS (SELECT w.k, string_agg(w.word, ' ' ORDER BY w.p) AS text, count(*) AS n FROM words w ANTI JOIN hit h ON w.k = h.k AND w.p = h.p GROUP BY w.k)
    SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(x.n, 0) AS n_removed, sha256(coalesce(x.text, '')) AS kept_sha256 FROM d LEFT JOIN kept x ON d.k = x.k"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express. The others hold a learned model, a
    tokenizer, or a hash that SQL lacks; ``tests/llm`` has plain versions."""
    return {"op5_decontamination": _OP5, "op10_substring_dedup": _OP10}
