"""The pipeline's stages against plain versions of their decisions."""

from collections import Counter

import corpus_pipeline
from test_corpus_operators import brute_contamination, brute_similar
from test_text_operators import plain_spans
from test_tokens_packing import check_pieces

from tessera.llm import quality_rules


def run_stages(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"file://{tmp_path}/{k}")
        out.append(spark.read.parquet(f"file://{tmp_path}/{k}"))
    return out


def check_groups(docs, kept):
    """The least id of each group of near copies stays; of the links that all
    pairs have, next to none is missed."""
    groups = {}
    for (i, _), c in zip(docs, brute_similar([t for _, t in docs]), strict=True):
        groups.setdefault(c, set()).add(i)
    assert all(min(g) in kept for g in groups.values()) and kept <= {i for i, _ in docs}
    assert 0 < len(docs) - len(groups) and len(kept) - len(groups) <= 0.1 * (len(docs) - len(groups))


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = run_stages(spark, docs, sf_dir, tmp_path)
    for stage in d[1:5]:
        assert stage.columns == docs.columns
    refs = quality_rules.language_references(docs)
    texts = {k: {r["doc_id"]: r["text"] for r in x.collect()} for k, x in enumerate(d[:5])}
    good = {r["doc_id"] for r in docs.collect() if quality_rules.judge(r["text"].encode(), r["lang"], refs, quality_rules.Limits())[6]}
    assert set(texts[1]) == good and 0 < len(good) < len(texts[0])
    check_groups(sorted(texts[1].items()), set(texts[2]))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {k[0] for k in brute_contamination(list(texts[2].items()), items) if k[-1]}
    assert set(texts[3]) == set(texts[2]) - dirty and dirty
    assert set(texts[4]) == set(texts[3])
    assert not any(plain_spans(t) for t in texts[4].values()) and any(plain_spans(t) for t in texts[3].values())
    assert all(t == texts[3][i] for i, t in texts[4].items() if not plain_spans(texts[3][i]))
    assert all(r["n_chars"] == len(r["text"]) for r in d[4].collect())
    check_pieces(d[5].collect(), list(texts[4].items()))


def test_run_and_odd(spark, sf_dir, odd_docs, no_docs, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        (tmp_path / name).mkdir()
        d = run_stages(spark, docs, sf_dir, tmp_path / name)
        assert d[4].columns == docs.columns
        assert Counter(r["doc_id"] for r in d[4].collect()).most_common(1)[:1] in ([], [(5, 1)])


def test_columns_of_any_name_pass_unchanged(spark, sf_dir, tmp_path):
    """Null ids, ids with several texts, and columns named as the operators'
    own keep their values in every stage."""
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang", "n_chars").limit(300).collect()]
    names = ("_h", "_n", "_id", "_key", "words", "k0", "k1", "start", "row", "near", "fp", "root", "c0", "_c0")
    rows = [(None if i % 4 == 0 else i // 2, r["text"], r["lang"], r["n_chars"], *(1000 * k + i for k in range(len(names)))) for i, r in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    d = run_stages(spark, df, sf_dir, tmp_path)
    for stage in d[1:5]:
        assert stage.columns == df.columns
        for r in stage.collect():
            i = r["_h"]
            assert all(r[n] == 1000 * k + i for k, n in enumerate(names)) and r["doc_id"] == rows[i][0] and r["lang"] == rows[i][2]
    # one row of each component, whatever its id
    left = [tuple(r) for r in d[1].select("_h", "text").collect()]
    kept = {r["_h"] for r in d[2].collect()}
    groups = {}
    for (i, _), c in zip(left, brute_similar([t for _, t in left]), strict=True):
        groups.setdefault(c, set()).add(i)
    assert len(groups) < len(left) and all(g & kept for g in groups.values()) and len(kept) <= len(groups) + 0.1 * (len(left) - len(groups))
