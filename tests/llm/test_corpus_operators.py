"""Operators that compare texts with each other, against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tessera.llm import decontamination, language_model, simhash, substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def brute_contamination(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


COLS5 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_op5(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"), rows(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", "text")
    got = Counter(rows(decontamination.op5_decontamination(spark, sf), *COLS5))
    assert got == brute_contamination(docs, items)
    assert sum(n for k, n in got.items() if k[-1]) > 5


def test_op5_odd(spark, odd_docs, no_docs):
    items = [(1, "One!"), (2, "fox jumps"), (3, None), (4, "..."), (5, "the lazy dog while SEVEN wizards quietly box with grumpy dwarves near"), (5, "a a a a a"), (None, "lost id text here"), (6, "été à la"), (7, "of0 w1 of1")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS len", "'x' AS win")
    assert Counter(rows(decontamination.contaminated(odd_docs, bench), *COLS5)) == brute_contamination(rows(odd_docs, "doc_id", "text"), items)
    assert decontamination.contaminated(no_docs, bench).collect() == []
    assert not any(r["contaminated"] for r in decontamination.contaminated(odd_docs, bench.limit(0)).collect())


def test_op5_joins_by_shuffle_beyond_the_broadcast(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    items = [(i, "the lazy dog while SEVEN wizards quietly box with grumpy dwarves near") for i in range(30)] + [(99, "of0 w1 of1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(rows(decontamination.contaminated(odd_docs, bench), *COLS5)) == brute_contamination(rows(odd_docs, "doc_id", "text"), items)


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = {}
    distinct = sorted(set(f for _, f in fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    for d, f in fps:
        if d is not None:
            ids[find(f)] = min(d, ids.get(find(f), d))
    return [(d, f, ids.get(find(f))) for d, f in fps]


def test_op6(spark):
    sf = "/root/testdata/sf0.01"
    docs = rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    want = brute_components([(i, brute_fingerprint(t)) for i, t in docs])
    got = rows(simhash.op6_simhash(spark, sf), "doc_id", "fingerprint", "component_id")
    assert Counter(got) == Counter((i, f"{f:016x}", c) for i, f, c in want)
    assert len({c for _, _, c in got}) < len(got)


def test_op6_odd(spark, odd_docs, no_docs):
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows(odd_docs, "doc_id", "text")])
    got = rows(simhash.near_duplicates(odd_docs), "doc_id", "fp", "component_id")
    assert Counter((i, f % (1 << 64), c) for i, f, c in got) == Counter(want)
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = rows(simhash.keep_one(odd_docs), "doc_id", "component_id") if "component_id" in odd_docs.columns else rows(simhash.keep_one(odd_docs), "doc_id")
    assert len(kept) == len({c for _, _, c in want})
    assert simhash.keep_one(odd_docs).columns == odd_docs.columns


def test_keep_one_keeps_a_row_of_each_component(spark):
    texts = [" ".join(f"{k}{i}" for i in range(60)) for k in "pqrst"]
    docs = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[4])]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, _h int")
    got = rows(simhash.keep_one(df), "doc_id", "text", "_h")
    assert Counter((i, t) for i, t, _ in got) == Counter([(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4])])
    assert all(docs[n] == (i, t) for i, t, n in got)


def brute_similar(texts):
    """Components of all pairs of wide fingerprints within the radius."""
    fps = [simhash.wide_fingerprint((t or "").translate(LOWER).encode().split()) for t in texts]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(1, len(fps)):
        for j in np.flatnonzero(simhash._far(np.stack(fps[:i]), fps[i]) <= simhash.wide_radius(0.8)).tolist():
            root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def near_copies(r, n, copies):
    """Texts with copies in which some words are others: Jaccard 0.8 to 1 over
    five-word shingles."""
    out = []
    for i in range(n):
        words = [f"w{r.integers(5000)}" for _ in range(int(r.integers(100, 300)))]
        out.append((i, words))
        for _ in range(copies):
            other = list(words)
            for at in r.choice(len(words), max(1, len(words) // 50), replace=False):
                other[at] = "changed"
            out.append((i, other))
    return out


def jaccard(a, b):
    s, t = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(s & t) / len(s | t)


def test_similar_texts_are_found(spark):
    """Pairs of a similarity of 0.8 or more end in one group, at least nine in
    ten; unrelated texts never do."""
    texts = near_copies(np.random.default_rng(4), 150, 2)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, (_, w) in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one_similar(docs).collect()}
    assert {texts[i][0] for i in kept} == set(range(150))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if texts[a][0] == texts[b][0] and jaccard(texts[a][1], texts[b][1]) >= 0.8]
    assert len(pairs) > 300 and sum(not {a, b} <= kept for a, b in pairs) >= 0.9 * len(pairs)


def test_similar_odd(spark, odd_docs, no_docs):
    got = simhash.keep_one_similar(odd_docs)
    assert got.columns == odd_docs.columns and simhash.keep_one_similar(no_docs).collect() == []
    texts = [r["text"] for r in odd_docs.collect()]
    assert got.count() == len(set(brute_similar(texts)))


@pytest.mark.parametrize("seed", range(3))
def test_large_shards_lose_no_link(seed, monkeypatch):
    """Chains and balls of fingerprints against all pairs."""
    monkeypatch.setattr(simhash, "TREE_MEMBERS", 60)
    r, radius = np.random.default_rng(seed), 20
    values = [r.integers(0, 1 << 63, 4).astype(np.uint64) for _ in range(3)]
    while len(values) < 200:
        v = values[int(r.integers(len(values)))].copy()
        for b in r.choice(256, int(r.integers(1, 30)), replace=False).tolist():
            v[b // 64] ^= np.uint64(1 << (b % 64))
        values.append(v)
    values = np.stack(values)

    def components(pairs):
        root = list(range(len(values)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(i for i in range(len(values)) if find(i) == c) for c in map(find, range(len(values)))}

    near = [(i, j) for i in range(len(values)) for j in range(i) if simhash._far(values[i], values[j]) <= radius]
    found = simhash.link_wide(values, radius)
    assert components(found) == components(near) and all(simhash._far(values[a], values[b]) <= radius for a, b in found)


def test_shards_adapt_to_the_number_of_members():
    for n in (1, 1000, 10**6, 10**9):
        families = simhash.shard_bits(n, 0.8)
        meet = (1 - simhash.flip_share(0.8)) ** len(families[0])
        assert 1 - (1 - meet) ** len(families) >= 0.97 and len(families) < 1000


@pytest.mark.parametrize("spread", [3, 8, 64])
def test_op6_links_are_whole(spark, spread):
    r = np.random.default_rng(spread)
    centres = [int(x) for x in r.integers(0, 1 << 63, 5)]
    fps = {0, (1 << 64) - 1} | {c ^ sum(1 << int(b) for b in r.choice(spread, 2)) ^ (1 << int(r.integers(64))) for c in centres for _ in range(200)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in sorted(fps)], "fp long")
    got = {n % (1 << 64): root for n, root in rows(simhash.components(simhash.links(df)), "node", "root")}
    want = brute_components([(i, f) for i, f in enumerate(sorted(fps))])
    groups = {}
    for _, f, c in want:
        groups.setdefault(c, set()).add(f)
    for members in groups.values():
        assert len({got.get(f, simhash._signed(f)) for f in members}) == 1
    assert len({got.get(f, simhash._signed(f)) for f in fps}) == len(groups)


@pytest.mark.parametrize("limit", [500, 20_000])
def test_op6_large_shard(monkeypatch, limit):
    r = np.random.default_rng(4)
    values = sorted({int(x) for x in r.integers(0, 1 << 16, 2500)})
    want = brute_components([(v, v) for v in values])
    monkeypatch.setattr(simhash, "SPLIT_FROM", limit)
    found = simhash.link_shard(values, list(range(64)), 2)
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in found:
        root[find(a)] = find(b)
    assert len({find(v) for v in values}) == len({c for _, _, c in want})


def test_components_of_a_path(spark):
    edges = spark.range(0, 200).selectExpr("(id * 37) % 211 AS a", "((id + 1) * 37) % 211 AS b")
    got = simhash.components(edges)
    assert got.select("root").distinct().count() == 1 and got.count() == 201


def brute_score(docs):
    split = lambda t: [*WORD.findall((t or "").translate(LOWER)), ""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in docs if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t))) for i, t in docs]


COLS9 = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def same_scores(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))


def test_op9(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(language_model.op9_language_model(spark, sf), *COLS9)
    same_scores(got, brute_score(rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")))
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > 0.99 * sum(g[5] for g in held)
    assert all(g[6] < 0 for g in got)


def test_op9_odd(spark, odd_docs, no_docs):
    got = rows(language_model.lm_scores(odd_docs, head_words=20), *COLS9)
    same_scores(got, brute_score(rows(odd_docs, "doc_id", "text")))
    assert language_model.lm_scores(no_docs).collect() == []


def test_op9_refining_helps(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARE", 2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    vocab = language_model.Vocabulary.of(language_model.count_words(docs))
    model = language_model.Gru(vocab)
    places = [language_model.token_places((r["text"] or "").encode(), vocab.index())[1] for r in docs.limit(80).collect()]
    texts = [np.where((at >= 0) & (at < model.rest), at, model.rest) for at in places]
    before = model.score(texts).sum()
    model = language_model.refine(docs, vocab, model)
    assert model.score(texts).sum() > before
    again = language_model.refine(docs, vocab, language_model.Gru(vocab))
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p)
    assert language_model.refine(docs.limit(0), vocab, again) is again


def test_op9_every_training_text_reaches_the_weights(spark):
    texts = [f"w{i} " * 40 + f"and w{i + 1} w{i + 2}" for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    vocab = language_model.Vocabulary.of(language_model.count_words(docs))
    weights = lambda d: language_model.refine(d, vocab, language_model.Gru(vocab)).p["x"]
    whole = weights(docs)
    for gone in (0, 5, 11):
        assert not np.array_equal(whole, weights(docs.where(f"doc_id <> {gone}")))


def test_op9_head_of_the_counts(spark):
    counts = spark.createDataFrame([(f"w{i}", 1000 // (i + 1) + 1) for i in range(900)], "word string, c long")
    for most in (0, 1, 7, 100, 500, 899, 900, 5000):
        got = rows(language_model.most_frequent(counts, most, 64), "word", "c")
        assert len(set(got)) == len(got) <= most
        least = min((c for _, c in got), default=0)
        # only words of the least grade or below can be missing
        assert all(int(r["c"]) <= least * 1.05 + 1 for r in counts.collect() if (r["word"], r["c"]) not in got) or not got
        assert most < 100 or len(got) > 0.5 * min(most, 900)


def test_op9_model_is_a_distribution_and_lanes_agree():
    head = {b"": 50, **{f"w{i}".encode(): 100 - i for i in range(90)}}
    vocab = language_model.Vocabulary(list(head), np.array(list(head.values())), len(head), sum(head.values()) + 40, len(head) + 30)
    r = np.random.default_rng(0)
    texts = [r.integers(0, 92, size=n).astype(np.int32) for n in (1, 5, 40, 300, 7)]
    model = language_model.Gru(vocab).fit(texts * 3)
    h = r.normal(size=(1, model.hidden)).astype(np.float32)
    every = np.array([model.log_probs(h, np.array([y]))[0] for y in range(len(head) + 1)])
    assert abs(np.exp(every).sum() - 1) < 1e-3
    together = model.score(texts * 200)
    for i, t in enumerate(texts):
        state, x, lp = np.zeros((1, model.hidden), np.float32), model.start, 0.0
        for y in t.tolist():
            state = model.step(state, np.array([x]))[0]
            lp += model.log_probs(state, np.array([y]))[0]
            x = y
        assert np.allclose(together[i :: len(texts)], lp, rtol=1e-3)


def test_op9_long_texts_take_few_windows(monkeypatch):
    """One text far longer than the others: its steps alone fill whole windows,
    and its score is that of one token after another."""
    head = {b"": 50, **{f"w{i}".encode(): 100 - i for i in range(90)}}
    vocab = language_model.Vocabulary(list(head), np.array(list(head.values())), len(head), sum(head.values()) + 40, len(head) + 30)
    r = np.random.default_rng(3)
    texts = [r.integers(0, 92, size=n).astype(np.int32) for n in (5000, *[20] * 800)]
    model = language_model.Gru(vocab).fit(texts, epochs=1)
    calls, plain = [], model.log_probs
    monkeypatch.setattr(model, "log_probs", lambda h, y: calls.append(len(y)) or plain(h, y))
    got = model.score(texts)
    assert sum(calls) == 21_000 and len(calls) < 50
    state, x, lp = np.zeros((1, model.hidden), np.float32), model.start, 0.0
    for y in texts[0].tolist():
        state = model.step(state, np.array([x]))[0]
        lp += plain(state, np.array([y]))[0]
        x = y
    assert np.isclose(got[0], lp, rtol=1e-3)


def test_op9_lanes_are_columns():
    """``gates`` is the plain formula with a column a lane, whether or not it is
    given arrays to write to; sums beyond single precision keep their logs."""
    r = np.random.default_rng(5)
    head = {b"": 9, b"a": 5, b"b": 3}
    model = language_model.Gru(language_model.Vocabulary(list(head), np.array(list(head.values())), 3, 17, 3))
    k = model.hidden
    gi, h = r.normal(size=(3 * k, 7)).astype("f4"), r.normal(size=(k, 7)).astype("f4")
    gh = model.p["u"].T.astype("f8") @ h
    plain = lambda x: 1 / (1 + np.exp(-x))
    z, c = plain(gi[k : 2 * k] + gh[k : 2 * k]), np.tanh(gi[2 * k :] + plain(gi[:k] + gh[:k]) * gh[2 * k :])
    given = [np.empty((n * k, 7), np.float32) for n in (3, 2, 1, 1)]
    for out in (model.gates(gi, h)[0], model.gates(gi, h, *given)[0], given[3]):
        assert np.abs(out - (c + z * (h - c))).max() < 1e-5
    far = np.array([[200, 199], [-300, -299], [1, 2]], np.float32)
    e, s, m = language_model.exps(far)
    assert np.allclose(np.log(s) + m, np.logaddexp(*far.T)) and np.allclose(e.sum(axis=1), s)


def test_op9_gradients():
    head = {b"": 5, **{f"w{i}".encode(): 9 for i in range(70)}}
    vocab = language_model.Vocabulary(list(head), np.array(list(head.values())), len(head), sum(head.values()), len(head))
    model = language_model.Gru(vocab)
    r = np.random.default_rng(1)
    model.p = {k: (v + r.normal(size=v.shape) * 0.1).astype(np.float64) for k, v in model.p.items()}
    h, y = r.normal(size=(6, model.hidden)), np.array([0, 3, 66, 71, 70, 3])
    g = {k: np.zeros_like(v) for k, v in model.p.items()}
    dh = model._output_grads(h, y, g)
    for k, at in (("wc", (2, 1)), ("ww", (0, 3, 3)), ("bc", (0,))):
        model.p[k][at] += 1e-5
        up = model.log_probs(h, y.copy()).sum()
        model.p[k][at] -= 2e-5
        down = model.log_probs(h, y.copy()).sum()
        model.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4
    h2 = h.copy()
    h2[1, 4] += 1e-5
    assert abs((model.log_probs(h2, y.copy()).sum() - model.log_probs(h, y.copy()).sum()) / 1e-5 - dh[1, 4]) < 1e-3


def brute_repeats(docs, k=35):
    c = Counter()
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    for _, w in split:
        c.update(tuple(w[s : s + k]) for s in range(len(w) - k + 1))
    out = []
    for i, w in split:
        gone = {s + j for s in range(len(w) - k + 1) if c[tuple(w[s : s + k])] > 1 for j in range(k)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


COLS10 = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_op10(spark):
    sf = "/root/testdata/sf0.01"
    got = Counter(rows(substring_dedup.op10_substring_dedup(spark, sf), *COLS10))
    assert got == brute_repeats(rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"))


@pytest.mark.parametrize("width", [27, 11])
def test_op10_odd(spark, odd_docs, no_docs, width):
    """Also with a sketch so narrow that most estimates are too high."""
    got = Counter(rows(substring_dedup.remove_repeats(odd_docs, width=width), *COLS10))
    assert got == brute_repeats(rows(odd_docs, "doc_id", "text"))
    assert substring_dedup.remove_repeats(no_docs).collect() == []


def test_op10_periodic(spark):
    texts = [" ".join(["a"] * n) for n in (34, 35, 36, 90)] + [" ".join(f"x{i % 20}" for i in range(n)) for n in (50, 54, 55, 200)] + [" ".join(f"y{i}" for i in range(36))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(rows(substring_dedup.remove_repeats(df), *COLS10)) == brute_repeats(list(enumerate(texts)))
    alone = df.where("doc_id = 3")
    assert Counter(rows(substring_dedup.remove_repeats(alone), *COLS10)) == brute_repeats([(3, texts[3])])
