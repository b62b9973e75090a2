import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, tokens

TOK = tokens.default_tokenizer()


PLAIN = Tokenizer.from_file(TOK)


def brute_ids(text):
    ids = PLAIN.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, tokens.END_ID], dtype="<u4").tobytes()


def read(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def check_files(got, docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    want, start = [], 0
    for i, t in docs:
        b = brute_ids(t)
        want.append((i, len(b) // 4, zlib.crc32(b)))
    got = sorted(got, key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(want)
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


def test_op8_round_trip(spark, sf_dir):
    check_files(tokens.op8_token_files(spark, sf_dir).collect(), read(spark, sf_dir))


@pytest.mark.parametrize("delta", [True, False])
def test_token_files_odd(spark, odd_docs, no_docs, tmp_path, delta):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        path = f"file://{tmp_path}/{name}{delta}"
        tokens.write_token_files(docs, path, TOK, delta=delta)
        check_files(tokens.token_digests(tokens.read_token_files(spark, path)).collect(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert tokens.read_token_meta(spark, f"file://{tmp_path}/odd{delta}", 2, 3).count() == 3


def check_pieces(pieces, docs):
    texts = Counter()
    for i, t in docs:
        b = brute_ids(t)
        texts[(i, len(b) // 4, zlib.crc32(b))] += 1
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert sum(p["length"] for p in pieces) == sum(n * c for (_, n, _), c in texts.items())
    for (i, n), own in by_doc.items():
        copies = sum(c for (j, m, _), c in texts.items() if (i, n) == (j, m))
        spans = Counter((p["start"], p["length"]) for p in own)
        assert set(spans.values()) <= {copies} or copies > 1
        at = 0
        for (s, length), c in sorted(spans.items()):
            assert s == at and c == copies
            at += length
        assert at == n
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= packing.CAPACITY


def test_op1_pieces(spark, sf_dir):
    docs = read(spark, sf_dir)
    got = packing.op1_packing(spark, sf_dir).collect()
    check_pieces(got, docs)
    ids = {i: brute_ids(t) for i, t in docs}
    assert all(zlib.crc32(ids[p["doc_id"]][4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"] for p in got)
    total = sum(p["length"] for p in got)
    assert len({p["sequence_id"] for p in got}) <= 1.02 * total / packing.CAPACITY + 2


def test_pack_odd(spark, odd_docs, no_docs):
    check_pieces(packing.pack(odd_docs, TOK).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert packing.pack(no_docs, TOK).collect() == []


@pytest.mark.parametrize("capacity", [64, 100, 128, 200, 256, 777, 4096])
def test_pack_any_capacity(spark, sf_dir, monkeypatch, capacity):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    monkeypatch.setattr(packing, "CAPACITY", capacity)
    got = packing.pack(docs, TOK, capacity).collect()
    check_pieces(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len({p["sequence_id"] for p in got}) <= 1.15 * sum(p["length"] for p in got) / capacity + 3


def test_pack_needs_room(spark, odd_docs):
    with pytest.raises(ValueError):
        packing.pack(odd_docs, TOK, 63)


@pytest.mark.parametrize("text", ["<|endoftext|>", "<|ENDOFTEXT|> x", "a<|EndOfText|>B C", "Ab <|startoftext|>Cd", "A<|b|> <| |> X<|", "A B.c, 10 0"])
def test_special_tokens_keep_their_case(text):
    enc = tokens.ChunkEncoder(TOK)
    assert not enc.whole
    assert enc.encode([text.encode(), b"Plain WORDS", None]) == [brute_ids(text), brute_ids("Plain WORDS"), brute_ids("")]


def test_other_tokenizers_fall_back_to_whole_texts(tmp_path):
    """One that keeps case and joins over blanks is not cut into words."""
    from tokenizers import models, pre_tokenizers

    tok = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(map(chr, range(32, 127)))}, merges=[]))
    tok.pre_tokenizer = pre_tokenizers.Sequence([])
    tok.add_special_tokens(["<|x|>"])
    tok.save(str(tmp_path / "t.json"))
    enc = tokens.ChunkEncoder(str(tmp_path / "t.json"))
    assert enc.whole
    ids = tok.encode("Some Text", add_special_tokens=False).ids
    assert enc.encode([b"Some Text", None]) == [np.array([*ids, tokens.END_ID], "<u4").tobytes(), np.array([tokens.END_ID], "<u4").tobytes()]


def test_sequences_hold_the_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 20")
    pieces = packing.pack(docs, TOK)
    got = packing.sequences(docs, pieces, TOK).collect()
    assert sum(len(r["ids"]) for r in got) == sum(len(brute_ids(r["text"])) // 4 for r in docs.collect())


@pytest.mark.parametrize("lengths", ["uniform", "one length", "ones", "mixed"])
def test_plan_is_tight(lengths):
    r = random.Random(3)
    draw = {"uniform": lambda: r.randint(1, 2047), "one length": lambda: 1030, "ones": lambda: 1, "mixed": lambda: r.choice((1030, 1500, 7, 300))}[lengths]
    tails = Counter(draw() for _ in range(4000))
    cut, slots = packing.plan_packing(dict(tails), 3)
    placed = Counter()
    for k, lo, hi, per, _base, _slot, _into in slots:
        assert per > 0 and hi > lo
        placed[k] += hi - lo
    kinds = packing.classes(packing.CAPACITY)
    need = Counter({packing.class_of(2048): 3})
    for t, c in tails.items():
        for piece in packing.cut_tail(t, cut):
            need[packing.class_of(piece)] += c
    assert {k: -(-c // kinds[k][1]) for k, c in need.items()} == dict(placed)
    seqs = 1 + max(s[4] + (s[6] + s[2] - s[1] - 1) // s[3] for s in slots)
    assert seqs <= 1.02 * (sum(t * c for t, c in tails.items()) / 2048 + 3) + 2


def test_encoder_odd_words():
    """Stops, zeros, special tokens and rare white space, joined at random."""
    pieces = ["a", "B", "z", "0", "10", ".", ",", "..", " ", "\t", "\n", "é", "日", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "it's", "x.", "X,", "@", "\x1c", "\x85", "\xa0", "a0."]
    draw, enc = random.Random(5), tokens.encoder(TOK)
    assert not enc.whole
    for _ in range(300):
        texts = ["".join(draw.choices(pieces, k=draw.randint(0, 14))) for _ in range(draw.randint(1, 6))]
        assert enc.encode([t.encode() for t in texts]) == [brute_ids(t) for t in texts]
    assert enc.encode([None, b""]) == [brute_ids("")] * 2
