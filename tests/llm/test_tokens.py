"""Token store, piece sampling and decoding against libraries and enumeration."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import with_clashes
from tokenizers import Tokenizer

from headwise.llm import pieces, token_store

BPE = public_tokenizers.path("byte_bpe_50k.json")
SPM = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


def test_segment_round_trip_and_random_access():
    rng = random.Random(3)
    docs = [(i or None, np.array([rng.choice([0, 5, 255, 256, 50256, 65535, 70000, 2**31]) for _ in range(rng.randint(0, 900))], dtype="<u4")) for i in range(30)]
    segment = token_store.Segment(token_store.packed(docs))
    flat = np.concatenate([d for _, d in docs])
    assert all(np.array_equal(segment.document(k), d) for k, (_, d) in enumerate(docs))
    assert [segment.token(i) for i in range(0, len(flat), 11)] == flat[::11].tolist()
    for _ in range(50):
        a = rng.randrange(len(flat))
        b = rng.randint(a, len(flat))
        assert np.array_equal(segment.tokens(a, b), flat[a:b])
    assert token_store.Segment(token_store.packed([])).n_docs == 0
    with pytest.raises(ValueError):
        token_store.Segment(b"something else..")


def test_word_by_word_encoding_equals_whole_texts():
    encoder = token_store.Encoder(BPE)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "12", "!", "<|endoftext|>", "\x1c", " ", "日", "\r", "\x85", "\x0b", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_added_tokens_have_the_ids_of_the_plain_tokenizer():
    tokenizer = Tokenizer.from_file(BPE)
    texts = ["before <|endoftext|> after", "<|endoftext|>", " a<|endoftext|>b <|endoftext", "no token", " word  <|endoftext|>  word ", "<|endoftext|" + ">" * 3, None, ""]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_store.Encoder(BPE).encode(texts * 2)]
    assert got[0] == [19052, 220, 50256, 706]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts * 2]


def test_token_store(spark, tmp_path, words, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.randint(0, 10**6), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for _ in range(200)]
    rows += [(5, None), (6, ""), (None, "no id"), (7, "twice"), (7, "twice"), (8, "long " * 50_000)]
    token_store.write(with_clashes(spark.createDataFrame(rows, DOCS)), BPE, str(tmp_path / "t"))
    got = token_store.read(spark, str(tmp_path / "t")).collect()
    tokenizer = Tokenizer.from_file(BPE)
    want, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    token_store.write(spark.createDataFrame([], DOCS), BPE, str(tmp_path / "e"))
    assert token_store.read(spark, str(tmp_path / "e")).count() == 0


def segmentations(lattices, text):
    """Every segmentation with its probability."""
    v = lattices.vocabulary
    names = {v.bytes[i].decode(): i for i in range(259, len(v.bytes)) if v.bytes[i]}
    text = " " + text

    def rest(at):
        if at == len(text):
            yield (), 0.0
            return
        for n in range(1, 17):
            if at + n <= len(text) and text[at : at + n] in names:
                i = names[text[at : at + n]]
                for tail, w in rest(at + n):
                    yield (i, *tail), w + v.weight[i]
        if text[at] not in names:
            spelt = list(text[at].encode())
            for tail, w in rest(at + 1):
                yield (*v.byte_id[spelt].tolist(), *tail), w + v.byte_weight * len(spelt)

    every = list(rest(0))
    top = max(w for _, w in every)
    total = sum(math.exp(w - top) for _, w in every)
    return {s: math.exp(w - top) / total for s, w in every}


def test_samples_follow_the_exact_distribution():
    lattices = pieces.Lattices(pieces.Vocabulary(SPM, 0.2))
    text = "an in☃ a\nb"
    exact = segmentations(lattices, text)
    n = 20_000
    got = pieces.sampled(lattices, [text] * n, pieces.mix(np.arange(n, dtype=np.uint64)), 3)
    first, second = {}, {}
    for samples in got:
        ids = [tuple(s[0].tolist()) for s in samples]
        assert len(set(ids)) == 3 and samples[0][2] >= samples[1][2] >= samples[2][2]
        assert all(abs(math.exp(s[1]) - exact[i]) < 1e-9 for s, i in zip(samples, ids))
        first[ids[0]] = first.get(ids[0], 0) + 1
        second[ids[1]] = second.get(ids[1], 0) + 1
    assert len(exact) > 20
    for s, p in exact.items():
        assert abs(first.get(s, 0) / n - p) < 0.015
        after = sum(q * p / (1 - q) for t, q in exact.items() if t != s)
        assert abs(second.get(s, 0) / n - after) < 0.015
    # Weighted by their inclusion scores, samples give unbiased sums.
    assert abs(np.mean([sum(math.exp(s[1]) / s[3] for s in x) for x in got]) - 1) < 0.02


def test_a_text_alone_and_among_others_has_equal_samples(words):
    lattices = pieces.Lattices(pieces.Vocabulary(SPM, 0.2))
    rng = random.Random(8)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    seeds = pieces.mix(np.arange(len(texts), dtype=np.uint64))
    together = pieces.sampled(lattices, texts, seeds, 3)
    for k, text in enumerate(texts):
        alone = pieces.sampled(lattices, [text], seeds[k : k + 1], 3)[0]
        assert [(a[0].tolist(), *a[1:]) for a in alone] == [(a[0].tolist(), *a[1:]) for a in together[k]]


def test_few_segmentations_are_all_given():
    lattices = pieces.Lattices(pieces.Vocabulary(SPM, 0.5))
    exact = segmentations(lattices, "the a")
    got = pieces.sampled(lattices, ["the a", "", None], np.arange(3, dtype=np.uint64), len(exact) + 5)
    assert {tuple(s[0].tolist()) for s in got[0]} == set(exact) and all(s[3] == 1.0 for s in got[0])
    assert [[(len(s[0]), s[1], s[3]) for s in x] for x in got[1:]] == [[(0, 0.0, 1.0)]] * 2


def test_encode_and_decode(spark, words):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(words) for _ in range(40)), "  two  spaces \n\ttabs\x00", "日本 émoji 🙂 ▁", "", None, "x" * 30_000, "word " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "no key")], DOCS)
    out = pieces.encode(with_clashes(df), SPM, k=2)
    rows = out.collect()
    assert all(r.round_trip for r in rows)
    assert {(r.doc_id, r["rank"]) for r in rows} == {(i, k) for i in (0, 1, 2, 5, 6, None) for k in (1, 2)} | {(3, 1), (4, 1)}
    # The same key and text give the same samples, wherever they are.
    assert sorted(r.ids_crc32 for r in rows if r.doc_id == 0) == sorted(2 * [r.ids_crc32 for r in pieces.encode(df.where("doc_id = 0").limit(1), SPM).collect()])
    back = pieces.decode(out, SPM)
    assert {(r.doc_id, r.ids) for r in back.collect()} == {(i, (t or "").replace("▁", " ")) for i, t in [*enumerate(texts), (None, "no key")]}
    assert pieces.encode(df.limit(0), SPM).count() == 0
