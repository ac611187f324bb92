"""Collocations, repeated strings, the conversation trie and their building blocks against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import with_clashes
from pyspark.sql import functions as F

from headwise.llm import collocations, ordering, quotient, repeats, turn_trie


@pytest.mark.parametrize("bits", [1, 2, 3, 17, 33, 42, 63, 64])
def test_permutation_is_invertible(bits):
    rng = np.random.default_rng(bits)
    keys = np.unique(rng.integers(0, (1 << bits) - 1, 2000, dtype=np.uint64, endpoint=True))
    there = quotient.permute(keys, bits)
    assert len(np.unique(there)) == len(keys) and int(there.max()) < 1 << bits
    assert (quotient.restore(there, bits) == keys).all()


@pytest.mark.parametrize("bits, n", [(64, 1000), (40, 5000), (9, 400), (3, 8), (1, 1), (20, 0)])
def test_filters_keep_keys_and_counts(bits, n):
    rng = np.random.default_rng(n)
    shards, want = [], Counter()
    for _ in range(4):
        keys, counts = quotient.counted(rng.integers(0, (1 << bits) - 1, n, dtype=np.uint64, endpoint=True))
        counts = counts * rng.choice([1, 1, 1, 254, 255, 256, 10**12], len(counts))
        shards.append(quotient.encode(keys, counts, bits))
        again, held = quotient.decode(shards[-1])
        assert (again == keys).all() and (held == counts).all()
        for k, c in zip(keys.tolist(), counts.tolist()):
            want[k] += c
    keys, counts = quotient.merge(shards)
    assert dict(zip(keys.tolist(), counts.tolist())) == want and keys.tolist() == sorted(want)


def test_filter_is_smaller_than_its_keys():
    keys, counts = quotient.counted(quotient.permute(np.arange(100_000, dtype=np.uint64) * np.uint64(977), 36))
    assert len(quotient.encode(keys, counts, 36)) < 5 * len(keys)


def phrases_by_hand(rows, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, of in f.items():
        held = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        own = []
        for p, a in held.items():
            if len(p) == 2 and any(100 * b >= share * a for q, b in held.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, l, r = min((1000000 * a * a // (of[p[:k]] * of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            own.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(own)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def chatter(seed=3, rows=200):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gam\xe9", "d", "e\x00x", "中文", "zeta", "eta", "theta", "iota"]
    rare = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(rows):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(words if rng.random() < 0.85 else rare))
            if rng.random() < 0.3:
                parts += ["new", "york", "city"] if rng.random() < 0.6 else ["new", "york"]
            parts.append(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]))
            if rng.random() < 0.9:
                parts.append(" ")
        out.append((" ".join(parts), rng.choice(["en", "en", "de", None, ""])))
    return out + [(None, "en"), ("", "fr"), (" .,;", "en"), ("solo", "it"), ("ha " * 5000, "en"), ("new york city " * 30, "en")]


@pytest.mark.parametrize("limit", [collocations.VOCABULARY, 6])
def test_collocations_equal_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_ROWS", 500)
    rows = chatter()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = collocations.collocations(with_clashes(df.withColumn("h1", F.lit(1)), keep=("lang",)), limit=limit, top=25).collect()
    want = phrases_by_hand(rows, top=25)
    assert sorted(map(tuple, got)) == want and {r[0] for r in want} >= {"en", "de", "und", ""} and len(want) > 40


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).collect() == []
    few = spark.createDataFrame([(None, None), ("a b c", "x"), ("a b c", "x")], "text string, lang string")
    assert collocations.collocations(few).collect() == []
    assert [r.phrase for r in collocations.collocations(few, least=2).collect()] == ["a b c"]


def test_scores_past_64_bits(spark):
    big = 5_000_000_000
    words = spark.createDataFrame([(1, "x", "a", big), (2, "x", "b", big + 7)], "h long, lang string, word string, n long")
    grams = spark.createDataFrame([(2, 1, 2, None, big - 3)], "size int, h1 long, h2 long, h3 long, a long")
    assert collocations.scored(grams, words).first().score == 1000000 * (big - 3) ** 2 // (big * (big + 7))


def without_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (key, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((key, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def passages(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdefghij klm\xe9") for _ in range(n))
    shared = [some(rng.choice([380, 395, 400, 401, 420, 600, 1500])) for _ in range(12)]
    rows = []
    for _ in range(70):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p, kind = rng.choice(shared), rng.random()
            if 0.4 <= kind < 0.6:
                p = p[rng.randint(0, len(p) // 3) :]
            elif 0.6 <= kind < 0.8:
                at = rng.randrange(len(p))
                p = p[:at] + "Z" + p[at + 1 :]
            parts += [p, some(rng.randint(0, 300))]
        rows.append("".join(parts))
    rows += [rows[3], rows[3], "a" * 1000, "a" * 399, "ab" * 400, "xyz" * 500 + some(50) + "xyz" * 300, None, "", shared[0], shared[1] + shared[1], "b" * 401, "é" * 600]
    return list(enumerate(rows)) + [(5, rows[7]), (None, rows[8]), (5, rows[5])]


@pytest.mark.parametrize("length", [400, 280])
def test_repeats_equal_brute_force(spark, length):
    rows = passages(length)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.remove_repeats(with_clashes(df.withColumn("runs", F.lit(1)).withColumn("hi", F.lit(1)).withColumn("rank", F.lit(0))), length=length).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got), key=key)
    assert got == sorted(without_repeats(rows, length), key=key)
    assert 20 < sum(len(r[2]) for r in got)


def test_a_very_long_text_repeats_itself(spark):
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefgh ") for _ in range(90_000))
    text = part + "".join(rng.choice("abcdefgh ") for _ in range(400_000)) + "!" + part + "?"
    rows = [(1, text), (2, part[40_000:40_900]), (3, text[200_000:200_399])]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    again = len(text) - 1 - len(part)
    assert got == {1: [(0, 90_000), (again, again + 90_000)], 2: [(0, 900)], 3: []}


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([], "doc_id string, text string"), length=200)


@pytest.mark.parametrize("small", [8, 10_000])
def test_list_ranks(spark, small):
    rng = random.Random(small)
    items = rng.sample(range(1 << 45), 700)
    lists = [items[:1], items[1:3], items[3:650], items[650:]]
    links = [(x, own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None, 1 + x % 3) for own in lists for i, x in enumerate(own)]
    rng.shuffle(links)
    got = ordering.list_ranks(spark.createDataFrame(links, "item long, prev long, next long, hop long"), small)
    want = {x: sum(1 + y % 3 for y in own[i:]) for own in lists for i, x in enumerate(own)}
    assert {r.item: r.rest for r in got.collect()} == want and got.count() == len(want)


def trie_by_hand(rows, rebuild=True):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(own)] for c, own in turns.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:]) if rebuild else tuple(own)
    nodes = defaultdict(list)
    for c, own in full.items():
        for d in range(len(own) + 1):
            nodes[own[:d]].append(c)
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = Counter(), Counter(), []
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if full[c] == k)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks():
    rng = random.Random(21)
    lines = ["hi", "hello", "", None, "éè", "bye"]
    rows = []
    for c in [*range(0, 12), *range(100, 140), *range(205, 240), 1_000_000_007]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), rng.choice(lines[:2] if t < 2 else lines)))
    rows += [(7, 3, "user", "hi")] * 3 + [(None, 1, "user", "lost")] + [(300 + i, t, "u", f"same {t}") for i in range(50) for t in range(4)]
    return rows + [(400, t, "u", f"long {t}") for t in range(300)]


@pytest.mark.parametrize("small", [16, 1 << 15])
def test_trie_equals_brute_force(spark, small):
    rows = talks()
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7), keep=("text", "role"))
    turns = turn_trie.numbered_turns(df.withColumn("part", F.lit(0)).withColumn("conv", F.lit(0)))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    got = turn_trie.prefix_trie(*turn_trie.with_heads_of(turns, F.col("conv") - F.col("conv") % 100, head, 5), small=small).collect()
    assert sorted(map(tuple, got), key=repr) == trie_by_hand(rows)


def test_trie_of_plain_conversations_and_of_nothing(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "b", "cc"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "b", "cc"), (3, 2, "u", "d")]
    turns = turn_trie.numbered_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = turn_trie.prefix_trie(turns, turns.select("conv").distinct()).collect()
    assert sorted(map(tuple, got), key=repr) == trie_by_hand(rows, rebuild=False)
    none = turn_trie.numbered_turns(spark.createDataFrame([], "conv_id int, turn int, role string, text string"))
    assert turn_trie.prefix_trie(none, none.select("conv")).collect() == []
