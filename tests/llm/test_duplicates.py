"""Near-duplicate documents, fuzzy lines and components against brute force."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import CLASHES, prose, with_clashes  # noqa: F401

from headwise.llm import common, graph, line_dedup, near_dups
from headwise.session import shared_dir
from headwise.sources import tables

DOCS = "doc_id long, text string"


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_links(sets, num, den):
    keys = sorted(sets)
    return [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def corpus(words):
    rng = random.Random(11)
    rows = []
    for family in range(12):
        base = prose(rng, words, rng.randint(3, 120)).split()
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    shared = prose(rng, words, 60)
    rows += [shared + " " + prose(rng, words, rng.randint(8, 40)) for _ in range(40)]
    rows += ["x", "x", "X  x", "", None, "  \t", "a b", "A\nB"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words_in", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words, words_in):
    rows = corpus(words)
    got = near_dups.near_duplicates(spark.createDataFrame(rows, DOCS), words=words_in).collect()
    sets = {i: shingle_set(t, words_in) for i, t in rows}
    want = closure(sets, jaccard_links(sets, 80, 100))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert len(got) == len(rows)


def test_near_duplicates_edge_cases(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (9, None)]
    df = with_clashes(spark.createDataFrame(rows, DOCS))
    got = sorted(tuple(r) for r in near_dups.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False), (9, 0, 9, True)]
    lost = [r for r in near_dups.near_duplicates(df).collect() if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in lost] == [(None, True)] * 2


def test_very_long_text(spark, words):
    rng = random.Random(2)
    long = prose(rng, words, 300_000)
    got = near_dups.near_duplicates(spark.createDataFrame([(1, long), (2, long + " tail"), (3, "short text")], DOCS), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_set(line):
    n = line_dedup.SHINGLE
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def test_line_dedup_equals_brute_force(spark, words):
    rng = random.Random(4)
    lines = [prose(rng, words, rng.randint(1, 25)) for _ in range(60)]
    lines += [x[:-1] + "z" for x in lines[:30]] + ["é" * 3, "é" * 3 + "ü", "  ", "", "ab"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(60)] + [(60, None), (61, "")]
    got = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(spark.createDataFrame(rows, DOCS)).collect()}
    places = {(i, k): x for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip()}
    by_line = {}
    for p in sorted(places):
        by_line.setdefault(places[p], p)
    links = jaccard_links({p: line_set(x) for x, p in by_line.items()}, 80, 100)
    root = closure(by_line.values(), links)
    keep = {p for p, x in places.items() if p == root[by_line[x]]}
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or (i, k) in keep) for i, t in rows}
    assert got == want


def test_line_dedup_edge_cases(spark):
    df = spark.createDataFrame([(None, "same line here\nother"), (2, "same line here"), (1, "same line here\n\nsame line here"), (1, "same line here\n\nsame line here")], DOCS)
    out = line_dedup.drop_duplicate_lines(with_clashes(df))
    assert len(out.columns) == 2 + len(CLASHES)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "same line here\nother"), (1, "same line here\n"), (1, "same line here\n"), (2, "")]
    assert line_dedup.drop_duplicate_lines(df.limit(0)).count() == 0


def test_texts_of_a_repeated_id_keep_their_own_links(spark, words):
    rng = random.Random(31)
    text = prose(rng, words, 60)
    rows = [(1, "zzz " + prose(rng, words, 40)), (1, text), (2, text + " more"), (3, text + " words"), (3, prose(rng, words, 30)), (4, None)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True), (4, 4, True)]
    assert near_dups.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def line_keys(lines):
    data, bounds = line_dedup.raw(pa.array(["\n".join(lines)]))
    _, _, starts, ends = line_dedup.line_spans(data, bounds)
    return np.concatenate([line_dedup.keys_of(line_dedup.signatures(*line_dedup.shingles(data, starts[k : k + 512], ends[k : k + 512]), len(starts[k : k + 512]))) for k in range(0, len(starts), 512)])


@pytest.mark.parametrize("shortest, longest", [(10, 40), (40, 120)])
def test_lines_at_the_threshold_share_a_bucket(words, shortest, longest):
    rng = random.Random(21)
    pairs = []
    while len(pairs) < 2000:
        a = [rng.choice(words) for _ in range(rng.randint(shortest, longest))]
        b = [rng.choice(words) if rng.random() < 0.05 else w for w in a]
        x, y = line_set(" ".join(a)), line_set(" ".join(b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.83:
            pairs.append((" ".join(a), " ".join(b)))
    keys = line_keys([x for pair in pairs for x in pair])
    assert (keys[0::2] == keys[1::2]).any(axis=1).all()


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(300):
        both, x, y = (rng.integers(0, 1 << 63, rng.integers(0, n), dtype=np.uint64) for n in (3000, 300, 300))
        bits = np.bitwise_xor(graph.parity(np.concatenate((both, x))), graph.parity(np.concatenate((both, y))))
        apart = int(np.unpackbits(bits.view(np.uint8)).sum())
        assert apart <= len(x) + len(y) and (apart + len(x) + len(y)) % 2 == 0


def family(words, copies):
    """Lines that share half their words, some of them with a near copy."""
    rng = random.Random(29)
    passage = prose(rng, words, 12)
    lines = [passage + " " + prose(rng, words, 12) for _ in range(60)]
    return lines + [x + "s" for x in lines[:copies]]


def test_sketches_equal_those_of_single_sets(words):
    lines = [*family(words, 5), "ab", "é" * 9, "abcabcabcabc"]
    data, bounds = line_dedup.raw(pa.array(["\n".join(lines)]))
    _, _, starts, ends = line_dedup.line_spans(data, bounds)
    n, bits = line_dedup.sketches(*line_dedup.shingles(data, starts, ends), len(starts))
    for own, size, row in zip(line_dedup.shingler(pa.array(lines)), n, bits):
        assert size == len(own) and (row == graph.parity(own)).all()


def test_prefix_filter_makes_only_pairs_that_parity_bits_leave_open(spark, words):
    lines = family(words, 10)
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, text string")
    roots = spark.createDataFrame([], "node long, root long")
    links = set(jaccard_links({i: line_set(x) for i, x in enumerate(lines)}, 80, 100))
    plain, bits = ({tuple(r) for r in graph._by_rare_shingles(texts, roots, line_dedup.shingler, 80, 100, own).collect()} for own in (False, True))
    assert links and links <= bits <= plain
    assert len(bits) < 2 * len(links) < len(plain)


def test_texts_are_asked_for_only_where_parity_bits_leave_a_pair_open(spark, words):
    # Two buckets of few lines, of which ten have a near copy, and one of them all.
    lines, asked = family(words, 10), []
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, text string")
    small = [(k % 2, k) for k in range(len(lines))]
    sets = [[i, len(x), *graph.parity(x).tolist()] for i, x in enumerate(line_dedup.shingler(pa.array(lines)))]
    sketches = spark.createDataFrame(sets, graph.SKETCH)

    def texts_of(nodes):
        asked.append(nodes.count())
        return texts.join(nodes, "node")

    for members in (small, small + [(2, k) for k in range(len(lines))]):
        asked.clear()
        buckets = spark.createDataFrame(members, "bucket long, node long")
        got = graph.linked(buckets, texts_of, line_dedup.shingler, 80, 100, lambda nodes: sketches.join(nodes, "node"))
        sets_of = {i: line_set(x) for i, x in enumerate(lines)}
        links = [(a, b) for a, b in jaccard_links(sets_of, 80, 100) if members is not small or a % 2 == b % 2]
        assert {tuple(r) for r in got.collect()} == {(i, r) for i, r in closure({x for pair in links for x in pair}, links).items()}
        # Those of the large bucket are asked for once, by the prefix filter; the others only for their links.
        assert sorted(asked)[-1] <= (len(lines) if members is not small else 30)
        assert sum(asked) <= (len(lines) if members is not small else 0) + 60


def test_long_lines_and_lines_sharing_a_passage(spark, words):
    rng = random.Random(17)
    passage = prose(rng, words, 60)
    lines = [passage + " " + prose(rng, words, rng.randint(14, 60)) for _ in range(120)]
    chain = [prose(rng, words, 50)]
    for _ in range(60):
        own = chain[-1].split()
        own[rng.randrange(len(own))] = rng.choice(words)
        chain.append(" ".join(own))
    long = prose(rng, words, 40_000)
    rows = list(enumerate([*lines, *chain, long, long[:-3] + " é x"]))
    got = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(spark.createDataFrame(rows, DOCS)).collect()}
    want = closure(range(len(rows)), jaccard_links({i: line_set(x) for i, x in rows}, 80, 100))
    assert {i for i, x in got.items() if x} == {i for i, r in want.items() if i == r}


def test_stored_leaves_no_shuffle_files(spark):
    """what is shuffled for a stored table goes with it, without waiting for the driver's garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, mode = files(), spark.conf.get(common.CLEAN, None)
    out = common.stored(spark.range(20_000).repartition(3, "id"), "dealt")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before and out.count() == 20_000 and spark.conf.get(common.CLEAN, None) == mode


def test_line_dedup_leaves_only_what_its_result_reads(spark, words):
    """tables of its steps leave the shared folder; only the lines to drop are read by the result."""
    held = lambda: set(tables.names(spark, shared_dir(spark)))
    lines, before = family(words, 20), held()
    rows = [(k, "\n".join(lines[k : k + 3])) for k in range(len(lines))]
    out = line_dedup.drop_duplicate_lines(spark.createDataFrame(rows, DOCS))
    assert [n.rsplit("-", 1)[0] for n in held() - before] == ["gone"]
    firsts = {x: k for k, x in reversed(list(enumerate(lines)))}
    root = closure(firsts.values(), jaccard_links({k: line_set(x) for x, k in firsts.items()}, 80, 100))
    kept = {x for x, k in firsts.items() if root[k] == k}
    assert {x for r in out.collect() for x in r.text.split("\n") if x} == kept


def test_rounds_of_bands_give_every_bucket(words):
    """bands dealt in rounds have the keys of all bands at once."""
    lines = [*family(words, 5), "ab", "é" * 9, "abcabcabcabc"]
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(lines)])], ["text"])
    rows = [{(r["bucket"], r["node"]) for b in line_dedup._buckets(bands)(iter([batch])) for r in b.to_pylist()} for bands in (range(22), range(9), range(9, 22))]
    assert rows[0] == rows[1] | rows[2] and not rows[1] & rows[2]
    assert {k for k, _ in rows[0]} == set(line_keys(lines).ravel().view(np.int64).tolist())
