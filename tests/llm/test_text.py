"""Quality rules, language identification, page text, licenses and mixing."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import CLASHES, prose, with_clashes
from pyspark.sql import functions as F

from headwise.llm import html_text, language_id, licenses, mixing, quality

DOCS = "doc_id long, text string"


def test_rules_and_cascade(spark, words):
    rng = random.Random(9)
    good = prose(rng, words, 60)
    rows = [(1, good), (2, "too few words"), (3, None), (4, ""), (5, (good[:60] + " ") * 6), (6, " ".join(w + "##" for w in good.split())), (7, "\n".join([good] + ["one line of it"] * 9)), (8, " ".join(w + " " + w for w in good.split())), (1, good), (None, good)]
    df = with_clashes(spark.createDataFrame(rows, DOCS))
    got = sorted(((r.doc_id or 0, r.kept) for r in quality.judge(df).collect()))
    assert got == [(0, True), (1, True), (1, True), *((i, False) for i in range(2, 9))]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1]
    assert quality.judge(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_order_does_not_change_the_verdict_and_stops_early(words):
    rng = random.Random(3)
    texts = pa.array([prose(rng, words, rng.randint(1, 40)) for _ in range(50)] + [None, "#### " * 20])
    names = list(quality.RULES)
    want = ~np.logical_or.reduce([rule(quality.Texts(texts)) for rule in quality.RULES.values()])
    for _ in range(5):
        rng.shuffle(names)
        kept, n_run = quality.cascade(texts, quality.RULES, names)
        assert np.array_equal(kept, want) and (n_run[kept] == len(names)).all() and n_run.min() >= 1
    order = quality.best_order([("few_words", 1.0, 0.1), ("symbols", 1.0, 0.5), ("echoes", 0.1, 0.02)])
    assert order[:3] == ["symbols", "echoes", "few_words"]


def test_language_id(spark):
    rng = random.Random(6)
    parts = {"xa": "bla blu kri mon tar", "yb": "zöp wüx qäl joch", "zc": "ño lé çu shé"}
    rows = [(i, " ".join(rng.choice(parts[k].split()) + rng.choice(["", ",", " 7"]) for _ in range(20)), k) for i, k in enumerate(rng.choice(list(parts)) for _ in range(300))]
    df = spark.createDataFrame([*rows, (900, None, "xa"), (901, "12 !?", "xa"), (902, "", None), (None, "kri mon", None)], "doc_id long, text string, lang string")
    model = language_id.train(df.where(~language_id.held_out(F.col("doc_id"))))
    assert (model["weights"] == 0).mean() > 0.5
    got = {r.doc_id: r for r in language_id.predict(with_clashes(df), model).collect()}
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got.values())
    held = {r.doc_id for r in df.where(language_id.held_out(F.col("doc_id"))).collect()}
    assert held and all(got[i].lang_pred == k for i, _, k in rows if i in held)
    assert [got[i].lang_pred for i in (900, 901, 902, None)] == ["und"] * 3 + ["xa"]
    empty = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, empty).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="v3"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="wrap c12">
<div class="story n%d"><h1>Head &amp; line</h1><p>First  <b>bold</b>&nbsp;para<br>goes on.<p>Second &lt;para&gt;<ul><li>one<li>two</ul><div class="ad">Buy</div>
<form><input><p>mail</p></form><script>var x = "<p>no</p>";</script><table><tr><td>cell</td></tr></table></div><aside>Side</aside></div>
<section class="comments"><p>Nice read, a very long comment it is, longer than the story itself, on and on and on it goes until the end</p></section><footer>&copy; x</footer></body></html>"""
TEXT = "Head & line\nFirst bold para goes on.\nSecond <para>\none\ntwo\ncell"


def test_html_text(spark):
    rows = [(i, f"http://Host.example/{i}", PAGE % i) for i in range(4)]
    rows += [(10, None, "<p>plain"), (11, "http://host.example/o", "<article><p>other &eacute; layout</article>"), (12, "x", None), (13, "x", ""), (14, "x", "<!-- open"), (15, "x", "no tags at\n all"), (0, "http://host.example/0", PAGE % 0)]
    rows += [(16, "y", '<div class="a><p>x</p>'), (17, "z", "<p>" + "long text " * 30_000), (18, "z", "<div>" * 3000 + "deep")]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert [text[i] for i in range(4)] == [TEXT] * 4
    assert (text[10], text[11], text[12], text[13], text[14], text[15]) == ("plain", "other é layout", "", "", "", "no tags at all")
    assert len(text[17]) == 299_999 and text[18] == "deep"
    paths = {r.host: r.path for r in html_text.winning_paths(df.select(html_text.host("url").alias("host"), "html")).collect()}
    assert paths["host.example"].endswith("div.story.n") or paths["host.example"].endswith("div.n.story")
    assert html_text.extract(df.limit(0)).count() == 0


def own_text(page):
    return html_text.main_text(html_text.read(page), None)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><p>it's <a title=\"x > y\">link</a> and text", "it's link and text"),
        ("<body><p>say \"hi <b class='a>b'>there</b>", 'say "hi there'),
        ("<div class=post><h1>T</h1><p class=lead>lead</p><div class=entry><p>" + "body " * 60 + "</p></div></div>", "T\nlead\n" + " ".join(["body"] * 60)),
        ("<article><h2 id=search>S</h2><h2 id='related-work'>R</h2><p id=legal>L</p><div class='header-image entry'>E</div></article>", "S\nR\nL\nE"),
        ("<article><p>A</p><div class='ad-slot'>x</div><div id=sidebar-left>x</div><p class=notice>x</p><ul class='nav links'><li>x</ul></article>", "A"),
        ("<body><form id=frame><div><p>All of the page</p><input><nav>no</nav></div></form>", "All of the page"),
        ("<body><p>story of some length</p><form><p>mail</p></form>", "story of some length"),
        ("<body><p>a < b and <b", "a < b and <b"),
        ("<body><p>one</p><nav>two <i", "one"),
    ],
)
def test_html_parts_that_stay_and_go(page, text):
    assert own_text(page) == text


@pytest.mark.parametrize("page", ['<a "' * 8000, '<a b="' * 150_000, '<a "' * 250_000, "<div>" * 100_000 + "x", "<div>" * 30_000 + "</b>" * 30_000])
def test_html_reading_is_linear(page):
    start = time.process_time()
    own_text(page)
    assert time.process_time() - start < 10  # quadratic work would take minutes


def test_hosts_vote_for_their_own_layouts(spark):
    frames = {
        "a.example": ("<div class='page'><div class='text%d'>", "</div><div class='teasers'><a href=x>%s</a></div></div>"),
        "b.example": ("<table><tr><td class='left'><a href=x>links of the site</a></td><td class='story'>", "</td></tr></table><p><a href=y>%s</a></p>"),
        "c.example": ("<main><section class='copy'>", "</section></main><p><a href=y>%s</a></p>"),
    }
    rows, want = [], {}
    for h, (before, after) in frames.items():
        for i in range(12):
            title, lead, body = f"Title {i}", f"Lead {i} of {h}", " ".join(f"w{i}x{k}" for k in range(5 + 7 * i))
            # Some pages hold more in links than in text.
            page = (before % i if "%" in before else before) + f"<h1>{title}</h1><p>{lead}</p><div class='entry'><p>{body}</p></div>" + after % ("teaser " * (3 if i % 3 else 300))
            rows.append((len(rows), f"https://{h}/{i}", page))
            want[rows[-1][0]] = f"{title}\n{lead}\n{body}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == want
    paths = {r.host: r.path.rpartition(">")[2] for r in html_text.winning_paths(df.select(html_text.host("url").alias("host"), "html")).collect()}
    assert paths == {"a.example": "div.text", "b.example": "td.story", "c.example": "section.copy"} or paths["c.example"] == "main"


def test_licenses(spark, words):
    rng = random.Random(1)
    mit = next(t for k, t in licenses.TEMPLATES if k == "MIT" and len(t) > 200)
    files = [
        (1, "repo/LICENSE", "Copyright 2020 someone\n\n" + mit[: len(mit) // 2] + "\n" + mit[len(mit) // 2 :]),
        (2, "repo/a/COPYING.txt", "Licensed under the Apache License, Version 2.0."),
        (3, "repo/a/b/x.txt", prose(rng, words, 30)),
        (4, "repo/z/y.txt", prose(rng, words, 30)),
        (5, "repo/a/own.txt", "# " + prose(rng, words, 5) + "\n# Licensed under CC BY-NC 4.0.\n\n" + prose(rng, words, 50)),
        (6, "other/y.txt", "the license of this version"),
        (7, None, None),
        (8, "repoa/x.txt", ""),
        (9, "/abs/LICENSE", "All rights reserved."),
        (9, "/abs/LICENSE", "All rights reserved."),
        (10, "/abs/c/d/e", "x"),
    ]
    df = with_clashes(spark.createDataFrame(files, "doc_id long, path string, text string"), keep=("path",))
    got = [(r.doc_id, r.own_license, r.license, r.license_dir) for r in licenses.scan(df).collect()]
    want = [(1, "MIT", "MIT", None), (2, "Apache-2.0", "Apache-2.0", None), (3, None, "Apache-2.0", "repo/a"), (4, None, "MIT", "repo"), (5, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (6, None, None, None), (7, None, None, None), (8, None, None, None), (9, "proprietary", "proprietary", None), (9, "proprietary", "proprietary", None), (10, None, "proprietary", "/abs")]
    assert sorted(got, key=lambda r: r[0]) == want
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_scores_equal_brute_force(spark, words):
    rng = random.Random(4)
    texts = [rng.choice(licenses.TEMPLATES)[1].replace("License", rng.choice(["License", "Licence", "text"])) + " " + prose(rng, words, rng.randint(0, 4)) for _ in range(40)]
    df = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    seen, total = licenses.document_frequencies(df.select("text"))
    idf = np.log((1 + total) / (1 + seen)) + 1

    def vector(t):
        f, w = licenses._vector(licenses._words(*licenses.raw(pa.array([t])))[0], idf)
        return dict(zip(f.tolist(), w.tolist()))

    forms = [(k, vector(t)) for k, t in licenses.TEMPLATES]
    got = {r.id: (r.license, r.score) for r in licenses.own_licenses(df).collect()}
    for i, t in enumerate(texts):
        own = vector(t)
        scores = [round(sum(w * form.get(f, 0) for f, w in own.items()), 9) for _, form in forms]
        best = max(scores)
        if best >= licenses.THRESHOLD + 1e-6:
            assert got[i][0] == forms[scores.index(best)][0] and abs(got[i][1] - best) < 1e-8
        elif best < licenses.THRESHOLD - 1e-6:
            assert got[i] == (None, None)


def found_licenses(spark, words, texts):
    """Own licenses of texts among others of prose, by their numbers."""
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, prose(rng, words, 40) + " the license of this work and version is under a public file") for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).withColumn("path", F.lit("x"))
    got = {r.doc_id: r.own_license for r in licenses.scan(df).collect()}
    assert not any(got[i] for i in got if i >= 1000)
    return [got[i] for i in range(len(texts))]


def test_licenses_within_longer_lines(spark, words):
    rng = random.Random(2)
    more = lambda: prose(rng, words, 15)
    mit = next(t for k, t in licenses.TEMPLATES if k == "MIT" and len(t) > 200).split()
    wrapped = "\n".join("// " + " ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    texts = ["Copyright (c) 2021 Example Corp. All rights reserved.", f"{more()} Released under the MIT License. {more()}", f"{more()}\n{wrapped}\n" + "\n".join(more() for _ in range(20)), f"{more()} All rights reserved. {more()} Licensed under the Apache License, Version 2.0. {more()}"]
    texts.append("This project is released under the MIT License, see COPYING for details.")
    assert found_licenses(spark, words, texts) == ["proprietary", "MIT", "MIT", "Apache-2.0", "MIT"]


def test_licenses_of_confusable_families(spark, words):
    rng = random.Random(3)
    header = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as published by the Free Software Foundation; either version %s of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
    cc = "This work is licensed under a Creative Commons Attribution%s %s International License."
    pairs = [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        (header % ("", "2"), "GPL-2.0"),
        (header % ("", "3"), "GPL-3.0"),
        (header % ("Lesser ", "2.1"), "LGPL-2.1"),
        (header % ("Lesser ", "3"), "LGPL-3.0"),
        (header % ("Affero ", "3"), "AGPL-3.0"),
        (cc % ("", "4.0"), "CC-BY-4.0"),
        (cc % ("-ShareAlike", "4.0"), "CC-BY-SA-4.0"),
        (cc % ("-ShareAlike", "3.0"), "CC-BY-SA-3.0"),
        (cc % ("-NonCommercial-NoDerivatives", "4.0"), "CC-BY-NC-ND-4.0"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        (bsd, "BSD-2-Clause"),
        (bsd + "3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products.", "BSD-3-Clause"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
        ("Licensed under the Mozilla Public License, version 2.0.", "MPL-2.0"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("# SPDX-License-Identifier: MIT\nimport os", "MIT"),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Linux-syscall-note */", "GPL-2.0 WITH Linux-syscall-note"),
    ]
    assert found_licenses(spark, words, [t for t, _ in pairs]) == [k for _, k in pairs]
    within = [prose(rng, words, 12) + " " + t + " " + prose(rng, words, 12) for t, _ in pairs[:13]]
    assert found_licenses(spark, words, within) == [k for _, k in pairs[:13]]


@pytest.mark.parametrize("seed", range(6))
def test_period_keeps_within_a_block(seed):
    rng = random.Random(seed)
    share = {f"s{i}": rng.randint(1, 60) for i in range(rng.randint(1, 25))}
    total, given = sum(share.values()), dict.fromkeys(share, 0)
    for slot, (source, number) in enumerate(mixing.period(share), 1):
        assert number == given[source]
        given[source] += 1
        assert all(abs(given[s] - slot * share[s] / total) < 1 for s in share)
    assert given == share


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, f"t{i}", rng.choice(["a"] * 8 + ["b", "b", "c", None])) for i in range(1500)] + [(None, "n", "c"), (3, "t3", "a")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    weights = {"a": 2.0, "b": 1.0, "c": 1.0}
    out = mixing.interleaved(df, weights=weights, block=8).orderBy("mix_place").collect()
    assert len(out) == len(rows) and len({r.mix_place for r in out}) == len(rows)
    assert {r.mix_source for r in out} == {"a", "b", "c", "\x01rest"}
    # Until the first source ends, each has had its share to within a block.
    share = mixing.shares({**weights, "\x01rest": 1.0})
    total = sum(share.values())
    left = {k: sum(r.mix_source == k for r in out) for k in share}
    given = dict.fromkeys(share, 0)
    for n, r in enumerate(out, 1):
        given[r.mix_source] += 1
        if given[r.mix_source] == left[r.mix_source]:
            break
        if n % 8 == 0:
            assert all(abs(given[k] / 8 - n / 8 * share[k] / total) < 1 for k in share)
    mixed = mixing.mixed(df, weights=weights, block=8)
    assert mixed.columns == df.columns and len(CLASHES) + 3 == len(df.columns)
    assert [r.doc_id for r in mixed.collect()] == [r.row.doc_id for r in out]
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mixing_keeps_to_tiny_weights():
    weights = {"big": 0.9, **{f"s{i}": 0.001 for i in range(100)}, "tiny": 1e-7}
    share, given = mixing.shares(weights), dict.fromkeys(weights, 0)
    count = {k: 4000 if k == "big" else 4 for k in weights}
    whole = sum(weights.values())
    for slot, (source, number) in enumerate(mixing.slots(share, count), 1):
        assert number == given[source]
        given[source] += 1
        if slot < 3500:
            assert all(abs(given[k] - slot * weights[k] / whole) < 1 + 1e-9 for k in weights)
    assert given == count
    # Sources that ended leave the others their shares; one of weight 0 comes last.
    order = [k for k, _ in mixing.slots(mixing.shares({"a": 3, "b": 1, "c": 1, "z": 0}), {"a": 3, "b": 50, "c": 50, "z": 2})]
    assert order[-2:] == ["z", "z"]
    assert all(abs(order[:n].count("b") - (n - 3) / 2) < 1 for n in range(5, 103))


def test_mixing_gives_every_source_its_own_weight(spark):
    rows = [(i, "big" if i < 2000 else f"s{i % 300}") for i in range(8000)]
    out = mixing.interleaved(spark.createDataFrame(rows, "doc_id long, source string"), block=1).orderBy("mix_place").collect()
    sizes = {k: sum(r.mix_source == k for r in out) for k in {r.mix_source for r in out}}
    assert len(out) == 8000 and len(sizes) == 301 and [r.mix_place for r in out] == list(range(8000))
    weights = {k: n**mixing.ALPHA for k, n in sizes.items()}
    whole, given = sum(weights.values()), dict.fromkeys(sizes, 0)
    for n, r in enumerate(out, 1):
        given[r.mix_source] += 1
        if n < 5000:
            assert abs(given[r.mix_source] - n * weights[r.mix_source] / whole) < 1 + 1e-9
