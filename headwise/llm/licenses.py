"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Texts are cut into segments: each line, and each run of lines without a blank one between them. A
statement within a longer line or among other lines is met by windows: as many words as a template
has, slid over the whole text from each of the template's words and up to each of them. A segment's words (runs of ASCII letters, digits and other non-ASCII characters, in lower case) are
hashed to ``DIM`` features; a feature's weight is its count times its inverse document frequency over
all documents. The segment nearest to a template by cosine, if at ``threshold`` or more, gives the
document's own license; ties go to the template that stands first, then to the earlier segment. As
other licenses also reserve rights, "proprietary" counts only where nothing else is near enough.
Among the GNU, Creative Commons and BSD licenses the version and variant words of the matched text
itself decide; GNU and CC texts without a version get the family's name alone. The BSD opening is
three-clause unless a list of conditions without that on names follows. An SPDX tag outranks all
wordings. Licenses beyond ``TEMPLATES``, or in other words than theirs, are met by their tag only.

A file whose name says that it states a license passes its license on to its directory and those
below, unless a nearer directory has one of its own: each directory is joined with all its ancestors
by path, and the deepest with a license wins. Of several such files in a directory the best score
wins, then the license that sorts first. A file with a license of its own keeps it.

Null or empty text has no license of its own. A null path inherits nothing. Rows that repeat are each
returned. Whole texts are scanned; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .hashing import LOWER, prefix_sums, raw, spans_hash

DIM = 1 << 16
THRESHOLD = 0.7

# Wordings in which public licenses are stated.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for license information."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("ISC", "Released under the ISC License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("proprietary", "All rights reserved."),
]
#: What a text says that grants nothing.
OWNED = "proprietary"
#: File names that state a directory's license.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"

#: A tag that names a license by its identifier.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+-]+)*)")
VERSION = re.compile(r"(?:\bversions?|\bv|\bl?a?gpl)[\s.,:v-]*(\d+(?:\.\d+)?)")


def variant(kind: str, words: str, after: str) -> str:
    """The kind that a text near a template of ``kind`` states by its own words.

    ``after`` is what follows the matched ``words``. In a family a wording is shared by several
    versions and variants: those words decide that the text has, whichever template is nearest."""
    words = words.lower()
    if kind.startswith(("GPL", "LGPL", "AGPL")):
        name = "AGPL" if "affero" in words or "agpl" in words else "LGPL" if re.search(r"\b(lesser|library|lgpl)\b", words) else "GPL"
        found = VERSION.search(words) or VERSION.match(after.lower().lstrip(" ,;:.(\n#*/"))
        if not found:
            return name
        number = found[1] if "." in found[1] else found[1] + ".0"
        return f"{name}-{number}"
    if kind.startswith("CC-BY"):
        tokens = set(re.findall(r"[a-z]+", words))
        name = "CC-BY"
        for part, names in (("NC", {"nc", "noncommercial"}), ("SA", {"sa", "sharealike"}), ("ND", {"nd", "noderivatives", "noderivs"})):
            spelt = {"NC": "non-?commercial", "SA": "share-?alike", "ND": "no-?deriv"}[part]
            if names & tokens or re.search(spelt, words):
                name += f"-{part}"
        found = re.search(r"\b(\d\.\d)\b", words)
        return f"{name}-{found[1]}" if found else name
    if kind == "BSD-3-Clause" and "redistribution" in words:
        # The opening sentence is shared; the third clause is about names.
        rest = " ".join(re.findall(r"[a-z]+", after[:4000].lower()))
        if "list of conditions" in rest and not re.search(r"neither the names?|endorse or promote", rest):
            return "BSD-2-Clause"
    return kind


def tagged(text: str | None) -> str | None:
    """The license of the first SPDX tag, without the suffixes of its GNU identifiers."""
    found = SPDX.search(text) if text else None
    return found and re.sub(r"(GPL-\d\.\d)(-only|-or-later|\+)", r"\1", " ".join(found[1].split()))


#: Bytes that stand between words.
BETWEEN = np.array([not (chr(c).isalnum() if c < 128 else True) for c in range(256)])


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, start) of each word; no word crosses a row's border."""
    data = LOWER[data]
    inside = ~BETWEEN[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[bounds[bounds < len(data)]] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[bounds[bounds > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return (spans_hash(prefix_sums(data), starts, ends) >> np.uint64(48)).astype(np.int64), starts


def _vector(features: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their weights at unit length."""
    found, count = np.unique(features, return_counts=True)
    weight = count * idf[found]
    return found, weight / np.sqrt((weight * weight).sum())


def _segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each line and of each run of two or more lines without a blank one."""
    starts, ends = [], []
    breaks = np.flatnonzero(data == 10)
    line0 = np.sort(np.concatenate((bounds[:-1], breaks + 1)))
    line1 = np.sort(np.concatenate((breaks, bounds[1:])))
    seen = np.concatenate(([0], np.cumsum((data != 32) & ((data < 9) | (data > 13)), dtype=np.int64)))
    full = seen[line1] > seen[line0]
    row = np.searchsorted(bounds, line0, "right") - 1
    starts.append(line0[full])
    ends.append(line1[full])
    joined = np.zeros(len(full), dtype=bool)
    joined[1:] = full[1:] & full[:-1] & (row[1:] == row[:-1])
    head = np.flatnonzero(full & ~joined)
    if len(head):
        # The run of a head goes on to the next line that is not joined.
        alone = np.flatnonzero(~joined)
        last = np.append(alone, len(full))[np.searchsorted(alone, head, "right")] - 1
        many = last > head
        starts.append(line0[head[many]])
        ends.append(line1[last[many]])
    return np.concatenate(starts), np.concatenate(ends)


def _windows(features: np.ndarray, row: np.ndarray, edges: np.ndarray, own: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) words of the windows of ``length`` that begin or end with a word marked in
    ``own``, cut at the edges of their row."""
    at = np.flatnonzero(own)
    first = np.unique(np.concatenate((at, np.maximum(at - length + 1, edges[row[at]]))))
    return first, np.minimum(first + length, edges[row[first] + 1])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each feature, and all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIM + 1, dtype=np.int64), 0
        for batch in slices(batches, "text"):
            data, bounds = raw(batch.column("text"))
            features, starts = _words(data, bounds)
            row = np.searchsorted(bounds, starts, "right") - 1
            seen[:DIM] += np.bincount(np.unique(row * DIM + features) % DIM, minlength=DIM)
            n += batch.num_rows
        seen[DIM] = n
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["feature", "n"])

    seen = np.zeros(DIM + 1, dtype=np.int64)
    # One number for each feature, however many documents.
    for feature, n in texts.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect():
        seen[feature] = n
    return seen[:DIM], int(seen[DIM])


def own_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """(id, path, license, score): each row's own license and cosine, null where none is near enough.

    Without ``windows`` only whole lines and runs of lines are scored."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    seen, total = document_frequencies(texts.select("text"))
    idf = np.log((1 + total) / (1 + seen)) + 1
    names = [n for n, _ in TEMPLATES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = np.zeros((DIM, len(TEMPLATES)))
        lengths = []
        for k, (_, text) in enumerate(TEMPLATES):
            own = _words(*raw(pa.array([text])))[0]
            found, weight = _vector(own, idf)
            forms[found, k] = weight
            lengths.append(len(own))
        known = forms.any(axis=1)
        for batch in slices(batches, "text"):
            data, bounds = raw(batch.column("text"))
            features, starts = _words(data, bounds)
            a, b = _segments(data, bounds)
            first, last = np.searchsorted(starts, a), np.searchsorted(starts, b)
            # A cosine is at most the product with a template over the root of the squared weights
            # of all words, counted singly; segments under the threshold by that are done with.
            square = np.concatenate(([0.0], np.cumsum(idf[features] ** 2)))
            at = np.flatnonzero(known[features])
            part = np.concatenate((np.zeros((1, len(names))), np.cumsum(forms[features[at]] * idf[features[at], None], axis=0)))
            f, l = np.searchsorted(at, first), np.searchsorted(at, last)
            bound = (part[l] - part[f]).max(axis=1)
            near = np.flatnonzero((last > first) & (bound >= threshold * np.sqrt(square[last] - square[first]) - 1e-6))
            best: dict[int, tuple[bool, float, int, int, int]] = {}
            rows = np.searchsorted(bounds, a[near], "right") - 1
            for s, row in zip(near.tolist(), rows.tolist()):
                found, weight = _vector(features[first[s] : last[s]], idf)
                score = weight @ forms[found]
                k = int(score.argmax())
                if score[k] >= threshold:
                    best[row] = max(best.get(row, (False, 0.0, 0, 0, 0)), (names[k] != OWNED, round(float(score[k]), 9), -k, -int(first[s]), int(last[s])))
            if windows:
                row = np.searchsorted(bounds, starts, "right") - 1
                edges = np.searchsorted(starts, bounds)
                for k, length in enumerate(lengths):
                    first, last = _windows(features, row, edges, forms[features, k] > 0, length)
                    f, l = np.searchsorted(at, first), np.searchsorted(at, last)
                    bound = (part[l, k] - part[f, k]) / np.sqrt(np.maximum(square[last] - square[first], 1e-12))
                    near = np.flatnonzero(bound >= threshold - 1e-6)
                    # The most promising windows of a row first: the others can't be nearer.
                    for w in near[np.argsort(-bound[near], kind="stable")].tolist():
                        r, a, b = int(row[first[w]]), int(first[w]), int(last[w])
                        held = best.get(r, (False, 0.0, 0, 0, 0))
                        if (names[k] != OWNED, bound[w] + 1e-6) < held[:2]:
                            continue
                        found, weight = _vector(features[a:b], idf)
                        score = round(float(weight @ forms[found, k]), 9)
                        if score >= threshold:
                            best[r] = max(held, (names[k] != OWNED, score, -k, -a, b))
            stated: list[str | None] = [None] * batch.num_rows
            scores: list[float | None] = [None] * batch.num_rows
            for r, (_, score, k, a, b) in best.items():
                begin, end = starts[-a], starts[b] if b < len(starts) and starts[b] < bounds[r + 1] else bounds[r + 1]
                text = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in ((begin, end), (end, bounds[r + 1]))]
                stated[r], scores[r] = variant(names[-k], *text), score
            if windows:
                for r, text in enumerate(batch.column("text").to_pylist()):
                    if tag := tagged(text):
                        stated[r], scores[r] = tag, 1.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("path"), pa.array(stated, pa.string()), pa.array(scores, pa.float64())], ["id", "path", "license", "score"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, path string, license string, score double")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, path, own_license, score, license, license_dir): what holds for each row, and the
    directory that it is inherited from, null if the license is its own or there is none."""
    files = own_licenses(docs, id_col, text_col, path_col, threshold, windows=True)
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/+", "/")
    files = stored(files.withColumn("dir", F.when(F.col("path").isNotNull(), folder)), "files")
    stated = files.where(F.col("license").isNotNull() & F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE))
    stated = stated.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    stated = stored(stated.select(F.col("dir").alias("above"), F.col("best.license").alias("passed")), "stated")
    # Directories are far fewer than files, and each has as many ancestors as it has levels.
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("above")))
    dirs = files.where("dir is not null").select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above")
    found = dirs.join(stated, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "passed")).alias("near"))
    found = found.select("dir", F.col("near.above").alias("above"), F.col("near.passed").alias("passed"))
    out = files.join(found, "dir", "left")
    own = F.col("license").isNotNull()
    return out.select(F.col("id").alias(id_col), "path", F.col("license").alias("own_license"), "score", F.coalesce("license", "passed").alias("license"), F.when(~own, F.col("above")).alias("license_dir"))
