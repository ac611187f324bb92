"""Phrase collocations: words that stand together more often than their parts explain.

Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words ``[^\\x20\\x09]+``, A-Z in lower
case. Everything is counted within a language. Three passes over the texts' words:

1. Words are counted by a 64-bit hash, and the words under each hash are compared: should two share
   one, all is counted anew under another seed. From then on the hash stands for the word.
2. The words that are frequent enough to be in a phrase get numbers. Two or three numbers are packed
   into one key and counted in counting quotient filters (``quotient``), cut by ranges of the permuted
   key. Each task writes one filter a range; all filters of a range merge into one. The permutation
   spreads keys evenly and a task counts before it writes, so a phrase that fills a third of the
   corpus is one entry of each shard.
3. Phrases with enough occurrences are scored by joins with the counts of their parts.

The dictionary of numbered words is sent to every task; it holds at most ``limit`` words (16 MB for the
largest), the most frequent. Should there be more frequent words, the phrases that hold one of those
are counted by a plain aggregation instead; the result is the same.

Null text is empty; null language is ``und``. Repeated rows count again. Ties in score go to the
larger count, then to the phrase in byte order. No rows, or no phrase that is frequent enough, give
no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import quotient
from .common import slices, stored
from .hashing import LOWER, U, mix, prefix_sums, raw, spans_hash

#: Words with a number; three numbers fill 63 bits.
VOCABULARY = (1 << 21) - 1
#: Phrase occurrences that a range of keys holds on average.
RANGE_ROWS = 1_000_000
#: Phrase occurrences that a task gathers before it writes its filters.
GATHERED = 1_500_000
#: Words that a task gathers before it writes its counts.
GATHERED_WORDS = 500_000

#: Bytes that end a piece and bytes that end a word.
PIECE_END = np.zeros(256, dtype=bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD_END = PIECE_END.copy()
WORD_END[[0x20, 0x09]] = True


def _edges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~WORD_END[data]
    steps = np.diff(word)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    # A row ends its last word where the next row goes on without a break.
    inner = np.unique(bounds[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = inner[(word[inner] == 1) & (word[inner + 1] == 1)]
    return np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))


def _words(texts: pa.Array, langs: pa.Array, seed: int):
    """Hash of each word under its language, piece number of each, the spans, their row, and the lower-cased bytes."""
    data, bounds = raw(texts)
    data = LOWER[data]
    starts, ends = _edges(data, bounds)
    row = np.searchsorted(bounds, starts, "right") - 1
    breaks = np.cumsum(PIECE_END[data])
    piece = breaks[starts] + row if len(starts) else starts  # grows at every separator and every row
    codes = pc.dictionary_encode(pc.fill_null(langs, "und"))
    marks = np.array([int.from_bytes(hashlib.blake2b(f"{seed} {x}".encode(), digest_size=8).digest(), "little") for x in codes.dictionary.to_pylist()], dtype=U)
    own = marks[np.asarray(codes.indices)[row]] if len(row) else np.zeros(0, U)
    return mix(spans_hash(prefix_sums(data), starts, ends) + own), piece, starts, ends, row, data


def _texts_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as strings."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def _whole(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> DataFrame:
    """(h, lang, word, n): occurrences of each word of each language under its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def joined() -> pa.Table:
            rows = pa.concat_tables(held).combine_chunks()
            h = rows.column("h").to_numpy()
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            n = np.add.reduceat(rows.column("n").to_numpy()[order], first)
            return rows.take(pa.array(order[first])).set_column(3, "n", pa.array(n))

        for batch in slices(batches, "text"):
            h, _, starts, ends, row, data = _words(batch.column("text"), batch.column("lang"), seed)
            if not len(h):
                continue
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            langs = batch.column("lang").take(pa.array(row[first]))
            held.append(pa.table({"h": h.view(np.int64), "lang": langs, "word": _texts_at(data, starts[first], ends[first]), "n": n}))
            size += len(h)
            if size > GATHERED_WORDS:
                held = [joined()]
                size = held[0].num_rows
                if 2 * size > GATHERED_WORDS:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from joined().to_batches()

    found = _whole(docs, text_col, lang_col).mapInArrow(run, "h long, lang string, word string, n long")
    return found.groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def exact_word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, int]:
    """Stored word counts under hashes that no two words share, and the seed of those."""
    for seed in count():
        words = stored(word_counts(docs, text_col, lang_col, seed), "words")
        if words.groupBy("h").count().where("count > 1").isEmpty():
            return words, seed
    raise AssertionError


def _runs(piece: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Where ``size`` words of one piece, all with a number, stand in a row."""
    last = len(ids) - size + 1
    if last <= 0:
        return np.zeros(0, np.int64)
    ok = piece[:last] == piece[size - 1 :]
    for k in range(size):
        ok &= ids[k : last + k] > 0
    return np.flatnonzero(ok)


def phrase_filters(docs: DataFrame, names: np.ndarray, bits: int, ranges: int, seed: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(size, range, filter): one merged filter for each size and range of keys.

    names: the hashes of the numbered words, ascending; number i is ``names[i - 1]``. A key packs the
    numbers of a phrase, ``bits`` bits each; its permuted first ``ranges`` bits choose the range.
    """
    sent = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        held: dict[int, list[np.ndarray]] = {2: [], 3: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for width, keys in held.items():
                if not keys:
                    continue
                found, n = quotient.counted(quotient.permute(np.concatenate(keys), width * bits))
                keys.clear()
                left = width * bits - ranges
                of = (found >> U(left)).astype(np.int64) if ranges else np.zeros(len(found), np.int64)
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                rest = found & U((1 << left) - 1)
                parts = [quotient.encode(rest[a:b], n[a:b], left) for a, b in zip(cuts, np.append(cuts[1:], len(of)))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), width, np.int32)), pa.array(of[cuts].astype(np.int32)), pa.array(parts, pa.binary())], ["size", "range", "filter"])

        for batch in slices(batches, "text"):
            h, piece, *_ = _words(batch.column("text"), batch.column("lang"), seed)
            h = h.view(np.int64)
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            ids = np.where(names[at] == h, at + 1, 0).astype(U)
            for width, keys in held.items():
                where = _runs(piece, ids, width)
                key = ids[where]
                for k in range(1, width):
                    key = key << U(bits) | ids[where + k]
                keys.append(key)
                size += len(key)
            if size > GATHERED:
                yield from flush()
                size = 0
        yield from flush()

    def merged(key, rows):
        keys, n = quotient.merge(rows.column("filter").to_pylist())
        filter_ = quotient.encode(keys, n, key[0].as_py() * bits - ranges)
        return pa.table({"size": pa.array([key[0].as_py()], pa.int32()), "range": pa.array([key[1].as_py()], pa.int32()), "filter": pa.array([filter_], pa.binary())})

    schema = "size int, range int, filter binary"
    return _whole(docs, text_col, lang_col).mapInArrow(run, schema).groupBy("size", "range").applyInArrow(merged, schema)


def frequent(filters: DataFrame, names: np.ndarray, bits: int, ranges: int, least: int) -> DataFrame:
    """(size, h1, h2, h3, a): the phrases of the filters with ``least`` occurrences or more; no third word is null."""
    sent = filters.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        mask = U((1 << bits) - 1)
        for batch in batches:
            for size, range_, filter_ in zip(*(batch.column(c).to_pylist() for c in ("size", "range", "filter"))):
                keys, n = quotient.decode(filter_)
                keys, n = keys[n >= least], n[n >= least]
                keys = quotient.restore(keys | U(range_ << (size * bits - ranges)), size * bits)
                h = [pa.array(names[((keys >> U((size - 1 - k) * bits)) & mask).astype(np.int64) - 1]) for k in range(size)]
                h += [pa.nulls(len(keys), pa.int64())] * (3 - size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, np.int32)), *h, pa.array(n)], ["size", "h1", "h2", "h3", "a"])

    return filters.mapInArrow(run, "size int, h1 long, h2 long, h3 long, a long")


def _beyond(docs: DataFrame, names: np.ndarray, seed: int, least: int, text_col: str, lang_col: str) -> DataFrame:
    """The same of phrases that hold a word without a number."""
    sent = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        for batch in slices(batches, "text"):
            h, piece, *_ = _words(batch.column("text"), batch.column("lang"), seed)
            h = h.view(np.int64)
            known = names[np.minimum(np.searchsorted(names, h), len(names) - 1)] == h
            for size in (2, 3):
                where = _runs(piece, np.ones(len(h), U), size)
                where = where[~np.all([known[where + k] for k in range(size)], axis=0)]
                words = [pa.array(h[where + k]) for k in range(size)] + [pa.nulls(len(where), pa.int64())] * (3 - size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), size, np.int32)), *words], ["size", "h1", "h2", "h3"])

    found = _whole(docs, text_col, lang_col).mapInArrow(run, "size int, h1 long, h2 long, h3 long")
    return found.groupBy("size", "h1", "h2", "h3").agg(F.count("*").alias("a")).where(F.col("a") >= least)


def scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """grams with lang, l, r and score of the cut that scores lowest (of equals, the first)."""
    unit = words.select("h", F.col("n").alias("f"))
    pairs = grams.where("size = 2").select("h1", "h2", F.col("a").alias("f"))
    head = grams.join(words.select(F.col("h").alias("h1"), "lang", F.col("n").alias("f1")), "h1")
    two = head.where("size = 2").join(unit.select(F.col("h").alias("h2"), F.col("f").alias("f2")), "h2")
    two = two.select("size", "lang", "h1", "h2", "h3", "a", F.struct(F.col("f1").alias("l"), F.col("f2").alias("r")).alias("x"), F.lit(None).cast("struct<l: bigint, r: bigint>").alias("y"))
    three = head.where("size = 3").join(unit.select(F.col("h").alias("h3"), F.col("f").alias("f3")), "h3")
    three = three.join(pairs.select("h1", "h2", F.col("f").alias("f12")), ["h1", "h2"]).join(pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("f").alias("f23")), ["h2", "h3"])
    three = three.select("size", "lang", "h1", "h2", "h3", "a", F.struct(F.col("f1").alias("l"), F.col("f23").alias("r")).alias("x"), F.struct(F.col("f12").alias("l"), F.col("f3").alias("r")).alias("y"))
    # Whole numbers throughout: the quotient of decimals without a fraction.
    wide = "cast({} as decimal(19, 0))"
    of = lambda cut: F.expr(f"(cast(1000000 as decimal(7, 0)) * {wide.format('a')} * {wide.format('a')}) div ({wide.format(cut + '.l')} * {wide.format(cut + '.r')})")
    both = two.unionByName(three).withColumn("sx", of("x")).withColumn("sy", of("y"))
    first = F.col("y").isNull() | (F.col("sx") <= F.col("sy"))
    cut = F.when(first, F.col("x")).otherwise(F.col("y"))
    return both.select("size", "lang", "h1", "h2", "h3", "a", cut["l"].alias("l"), cut["r"].alias("r"), F.when(first, F.col("sx")).otherwise(F.col("sy")).cast("long").alias("score"))


def not_within(rows: DataFrame, grams: DataFrame, share: int) -> DataFrame:
    """rows but for those of which ``share`` percent or more stand in one longer phrase of ``grams``."""
    longer = grams.where("size = 3")
    inner = longer.select("h1", "h2", "a").union(longer.select("h2", "h3", "a")).groupBy("h1", "h2").agg(F.max("a").alias("most"))
    two = rows.where("size = 2").join(inner, ["h1", "h2"], "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True)))
    return two.select(*rows.columns).union(rows.where("size = 3"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, share: int = 50, top: int = 2000, limit: int = VOCABULARY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words.

    a: occurrences of the phrase, at least ``least``; l and r those of the parts of the cut that scores
    lowest; n: words of the language; score: ``1000000 * a * a / (l * r)``, rounded down. Phrases
    of which ``share`` percent or more stand in one longer phrase are left out.
    """
    words, seed = exact_word_counts(docs, text_col, lang_col)
    known = stored(words.where(F.col("n") >= least), "known")
    many = known.count()
    chosen = known if many <= limit else known.orderBy(F.desc("n"), "h").limit(limit)
    names = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.asarray(c) for c in chosen.select("h").toArrow().column("h").chunks)]))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(1, len(names).bit_length())
    ranges = min(16, 2 * bits, max(0, int(total // RANGE_ROWS).bit_length()))
    if len(names):
        grams = frequent(phrase_filters(docs, names, bits, ranges, seed, text_col, lang_col), names, bits, ranges, least)
    else:
        grams = docs.sparkSession.createDataFrame([], "size int, h1 long, h2 long, h3 long, a long")
    if many > limit:
        grams = grams.union(_beyond(docs, names, seed, least, text_col, lang_col))
    grams = stored(grams, "phrases")
    rows = stored(not_within(scored(grams, known), grams, share), "scores")
    # Strings are fetched for the first of each language only, ties included.
    best = rows.withColumn("_at", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_at") <= top)
    for k in ("1", "2", "3"):
        best = best.join(known.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}")), f"h{k}", "left")
    named = best.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    sums = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
