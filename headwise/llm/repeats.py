"""Long repeated strings, found by prefix doubling over anchors, and texts without them.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table.
Sorting a suffix of every byte would cost many times the input, so only anchors are sorted: of each
``WINDOW`` neighbouring ``GRAM``-byte strings of a text the one with the least hash, the first of equals.
Which one that is depends on these bytes alone, so wherever a long string stands, its anchors stand at
the same places in it. Every start of a long string belongs to the anchor of its own window, and at
least ``length + 1 - WINDOW`` bytes from that anchor on (the reach) are part of the long string.

1. **Ranks.** An anchor's first rank is that of the string up to the next anchor. Then the ranks of
   anchor ``i`` and of anchor ``i + 1, i + 2, i + 4 ...`` of the same text make pairs; Spark counts and sorts the
   distinct pairs, and their place is the next rank. An anchor whose rank stands once, in the whole
   table, is out; one whose next pair would pass the reach is ranked once more with what is left of the
   bytes that all long strings at its starts have in common (the core).
2. **Blocks.** The starts that belong to an anchor, with ``length`` bytes from the last one, make a block.
   Blocks of the same rank and content are repeated as a whole.
3. **Rims.** Where blocks of one rank differ, the long strings at each of their starts are hashed and
   counted one by one; of equal blocks one stands for all.

Every step counts before it shuffles and joins on counted keys; no group is gathered, no pair of members
is formed, so a passage in a third of all texts costs its bytes. Texts that are equal as a whole are
repeated as a whole; one of each group takes part for the others' sake. Hashes only sort out: two blocks
are held equal if their ranks, their places and a 64-bit hash of their bytes agree.

Null or empty text: nothing to remove, no bytes left. Texts shorter than ``length`` stay as they are. Rows
that repeat an id are each returned with their own text; a null id stays null. No rows give no
rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored
from .hashing import INVERSE, U, mix, powers, prefix_sums, raw, spans_hash

LENGTH = 400
#: At most 128: places of starts relative to their anchor are kept in seven bits.
WINDOW, GRAM = 128, 12
#: Phrases counted for an anchor; those beyond only save ranks.
MOST_PARTS = 127

DOC = ["hi", "lo"]
#: where: place, places from the first start to the anchor (7 bits), number of starts (8), parts (7).
ANCHORS = "doc long, hi long, lo long, idx int, where long, phrase long, core int, block long"


def _part(shift: int, bits: int) -> Column:
    return F.shiftright("where", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


#: Of ``where``: shift and bits.
AHEAD, STARTS, PARTS = (15, 7), (7, 8), (0, 7)


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    n = len(values)
    if n < size:
        return values[:0]
    whole = np.full(-(-n // size) * size, np.iinfo(U).max, dtype=U)
    whole[:n] = values
    grid = whole.reshape(-1, size)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def anchors_of(data: np.ndarray, bounds: np.ndarray, length: int):
    """(row, idx, place, s, e, parts, phrase, core, block) of the anchors of all rows of a column.

    place: byte of the anchor in its row; s to e: the starts that belong to it (e < s: none); parts:
    how many phrases (strings from one anchor to the next) the reach determines; phrase: hash of the
    first (0: none); core and block: hashes of the bytes in all of its long strings, as far as the reach
    goes, and of the bytes in any of them.
    """
    n = len(data)
    sums = prefix_sums(data)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(INVERSE, n + 1)[: max(0, n + 1 - GRAM)]) if n >= GRAM else np.zeros(0, U)
    least = _sliding_min(grams >> U(32) << U(32) | np.arange(len(grams), dtype=U), WINDOW)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(row[: len(least)] == row[WINDOW + GRAM - 2 : WINDOW + GRAM - 2 + len(least)])
    chosen = (least[at] & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    place, s, own = chosen[first], at[first], row[chosen[first]]
    last_window = at[np.append(first[1:], len(at)) - 1] if len(first) else first
    e = np.minimum(last_window, bounds[own + 1] - length)
    follows = np.append(own[1:] == own[:-1], False) if len(own) else np.zeros(0, bool)
    phrase = np.zeros(len(own), dtype=U)
    i = np.flatnonzero(follows)
    phrase[i] = spans_hash(sums, place[i], place[i + 1] + GRAM) | U(1)
    # The next anchor is determined by the WINDOW + GRAM bytes from an anchor on.
    reach = length + 1 - WINDOW
    last = np.searchsorted(place, place + reach - WINDOW - GRAM, "right") - 1
    head = np.searchsorted(own, np.arange(len(bounds) - 1))
    tail = np.searchsorted(own, np.arange(len(bounds) - 1), "right") - 1
    # Anchor ``last`` is determined from here; so is the string up to it, and one phrase in any case.
    parts = np.maximum(1, np.minimum(last, tail[own]) - np.arange(len(own)))
    core, block = np.zeros(len(own), dtype=U), np.zeros(len(own), dtype=U)
    i = np.flatnonzero(e >= s)
    # The last window is determined by what follows, the end of the row is not: the core begins there.
    core[i] = spans_hash(sums, last_window[i], place[i] + reach)
    block[i] = spans_hash(sums, s[i], e[i] + length)
    base = bounds[own]
    return own, np.arange(len(own)) - head[own], place - base, s - base, e - base, parts, phrase, core, block


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, bounds = raw(batch.column("text"))
            row, idx, place, s, e, parts, phrase, core, block = anchors_of(data, bounds, length)
            starts = np.maximum(e - s + 1, 0)
            where = place << 22 | np.where(starts > 0, place - s, 0) << 15 | starts << 7 | np.minimum(parts, MOST_PARTS)
            keys = [batch.column(c).take(pa.array(row)) for c in ("doc", *DOC)]
            core = pa.array((core >> U(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(idx.astype(np.int32)), pa.array(where), pa.array(phrase.view(np.int64)), core, pa.array(block.view(np.int64))],
                ["doc", "hi", "lo", "idx", "where", "phrase", "core", "block"],
            )

    return texts.select(F.monotonically_increasing_id().alias("doc"), *DOC, "text").mapInArrow(run, ANCHORS)


def _ranked(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Stored: the rows whose key stands more than once, with ``rank``, the place of the key among those in order."""
    repeated = rows.groupBy(*keys).count().where("count > 1").select(*keys)
    places = stored(repeated.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    out = stored(rows.join(places, keys).drop(*keys), label)
    discard(places)
    return out


def repeated_anchors(anchors: DataFrame) -> DataFrame:
    """Stored (doc, where, block, rank): anchors with starts, by equal strings within the reach.

    anchors: stored (doc, idx, where, phrase, core, block). Prefix doubling: ``rank`` orders the strings of ``step``
    phrases. Anchors that are alone are left out as soon as that shows.
    """
    keep = anchors.select("doc", "idx", "where", "phrase", "core", "block").where("phrase <> 0")
    rows = _ranked(keep, ["phrase"], "step1")
    step, done, used = 1, [], []
    while True:
        far = _part(*PARTS) >= 2 * step
        done.append(rows.where(~far & (_part(*STARTS) > 0)).select("doc", "where", "core", "block", F.lit(step).alias("step"), F.col("rank").alias("level")))
        used.append(rows)
        going = rows.where(far)
        if 2 * step > MOST_PARTS or going.isEmpty():
            break
        ahead = rows.select("doc", (F.col("idx") - step).alias("idx"), F.col("rank").alias("after"))
        # Where the later part is alone, so is the whole. A later anchor sees further than an earlier
        # one, so the one looked up has come as far.
        pairs = stored(going.withColumnRenamed("rank", "before").join(ahead, ["doc", "idx"]), "pairs")
        rows = _ranked(pairs, ["before", "after"], f"step{2 * step}")
        discard(pairs)
        step *= 2
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    out = _ranked(out, ["step", "level", "core"], "repeated")
    discard(*used)
    return out


def _starts(blocks: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(rank, h, ref): each start of the blocks with the hash of its long string and its distance from the anchor.

    ref: of an open block its id and the start's number in it, ``id * 128 + number``; else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, bounds = raw(batch.column("text"))
            sums = prefix_sums(data)
            rows = batch.column("rows")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(rows.offsets))
            flat = rows.flatten()
            id_, rank, where = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            open_ = flat.field(3).to_numpy(zero_copy_only=False)
            ahead, size = where >> 15 & 127, where >> 7 & 255
            of = np.repeat(np.arange(len(size)), size)
            number = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            for a in range(0, len(of), 1 << 18):
                part, n = of[a : a + (1 << 18)], number[a : a + (1 << 18)]
                begin = (where[part] >> 22) - ahead[part] + n + bounds[owner[part]]
                h = mix(spans_hash(sums, begin, begin + length) + (ahead[part] - n).astype(U))
                ref = pa.array(id_[part] * 128 + n, mask=~open_[part])
                yield pa.RecordBatch.from_arrays([pa.array(rank[part]), pa.array(h.view(np.int64)), ref], ["rank", "h", "ref"])

    lists = blocks.groupBy(*DOC).agg(F.collect_list(F.struct("id", "rank", "where", "open")).alias("rows"))
    return texts.select(*DOC, "text").join(lists, DOC).mapInArrow(run, "rank long, h long, ref long")


def _repeated_starts(texts: DataFrame, length: int) -> DataFrame:
    """Stored (hi, lo, runs): runs of starts of repeated long strings, an array of (s, e), a row a text."""
    anchors = stored(_anchors(texts, length), "anchors")
    heads = stored(anchors.where("idx = 0").select("doc", *DOC), "heads")
    repeated = repeated_anchors(anchors)
    discard(anchors)
    kind = ["rank", "ahead", "block"]
    rows = repeated.withColumn("ahead", _part(*AHEAD))
    blocks = stored(rows.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("doc", "where")).alias("one")), "blocks")
    first = F.shiftright("where", 22) - _part(*AHEAD)
    run = F.struct(first.cast("int").alias("s"), (first + _part(*STARTS) - 1).cast("int").alias("e"))
    whole = rows.join(blocks.where("n > 1").select(*kind), kind).select("doc", F.array(run).alias("runs"))
    # Blocks of a rank that has other blocks beside them.
    mixed = blocks.groupBy("rank").count().where("count > 1").select("rank")
    rims = blocks.join(mixed, "rank").select(F.monotonically_increasing_id().alias("id"), "rank", "one.*", (F.col("n") == 1).alias("open"))
    rims = stored(rims, "rims")
    starts = stored(_starts(rims.join(heads, "doc"), texts, length), "starts")
    again = starts.groupBy("rank", "h").count().where("count > 1").select("rank", "h")
    found = starts.where("ref is not null").join(again, ["rank", "h"])
    found = found.groupBy(F.shiftright("ref", 7).alias("id")).agg(F.collect_list((F.col("ref") % 128).cast("int")).alias("numbers"))
    single = found.join(rims.select("id", "doc", first.cast("int").alias("first")), "id")
    one = lambda n: F.struct((F.col("first") + n).alias("s"), (F.col("first") + n).alias("e"))
    every = whole.union(single.select("doc", F.transform("numbers", one).alias("runs")))
    out = stored(every.groupBy("doc").agg(F.flatten(F.collect_list("runs")).alias("runs")).join(heads, "doc").select(*DOC, "runs"), "runs")
    discard(repeated, blocks, rims, starts)
    return out


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("hi"), F.xxhash64(F.lit(7), text).alias("lo")]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id_col, n_bytes, spans, kept), one row for each row of ``docs``.

    spans: the removed runs of bytes (start, end: first byte and first byte after), as long as they
    go, in order; kept: the other bytes. ``length`` must be at least ``2 * WINDOW + GRAM - 1``.
    """
    if length < 2 * WINDOW + GRAM - 1:
        raise ValueError("length is too short for the window")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", *_hashes(F.col("text")))
    long = rows.where(F.octet_length("text") >= length)
    twins = long.groupBy(*DOC).agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    twins = stored(twins.select(*DOC, "first"), "twins").withColumn("twin", F.lit(True))
    # Of equal texts one is read; a row that is there several times over is left once.
    own = long.join(twins.select(*DOC), DOC, "left_anti").select(*DOC, "text")
    shared = long.join(twins, DOC).where(F.col("id").eqNullSafe(F.col("first"))).dropDuplicates(DOC).select(*DOC, "text")
    found = _repeated_starts(own.union(shared), length)
    state = found.join(twins.select(*DOC, "twin"), DOC, "full_outer").select(*DOC, "runs", F.coalesce("twin", F.lit(False)).alias("twin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, bounds = raw(batch.column("text"))
            size = np.diff(bounds)
            runs, twin = batch.column("runs"), batch.column("twin").to_numpy(zero_copy_only=False)
            flat, offsets = runs.flatten(), np.concatenate(([0], np.cumsum(runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            steps = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(steps, flat.field(0).to_numpy(zero_copy_only=False) + bounds[owner], 1)
            np.add.at(steps, flat.field(1).to_numpy(zero_copy_only=False) + bounds[owner] + length, -1)
            whole = np.flatnonzero(twin == True)  # noqa: E712
            np.add.at(steps, bounds[whole], 1)
            np.add.at(steps, bounds[whole + 1], -1)
            gone = np.cumsum(steps[:-1]) > 0
            row = np.repeat(np.arange(len(size)), size)
            cut = np.ones(len(data) + 1, dtype=bool)  # before a byte: another row, or another kind of byte
            cut[1:-1] = (row[1:] != row[:-1]) | (gone[1:] != gone[:-1])
            begins, ends = np.flatnonzero(cut[:-1] & gone), np.flatnonzero(cut[1:] & gone) + 1
            of = row[begins]
            spans = pa.StructArray.from_arrays([pa.array(x - bounds[of]) for x in (begins, ends)], ["start", "end"])
            cuts = pa.array(np.searchsorted(of, np.arange(len(size) + 1)).astype(np.int32))
            left = np.concatenate(([0], np.cumsum(~gone)))[bounds].astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(left), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), pa.ListArray.from_arrays(cuts, spans), kept], ["id", "n_bytes", "spans", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.join(stored(state, "state"), DOC, "left").select("id", "text", "runs", "twin")
    return out.mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary").withColumnRenamed("id", id_col)
