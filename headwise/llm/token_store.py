"""Token ids in a binary format with random access: directly addressable codes.

An id is split into chunks of ``CHUNK`` bits, lowest first. Level 0 holds the first chunk of every
token, level k the (k + 1)th chunk of those that have one, in token order; each level has a
continuation bitmap that marks the tokens which go on, and a directory with the number of marks
before every ``RANK`` bits. Token i of level k is token ``rank_k(i)`` of level k + 1, so a token is
read from a few bytes, whatever its place, without decoding a block.

A segment is one such file for a run of documents in ascending order of their id; its layout, all
little-endian:

    magic "HWDAC1\\0\\0", n_docs u32, n_levels u32
    for each level: n u64, then its n chunks u8, bitmap ceil(n / 8) bytes, directory (n // RANK + 1) u32
    n_docs ids i64, n_docs flags u8 (1: the id is null), n_docs + 1 token offsets u64

Segments are rows of a Parquet table (first id, number, payload), so Spark's commit protocol covers
them and they may lie in any store that Spark writes to. Documents with null text hold the end id
alone. A null id sorts first. Rows that repeat an id stand next to each other, in any order. An
empty table gives no segments. Other columns play no part.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, stored

MAGIC = b"HWDAC1\0\0"
CHUNK = 8
RANK = 512
#: Tokens in a segment, but for its last document.
SEGMENT = 1 << 22
#: Words whose ids a worker keeps; then those not met among the last as many go.
KEEP_WORDS = 800_000


def packed(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """One segment of (id, token ids)."""
    rest = np.concatenate([x[1] for x in docs]).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    levels = []
    while len(rest) or not levels:
        more = rest >> CHUNK > 0
        marks = np.concatenate(([0], np.cumsum(more, dtype=np.uint32)))[: len(rest) + 1 : RANK].astype("<u4")
        levels.append(np.uint64(len(rest)).tobytes() + (rest & ((1 << CHUNK) - 1)).astype(np.uint8).tobytes() + np.packbits(more, bitorder="little").tobytes() + marks.tobytes())
        rest = rest[more] >> CHUNK
    ids = np.array([x[0] or 0 for x in docs], dtype="<i8").tobytes() + np.array([x[0] is None for x in docs], dtype=np.uint8).tobytes()
    ends = np.concatenate(([0], np.cumsum([len(x[1]) for x in docs]))).astype("<u8").tobytes()
    return MAGIC + np.array([len(docs), len(levels)], dtype="<u4").tobytes() + b"".join(levels) + ids + ends


class Segment:
    """A view of a segment's bytes; nothing is decoded until asked for."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a token segment")
        self.n_docs, n_levels = (int(x) for x in np.frombuffer(payload, "<u4", 2, 8))
        at = 16
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(payload, "<u8", 1, at)[0])
            at += 8
            chunks = np.frombuffer(payload, np.uint8, n, at)
            bits = np.frombuffer(payload, np.uint8, -(-n // 8), at + n)
            marks = np.frombuffer(payload, "<u4", n // RANK + 1, at + n + len(bits))
            self.levels.append((chunks, bits, marks))
            at += n + len(bits) + 4 * len(marks)
        self.ids = np.frombuffer(payload, "<i8", self.n_docs, at)
        self.null = np.frombuffer(payload, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.ends = np.frombuffer(payload, "<u8", self.n_docs + 1, at + 9 * self.n_docs)

    def token(self, i: int) -> int:
        """The id of token i, by a walk down the levels."""
        out, shift = 0, 0
        for chunks, bits, marks in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK
            before = bits[block * RANK // 8 : i >> 3]
            i = int(marks[block]) + int(np.bitwise_count(before).sum()) + int(np.bitwise_count(bits[i >> 3] & ((1 << (i & 7)) - 1)))
            shift += CHUNK
        return out

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids of a run of tokens; only their chunks are touched."""
        out = np.zeros(stop - start, dtype=np.uint32)
        where = np.arange(stop - start)
        for level, (chunks, bits, marks) in enumerate(self.levels):
            if start >= stop:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(level * CHUNK)
            block = start // RANK
            flags = np.unpackbits(bits[block * RANK // 8 : -(-stop // 8)], bitorder="little").view(bool)
            skip = start - block * RANK
            own = flags[skip : skip + stop - start]
            where = where[own]
            start = int(marks[block]) + int(np.count_nonzero(flags[:skip]))
            stop = start + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ends[k]), int(self.ends[k + 1]))


class Encoder:
    """A byte-level tokenizer with the ids of words it has met.

    The tokenizer never joins a space that a letter or other visible character follows to what
    stands before it, so a text is encoded piece by piece between such spaces. The ids are those that the
    tokenizer gives to the whole text, with added tokens (``<|endoftext|>``) as it reads them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # One thread in each worker: Spark's tasks already fill the cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # A text that holds an added token's string may hold that token: it is encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # Words joined by their spaces can't make up one without a space.
        self.apart = not any(c.isspace() for t in self.added for c in t)
        # Every byte of a text is one character of its tokens' names.
        names = self.tokenizer.get_vocab()
        self.size = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, i in names.items():
            self.size[i] = len(name)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; those that begin with a space and a letter go in as one long text.

        Byte-level tokens spell their text out, so their lengths tell where each part ends."""
        joint = [t for t in texts if t[0] == " " and t[1:2].isalpha()] if self.apart else []
        out = {}
        for at in range(0, len(joint), 2000):
            part = joint[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(t.encode()) for t in part])) + 1
            cuts = [0, *ends.tolist()]
            out.update((t, ids[a:b].tobytes()) for t, a, b in zip(part, cuts, cuts[1:]))
        rest = [t for t in texts if t not in out]
        out.update((t, np.array(e.ids, dtype="<u4").tobytes()) for t, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))
        return [out[t] for t in texts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.known) > KEEP_WORDS:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        heads, parts = [], []
        whole = {t for t in texts if t and any(a in t for a in self.added)}
        ids_whole = {t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in whole}
        for text in texts:
            head, *rest = _pieces(text) if text and text not in whole else ("",)
            heads.append(head)
            parts.append(rest)
        # Known words go by their name without the space in front.
        found = [list(map(known.get, own)) for own in parts]
        gaps = [[i for i, ids in enumerate(row) if ids is None] for row in found]
        new = {own[i] for own, at in zip(parts, gaps) for i in at}
        known.update({p: old[p] for p in new if p in old})
        atoms = {p: _atoms(" " + p) for p in new if p not in known}
        wanted = {a for own in atoms.values() for a in own} | {h for h in heads if h}
        ids_of = {a: known[a[1:]] for a in wanted if a[0] == " " and a[1:] in known}
        fresh = [a for a in wanted if a not in ids_of]
        ids_of.update(zip(fresh, self._plain(fresh)))
        for p, own in atoms.items():
            known[p] = ids_of[own[0]] if len(own) == 1 else b"".join([ids_of[a] for a in own])
            if len(own) > 1 and own[0][0] == " ":
                known[own[0][1:]] = ids_of[own[0]]
        for own, row, at in zip(parts, found, gaps):
            for i in at:
                row[i] = known[own[i]]
        return [ids_whole[t] if t in ids_whole else (ids_of[h] if h else b"") + b"".join(row) for t, h, row in zip(texts, heads, found)]


_blank = re.compile(r" [\s\x1c-\x1f]| $")
_cut = re.compile(r" (?=[^\s\x1c-\x1f])")


def _pieces(text: str) -> list[str]:
    """The text cut at each space that a visible character follows, without that space."""
    return _cut.split(text) if _blank.search(text) else text.split(" ")


#: ASCII marks that never join a word before them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"


def _atoms(piece: str) -> tuple[str, ...]:
    """A piece cut around a single line break, and its words from the marks after them.

    The tokenizer always cuts there. Any other piece stays whole."""
    head, line, tail = piece.partition("\n")
    if not line:
        return _word(piece)
    if not head or not tail or "\n" in tail or head[-1].isspace() or tail[0].isspace():
        return (piece,)
    return (*_word(head), line, *_word(tail))


def _word(word: str) -> tuple[str, ...]:
    stem = word.rstrip(MARKS)
    if len(stem) < len(word) and stem.lstrip(" ").isalpha():
        return stem, word[len(stem) :]
    return (word,)


_encoders: dict[str, Encoder] = {}


def write(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Write the table of segments (first_id, number, n_tokens, payload) at ``path``.

    ``tokenizer`` is a file on the workers. Documents are dealt by ranges of ids; each task sorts
    its range and writes segments as it goes, holding one at a time.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        end = np.array([end_id], dtype="<u4").tobytes()
        held: list[tuple[int | None, np.ndarray]] = []
        size = number = 0

        def segment():
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0][0]], pa.int64()), pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([packed(held)], pa.binary())], ["first_id", "number", "n_tokens", "payload"]
            )

        for batch in slices(batches, "text"):
            for key, ids in zip(batch.column("id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                ids = np.frombuffer(ids + end, dtype="<u4")
                held.append((key, ids))
                size += len(ids)
                if size >= SEGMENT:
                    yield segment()
                    held, size, number = [], 0, number + 1
        if held:
            yield segment()

    sorted_ = texts.repartitionByRange("id").sortWithinPartitions("id")
    sorted_.mapInArrow(run, "first_id long, number long, n_tokens long, payload binary").write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the segments at ``path``.

    ``start`` counts the tokens of all documents before it.
    """
    table = spark.read.parquet(path)
    # A row for each segment, of some millions of tokens: their running sum is small.
    heads = table.select("first_id", "number", "n_tokens")
    before = F.sum("n_tokens").over(W.orderBy(F.asc_nulls_first("first_id"), "number").rowsBetween(W.unboundedPreceding, -1))
    heads = stored(heads.withColumn("base", F.coalesce(before, F.lit(0))), "segments")
    key = [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("first_id", "number")]
    joined = table.alias("s").join(heads.alias("h"), key[0] & key[1]).select("h.base", "s.payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload")):
                segment = Segment(payload.as_buffer())
                whole = segment.tokens(0, int(segment.ends[-1]))
                ends = segment.ends.astype(np.int64)
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment.ids, mask=segment.null.astype(bool)), pa.array(ends[:-1] + base), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
