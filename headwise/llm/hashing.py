"""Word and shingle hashes of many texts at once, on the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Multiplier of the polynomial byte hash (odd, so invertible modulo 2**64).
BASE = 0x9E6C63D0876A3F5D
INVERSE = pow(BASE, -1, 1 << 64)
#: ASCII letters in lower case; all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space that separates words: space and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and where each row begins (and the last ends); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, wherever it stands."""
    n = int(starts.max()) + 1 if len(starts) else 0
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts] ^ (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): spans of the words, and the index of each row's first word (one more at the end)."""
    word = ~SPACE[data]
    before = np.zeros(len(word), dtype=bool)
    before[1:] = word[:-1]
    inner = bounds[bounds < len(data)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(len(word), dtype=bool)
    after[:-1] = word[1:]
    after[bounds[bounds > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, and the index of each row's first word."""
    data, bounds = raw(column)
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, bounds)
    return spans_hash(prefix_sums(data), starts, ends), first


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; one hash of all words if there are fewer, none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, dtype=U)
    for k in range(size):
        out = mix(out * U(0x9FB21C651E98DF25) + words[k : len(words) - size + 1 + k])
    return out
