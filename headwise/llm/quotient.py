"""Counting quotient filters that lose nothing: exact counts of packed keys in few bytes.

A key of ``bits`` bits goes through an invertible permutation, so keys spread evenly and the key can
be had back. Its first bits, the quotient, are not stored: a bitmap says in unary how many keys each
quotient has. The rest, the whole remainder, is stored in order, and beside it the count. Filters
are sorted by nature, so two of the same key space merge in one pass, over shards and over corpora.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

U = np.uint64
#: Odd multipliers of the permutation.
FACTORS = (0xD6E8FEB86659FD93, 0x9E6C63D0876A3F5D)
#: Counts from this one on stand apart.
LARGE = 255


def _fold(x: np.ndarray, bits: int) -> np.ndarray:
    return x ^ (x >> U((bits + 1) // 2))  # its own inverse


def permute(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the numbers below ``2 ** bits``, 1 to 64 bits."""
    mask = U((1 << bits) - 1)
    out = _fold(keys, bits)
    for factor in FACTORS:
        out = _fold((out * U(factor)) & mask, bits)
    return out


def restore(keys: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of :func:`permute`."""
    mask = U((1 << bits) - 1)
    out = keys
    for factor in reversed(FACTORS):
        out = (_fold(out, bits) * U(pow(factor, -1, 1 << bits))) & mask
    return _fold(out, bits)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each stands; ``keys`` is sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def encode(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of distinct ascending permuted ``keys`` of ``bits`` bits (those that differ, 0 to 64)."""
    n = len(keys)
    q = min(bits, max(0, n.bit_length() - 1))
    quotient = (keys >> U(bits - q)).astype(np.int64) if q else np.zeros(n, np.int64)
    runs = np.zeros(n + (1 << q), dtype=np.uint8)
    runs[np.arange(n) + quotient] = 1
    width = -(-(bits - q) // 8)
    rest = keys & U((1 << (bits - q)) - 1)
    large = counts >= LARGE
    return b"".join(
        (
            np.array([n, q, bits, int(large.sum())], dtype=np.int64).tobytes(),
            np.packbits(runs).tobytes(),
            np.ascontiguousarray(rest.view(np.uint8).reshape(n, 8)[:, :width].T).tobytes(),  # byte by byte, alike ones together
            np.where(large, LARGE, counts).astype(np.uint8).tobytes(),
            counts[large].astype(np.int64).tobytes(),
        )
    )


def decode(filter_: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a filter, keys ascending."""
    n, q, bits, many = (int(x) for x in np.frombuffer(filter_, dtype=np.int64, count=4))
    at, size = 32, n + (1 << q)
    runs = np.unpackbits(np.frombuffer(filter_, dtype=np.uint8, count=-(-size // 8), offset=at), count=size)
    at += -(-size // 8)
    quotient = np.flatnonzero(runs) - np.arange(n)
    width = -(-(bits - q) // 8)
    rest = np.zeros((n, 8), dtype=np.uint8)
    rest[:, :width] = np.frombuffer(filter_, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
    at += n * width
    counts = np.frombuffer(filter_, dtype=np.uint8, count=n, offset=at).astype(np.int64)
    counts[counts == LARGE] = np.frombuffer(filter_, dtype=np.int64, count=many, offset=at + n)
    keys = rest.view(U).ravel()
    return (keys | quotient.astype(U) << U(bits - q) if q else keys), counts


def merge(filters: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of filters of one key space, merged: equal keys add up."""
    parts = [decode(f) for f in filters]
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")  # merges the ascending runs
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)
