"""Words of many texts as spans of one byte buffer, and XXH64 over spans, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

SPACE, BREAK = 0x20, 0x0A
#: XXH64's primes. Fixed values of the hash function.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


@dataclass
class Words:
    """``start`` and ``length`` of each word in ``buffer``; text k has words ``first[k]`` to ``first[k + 1]``."""

    buffer: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray


def words_of(texts: Iterable[bytes]) -> Words:
    """Lower A-Z, split at ASCII white space, lay the words of a text out with one space between them."""
    lines = [b" ".join(t.lower().split()) + b"\n" for t in texts]
    buffer = np.frombuffer(b"\n" + b"".join(lines) + bytes(8), np.uint8)
    marks = np.flatnonzero((buffer == SPACE) | (buffer == BREAK))
    start, length = marks[:-1] + 1, np.diff(marks) - 1
    breaks = marks[buffer[marks] == BREAK]
    real = length > 0
    start, length = start[real], length[real]
    return Words(buffer, start, length, np.searchsorted(start, breaks))


def slices(sizes: Iterable[int], limit: int) -> Iterator[slice]:
    """Consecutive ranges of about ``limit`` in all; what is larger alone stands alone."""
    begin, total, k = 0, 0, -1
    for k, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(begin, k)
            begin, total = k, 0
        total += size
    if k >= begin:
        yield slice(begin, k + 1)


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _loads(buffer: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian number that begins at each byte."""
    width = np.dtype(kind).itemsize
    return np.ndarray((len(buffer) - width + 1,), kind, buffer, strides=(1,))


def xxh64(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every span; ``buffer`` has eight spare bytes at its end."""
    with np.errstate(over="ignore"):
        by8, by4, seed64 = _loads(buffer, "<u8"), _loads(buffer, "<u4"), np.uint64(seed)
        at, left = start.astype(np.int64), length.astype(np.int64)
        h = np.full(len(at), seed64 + P5)
        if (long := np.flatnonzero(left >= 32)).size:
            acc = [np.full(long.size, x) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            here, rest, live = at[long], left[long], np.arange(long.size)
            while live.size:
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], by8[here[live] + 8 * k])
                here[live] += 32
                rest[live] -= 32
                live = live[rest[live] >= 32]
            merged = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            zero = np.zeros(long.size, np.uint64)
            for k in range(4):
                merged = (merged ^ _round(zero, acc[k])) * P1 + P4
            h[long], at[long], left[long] = merged, here, rest
        h += length.astype(np.uint64)
        zero = np.uint64(0)
        live = np.flatnonzero(left >= 8)
        while live.size:
            h[live] = _rotl(h[live] ^ _round(zero, by8[at[live]]), 27) * P1 + P4
            at[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        if live.size:
            h[live] = _rotl(h[live] ^ (by4[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
            at[live] += 4
            left[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(left > 0)
            if not live.size:
                break
            h[live] = _rotl(h[live] ^ (buffer[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
            left[live] -= 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h
