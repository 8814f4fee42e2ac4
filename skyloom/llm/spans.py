"""Which spans of a byte string hold equal bytes: grouped by a hash, then compared byte by byte.

Spans of up to ``LONG`` bytes are read eight bytes at a time, all spans at once;
longer ones are few for their bytes and are hashed and compared one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

LONG = 64
#: The low 0 to 8 bytes of a word.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct value, number of the value at each place)"""
    group, names = pd.factorize(h.view(np.int64))
    first = np.empty(len(names), np.int64)
    first[group[::-1]] = np.arange(len(h) - 1, -1, -1)
    return first, group


def loader(raw: bytes):
    """What reads up to eight bytes from each of some places on, as a word."""
    words = np.frombuffer(raw + bytes(16 + -len(raw) % 8), "<u8")

    def load(at: np.ndarray, many: np.ndarray) -> np.ndarray:
        off = (at & 7).astype(np.uint64) << np.uint64(3)
        low = words[at >> 3] >> off
        high = np.where(off > 0, words[(at >> 3) + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (low | high) & LOW[np.minimum(many, 8)]

    return load


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64_spans(raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each span: those of under 32 bytes all at once, the others by the library."""
    load = loader(raw)
    h = size.astype(np.uint64) + P5
    for at in (0, 8, 16):
        some = np.flatnonzero(size >= at + 8)
        lane = turned(load(start[some] + at, np.full(len(some), 8)) * P2, 31) * P1
        h[some] = turned(h[some] ^ lane, 27) * P1 + P4
    at = start + (size & ~7)
    rest = load(at, size & 7)
    some = np.flatnonzero(size & 4)
    h[some] = turned(h[some] ^ ((rest[some] & LOW[4]) * P1), 23) * P2 + P3
    rest[some] >>= np.uint64(32)
    for k in range(3):
        some = np.flatnonzero((size & 3) > k)
        h[some] = turned(h[some] ^ (((rest[some] >> np.uint64(8 * k)) & LOW[1]) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + size[i]])
    return h


def distinct_spans(raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of one span of each group, group of each span): spans are in one group if and only if their bytes are equal."""
    load = loader(raw)
    head = load(start, size)
    h = stirred(head ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    deeper, some = [], np.flatnonzero(size > 8)
    for at in range(8, LONG, 8):
        some = some[size[some] > at]
        if not len(some):
            break
        x = load(start[some] + at, size[some] - at)
        h[some] = stirred(h[some] + x)
        deeper.append((some, x))
    long = np.flatnonzero(size > LONG).tolist()
    bytes_of = lambda i: raw[start[i] : start[i] + size[i]]
    for i in long:
        h[i] = xxhash.xxh64_intdigest(bytes_of(i), 7)
    first, group = numbered(h)
    of = first[group]
    differ = (size[of] != size) | (head[of] != head)
    place = np.zeros(len(size), np.int64)
    for some, x in deeper:
        place[some] = np.arange(len(some))
        differ[some] |= x[place[of[some]]] != x
    for i in long:
        differ[i] = of[i] != i and bytes_of(i) != bytes_of(of[i])
    if differ.any():  # equal hashes of different bytes
        more: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(differ).tolist():
            if bytes_of(i) not in more:
                more[bytes_of(i)] = len(first) + len(extra)
                extra.append(i)
            group[i] = more[bytes_of(i)]
        first = np.append(first, extra)
    return first, group
