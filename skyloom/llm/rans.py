"""Static range asymmetric numeral system over token ids, in numpy, with interleaved lanes.

One frequency table, shared by all blocks, sums to 2**PRECISION.  A block of ids is
dealt over lanes (id i to lane i mod lanes); each lane is its own coder with a
64-bit state that sheds or takes 32-bit words, so a step treats all lanes at once.
Decoding runs the steps in order, encoding backwards.

Every ``every`` steps there is a checkpoint: where the words go on and the lanes'
states.  It opens a part, which can be decoded by itself and has a checksum.  The
block's start is the first checkpoint.

Block format (little-endian): magic 'SKRB', ids u32, lanes u32, steps a part u32,
parts u32, words u32, crc32 of the ids (as u32) u32; for each part its first word's
number u32 and the crc32 of its ids u32; for each part the lanes' states u64; the
words u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PRECISION, LOW, LANES, EVERY = 20, 1 << 31, 2048, 64
HEAD = struct.Struct("<4sIIIIII")


def table_of(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies of sum 2**precision in proportion to the counts; every id of a positive count gets 1 at least."""
    counts = np.asarray(counts, np.float64)
    total = counts.sum()
    if not total:
        out = np.zeros(len(counts), np.int64)
        out[0] = 1 << precision
        return out
    out = np.where(counts > 0, np.maximum(1, np.floor(counts / total * (1 << precision))), 0).astype(np.int64)
    short = (1 << precision) - int(out.sum())
    if short >= 0:
        out[int(counts.argmax())] += short
    while short < 0:  # rare ids were lifted to 1: the largest pay, in turn
        order = np.argsort(-out, kind="stable")[: max(1, min(-short, int((out > 1).sum())))]
        out[order[out[order] > 1]] -= 1
        short = (1 << precision) - int(out.sum())
    return out


def lanes_for(n: int, most: int = LANES) -> int:
    """Lanes of a block of n ids: a short one has fewer, as each lane's state takes 8 bytes a part."""
    return max(1, min(most, n // 64))


def block_head(data: bytes) -> tuple[int, int, int, int, int, int]:
    """(ids, lanes, steps a part, parts, words, crc32) of a block from its first bytes."""
    magic, *rest = HEAD.unpack_from(data)
    if magic != b"SKRB":
        raise ValueError("not a block")
    return tuple(rest)


class Coder:
    """Encodes and decodes blocks by one frequency table."""

    def __init__(self, freq: np.ndarray, precision: int = PRECISION):
        # a state is kept below 2**63; a lane sheds 32 bits where x >= freq << room
        self.freq, self.bits, self.room = freq.astype(np.uint64), np.uint64(precision), np.uint64(63 - precision)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int | None = None, every: int = EVERY) -> bytes:
        n = len(ids)
        if (self.freq.take(ids) == 0).any():
            raise ValueError("an id is not in the frequency table")
        lanes = lanes_for(n) if lanes is None else max(1, min(lanes, n))
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        out, marks, held = [], [], 0
        f32 = np.uint64(32)
        for s in range(steps - 1, -1, -1):
            part = ids[s * lanes : (s + 1) * lanes].astype(np.int64)
            k = len(part)
            x, f = state[:k], self.freq.take(part, mode="clip")
            shed = np.flatnonzero(x >= f << self.room)
            if len(shed):
                out.append((x[shed] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
                held += len(shed)
                x[shed] >>= f32
            times = x // f
            state[:k] = (times << self.bits) + (x - times * f) + self.start.take(part, mode="clip")
            if s % every == 0:
                marks.append((s, held, state.astype("<u8").tobytes()))
        marks.reverse()
        words = np.concatenate(out)[::-1] if out else np.zeros(0, "<u4")
        whole = np.ascontiguousarray(ids, "<u4")
        heads = b"".join(struct.pack("<II", held - at, zlib.crc32(whole[s * lanes : (s + every) * lanes])) for s, at, _ in marks)
        return HEAD.pack(b"SKRB", n, lanes, every, len(marks), len(words), zlib.crc32(whole)) + heads + b"".join(x for _, _, x in marks) + words.tobytes()

    def steps(self, state: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids from the lanes' states on."""
        lanes, pos = len(state), 0
        out = np.empty(n, np.uint32)
        # states are below 2**63, and signed numbers serve as indices as they are; none is out of range, and clipping needs no copy
        state, freq, start, words = state.astype(np.int64), self.freq.view(np.int64), self.start.view(np.int64), words.astype(np.int64)
        mask = (1 << int(self.bits)) - 1
        for s in range(0, n, lanes):
            k = min(lanes, n - s)
            x = state[:k]
            slot = x & mask
            sym = self.symbol.take(slot, mode="clip")
            out[s : s + k] = sym
            x >>= int(self.bits)
            x *= freq.take(sym, mode="clip")
            slot -= start.take(sym, mode="clip")
            x += slot
            take = np.flatnonzero(x < LOW)
            if len(take):
                x[take] = (x.take(take) << 32) | words[pos : pos + len(take)]
                pos += len(take)
        return out

    def part(self, read, number: int) -> np.ndarray:
        """The ids of one part of a block; ``read(at, size)`` gives bytes of the block, of which only that part's are read."""
        n, lanes, every, parts, words, _ = block_head(read(0, HEAD.size))
        table = np.frombuffer(read(HEAD.size, 8 * parts), "<u4").reshape(parts, 2)
        states = HEAD.size + 8 * parts
        state = np.frombuffer(read(states + 8 * lanes * number, 8 * lanes), "<u8").astype(np.uint64)
        lo, hi = int(table[number, 0]), int(table[number + 1, 0]) if number + 1 < parts else words
        own = np.frombuffer(read(states + 8 * lanes * parts + 4 * lo, 4 * (hi - lo)), "<u4")
        ids = self.steps(state, own, min(every * lanes, n - number * every * lanes))
        if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != table[number, 1]:
            raise ValueError("checksum of a part differs")
        return ids

    def decode(self, block: bytes) -> np.ndarray:
        """All ids of a block; checks the crc32 of each part and of the whole."""
        view = memoryview(block)
        n, _, _, parts, _, crc = block_head(block)
        ids = [self.part(lambda at, size: view[at : at + size], k) for k in range(parts)]
        out = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        if len(out) != n or zlib.crc32(np.ascontiguousarray(out, "<u4")) != crc:
            raise ValueError("checksum of a block differs")
        return out


def _times(matrix: list[int], vector: int) -> int:
    """A matrix of bits (a number for each bit of the vector) times a vector."""
    out = 0
    while vector:
        low = vector & -vector
        out ^= matrix[low.bit_length() - 1]
        vector ^= low
    return out


#: What 1, 2, 4, 8... zero bytes do to the register of a crc32, as far as needed yet.
_zeros: list[list[int]] = []


def crc32_joined(first: int, second: int, size: int) -> int:
    """crc32 of two strings put together, from the crc32 of each and the second's size in bytes."""
    if not _zeros:
        step = [0xEDB88320] + [1 << k for k in range(31)]  # a zero bit
        for _ in range(3):
            step = [_times(step, row) for row in step]
        _zeros.append(step)
    while len(_zeros) < size.bit_length():
        _zeros.append([_times(_zeros[-1], row) for row in _zeros[-1]])
    for k in range(size.bit_length()):
        if size >> k & 1:
            first = _times(_zeros[k], first)
    return first ^ second
