"""LM scoring with an Elias-Fano n-gram trie in memory-mapped level files.

Level 1 holds all words of the training texts, as sorted 64-bit hashes (XXH64 of the
word's bytes; equal words are found by their bytes).  A deeper level holds all n-grams
of the training texts, sorted by context and last word.  For each context a monotone
pointer gives the range of its successors; a successor is stored relative to its
context (its word number plus the last code of the ranges before), so that the codes
are monotone as well.  Both sequences, and the hashes, are Elias-Fano coded; a lookup
is a successor search in the context's range.  Absolute discounting is interpolated
down to add-one unigrams; a shard's discount at a level is n1 / (n1 + 2 n2), of the
numbers of n-grams seen once and twice.  Discounted probabilities and back-off weights
are quantised to a byte, unigram probabilities to two; exact word counts stand beside
them for the base score.

A level is counted over all training texts: blocks of distinct n-grams with their
counts meet by context range.  Words are dealt to shards by hash; a deeper level is cut
where the contexts' occurrences sum up to ``MASS``, so that a frequent first word has
as many shards as its n-grams need.  Tasks map the files from the shared folder and
hold no level in memory (other stores are read into memory).

Defined cases: null is the empty text, which is the end token alone; without a
training text every token is unknown; rows of equal id are scored each; rows of null
id are learned from; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, fresh_dir, release_shuffles, small_batches, utf8
from .spans import distinct_spans, xxh64_spans
from .token_files import write_whole
from .token_ids import groups_by_size

#: ``DISCOUNT`` is that of a shard whose counts fit none; ``SHARD`` bytes of text give one shard of words, ``MASS`` occurrences one of n-grams.
ORDER, DISCOUNT, SHARD, MASS = 3, 0.75, 16 << 20, 3 << 20
#: Characters of the texts that are counted or scored at once.
PIECE = 9_000_000
#: The end token; no word has a line feed in it.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
#: Quantised logs: code 255 is 0, each step below it STEP.  A word's code is the log of its count and one in steps of WORD_STEP.
STEP, WORD_STEP = 9.0 / 255, 20.0 / 65535
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


#: A one, and the high bit, of each byte; place of the r-th one of a byte b at 8 b + r.
EACH, HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
BIT_AT = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for b in range(256) for r in range(8)], np.int64)


class EliasFano:
    """A sorted sequence of unsigned longs: low bits packed, high bits in unary."""

    def __init__(self, arrays: dict, name: str):
        self.n, self.low_bits, self.buckets = (int(x) for x in arrays[f"{name}.meta"][:3])
        self.least = arrays[f"{name}.meta"][3:].astype(np.uint64)
        self.low, self.high, self.rank = arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.rank"]
        #: Eight bytes from every byte on.
        self.from_byte = np.ndarray(8 * len(self.low) - 7, "<u8", np.ascontiguousarray(self.low).view(np.uint8).data, strides=(1,)) if self.low_bits <= 57 else None
        self.zeros = np.arange(len(self.rank), dtype=np.int64) * 64 - self.rank.astype(np.int64)

    @staticmethod
    def build(name: str, values: np.ndarray) -> dict:
        values = np.asarray(values, np.uint64)
        n = len(values)
        least = values[:1] if n else np.zeros(1, np.uint64)
        values = values - least  # a shard's values start far from 0
        top = int(values[-1]) if n else 0
        l = max(0, ((top // n) if n else 0).bit_length() - 1)
        high = (values >> np.uint64(l)).astype(np.int64)
        buckets = (int(high[-1]) + 1) if n else 1
        bits = np.zeros(-(-(n + buckets + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        low = np.zeros(n * l // 64 + 2, np.uint64)
        if l and n:
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            v = values & np.uint64((1 << l) - 1)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, v << off)
            over = np.flatnonzero(off + np.uint64(l) > 64)
            np.bitwise_or.at(low, word[over] + 1, v[over] >> (np.uint64(64) - off[over]))
        return {f"{name}.meta": np.append(np.array([n, l, buckets], np.uint64), least), f"{name}.low": low, f"{name}.high": words, f"{name}.rank": (np.cumsum(ones) - ones).astype("<u8")}

    def lows(self, i: np.ndarray) -> np.ndarray:
        l = self.low_bits
        if not l:
            return np.zeros(len(i), np.uint64)
        if self.from_byte is not None:
            at = i * l
            return (self.from_byte[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << l) - 1)
        at = i.astype(np.uint64) * np.uint64(l)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> off
        more = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (x | more) & np.uint64((1 << l) - 1)

    @staticmethod
    def _select(word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th one of each word: counts of ones up to each byte, all in one word, name the byte; a table the bit."""
        x = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
        x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
        upto = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * EACH
        rank = r.astype(np.uint64)
        reached = ((upto | HIGH) - (rank + np.uint64(1)) * EACH) & HIGH
        shift = (np.uint64(8) - np.bitwise_count(reached)) << np.uint64(3)
        rank -= ((upto << np.uint64(8)) >> shift) & np.uint64(255)
        return shift.astype(np.int64) + BIT_AT[((word >> shift) & np.uint64(255)) * np.uint64(8) + rank]

    def zero_at(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero."""
        j = np.searchsorted(self.zeros, k, side="right") - 1
        return j * 64 + self._select(~self.high[j], k - self.zeros[j])

    def bucket_ranges(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry of each bucket, and the entry after its last: the zeros before and behind its ones, mostly of one word."""
        before = np.where(h > 0, self.zero_at(np.maximum(h - 1, 0)), -1)
        at = before + 1
        j = at >> 6
        open_ = ~self.high[j] >> (at & 63).astype(np.uint64)
        ones = np.bitwise_count(~open_ & (open_ - np.uint64(1))).astype(np.int64)  # up to the next zero
        far = np.flatnonzero(open_ == 0)
        if len(far):
            ones[far] = self.zero_at(h[far]) - at[far]
        first = at - h
        return first, first + ones

    def access(self, i: np.ndarray) -> np.ndarray:
        j = np.searchsorted(self.rank, i.astype(np.uint64), side="right") - 1
        pos = j * 64 + self._select(self.high[j], i - self.rank[j].astype(np.int64))
        return (((pos - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(i)) + self.least

    def both_ends(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1; i mostly ascends, and i + 1 is often the next i."""
        last = np.append(i[1:] != i[:-1] + 1, True)
        lo = self.access(i).astype(np.int64)
        hi = np.append(lo[1:], 0)
        hi[last] = self.access(i[last] + 1).astype(np.int64)
        return lo, hi

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: successor search in the bucket of its high bits."""
        out = np.full(len(x), -1, np.int64)
        above = x >= self.least
        x = x - self.least
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        some = np.flatnonzero(above & (h < self.buckets) & (h >= 0)) if self.n else np.zeros(0, np.int64)
        if not len(some):
            return out
        h = h[some]
        want = x[some] & np.uint64((1 << self.low_bits) - 1)
        # neighbours often share their bucket: its range is looked up once
        new = np.append(True, h[1:] != h[:-1])
        own = np.cumsum(new) - 1
        first, last = self.bucket_ranges(h[new])
        at, end = first[own], last[own]
        # the last entry that isn't above; most buckets have one at most
        stop, live = end.copy(), np.flatnonzero(end - at > 1)
        while len(live):  # a bucket of a frequent context may hold thousands
            lo, hi = at[live], stop[live]
            middle = (lo + hi) >> 1
            above = self.lows(middle) > want[live]
            lo, hi = np.where(above, lo, middle), np.where(above, middle, hi)
            at[live], stop[live] = lo, hi
            live = live[hi - lo > 1]
        inside = np.flatnonzero(at < end)
        inside = inside[self.lows(at[inside]) == want[inside]]
        out[some[inside]] = at[inside]
        return out


def container(arrays: dict) -> bytes:
    """Arrays in one file: length and JSON of names, kinds, places; then the arrays, each at a multiple of 8."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, len(a), at]
        parts.append(data + b"\0" * (-len(data) % 8))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return np.array([len(text)], "<u8").tobytes() + text + b"".join(parts)


def mapped(uri: str) -> dict:
    """The arrays of a file: memory-mapped where it is a file of a mounted file system."""
    system, path = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    else:
        with system.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int(raw[:8].view("<u8")[0])
    head = json.loads(raw[8 : 8 + size].tobytes())
    return {n: raw[8 + size + at : 8 + size + at + count * np.dtype(kind).itemsize].view(kind) for n, (kind, count, at) in head.items()}


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def by_shard(where: np.ndarray):
    """(shard, positions) of each shard that occurs; the positions are a slice where the shards ascend."""
    if not len(where):
        return
    if (where[1:] >= where[:-1]).all():
        cut = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(where[a]), slice(a, b)
        return
    order = np.argsort(where.astype(np.int16) if where.max() < 1 << 15 else where, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        yield int(where[part[0]]), part


def between(edges: np.ndarray, numbers: np.ndarray):
    """(k, positions) of each k with numbers from ``edges[k]`` to below ``edges[k + 1]``; slices where the numbers ascend."""
    if not len(numbers):
        return
    if (numbers[1:] >= numbers[:-1]).all():  # few edges are looked up, not all numbers
        cut = np.searchsorted(numbers, edges[1:])
        cut[-1] = len(numbers)
        begin = np.append(0, cut[:-1])
        for k in np.flatnonzero(cut > begin).tolist():
            yield k, slice(int(begin[k]), int(cut[k]))
        return
    yield from by_shard(np.searchsorted(edges, numbers, side="right") - 1)


class Trie:
    """The levels built so far.

    ``starts[k]``: number of the first entry of each shard at level k + 1; ``cuts[k]``:
    number of the first context (an entry of level k) of each of these shards.
    """

    def __init__(self, folder: str, shards: int, starts: list[np.ndarray], cuts: list[np.ndarray], tokens: int):
        self.folder, self.shards, self.starts, self.cuts, self.tokens = folder, shards, starts, cuts, tokens
        self.open: dict = {}

    def part(self, level: int, shard: int) -> dict:
        if (level, shard) not in self.open:
            arrays = mapped(f"{self.folder}/level{level}-{shard:05d}.trie")
            arrays |= {"codes": EliasFano(arrays, "codes")} | ({"pointers": EliasFano(arrays, "pointers")} if level > 1 else {})
            self.open[level, shard] = arrays
        return self.open[level, shard]

    def words(self, h: np.ndarray) -> np.ndarray:
        """Numbers of word hashes, or -1."""
        out = np.full(len(h), -1, np.int64)
        for s, at in by_shard(shard_of(h, self.shards)):
            if self.starts[0][s + 1] > self.starts[0][s]:
                i = self.part(1, s)["codes"].find(h[at])
                out[at] = np.where(i >= 0, i + self.starts[0][s], -1)
        return out

    def extend(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams of ``level`` made of a context of one level less and a word, or -1."""
        out = np.full(len(context), -1, np.int64)
        some = np.flatnonzero((context >= 0) & (word >= 0))
        if not len(some):
            return out
        over = self.cuts[level - 1]
        for s, k in between(over, context[some]):
            at = some[k]
            if self.starts[level - 1][s + 1] == self.starts[level - 1][s]:
                continue
            part = self.part(level, s)
            c = context[at] - over[s]
            # neighbours often share their context: its range is looked up once
            new = np.append(True, c[1:] != c[:-1])
            own = np.cumsum(new) - 1
            c = c[new]
            lo, hi = part["pointers"].both_ends(c)
            base = np.where(lo > 0, part["codes"].access(np.maximum(lo - 1, 0)) + np.uint64(1), np.uint64(0))
            full = np.flatnonzero((hi > lo)[own])
            at, own = at[full], own[full]
            i = part["codes"].find(base[own] + word[at].astype(np.uint64))
            out[at] = np.where((i >= lo[own]) & (i < hi[own]), i + self.starts[level - 1][s], -1)
        return out

    def read(self, level: int, name: str, number: np.ndarray) -> np.ndarray:
        """Array ``name`` of a level at entries, which all exist."""
        out = None
        for s, at in between(self.starts[level - 1], number):
            got = self.part(level, s)[name][number[at] - self.starts[level - 1][s]]
            out = np.zeros(len(number), got.dtype) if out is None else out
            out[at] = got
        return out if out is not None else np.zeros(0)

    def weights(self, level: int, context: np.ndarray) -> np.ndarray:
        """Codes of the back-off weights of contexts of ``level`` towards level + 1."""
        out = np.zeros(len(context), np.uint8)
        over = self.cuts[level]
        for s, at in between(over, context):
            out[at] = self.part(level + 1, s)["weights"][context[at] - over[s]] if self.starts[level][s + 1] > self.starts[level][s] else 255
        return out


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(255 + np.log10(np.maximum(p, 1e-12)) / STEP), 0, 255).astype(np.uint8)


#: What a code stands for.
VALUES = 10.0 ** ((np.arange(256) - 255) * STEP)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct token, number of the token at each place, number of tokens of each text): words, then the end."""
    parts = [utf8(t) for t in texts]
    raw = (b"\n".join(parts) + b"\n").lower()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    white = np.ones(len(raw) + 1, bool)
    white[1:] = WHITE[np.frombuffer(raw, np.uint8)]
    change = np.flatnonzero(white[1:] != white[:-1])  # the last byte is white
    start, end = change[0::2], change[1::2]
    first, group = distinct_spans(raw, start, end - start)
    names = xxh64_spans(raw, start[first], (end - start)[first])
    words = np.diff(np.searchsorted(start, np.append(0, np.cumsum(sizes))))
    many = words + 1
    doc = np.repeat(np.arange(len(texts)), words)
    at = np.full(int(many.sum()), len(names))
    at[np.arange(len(start)) + doc] = group
    return np.append(names, END), at, many


def held_out(keys: list) -> np.ndarray:
    return np.fromiter((k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k in keys), bool, len(keys))


SENT = "shard int, n int, a binary, b binary, c binary"


def sent_rows(where: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    rows = [(s, len(columns[0][at]), *[c[at].tobytes() for c in columns]) for s, at in by_shard(where)]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "n", "a", "b", "c"])


def _pieces(batches, most: int = PIECE):
    """(keys, texts) of about ``most`` characters, over the ends of record batches: the n-grams of a piece are looked up once each."""
    keys, held, size = [], [], 0
    for batch, texts in groups_by_size(batches):
        keys.append(batch.column(0))
        held += texts
        size += sum(len(t or "") for t in texts)
        if size >= most:
            yield pa.chunked_array(keys).combine_chunks(), held
            keys, held, size = [], [], 0
    if held:
        yield pa.chunked_array(keys).combine_chunks(), held


def _training(batches):
    """Tokens of the training texts, a piece at a time."""
    for keys, texts in _pieces(batches):
        held = [t for t, o in zip(texts, held_out(keys.to_pylist()), strict=True) if not o]
        if held:
            yield tokens_of(held)


def count_words(shards: int):
    def run(batches):
        for names, at, _ in _training(batches):
            yield sent_rows(shard_of(names, shards), [names, np.bincount(at, minlength=len(names)).astype("<u4"), np.zeros(len(names), np.uint8)])

    return run


def pieces_of(mass: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """(first entry, mass) of stretches of entries that have about ``least`` each, or one heavy entry."""
    before = np.cumsum(mass) - mass
    first = np.flatnonzero(np.append(True, np.diff(before // least) > 0)) if len(mass) else np.zeros(0, np.int64)
    return first.tolist(), np.add.reduceat(mass, first).tolist() if len(mass) else []


def context_cuts(done: list[dict], starts: np.ndarray, most: int) -> np.ndarray:
    """First contexts of the next level's shards, of ``most`` occurrences or one context each, and the number of contexts."""
    cuts, held = [0], 0
    for r in done:  # a few rows a shard
        for first, mass in zip(r["first"], r["mass"], strict=True):
            if held and held + mass > most:
                cuts.append(int(starts[r["shard"]]) + first)
                held = 0
            held += mass
    return np.array([*cuts, int(starts[-1])], np.int64)


def level_one(folder: str, mass: int = MASS):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in part["a"]])
        n = np.concatenate([np.frombuffer(x, "<u4") for x in part["b"]]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.add.reduceat(n, first)
        shard = int(part["shard"].iloc[0])
        arrays = EliasFano.build("codes", h[first]) | {"counts": n.astype("<u8"), "probs": np.rint(np.log10(n + 1.0) / WORD_STEP).astype("<u2")}
        write_whole(folder, f"level1-{shard:05d}.trie", container(arrays))
        some, masses = pieces_of(n, mass // 8)
        return pd.DataFrame({"shard": np.array([shard], np.int32), "entries": [len(first)], "total": [int(n.sum())], "first": [some], "mass": [masses]})

    return run


def packed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Both numbers, which are below 2**32, in one."""
    return (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def unpacked(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def walk(trie: Trie, known: np.ndarray, at: np.ndarray, many: np.ndarray, levels: int) -> tuple[np.ndarray, list[np.ndarray], list[tuple]]:
    """(word number of each token; for each level the number of the n-gram that ends before each token; the n-grams looked up).

    ``known`` has the numbers of the distinct words.  From level 2 on the n-grams are
    (tokens, number of the n-gram of each of these; context and own number of each n-gram).
    """
    word, end = known[at], known[-1]
    start = np.cumsum(many) - many

    def before(numbers: np.ndarray, opening: int) -> np.ndarray:
        out = np.empty_like(numbers)
        out[1:] = numbers[:-1]
        out[start] = opening
        return out

    contexts, looked = [before(word, int(end))], []
    for level in range(2, levels + 1):
        context = contexts[-1]
        good = np.flatnonzero((context >= 0) & (word >= 0))
        if len(good) and max(int(word.max()), int(context.max())) < 1 << 32:
            some, back = np.unique(packed(context[good], word[good]), return_inverse=True)
            c, w = unpacked(some)
        else:
            c, w, back = context[good], word[good], np.arange(len(good))
        found = trie.extend(level, c, w)
        looked.append((good, back, c, found))
        number = np.full(len(word), -1, np.int64)
        number[good] = found[back]
        contexts.append(before(number, -1))
    return word, contexts, looked


def count_level(trie: Trie, level: int):
    """Distinct (context, word) of a level with counts, where the context is in the trie."""

    def run(batches):
        for names, at, many in _training(batches):
            word, contexts, _ = walk(trie, trie.words(names), at, many, level - 1)
            c = contexts[level - 2]
            good = c >= 0
            if not good.any():
                continue
            c, w = c[good], word[good]
            if max(int(c.max()), int(w.max())) < 1 << 32:
                both, n = np.unique(packed(c, w), return_counts=True)
                c, w = unpacked(both)
            else:
                order = np.lexsort((w, c))
                c, w = c[order], w[order]
                first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])))
                n = np.diff(np.append(first, len(c)))
                c, w = c[first], w[first]
            where = np.searchsorted(trie.cuts[level - 1], c, side="right") - 1
            near = (c - trie.cuts[level - 1][where]).astype("<u4")
            yield sent_rows(where, [near, w.astype("<u4" if int(w.max()) < 1 << 32 else "<u8"), n.astype(np.uint8 if n.max() < 256 else "<u4")])

    return run


def discount(n: np.ndarray) -> float:
    """The absolute discount that fits counts, from the numbers of ones and twos."""
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    return once / (once + 2 * twice) if once and twice else DISCOUNT


def level_more(folder: str, level: int, sizes: np.ndarray, mass: int = MASS):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        c = np.concatenate([np.frombuffer(x, "<u4") for x in part["a"]]).astype(np.int64)
        w = np.concatenate([np.frombuffer(x, "<u4" if len(x) == 4 * m else "<u8").astype(np.int64) for x, m in zip(part["b"], part["n"], strict=True)])
        n = np.concatenate([np.frombuffer(x, np.uint8 if len(x) == m else "<u4").astype(np.int64) for x, m in zip(part["c"], part["n"], strict=True)])
        shard = int(part["shard"].iloc[0])
        order = np.argsort(packed(c, w)) if len(w) and int(w.max()) < 1 << 32 else np.lexsort((w, c))
        c, w, n = c[order], w[order], n[order]
        first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])))
        c, w, n = c[first], w[first], np.add.reduceat(n, first)
        total = np.bincount(c, n, minlength=sizes[shard])
        p = (n - discount(n)) / total[c]
        left = 1 - np.bincount(c, p, minlength=sizes[shard])
        pointers = np.append(0, np.cumsum(np.bincount(c, minlength=sizes[shard])))
        opens = np.append(True, c[1:] != c[:-1]) if len(c) else np.zeros(0, bool)
        # a code is the word number plus the last code, and one, of the ranges before
        step = w + 1
        lasts = np.where(np.append(opens[1:], True), step, 0) if len(c) else step
        base = np.cumsum(lasts) - lasts
        base = base[np.flatnonzero(opens)[np.cumsum(opens) - 1]] if len(c) else base
        arrays = EliasFano.build("codes", base + w) | EliasFano.build("pointers", pointers) | {"probs": quantised(p), "weights": quantised(left)}
        write_whole(folder, f"level{level}-{shard:05d}.trie", container(arrays))
        some, masses = pieces_of(n, mass // 8)
        return pd.DataFrame({"shard": np.array([shard], np.int32), "entries": [len(c)], "total": [int(n.sum())], "first": [some], "mass": [masses]})

    return run


KIND = "shard int, entries long, total long, first array<long>, mass array<long>"


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, mass: int = MASS) -> Trie:
    """Counts and writes all levels."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    folder = fresh_dir(spark, "trie")
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = int(1 + size // SHARD)

    def level_done(found: DataFrame, shards: int) -> tuple[list[dict], np.ndarray]:
        rows = sorted((r.asDict() for r in found.collect()), key=lambda r: r["shard"])  # a row a shard
        entries = np.zeros(shards, np.int64)
        for r in rows:
            entries[r["shard"]] = r["entries"]
        return rows, np.append(0, np.cumsum(entries))

    done, starts = level_done(by_bucket(docs.mapInArrow(count_words(shards), SENT), shards, level_one(folder, mass), KIND), shards)
    trie = Trie(folder, shards, [starts], [np.zeros(1, np.int64)], sum(r["total"] for r in done))
    release_shuffles(spark)
    for level in range(2, order + 1):
        cuts = context_cuts(done, trie.starts[-1], mass)
        grown = Trie(folder, shards, trie.starts, [*trie.cuts, cuts], trie.tokens)
        many = len(cuts) - 1
        done, starts = level_done(by_bucket(docs.mapInArrow(count_level(grown, level), SENT), many, level_more(folder, level, np.diff(cuts), mass), KIND), many)
        trie = Trie(folder, shards, [*trie.starts, starts], grown.cuts, trie.tokens)
        release_shuffles(spark)
    return trie


def score_tokens(trie: Trie, names: np.ndarray, place: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, log10 add-one probability, log10 model probability) of each token."""
    order = len(trie.starts)
    distinct = trie.words(names)
    word, contexts, looked = walk(trie, distinct, place, many, order)
    whole = trie.tokens + int(trie.starts[0][-1]) + 1
    known = np.flatnonzero(distinct >= 0)
    counts, first = np.zeros(len(names)), np.ones(len(names))
    if len(known):
        counts[known] = trie.read(1, "counts", distinct[known])
        first[known] = 10.0 ** (trie.read(1, "probs", distinct[known]) * WORD_STEP)
    count, p = counts[place], first[place] / whole
    base = np.log10((counts + 1) / whole)[place]
    for level in range(2, order + 1):
        good, back, c, number = looked[level - 2]
        more, hit = np.zeros(len(c)), np.flatnonzero(number >= 0)
        if len(hit):
            more[hit] = VALUES[trie.read(level, "probs", number[hit])]
        p[good] = p[good] * VALUES[trie.weights(level - 1, c)][back] + more[back]
        new = np.flatnonzero((contexts[level - 2] >= 0) & (word < 0))  # a word that no n-gram has
        p[new] *= VALUES[trie.weights(level - 1, contexts[level - 2][new])]
    return count, base, np.log10(p)


def score(docs: DataFrame, trie: Trie, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        for keys, texts in _pieces(batches):
            names, at, many = tokens_of(texts)
            count, base, model = score_tokens(trie, names, at, many)
            start = np.cumsum(many) - many
            sums = [np.add.reduceat(x, start) for x in ((count > 0).astype(np.int64), base, model)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(held_out(keys.to_pylist())), pa.array(many.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(len(many), trie.tokens)), pa.array(sums[1]), pa.array(sums[2])], names=["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = "k long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, kind).withColumnRenamed("k", key)
