"""Suffix-array dedup: bytes of passages that also stand in a document of smaller id are removed.

A byte goes if a string of ``MATCH`` bytes covers it that also starts in a document
with a smaller id.  Sorting the suffixes of the whole corpus isn't needed: only
repeated places matter.

1. Texts go to blocks of a few MB, written once.  In each block, anchors are the
   grams with the smallest hash of some window of ``MATCH`` bytes (winnowing), so equal
   strings of that length share an anchor at the same place in them.
2. Anchors meet by hash, with a hash of their context (all bytes of all strings of
   that length around the anchor) and their document.  An anchor whose whole context
   stands in a smaller document is settled.  One whose gram also stands elsewhere in
   another context is doubtful: its block sends the context's bytes.
3. Doubtful contexts of a gram meet.  Their suffixes are sorted with their common
   prefixes (an enhanced suffix array); a scan with a stack builds the intervals of the
   common-prefix tree; an interval of length ``MATCH`` or more is a repeat with all its
   occurrences, and it is maximal if the bytes to their left differ.  The smallest
   document of an interval keeps it.  A gram in over ``HOT`` contexts doesn't gather
   them: each of its strings goes its own way by hash, once a block, with the smallest
   document of the block.
4. Each block removes what it was told.

Tasks hold a block, or the anchors of one range of hashes; an anchor that stands
often is merged within each block first.  Strings are told apart by 64 bits of hash
and more, as is usual; the suffix array compares bytes.

Defined cases: null is the empty text; documents of equal id don't take from each
other; a null id is smaller than all others (and equal to the smallest long); texts
shorter than ``MATCH`` lose nothing; an empty table gives an empty result; other
columns, also clashing ones, are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, drop_caches, release_shuffles, sliding, small_batches, stored, trim_memory, utf8

MATCH, GRAM = 50, 20
WINDOW = MATCH - GRAM + 1
REACH = WINDOW - 1 + MATCH
#: Suffixes are sorted by so many bytes.
DEPTH = 56
BLOCK, RANGE, HOT = 1 << 20, 8 << 20, 1000
NONE = np.uint64((1 << 64) - 1)


BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def base_powers(count: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < count:
        size = max(count, 1 << 20)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.append(np.uint64(1), np.full(size - 1, base, np.uint64)))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def gram_hashes(raw: bytes) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)).astype(np.uint64)
    return mixed(x[:n] * np.uint64(0x9E3779B97F4A7C15) + (x[8 : 8 + n] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD1342543DE82EF95) + x[12 : 12 + n] * np.uint64(0xA0761D6478BD642F))


def anchors(raw: bytes, ends: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts that stand one after another and end at ``ends``."""
    cross = ends[:-1, None] - np.arange(1, GRAM)[None, :] if len(ends) > 1 else np.zeros((0, 1), np.int64)
    cross = np.unique(cross[cross >= 0])
    found, hashes = [], []
    span = step + 2 * (WINDOW - 1)
    for a in range(0, max(1, len(raw) - GRAM + 1), step):
        lo = max(0, a - (WINDOW - 1))
        h = gram_hashes(raw[lo : lo + span + GRAM - 1 if lo < a else a + step + WINDOW - 1 + GRAM - 1])
        if not len(h):
            continue
        inside = cross[np.searchsorted(cross, lo) : np.searchsorted(cross, lo + len(h))] - lo
        h[inside] = NONE
        padded = np.concatenate([np.full(WINDOW - 1, NONE), h, np.full(WINDOW - 1, NONE)])
        best = sliding(np.maximum, sliding(np.minimum, padded, WINDOW), WINDOW)
        # at the ends of the text padded windows only add anchors
        pick = np.flatnonzero((best == h) & (h != NONE)) + lo
        pick = pick[(pick >= a) & (pick < a + step)]
        found.append(pick)
        hashes.append(h[pick - lo])
    return (np.concatenate(found), np.concatenate(hashes)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def owned_strings(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of the strings of ``MATCH`` bytes whose smallest gram, the leftmost of equals, is each anchor."""
    first, last = at - WINDOW + 1, at.copy()
    for d in range(1, WINDOW):
        near = at[d:] - at[:-d] < WINDOW
        if not near.any():
            break
        i = np.flatnonzero(near & (h[:-d] <= h[d:])) + d
        first[i] = np.maximum(first[i], at[i - d] + 1)
        i = np.flatnonzero(near & (h[d:] < h[:-d]))
        last[i] = np.minimum(last[i], at[i + d] - WINDOW)
    return first, last


class Block:
    """Texts of one block with their anchors, in the order in which both sides of an exchange list them."""

    def __init__(self, raw: bytes, keys: np.ndarray, sizes: np.ndarray, ranges: int):
        self.raw, self.keys, self.sizes = raw, keys, sizes
        self.ends = np.cumsum(sizes)
        at, h = anchors(raw, self.ends)
        doc = np.searchsorted(self.ends, at, side="right")
        first, last = owned_strings(at, h)
        lo = np.maximum(self.ends[doc] - sizes[doc], first)
        hi = np.minimum(self.ends[doc], last + MATCH)
        keep = hi - lo >= MATCH
        at, h, doc, lo, hi = at[keep], h[keep], doc[keep], lo[keep], hi[keep]
        up, down = base_powers(len(raw) + 1)
        self.ranges, self.down, self.total = ranges, down, np.zeros(len(raw) + 1, np.uint64)
        total = self.total
        np.cumsum(WEIGHTS[np.frombuffer(raw, np.uint8)] * up[: len(raw)], out=total[1:])
        context = mixed((total[hi] - total[lo]) * down[lo] + (at - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (hi - lo).astype(np.uint64))
        bucket = bucket_of(mixed(h), ranges)  # an anchor's own hash is the smallest of a window, so most are small
        order = np.lexsort((keys[doc], context, h, bucket))
        self.at, self.h, self.doc, self.lo, self.hi, self.context = at[order], h[order], doc[order], lo[order], hi[order], context[order]
        bucket = bucket[order].astype(np.int64)
        n = len(order)
        new = np.ones(n, bool)
        new[1:] = (self.h[1:] != self.h[:-1]) | (self.context[1:] != self.context[:-1])
        #: the first of each (gram, context), which has the block's smallest key, stands for all of them
        self.first = np.flatnonzero(new)
        self.rank = np.cumsum(new) - 1
        self.bucket = bucket[self.first]
        self.buckets, cut = np.unique(self.bucket, return_index=True)
        self.cuts = np.append(cut, len(self.first))

    @property
    def smallest(self) -> np.ndarray:
        return self.keys[self.doc[self.first]]

    def hot_strings(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the contexts of code 3: (rank, place in it, number of its hash) of each string; (hash, least key) of each distinct one, by bucket."""
        ranks = np.flatnonzero(code == 3)
        lo = self.lo[self.first[ranks]]
        many = self.hi[self.first[ranks]] - lo - MATCH + 1
        rank = np.repeat(ranks, many)
        j = np.arange(len(rank)) - np.repeat(np.cumsum(many) - many, many)
        start = np.repeat(lo, many) + j
        h = mixed((self.total[start + MATCH] - self.total[start]) * self.down[start])
        distinct, number = np.unique(h, return_inverse=True)  # ascending, so by bucket too
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, number, self.smallest[rank])
        return rank, j, number, distinct, least


def bucket_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


WEIGHTS = np.random.default_rng(61_803).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def make_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of about ``BLOCK`` bytes of text: compressed texts, keys, sizes, and the other columns."""
    small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at_text = docs.columns.index(text)

    def run(batches):
        drop_caches()
        part, made = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3)
        held, size = [], 0

        def flush():
            raws, keys, rest = zip(*held, strict=True)
            flat = [r for x in raws for r in x]
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(rest)
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), *[pa.array([x], pa.binary()) for x in (pack.compress(b"".join(flat)), np.concatenate(keys).astype("<i8").tobytes(), np.array([len(x) for x in flat], "<i8").tobytes(), pack.compress(sink.getvalue().to_pybytes()))]], names=["block", "texts", "keys", "sizes", "rest"])

        for batch in batches:
            raws, lo, many = [utf8(t) for t in batch.column(at_text).to_pylist()], 0, 0
            for i, r in enumerate(raws):
                many += len(r)
                if size + many >= BLOCK or i + 1 == len(raws):
                    piece = batch.slice(lo, i + 1 - lo)
                    held.append((raws[lo : i + 1], piece.column(piece.num_columns - 1).to_numpy(), piece.drop_columns([names[at_text], "k"])))
                    size, lo, many = size + many, i + 1, 0
                    if size >= BLOCK:
                        yield flush()
                        held, size, made = [], 0, made + 1
        if held:
            yield flush()

    return docs.toDF(*names).withColumn("k", F.coalesce(F.col(names[docs.columns.index(key)]).cast("long"), F.lit(-(1 << 63)).cast("long"))).mapInArrow(run, "block long, texts binary, keys binary, sizes binary, rest binary")


def blocks_of(batch, ranges: int):
    unpack = zstandard.ZstdDecompressor()
    rows = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
    for i, block in enumerate(rows["block"]):
        trim_memory()
        yield i, block, Block(unpack.decompress(rows["texts"][i]), np.frombuffer(rows["keys"][i], "<i8"), np.frombuffer(rows["sizes"][i], "<i8"), ranges)


SENT = "bucket int, block long, n int, a binary, b binary, c binary"


def packed_rows(rows) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "n", "a", "b", "c"])


def keys_packed(keys: np.ndarray) -> bytes:
    """The least key, then distances to it in 4 bytes where that does."""
    base = int(keys.min())
    away = [int(keys.max()) - base < 1 << 32, keys - base]
    return np.array([base], "<i8").tobytes() + (away[1].astype("<u4") if away[0] else keys.astype("<i8")).tobytes()


def keys_unpacked(data: bytes, n: int) -> np.ndarray:
    base = np.frombuffer(data, "<i8", 1)[0]
    return np.frombuffer(data, "<u4", n, 8).astype(np.int64) + base if len(data) == 8 + 4 * n else np.frombuffer(data, "<i8", n, 8)


def send_anchors(ranges: int):
    def run(batches):
        for batch in batches:
            for _, block, x in blocks_of(batch, ranges):
                low, context, keys = x.h[x.first].astype("<u4"), x.context[x.first].astype("<u8"), x.smallest
                rows = [(int(b), block, int(hi - lo), low[lo:hi].tobytes(), context[lo:hi].tobytes(), keys_packed(keys[lo:hi])) for b, lo, hi in zip(x.buckets, x.cuts[:-1], x.cuts[1:], strict=True)]
                if rows:
                    yield packed_rows(rows)

    return run


def new_runs(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def judge_anchors(part: pd.DataFrame, most: int = HOT) -> pd.DataFrame:
    """Codes of a range's anchors: 1 settled (the context stands in a smaller document), 2 doubtful, 3 doubtful and of a hot gram, 0 alone."""
    low = np.concatenate([np.frombuffer(x, "<u4") for x in part["a"]])
    context = np.concatenate([np.frombuffer(x, "<u8") for x in part["b"]])
    keys = np.concatenate([keys_unpacked(x, n) for x, n in zip(part["c"], part["n"], strict=True)])
    order = np.lexsort((keys, context, low))
    l, c, k = low[order], context[order], keys[order]
    same, gram = new_runs(l, c), new_runs(l)
    same_at, gram_at = np.flatnonzero(same), np.flatnonzero(gram)
    least = k[same_at][np.cumsum(same) - 1]
    number = np.cumsum(gram) - 1
    contexts = np.add.reduceat(same.astype(np.int64), gram_at)
    differ = np.maximum.reduceat(k, gram_at) > np.minimum.reduceat(k, gram_at)
    hot = np.diff(np.append(gram_at, len(l))) > most
    doubtful = np.where((contexts > 1) & differ, np.where(hot, 3, 2), 0)[number]
    code = np.empty(len(order), np.uint8)
    code[order] = np.where(k > least, 1, doubtful)
    cuts = np.cumsum(part["n"].to_numpy())[:-1]
    return pd.DataFrame({"block": part["block"], "kind": np.int32(0), "bucket": part["bucket"], "reply": [zlib.compress(x.tobytes(), 1) for x in np.split(code, cuts)]})


def codes_of(x: Block, replies: dict) -> np.ndarray:
    parts = [np.frombuffer(zlib.decompress(replies[0, int(b)]), np.uint8) for b in x.buckets]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def replies_of(batch, i: int) -> dict:
    return {(r["kind"], r["bucket"]): r["reply"] for r in batch.column(batch.schema.get_field_index("replies"))[i].as_py() or []}


def runs_of(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    cut = np.flatnonzero(new_runs(values)).tolist() if len(values) else []
    return list(zip(cut, [*cut[1:], len(values)], strict=True))


def send_contexts(ranges: int):
    """Bytes of the doubtful contexts, with one byte to their left (or a 0 and a mark where there is none); strings of hot grams by their hash."""

    def run(batches):
        for batch in batches:
            for i, block, x in blocks_of(batch, ranges):
                code = codes_of(x, replies_of(batch, i))
                raw, rows = np.frombuffer(x.raw, np.uint8), []
                for b, lo, hi in zip(x.buckets, x.cuts[:-1], x.cuts[1:], strict=True):
                    pick = x.first[lo:hi][code[lo:hi] == 2]
                    if not len(pick):
                        continue
                    start, size = x.lo[pick], x.hi[pick] - x.lo[pick]
                    grid = start[:, None] + np.arange(REACH)[None, :]
                    text = np.where(np.arange(REACH)[None, :] < size[:, None], raw[np.minimum(grid, len(raw) - 1)], 0).astype(np.uint8)
                    doc = x.doc[pick]
                    left = np.where(start > x.ends[doc] - x.sizes[doc], raw[np.maximum(start - 1, 0)].astype(np.int64), 256)
                    head = np.stack([x.h[pick].astype("<u4").astype(np.int64), x.keys[doc], x.at[pick] - start, size, left], axis=1).astype("<i8")
                    rows.append((int(b), block, len(pick), head.tobytes(), text.tobytes(), b""))
                if (code == 3).any():
                    *_, h, least = x.hot_strings(code)
                    bucket = bucket_of(h, ranges).astype(np.int64)
                    for lo, hi in runs_of(bucket):
                        rows.append((int(bucket[lo]), block, hi - lo, h[lo:hi].tobytes(), keys_packed(least[lo:hi]), b"hot"))
                if rows:
                    yield packed_rows(rows)

    return run


def intervals(lcp: np.ndarray, left: np.ndarray, least: int):
    """(start, end, length, maximal, top) of the intervals of ``lcp`` (between neighbours) whose common prefix is at least ``least``.

    One scan with a stack over the enhanced suffix array.  An interval is maximal if
    the symbols to the left of its suffixes are not all the same, and top if no other interval holds it.
    """
    n = len(left)
    lcp, left = lcp.tolist(), left.tolist()
    stack: list[list] = []  # common prefix, first suffix, left symbol or -1 if several
    for i in range(1, n + 1):
        h = lcp[i - 1] if i < n else -1
        h = h if h >= least else -1
        at, symbol = i - 1, left[i - 1]
        while stack and stack[-1][0] > h:
            length, at, kind = stack.pop()
            kind = kind if kind == symbol else -1
            yield at, i, length, kind == -1, not stack and h < 0
            symbol = kind
            if stack and stack[-1][0] > h:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == symbol else -1
                symbol = stack[-1][2]
        if h >= least:
            if stack and stack[-1][0] == h:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == symbol else -1
            else:
                stack.append([h, at, symbol])


def enhanced_suffix_array(text: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the next) of suffixes cut to the columns of ``text``; those of different groups share nothing."""
    words = text.view(">u8").astype(np.uint64)
    order = np.lexsort((*[words[:, j] for j in range(words.shape[1] - 1, -1, -1)], group))
    t, g = text[order], group[order]
    equal = (t[1:] == t[:-1]).cumprod(axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return order, np.where(g[1:] == g[:-1], equal, 0)


def judge_strings(part: pd.DataFrame) -> pd.DataFrame:
    """For each string of a hot gram, whether it stands in a smaller document than in the block that sent it."""
    h = np.concatenate([np.frombuffer(x, "<u8") for x in part["a"]])
    key = np.concatenate([keys_unpacked(x, n) for x, n in zip(part["b"], part["n"], strict=True)])
    order = np.argsort(h, kind="stable")
    new = new_runs(h[order])
    least = np.minimum.reduceat(key[order], np.flatnonzero(new))
    taken = np.empty(len(h), np.uint8)
    taken[order] = least[np.cumsum(new) - 1] < key[order]
    cuts = np.cumsum(part["n"].to_numpy())[:-1]
    return pd.DataFrame({"block": part["block"], "kind": np.int32(2), "bucket": part["bucket"], "reply": [zlib.compress(x.tobytes(), 1) for x in np.split(taken, cuts)]})


def judge_doubtful(part: pd.DataFrame) -> pd.DataFrame:
    hot = part["c"] == b"hot"
    return pd.concat([judge(x) for judge, x in ((judge_contexts, part[~hot]), (judge_strings, part[hot])) if len(x)])


def judge_contexts(part: pd.DataFrame) -> pd.DataFrame:
    """For each context a mask: bit j is set if the string from its byte j on stands in a smaller document."""
    head = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 5) for x in part["a"]])
    text = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, REACH) for x in part["b"]])
    gram, key, _, size, left = head.T
    masks = np.zeros(len(head), np.uint64)
    done = np.argsort(gram, kind="stable")
    bounds = np.flatnonzero(new_runs(gram[done]))
    ends = np.append(bounds[1:], len(done))
    at = 0
    while at < len(bounds):  # whole groups, a few thousand contexts at a time: a group has ``HOT`` at most
        to = max(at + 1, int(np.searchsorted(ends, bounds[at] + 4000)))
        some = done[bounds[at] : ends[to - 1]]
        many = np.maximum(size[some] - MATCH + 1, 0)
        owner = np.repeat(some, many)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        # equal strings have the gram at the same place: suffixes of one gram meet by their distance to it
        place = gram[owner] * REACH + (head[owner, 2] - j + REACH // 2)
        columns = np.minimum(j[:, None] + np.arange(DEPTH)[None, :], REACH - 1)
        suffix = text[owner[:, None], columns]
        suffix[:, MATCH:][j[:, None] + np.arange(MATCH, DEPTH)[None, :] >= size[owner][:, None]] = 0
        before = np.where(j > 0, text[owner, np.maximum(j - 1, 0)], left[owner])
        order, lcp = enhanced_suffix_array(suffix, place)
        paired = np.zeros(len(order), bool)  # suffixes that share MATCH bytes with a neighbour
        paired[:-1] |= lcp >= MATCH
        paired[1:] |= lcp >= MATCH
        keep = np.flatnonzero(paired)
        if len(keep):
            order, lcp = order[keep], lcp[keep[:-1]]
            tops = np.array([a for a, _, _, _, top in intervals(lcp, before[order], MATCH) if top])
            k = key[owner[order]]
            least = np.minimum.reduceat(k, tops)[np.searchsorted(tops, np.arange(len(order)), side="right") - 1]
            hit = order[k > least]
            np.bitwise_or.at(masks, owner[hit], np.uint64(1) << j[hit].astype(np.uint64))
        at = to
    cuts = np.cumsum(part["n"].to_numpy())[:-1]
    return pd.DataFrame({"block": part["block"], "kind": np.int32(1), "bucket": part["bucket"], "reply": [x.astype("<u8").tobytes() for x in np.split(masks, cuts)]})


def removed_bytes(x: Block, replies: dict) -> np.ndarray:
    """A mask over the block's bytes."""
    code = codes_of(x, replies)
    change = np.zeros(len(x.raw) + 1, np.int32)
    whole = code[x.rank] == 1
    # within the block: a later document with the same context as the first
    whole |= x.keys[x.doc] > x.smallest[x.rank]
    np.add.at(change, x.lo[whole], 1)
    np.add.at(change, x.hi[whole], -1)
    by_rank = np.zeros(len(x.first), np.uint64)
    for b, lo, hi in zip(x.buckets, x.cuts[:-1], x.cuts[1:], strict=True):
        if (1, int(b)) in replies:
            by_rank[np.flatnonzero(code[lo:hi] == 2) + lo] = np.frombuffer(replies[1, int(b)], "<u8")
    # all anchors of a context, as they may stand twice in the smallest document
    marks = by_rank[x.rank]
    inside = np.flatnonzero(marks)
    marks = marks[inside]
    for j in range(WINDOW):
        hit = inside[(marks >> np.uint64(j)) & np.uint64(1) == 1]
        np.add.at(change, x.lo[hit] + j, 1)
        np.add.at(change, x.lo[hit] + j + MATCH, -1)
    if (code == 3).any():
        rank, j, number, h, least = x.hot_strings(code)
        bucket = bucket_of(h, x.ranges).astype(np.int64)
        taken = np.concatenate([np.frombuffer(zlib.decompress(replies[2, int(bucket[lo])]), np.uint8) for lo, _ in runs_of(bucket)]) > 0
        gone = taken[number] | (x.smallest[rank] > least[number])
        rank, j = rank[gone], j[gone]
        # all anchors of a context, which stand side by side
        opens = np.append(x.first, len(x.rank))
        many = opens[rank + 1] - opens[rank]
        anchor = np.repeat(opens[rank], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        start = x.lo[anchor] + np.repeat(j, many)
        np.add.at(change, start, 1)
        np.add.at(change, start + MATCH, -1)
    return np.cumsum(change[:-1]) > 0


def settled_blocks(docs: DataFrame, key: str, text: str, hot: int = HOT) -> tuple[DataFrame, int]:
    """Blocks with all replies, and the number of hash ranges."""
    spark = docs.sparkSession
    blocks = stored(make_blocks(docs, key, text), "blocks", "uncompressed")
    total = blocks.agg(F.sum(F.octet_length("texts"))).first()[0] or 0
    ranges = int(1 + 8 * total // RANGE)  # texts shrink to about a fifth, and anchors take as much as the texts
    small_batches(spark)
    kind = "block long, kind int, bucket int, reply binary"
    sent = blocks.select("block", "texts", "keys", "sizes").mapInArrow(send_anchors(ranges), SENT)
    codes = stored(by_bucket(sent, ranges, partial(judge_anchors, most=hot), kind), "codes")
    release_shuffles(spark)

    def told(replies):
        return replies.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "reply")).alias("replies"))  # at most three for each range

    doubtful = blocks.select("block", "texts", "keys", "sizes").join(told(codes).hint("shuffle_hash"), "block", "left").mapInArrow(send_contexts(ranges), SENT)
    masks = stored(by_bucket(doubtful, ranges, judge_doubtful, kind), "masks")
    release_shuffles(spark)
    return blocks.join(told(codes.union(masks)).hint("shuffle_hash"), "block", "left"), ranges


def removal_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    settled, ranges = settled_blocks(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "key", "text", hot)

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rest = batch.column(batch.schema.get_field_index("rest")).to_pylist()
            for i, _, x in blocks_of(batch, ranges):
                gone, raw, rows = removed_bytes(x, replies_of(batch, i)), np.frombuffer(x.raw, np.uint8), []
                keys = pa.ipc.open_stream(unpack.decompress(rest[i])).read_all().column(0).to_pylist()
                for k, a, b in zip(keys, (x.ends - x.sizes).tolist(), x.ends.tolist(), strict=True):
                    g = gone[a:b]
                    n = int(np.count_nonzero(g))
                    spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if n else 0
                    rows.append((k, b - a, n, spans, hashlib.sha256(raw[a:b][~g].tobytes() if n else x.raw[a:b]).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return settled.mapInArrow(run, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("key", key)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents and columns, texts without their removed bytes (a letter cut in the middle goes as well)."""
    settled, ranges = settled_blocks(docs, key, text)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at_text, kinds = docs.columns.index(text), docs.schema
    from pyspark.sql.types import StructField, StructType

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rest = batch.column(batch.schema.get_field_index("rest")).to_pylist()
            for i, _, x in blocks_of(batch, ranges):
                gone, raw, texts = removed_bytes(x, replies_of(batch, i)), np.frombuffer(x.raw, np.uint8), []
                for a, b in zip((x.ends - x.sizes).tolist(), x.ends.tolist(), strict=True):
                    g = gone[a:b]
                    texts.append((raw[a:b][~g].tobytes() if g.any() else x.raw[a:b]).decode("utf-8", "ignore"))
                table = pa.ipc.open_stream(unpack.decompress(rest[i])).read_all().combine_chunks()
                columns = {n: table.column(n).combine_chunks() for n in table.schema.names}
                columns[names[at_text]] = pa.array(texts)
                whole = [columns[n] if not isinstance(columns[n], pa.ChunkedArray) else pa.concat_arrays(columns[n].chunks) for n in names]
                yield pa.RecordBatch.from_arrays(whole, names=names)

    kind = StructType([StructField(n, f.dataType) for n, f in zip(names, kinds, strict=True)])
    return settled.mapInArrow(run, kind).toDF(*docs.columns)
