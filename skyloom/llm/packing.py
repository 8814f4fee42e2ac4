"""Best-fit packing of documents into sequences, bettered by swap-based local search.

Documents longer than a sequence are cut so that only the first piece may be
shorter; full pieces are sequences of their own.  The other pieces are dealt by
hash into groups of about ``GROUP`` pieces; each group is packed by itself, and the
pieces of badly filled sequences of all groups are packed again, in as many groups as
they need, until one group holds them (or most are left again, as with lengths that
can't fill a sequence).  In a group the longest piece goes first, each to the fullest
bin that holds it.  Then underfull bins move
one or two pieces, or exchange one for one, two for one or one for two, whenever that
raises the sum of squared fills, until no bin has such a change or the volume of the
pieces allows no fewer bins.

Defined cases: null is the empty text and has the end id alone; rows of equal key
(null too) are packed each; an empty table gives an empty result; other columns aren't
read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_caches, small_batches, stored
from .token_ids import PieceEncoder, groups_by_size

LENGTH, GROUP = 2048, 30_000
#: A sequence with less than this share filled is packed again; and most times that this is done.
FILLED, LEVELS = 0.97, 6


def pieces(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of a document's pieces: full ones behind a first of the rest."""
    first = (n - 1) % length + 1
    return [first] + [length] * ((n - first) // length)


def best_fit(lengths: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers: falling length, each to the bin with the least room that holds it."""
    room: list[list[int]] = [[] for _ in range(length + 1)]
    some = 0  # bit r is set if a bin has r left
    bins: list[list[int]] = []
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = sizes[i]
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            at = room[r].pop()
            if not room[r]:
                some ^= 1 << r
            bins[at].append(i)
        else:
            r, at = length, len(bins)
            bins.append([i])
        room[r - n].append(at)
        some |= 1 << (r - n)
    return bins


def pair_sums(sizes: list[int]) -> dict[int, tuple[int, int]]:
    """Sum -> two sizes, for all pairs of a bin's pieces; a bin has few distinct sizes, as they sum up to its fill."""
    many = Counter(sizes)
    some = sorted(many)
    return {a + b: (a, b) for k, a in enumerate(some) for b in some[k if many[a] > 1 else k + 1 :]}


class Underfull:
    """Bins by what they can take: for each set of pieces given away, the room after it and its size."""

    def __init__(self, length: int):
        self.outs: list[dict[int, dict[int, tuple]]] = [{} for _ in range(length + 1)]
        self.some = 0  # bit r is set if a bin can have r left
        self.has: dict[int, list[tuple[int, int]]] = {}

    def add(self, k: int, gap: int, sizes: list[int]) -> None:
        outs = {0: ()} | pair_sums(sizes) | {a: (a,) for a in sizes}
        self.has[k] = [(gap + o, o) for o in outs]
        for r, o in self.has[k]:
            self.outs[r].setdefault(o, {})[k] = outs[o]
            self.some |= 1 << r

    def remove(self, k: int) -> None:
        for r, o in self.has.pop(k, ()):
            at = self.outs[r]
            del at[o][k]
            if not at[o]:
                del at[o]
            if not at:
                self.some ^= 1 << r

    def taker(self, n: int, fill: int, length: int, single: bool):
        """(left, out size, bin, pieces out) of the bin that ``n`` from a bin of ``fill`` fills best, or None.

        Left is its room afterwards; it must then be fuller than the giver was.
        """
        r = n
        while higher := self.some >> r:
            r += (higher & -higher).bit_length() - 1
            if length - (r - n) <= fill:
                break
            for o in sorted(o for o in self.outs[r] if o < n):  # the least out: the giver loses most
                for k, out in self.outs[r][o].items():
                    if single or len(out) < 2:
                        return r - n, o, k, out
            r += 1
        return None


def local_search(bins: list[list[int]], lengths: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """Moves and exchanges between underfull bins that raise squared fill; emptied bins go.

    The least filled bin gives as long as another can take one or two of its pieces,
    for none, one or (against one) two shorter ones.  Bins take turns until none has
    a change.
    """
    size = lengths.tolist()
    bins = [list(b) for b in bins]
    fill = [sum(size[i] for i in b) for b in bins]
    sizes_of = lambda k: [size[i] for i in bins[k]]
    index = Underfull(length)
    spare = 0
    for k in range(len(bins)):
        if fill[k] < length:
            index.add(k, length - fill[k], sizes_of(k))
            spare += length - fill[k]

    def pull(k: int, out: tuple[int, ...]) -> list[int]:
        got = []
        for n in out:
            at = next(x for x, i in enumerate(bins[k]) if size[i] == n)
            got.append(bins[k].pop(at))
        return got

    better = True
    while better:
        better = False
        queue = [(fill[k], k) for k in index.has]
        heapq.heapify(queue)
        while queue and spare >= length:
            was, donor = heapq.heappop(queue)
            if donor not in index.has or was != fill[donor]:
                continue  # full, or it has come in again
            own = sizes_of(donor)
            index.remove(donor)
            offers = [(n, (n,)) for n in sorted(set(own), reverse=True)] + sorted(pair_sums(own).items(), reverse=True)
            found = None
            for n, given in offers:
                taker = index.taker(n, fill[donor], length, len(given) == 1)
                if taker and (found is None or (taker[0], taker[1] - n) < found[0]):
                    found = (taker[0], taker[1] - n), given, taker
                    if not taker[0] and not taker[1]:
                        break
            if found is None:
                index.add(donor, length - fill[donor], own)
                continue
            (_, less), given, (_, _, k, out) = found
            index.remove(k)
            mine, theirs = pull(donor, given), pull(k, out)
            bins[k] += mine
            bins[donor] += theirs
            fill[k] -= less
            fill[donor] += less
            better = True
            for x in (k, donor):
                if 0 < fill[x] < length:
                    index.add(x, length - fill[x], sizes_of(x))
                    heapq.heappush(queue, (fill[x], x))
            if not fill[donor]:
                spare -= length
        if spare < length:
            break
    return [b for b in bins if b]


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every piece."""
    small_batches(docs.sparkSession)

    def run(batches):
        drop_caches(but="pieces")
        encoder = PieceEncoder.of(tokenizer)
        end = np.array([end_id], "<u4")
        for batch, texts in groups_by_size(batches):
            keys, out = batch.column(0).to_pylist(), []
            for k, x in zip(keys, encoder.batch(texts), strict=True):
                ids = memoryview(np.concatenate([np.frombuffer(x, encoder.wide).astype("<u4"), end])).cast("B")
                at = 0
                for p, n in enumerate(pieces(len(ids) // 4, length)):
                    out.append((k, p, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["key", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t")).mapInArrow(run, "key long, piece int, start long, length long, ids_crc32 long")


def packer(groups: int, level: int, length: int):
    """Over the pieces of a group g: their sequence and place there, and whether the sequence is filled so badly that it is packed again."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("key", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes, g = part["length"].to_numpy(), part["g"].to_numpy()
        bins = local_search(best_fit(sizes, length), sizes, length)
        where, offset, again = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                where[i], offset[i] = b, at
                at += sizes[i]
            again[items] = at < FILLED * length
        columns = {"sequence_id": pa.array((where * groups + g) * LEVELS + level), "offset": pa.array(offset), "again": pa.array(again)}
        for name, values in columns.items():
            part = part.append_column(name, values)
        return part.drop_columns("g")

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    cut = stored(cut_documents(docs, tokenizer, end_id, key, text, length), "pieces")
    names = [*cut.columns, "sequence_id", "offset"]
    # a full piece is a sequence; its number is below zero and counts up within its partition
    parts = [cut.where(F.col("length") == length).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = cut.where(F.col("length") < length)
    for level in range(LEVELS):
        many = rest.count()
        groups = 1 + many // group
        dealt = rest.select(*cut.columns, F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(groups)).cast("int").alias("g"))
        done = dealt.groupBy("g").applyInArrow(packer(groups, level, length), "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, again boolean")
        if groups == 1 or level == LEVELS - 1:
            parts.append(done.select(*names))
            break
        done = stored(done, "packed")
        if 2 * done.where("again").count() > many:  # lengths that don't fill a sequence, in whatever group
            parts.append(done.select(*names))
            break
        parts.append(done.where("not again").select(*names))
        rest = done.where("again").select(*cut.columns)
    return reduce(DataFrame.union, parts).withColumnRenamed("key", key)
