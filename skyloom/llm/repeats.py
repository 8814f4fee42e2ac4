"""Maximal repeats of a corpus, each with all its occurrences, from common-prefix interval trees.

A repeat is a string of ``least`` bytes or more that stands twice or more.  It is maximal
if its occurrences differ (or end) to their left and to their right.

1. Each batch of texts goes to a file of the shared folder and sends the hash of every
   string of ``least`` bytes once, with the byte to its left if that is always the same.
2. Strings that stand twice, and that different bytes precede, can begin a maximal repeat;
   those inside a longer copy can't, so that few are left.
3. The places of these strings meet by hash.  Their suffixes are sorted with their common
   prefixes, as far as these go (read from the files); the intervals of the common-prefix
   tree whose left bytes differ are the maximal repeats that begin with the string.

Step 1 shuffles some 20 bytes for each byte of text; a string's places are held by one
task, with a few hundred bytes each.  This is a report on a corpus; the removal of
repeats (``suffix_dedup``) doesn't need it.

Defined cases: null is the empty text; repeats never cross documents, and what begins or
ends a text can't be extended there; rows of equal or null id are documents of their own;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, small_batches, stored, utf8
from .suffix_dedup import MATCH, WEIGHTS, base_powers, intervals, mixed, new_runs
from .token_files import write_whole
from .token_ids import groups_by_size

BATCH, SLICE, NAMES = 1_000_000, 256, ["name", "h", "n", "left"]


def string_hashes(raw: bytes, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, byte to the left or -1 at a text's start) of every string of ``least`` bytes within the texts that end at ``ends``."""
    x = np.frombuffer(raw, np.uint8)
    start = np.append(0, ends[:-1]) if len(ends) else ends
    place = np.concatenate([np.arange(a, b - least + 1) for a, b in zip(start.tolist(), ends.tolist(), strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    up, down = base_powers(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(WEIGHTS[x] * up[: len(x)], out=total[1:])
    h = mixed((total[place + least] - total[place]) * down[place])
    left = x[np.maximum(place - 1, 0)].astype(np.int32) if len(x) else np.zeros(0, np.int32)
    return place, h, np.where(np.isin(place, start), -1, left)


def write_batches(folder: str, least: int):
    """Over (key, text): (name, keys, ends, h, n, left), the distinct strings of each file as packed arrays."""

    def run(batches):
        task, part = TaskContext.get().taskAttemptId(), 0
        for batch, texts in groups_by_size(batches, BATCH):
            raws = [utf8(t) for t in texts]
            ends = np.cumsum([len(r) for r in raws])
            raw = b"".join(raws)
            name, part = f"{task}-{part}.raw", part + 1
            write_whole(folder, name, raw)
            _, h, left = string_hashes(raw, ends, least)
            order = np.argsort(h, kind="stable")
            h, left = h[order], left[order]
            first = np.flatnonzero(new_runs(h)) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(h)))
            low, high = (f.reduceat(left, first) if len(first) else left for f in (np.minimum, np.maximum))
            rows = pa.RecordBatch.from_arrays([pa.array([name] * len(first)), pa.array(h[first].view(np.int64)), pa.array(n), pa.array(np.where(low == high, low, -1).astype(np.int32))], names=NAMES)
            yield rows
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}|{a}|{b}|{'' if k is None else k}" for a, b, k in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), batch.column(0).to_pylist(), strict=True)]), pa.nulls(len(raws), pa.int64()), pa.nulls(len(raws), pa.int64()), pa.nulls(len(raws), pa.int32())], names=NAMES)

    return run


def reader(folder: str):
    system, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)

    def read(name: str, at: int, size: int | None = None) -> bytes:
        with system.open_input_file(f"{path}/{name}") as f:
            return f.read() if size is None else f.read_at(size, at)

    return read


def places(folder: str, least: int):
    """Over (name, texts, heads) of files: (h, name, at, end, start, key) of every place of the heads."""

    def run(batches):
        read = reader(folder)
        for batch in batches:
            for name, texts, heads in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = sorted((int(a), int(b), k) for a, b, k in (t.split("|") for t in texts))
                ends = np.array([b for _, b, _ in spans])
                at, h, _ = string_hashes(read(name, 0), ends, least)
                some = np.isin(h.view(np.int64), np.array(heads, np.int64))
                at, h = at[some], h[some]
                doc = np.searchsorted(ends, at, side="right")
                keys = [int(spans[i][2]) if spans[i][2] else None for i in doc.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([name] * len(at)), pa.array(at), pa.array(ends[doc]), pa.array(at - np.array([a for a, _, _ in spans])[doc]), pa.array(keys, pa.int64())], names=["h", "name", "at", "end", "start", "key"])

    return run


def shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else ()
    return int(differ[0]) if len(differ) else n


def groups_of(places: list[tuple[str, int, int, bool]], read, least: int):
    """(string, members) of the maximal repeats among suffixes (name, at, end, whether a byte stands before) that share their first bytes."""
    size = SLICE
    while True:
        text = [read(n, a, min(size, e - a)) for n, a, e, _ in places]
        order = sorted(range(len(places)), key=lambda i: text[i])
        lcp = np.array([shared(text[i], text[j]) for i, j in zip(order[:-1], order[1:], strict=True)], np.int64)
        if not len(lcp) or lcp.max() < size:
            break
        size *= 4  # some go on alike
    # what begins a text is unlike anything else to its left
    left = np.array([read(places[i][0], places[i][1] - 1, 1)[0] if places[i][3] else 256 + k for k, i in enumerate(order)]) if order else np.zeros(0, np.int64)
    for a, b, length, maximal, _ in intervals(lcp, left, least):
        if maximal:
            yield text[order[a]][:length], [order[k] for k in range(a, b)]


def judge(folder: str, least: int):
    """Over (h, name, at, end, start, key) sorted by h: (repeat, length, key, start) of all occurrences of maximal repeats."""

    def run(batches):
        read, held, held_h = reader(folder), [], None

        def flush():
            rows = []
            for string, members in groups_of([(r[1], r[2], r[3], r[4] > 0) for r in held], read, least) if len(held) > 1 else ():
                mark = xxhash.xxh64_intdigest(string) - (1 << 63)
                rows += [(mark, len(string), held[i][5], held[i][4]) for i in members]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["repeat", "length", "key", "start"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != held_h:
                    yield from flush()
                    held, held_h = [], row[0]
                held.append(row)
        yield from flush()

    return run


def maximal_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MATCH) -> DataFrame:
    """(repeat, length, key, start): every occurrence, by its first byte in the text, of every maximal repeat, named by a hash of its bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = fresh_dir(spark, "repeats")
    given = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows = stored(given.mapInArrow(write_batches(folder, least), "name string, h long, n long, left int"), "strings")
    strings = rows.where("h is not null")
    heads = strings.groupBy("h").agg(F.sum("n").alias("n"), F.min("left").alias("low"), F.max("left").alias("high")).where("n > 1 and (low = -1 or low < high)").select("h")
    wanted = strings.join(heads, "h", "left_semi").groupBy("name").agg(F.collect_set("h").alias("heads"))  # at most those of one file
    texts = rows.where("h is null").groupBy(F.substring_index("name", "|", 1).alias("name")).agg(F.collect_list(F.regexp_replace("name", r"^[^|]*\|", "")).alias("texts"))
    found = texts.join(wanted, "name").select("name", "texts", "heads").mapInArrow(places(folder, least), "h long, name string, at long, end long, start long, key long")
    return found.repartition("h").sortWithinPartitions("h", "name", "at").mapInArrow(judge(folder, least), "repeat long, length long, key long, start long").withColumnRenamed("key", key)
