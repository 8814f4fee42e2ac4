"""Near-duplicates by the exact Jaccard similarity of word shingles: SimHash links first, then a prefix join that misses no pair.

SimHash fingerprints of the shingle sets meet in the tables of a covering family; each
pair that is compared is checked by its sets.  That joins most copies, large groups
above all, but a pair of similarity 0.8 is about ten of 64 bits apart, often more, and
a covering family for ten bits has 2047 tables.  So a second step completes it: two
sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of each,
in whatever order all sets are sorted.  Shingles that are frequent in a sample go last,
so that few documents meet at a shingle; the sample decides what is compared, never
what is found.  Documents that SimHash has joined aren't compared again.

Documents of equal sets are one.  The sets lie in files of the shared folder, and a
document is named by its place there; a bucket of documents that share a shingle (or
the kept bits of a table) reads them, compares those not yet linked, and sends on a
spanning forest.

Defined cases: null and wordless texts have the empty set and link to each other
alone; a text of fewer than ``WIDTH`` words is one shingle; rows of null id link like
others; an empty table gives an empty result.  Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, drop_caches, fresh_dir, release_shuffles, remove_dir, small_batches, stored, trim_memory
from .ngram_trie import tokens_of
from .simhash import masks, signed
from .suffix_dedup import mixed
from .token_files import write_whole
from .token_ids import groups_by_size

#: Words of a shingle; least similarity as a fraction; bits of the SimHash step.
WIDTH, LEAST, RADIUS = 5, (4, 5), 3
#: Documents that the sample of shingle frequencies has about, and the most shingles that it names.
SAMPLE, NAMED = 4_000, 200_000
#: Rows of a prefix batch, about; hashes that a set read counts as besides its own, for what stands around them.
SENT_ROWS, AROUND = 100_000, 32
#: A place: number of the task's attempt, and of the set's first word in its file.
PLACE = 34
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    names, place, many = tokens_of(texts)
    h = names[place]
    factor = np.resize(ODD, width) + np.arange(width, dtype=np.uint64) * np.uint64(2)
    run = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        run += h[k : k + len(run)] * factor[k]
    run, out, at = mixed(run), [], 0
    for n in (many - 1).tolist():  # without the end token
        if n >= width:
            out.append(np.unique(run[at : at + n - width + 1]))
        else:
            out.append(mixed((h[at : at + n] * factor[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else np.zeros(0, np.uint64))
        at += n + 1
    return out


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The 64-bit SimHash of each set: a bit is 1 if set in over half of its hashes."""
    sizes = np.array([len(x) for x in sets], np.int64)
    some = np.flatnonzero(sizes)
    out = np.zeros(len(sets), np.uint64)
    if len(some):
        whole = np.concatenate([sets[i] for i in some])
        first = np.cumsum(sizes[some]) - sizes[some]
        ones = np.empty((len(some), 64), np.int32)
        for byte in range(8):  # a byte of all hashes at a time
            bits = np.unpackbits(((whole >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > sizes[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def write_sets(folder: str, key: str):
    """Over (key, text): (key, sh, n, place, fp) of each document; its set is written to this task's file."""

    def run(batches):
        drop_caches()
        task, part = TaskContext.get().taskAttemptId(), 0
        for batch, texts in groups_by_size(batches):
            sets = shingle_sets(texts)
            sizes = np.array([len(s) for s in sets], np.int64)
            # a group is a file; its number is a part of the place
            room = np.maximum(sizes, 1)  # the empty set has a place of its own too
            places = (np.int64(task) << PLACE) + (part << 20) + np.cumsum(room) - room
            if room.sum() >= 1 << 20 or part >= 1 << (PLACE - 20):
                raise ValueError("a file of shingle sets is too large for its place")
            marks = [int(mixed(s + np.uint64(0x51)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
            write_whole(folder, f"{task}-{part}.sets", np.concatenate([x if len(x) else np.zeros(1, np.uint64) for x in sets]).tobytes())
            part += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(places), pa.array(set_fingerprints(sets).view(np.int64))], names=[key, "sh", "n", "place", "fp"])

    return run


class Sets:
    """Reads sets by place and size; keeps the last ones read, up to ``most`` hashes."""

    def __init__(self, folder: str, most: int = 4_000_000):
        self.system, self.path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        self.most, self.held, self.kept = most, 0, {}

    def get(self, place: int, n: int) -> np.ndarray:
        found = self.kept.get(place)
        if found is None:
            task, rest = place >> PLACE, place & ((1 << PLACE) - 1)
            with self.system.open_input_file(f"{self.path}/{task}-{rest >> 20}.sets") as f:
                found = np.frombuffer(f.read_at(8 * n, 8 * (rest & ((1 << 20) - 1))), "<u8")
            if self.held + n + AROUND > self.most:
                self.kept, self.held = {}, 0
            self.kept[place] = found
            self.held += n + AROUND
        return found


def prefix_length(n: int, least: tuple[int, int] = LEAST) -> int:
    """So many shingles of a set of n > 0 meet those of every set that is similar enough."""
    return n - -(-least[0] * n // least[1]) + 1


def prefixes(folder: str, named, least: tuple[int, int]):
    """Over (place, n, label): (h, place, n, label) of the first shingles of each set, the rare ones first."""

    def run(batches):
        sets, (known, often) = Sets(folder, most=0), named.value  # each is read once

        def flush(held):
            h, *marks = zip(*held, strict=True)
            place, n, label = (np.array(x, np.int64) for x in marks)
            many = np.fromiter(map(len, h), np.int64, len(h))
            columns = np.concatenate(h).view(np.int64), np.repeat(place, many), np.repeat(n.astype(np.int32), many), np.repeat(label, many)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "place", "n", "label"])

        held, rows = [], 0
        for batch in batches:
            for place, n, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = sets.get(place, n)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, often[at], 0), kind="stable")]
                held.append((s[: prefix_length(n, least)].copy(), place, n, label))  # not a view, which would keep the whole set
                rows += len(held[-1][0])
                if rows >= SENT_ROWS:
                    yield flush(held)
                    held, rows = [], 0
        if held:
            yield flush(held)
        sets.kept.clear()
        trim_memory()

    return run


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared * least[1] >= least[0] * (len(both) - shared)


def bucket_links(folder: str, least: tuple[int, int]):
    """Over (h, place, n, label) sorted by (h, n, place): links (a, b) of labels that span what the buckets of a partition connect."""
    num, den = least

    def run(batches):
        sets, root = Sets(folder), {}

        def top(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        def judge(held, out):
            if sum(len(x[0]) for x in held) < 2:
                return
            places, sizes, own = (np.concatenate([x[k] for x in held]) for k in range(3))
            now = [top(x) for x in own.tolist()]
            if now.count(now[0]) == len(now):
                return
            low = np.searchsorted(sizes * den, sizes * num).tolist()  # shorter sets can't be similar enough
            joined: dict[int, list[int]] = {}  # members so far by label
            get = lambda i: sets.get(int(places[i]), int(sizes[i]))
            for j in range(len(places)):
                me = top(int(own[j]))
                for other in [x for x in joined if x != me]:
                    i = next((i for i in reversed(joined[other]) if i >= low[j] and similar(get(i), get(j), least)), None)
                    if i is not None:
                        a, b = sorted((me, other))
                        root[b] = a
                        out.append((int(own[i]), int(own[j])))
                        joined[a], me = joined.pop(other) + joined.pop(me, []), a
                joined.setdefault(me, []).append(j)

        held, held_h = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, p, n, label = (batch.column(i).to_numpy() for i in range(4))
            cut = np.append(0, np.flatnonzero(h[1:] != h[:-1]) + 1)
            size = np.diff(np.append(cut, len(h)))
            out = []
            for j in np.flatnonzero((size > 1) | np.isin(np.arange(len(cut)), (0, len(cut) - 1))).tolist():
                lo, hi = cut[j], cut[j] + size[j]
                if h[lo] != held_h:
                    judge(held, out)
                    held, held_h = [], h[lo]
                held.append((p[lo:hi].copy(), n[lo:hi].astype(np.int64), label[lo:hi].copy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
        out = []
        judge(held, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
        sets.kept.clear()
        trim_memory()

    return run


def frequent(reps: DataFrame, folder: str, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that two or more documents of a sample have."""
    share = max(1, reps.count() // sample)

    def run(batches):
        sets = Sets(folder, most=0)
        for batch in batches:
            for place, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(sets.get(place, n).view(np.int64))], names=["h"])
        sets.kept.clear()
        trim_memory()

    drawn = reps.where(F.pmod("sh", F.lit(share)) == 0).select("place", "n").mapInArrow(run, "h long")
    got = drawn.groupBy("h").agg(F.count("*").cast("int").alias("c")).where("c > 1").orderBy(F.desc("c"), "h").limit(NAMED).toPandas()  # NAMED rows at most
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["c"].to_numpy(np.int32)[order]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: tuple[int, int] = LEAST, radius: int = RADIUS) -> DataFrame:
    """(key, component_id): the smallest key that links of similarity ``least`` reach."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = fresh_dir(spark, "sets")
    marked = stored(docs.select(F.col(key).alias("s_key"), F.col(text).alias("s_text")).mapInArrow(write_sets(folder, "s_key"), f"s_key {docs.schema[key].dataType.simpleString()}, sh long, n int, place long, fp long"), "marked")
    reps = stored(marked.groupBy("sh", "n").agg(F.min("s_key").alias("rep"), F.min(F.struct("place", "fp")).alias("p")).select("sh", "n", "rep", "p.place", "p.fp"), "reps")
    some = reps.where("n > 0")

    def joined(sent: DataFrame, name: str) -> DataFrame:
        """(label, root) of labels that buckets of equal h connect."""
        met = sent.repartition("h").sortWithinPartitions("h", "n", "place").mapInArrow(bucket_links(folder, least), "a long, b long")
        found = stored(components(met, name).toDF("label", "root"), name)
        release_shuffles(spark)
        return found

    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks(radius))])
    by_bits = joined(some.select(F.explode(tables).alias("b"), "place", "n").select(F.xxhash64("b.t", "b.k").alias("h"), "place", "n", F.col("place").alias("label")), "by-bits")
    labelled = stored(reps.join(by_bits.withColumnRenamed("label", "place"), "place", "left").select("sh", "n", "rep", "place", F.coalesce("root", "place").alias("label")), "labelled")
    named = spark.sparkContext.broadcast(frequent(some, folder))  # NAMED shingles at most
    by_shingles = joined(labelled.where("n > 0").select("place", "n", "label").mapInArrow(prefixes(folder, named, least), "h long, place long, n int, label long"), "by-shingles")
    placed = labelled.join(by_shingles, "label", "left").select("sh", "n", "rep", F.coalesce("root", "label").alias("root"))
    least_key = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = stored(placed.join(least_key, "root").select("sh", "n", "component_id"), "classes")
    for done in (reps, by_bits, labelled, by_shingles):
        discard(done)
    remove_dir(spark, folder)
    return marked.select("s_key", "sh", "n").join(classes, ["sh", "n"]).select(F.col("s_key").alias(key), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose key is the smallest of their group, with all their columns; rows of null key all stay, as nothing names one of them."""
    kept = near_duplicates(docs, key, text).where((F.col("component_id") == F.col(key)) | F.col(key).isNull()).select(F.col(key).alias("kept_key")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["kept_key"]), "left_semi")
