"""SimHash near-duplicates found by covering locality-sensitive hashing.

Bit i of a fingerprint is given the non-zero vector phi(i) of r+1 bits; for each
non-zero v of r+1 bits a table keeps the bits with odd <phi(i), v>.  Two
fingerprints that differ in at most r bits agree on all kept bits of some table,
because r vectors can't span r+1 dimensions: no pair within the radius is missed.

Only distinct fingerprints are compared.  A bucket is scanned in sorted order by
one pass over its partition; small buckets are compared pair by pair, larger ones
by looking up each member's neighbours (all flips of up to r dropped bits), which
is linear in the bucket.  Buckets over ``HOT`` members are counted first and never
gathered: their members' neighbours are looked up by a distributed equi-join.  A
bucket sends on a spanning forest of its links, which keeps every component.

Defined cases: null and wordless texts have fingerprint 0 and link like any
other; rows of equal id share nothing but what their fingerprints say; a null id is
never a component's id unless no member has another, and ``deduplicate`` keeps all rows
of null id, as nothing names one of them; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, record_batch, small_batches, stored, text_batches, words_of

WIDTH, SEED, RADIUS, BITS = 3, 42, 2, 64
HOT = 50_000
PAIRWISE = 256


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The unsigned 64-bit SimHash of one text."""
    ws = words_of(text)
    if not ws:
        return 0
    joined, ends, at = b" ".join(ws), [], -1
    for w in ws:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    hashed = xxhash.xxh64_intdigest
    if len(ws) <= width:
        hashes = [hashed(joined, SEED)]
    else:
        hashes = [hashed(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]  # noqa: B905
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(bits), 1 << 14):
        ones += bits[k : k + (1 << 14)].sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType

    def run(batches):
        for batch, texts in text_batches(batches, "s_text"):
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["s_key", "fp"])

    from pyspark.sql.types import LongType, StructType

    out = StructType().add("s_key", kind).add("fp", LongType())
    return docs.select(F.col(key).alias("s_key"), F.col(text).alias("s_text")).mapInArrow(run, out).withColumnRenamed("s_key", key)


def masks(radius: int = RADIUS) -> list[int]:
    """The kept bits of each of the 2**(r+1) - 1 tables."""
    top = 2 ** (radius + 1)
    phi = [1 + i % (top - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if bin(phi[i] & v).count("1") % 2) for v in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(mask: int, radius: int = RADIUS) -> list[int]:
    """All changes of 1 to ``radius`` bits that the mask drops."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [sum(c) for r in range(1, radius + 1) for c in combinations(free, r)]


def forest(members: np.ndarray, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, label) that span the components of one bucket's sorted distinct members."""
    m = len(members)
    if m <= PAIRWISE:
        apart = np.bitwise_count(members[:, None] ^ members[None, :])
        left, right = np.nonzero(np.triu(apart <= radius, 1))
    else:
        found = []
        for f in flips(mask, radius):
            wanted = members ^ np.uint64(f)
            at = np.minimum(np.searchsorted(members, wanted), m - 1)
            hit = np.flatnonzero((members[at] == wanted) & (at > np.arange(m)))
            found.append((hit, at[hit]))
        left, right = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    label = np.arange(m)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(m))
    return members[moved], members[label[moved]]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: A table of so many hot buckets at most is sent to all tasks.
FEW = 100_000


def bucket_links(radius: int = RADIUS):
    """Over (t, k, fp) sorted by (t, k), no bucket hot: links within each bucket."""
    table = masks(radius)

    def run(batches):
        held, held_key = [], None

        def flush():
            if sum(map(len, held)) > 1:
                yield record_batch(LINKS, [pa.array(x.view(np.int64)) for x in forest(np.unique(np.concatenate(held)), table[held_key[0]], radius)])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (batch.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = [0, *cut.tolist(), len(t)]
            out = []
            for j in [j for j in range(len(bounds) - 1) if bounds[j + 1] - bounds[j] > 1 or j in (0, len(bounds) - 2)]:
                lo, hi = bounds[j], bounds[j + 1]
                here = (int(t[lo]), int(k[lo]))
                if here != held_key:
                    out += flush()
                    held, held_key = [], here
                held.append(fp[lo:hi].copy())
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        yield from flush()

    return run


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(fp, root) for every fingerprint that has a link; root is the smallest of its component, as a signed long."""
    spark = distinct.sparkSession
    keyed = distinct.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius)])).alias("t", "k"), "fp")
    small_batches(spark)
    # buckets are counted before their members meet: a hot one is never gathered
    crowded = stored(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("t", "k"), "crowded")
    many = crowded.count()
    cold, far = keyed, None
    if many:
        marks = F.broadcast(crowded) if many <= FEW else crowded
        cold = keyed.join(marks, ["t", "k"], "left_anti").select("t", "k", "fp")
        warm = keyed.join(marks, ["t", "k"], "left_semi").select("t", "fp")
        probes = spark.createDataFrame([(t, signed(f)) for t, m in enumerate(masks(radius)) for f in flips(m, radius)], "t int, f long")
        asked = warm.join(F.broadcast(probes), "t").select("t", F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("f")).alias("b"))  # a few hundred flips a member
        far = asked.join(warm.select("t", F.col("fp").alias("b")), ["t", "b"]).select("a", "b")
    found = cold.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(bucket_links(radius), "a long, b long")
    return components(found if far is None else found.union(far), "simhash").withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(key, fp, component_id): the smallest key that links of at most ``radius`` bits reach."""
    marked = stored(fingerprints(docs, key, text), "fingerprints")
    reps = marked.groupBy("fp").agg(F.min(key).alias("rep"))
    linked = stored(link_fingerprints(reps.select("fp"), radius, hot), "linked")
    placed = reps.join(linked, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = placed.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(key, "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose key is the smallest of their group, with all their columns."""
    kept = near_duplicates(docs, key, text).where((F.col("component_id") == F.col(key)) | F.col(key).isNull()).select(F.col(key).alias("kept_key")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["kept_key"]), "left_semi")
