"""Token ids in binary files: rANS blocks by one shared frequency table, in ascending key order.

Write: texts are encoded, dealt by key range, sorted and kept as ids; the counts of
all ids make the frequency table; each stretch of documents becomes one file.  The
number of ranges follows from the bytes of text.

A file: magic 'SKTG', blocks u32; for each block where it stands u64, the position of
its first id among all ids u64, documents u32, parts u32; then the blocks.  A block
has a row for each document with ids in it, column by column (key i64, the
document's first position u64, its length u32, whether the key is null u8), and the
coded ids (see ``rans``).  The table is the file ``table.freq`` (u32 a token id).  A
file is written under a temporary name and then renamed, so that a repeated task
leaves the same file.

Read: each part between two checkpoints of a block is decoded by itself, so a file is
read by as many tasks as it has parts; checksums of documents that cross parts are
put together.

Defined cases: null is the empty text and has the end id alone; null keys come before
all others; rows of equal key follow each other in the order of their ids; an empty
table gives no files and an empty result; other columns aren't read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyRanges, discard, fresh_dir, release_shuffles, small_batches, stored
from .rans import Coder, crc32_joined, table_of
from .token_ids import PieceEncoder, groups_by_size

HEAD = struct.Struct("<4sI")
BLOCK = np.dtype([("at", "<u8"), ("first", "<u8"), ("docs", "<u4"), ("parts", "<u4")])
BLOCK_IDS, FILE_IDS = 1 << 20, 1 << 23
#: Bytes of text in a key range.
RANGE = 32 << 20


def encoded(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(place, key, ids): number of the key range, and ids as little-endian u16 or u32 bytes, the end id last."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))  # a bound for each ``RANGE`` bytes

    def run(batches):
        encoder = PieceEncoder.of(tokenizer)
        end = np.array([end_id], encoder.wide).tobytes()
        for batch, texts in groups_by_size(batches):
            keys = batch.column(0)
            place = np.where(keys.is_null().to_numpy(False), 0, np.searchsorted(sent.value, keys.fill_null(0).to_numpy(), side="left"))
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), keys, pa.array([x + end for x in encoder.batch(texts)], pa.binary())], names=["place", "key", "ids"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t")).mapInArrow(run, "place int, key long, ids binary")


def _placed(batches):
    """Adds the partition and each row's bytes before it there."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
        ends = at + np.cumsum(size)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(ends - size)], names=["key", "ids", "part", "before"])
        at = int(ends[-1]) if len(ends) else at


def _filesystem(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_whole(uri: str, name: str, data: bytes) -> None:
    """One file, whole or not at all."""
    system, path = _filesystem(uri)
    system.create_dir(path, recursive=True)
    task = TaskContext.get()
    temporary = f"{path}/_{name}.{task.taskAttemptId() if task else 'driver'}"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    system.move(temporary, f"{path}/{name}")


def file_bytes(coder: Coder, first: int, keys: list[int | None], rows: list[np.ndarray], block_ids: int = BLOCK_IDS, **layout) -> bytes:
    """A file of documents that stand one after another from position ``first`` on."""
    ids = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    length = np.array([len(r) for r in rows], np.int64)
    end = np.cumsum(length)
    start = end - length
    null = np.array([k is None for k in keys], np.uint8)
    key = np.array([k or 0 for k in keys], "<i8")
    table, body = np.zeros(-(-len(ids) // block_ids), BLOCK), []
    at = HEAD.size + table.nbytes
    for b, lo in enumerate(range(0, len(ids), block_ids)):
        hi = min(lo + block_ids, len(ids))
        some = slice(int(np.searchsorted(end, lo, side="right")), int(np.searchsorted(start, hi, side="left")))
        coded = coder.encode(ids[lo:hi], **layout)
        body.append(b"".join([key[some].tobytes(), (first + start[some]).astype("<u8").tobytes(), length[some].astype("<u4").tobytes(), null[some].tobytes(), coded]))
        table[b] = (at, first + lo, some.stop - some.start, struct.unpack_from("<I", coded, 16)[0])
        at += len(body[-1])
    return b"".join([HEAD.pack(b"SKTG", len(table)), table.tobytes(), *body])


def block_table(read) -> np.ndarray:
    """The blocks of a file; ``read(at, size)`` gives its bytes."""
    magic, count = HEAD.unpack(read(0, HEAD.size))
    if magic != b"SKTG":
        raise ValueError("not a token file")
    return np.frombuffer(read(HEAD.size, count * BLOCK.itemsize), BLOCK)


DOCS = ("key", "start", "length", "null")


def block_docs(read, block) -> tuple[dict[str, np.ndarray], int]:
    """(columns of the documents with ids in a block, where the coded ids begin)."""
    n, at = int(block["docs"]), int(block["at"])
    raw = read(at, 21 * n)
    return dict(zip(DOCS, (np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64), np.frombuffer(raw, "<u4", n, 16 * n).astype(np.int64), np.frombuffer(raw, np.uint8, n, 20 * n) > 0), strict=True)), at + 21 * n


def read_part(coder: Coder, read, block, number: int) -> dict[str, np.ndarray]:
    """For each document with ids in a part of a block: its columns, how many of its ids come before, how many there are here, and their crc32."""
    docs, coded = block_docs(read, block)
    ids = coder.part(lambda at, size: read(coded + at, size), number)
    each = struct.unpack_from("<II", read(coded + 8, 8))  # lanes, steps a part
    first = int(block["first"]) + number * each[0] * each[1]
    some = np.flatnonzero((docs["start"] < first + len(ids)) & (docs["start"] + docs["length"] > first))
    docs = {n: x[some] for n, x in docs.items()}
    lo = np.maximum(docs["start"], first)
    hi = np.minimum(docs["start"] + docs["length"], first + len(ids))
    flat = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip((lo - first).tolist(), (hi - first).tolist(), strict=True)]
    return docs | {"before": lo - docs["start"], "here": hi - lo, "crc": np.array(crc, np.int64)}


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", bytes_a_range: int = RANGE) -> tuple[str, np.ndarray]:
    """Writes all documents' ids; returns the folder and the frequency table."""
    spark = docs.sparkSession
    encoder = PieceEncoder.of(tokenizer)
    wide, vocabulary = encoder.wide, max(encoder.library.get_vocab_size(), end_id + 1)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # key ranges from the keys alone: a range partitioner would encode all texts once more to sample them
    bounds = KeyRanges(docs, key, 1 + total // bytes_a_range).flat()
    dealt = encoded(docs, tokenizer, end_id, bounds, key, text).repartitionById(len(bounds) + 1, F.col("place")).select("key", "ids").sortWithinPartitions("key", "ids")
    ids = stored(dealt.mapInArrow(_placed, "key long, ids binary, part int, before long"), "ids")
    del dealt
    release_shuffles(spark)

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), wide)
            for lo in range(0, len(found), BLOCK_IDS):
                total += np.bincount(found[lo : lo + BLOCK_IDS], minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for row in ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():  # a row a token id at most
        counts[row["id"]] = row["n"]
    freq = table_of(counts)
    size = np.dtype(wide).itemsize
    totals = ids.groupBy("part").agg(F.sum(F.octet_length("ids")).alias("bytes")).orderBy("part").collect()  # a row a range
    base, at = np.zeros(len(bounds) + 1, np.int64), 0
    for row in totals:
        base[row["part"]] = at
        at += row["bytes"] // size
    base = spark.sparkContext.broadcast(base)
    folder = fresh_dir(spark, "tokens")
    write_whole(folder, "table.freq", freq.astype("<u4").tobytes())

    def write(batches):
        coder, held, keys, first, last, many, files = Coder(freq), [], [], 0, None, 0, 0

        def flush():
            write_whole(folder, f"{first:020d}.tok", file_bytes(coder, first, keys, held))

        for batch in batches:
            for k, x, part, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = int(base.value[part]) + before // size
                if keys and (start != last or many >= FILE_IDS):
                    flush()
                    held, keys, many, files = [], [], 0, files + 1
                if not keys:
                    first = start
                row = np.frombuffer(x, wide).astype(np.uint32)
                held.append(row)
                keys.append(k)
                many += len(row)
                last = start + len(row)
        if keys:
            flush()
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int32())], names=["files"])

    ids.mapInArrow(write, "files int").agg(F.sum("files")).collect()
    discard(ids)
    return folder, freq


def _joined(batches):
    """(key, start, n_tokens, ids_crc32) of documents whose parts follow each other in order."""
    start, done, crc = None, 0, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if start is None:
                start, done, crc = row["start"], 0, 0
            if (row["start"], row["before"]) != (start, done):
                raise ValueError("a part of a document is missing")
            crc, done = crc32_joined(crc, row["crc"], 4 * row["here"]), done + row["here"]
            if done == row["length"]:
                out.append((row["key"], start, done, crc))
                start = None
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["key", "start", "n_tokens", "ids_crc32"])
    if start is not None:
        raise ValueError("a part of a document is missing")


def read_tokens(spark: SparkSession, folder: str, freq: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document in the files."""
    small_batches(spark)
    path = _filesystem(folder)[1]

    def reader(name: str):
        f = _filesystem(folder)[0].open_input_file(f"{path}/{name}")
        return lambda at, size: f.read_at(size, at)

    def parts(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                name = uri.rsplit("/", 1)[1]
                many = block_table(reader(name))["parts"].astype(np.int64)
                block = np.repeat(np.arange(len(many)), many)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(block)), pa.array(block.astype(np.int32)), pa.array((np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32))], names=["name", "block", "part"])

    def decode(batches):
        coder = Coder(freq)
        for batch in batches:
            for name, block, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read = reader(name)
                got = read_part(coder, read, block_table(read)[block], part)
                yield pa.RecordBatch.from_arrays([pa.array(got["key"], mask=got["null"]), *[pa.array(got[n]) for n in ("start", "length", "before", "here", "crc")]], names=["key", "start", "length", "before", "here", "crc"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path")
    listed = stored(files.mapInArrow(parts, "name string, block int, part int"), "parts")
    many = max(listed.count(), 1)
    spread = max(1, min(many, 4 * spark.sparkContext.defaultParallelism + many // 16))  # 16 parts (of 2 ** 17 ids) a task in a large corpus
    rows = stored(listed.repartition(spread).mapInArrow(decode, "key long, start long, length long, before long, here long, crc long"), "decoded")
    discard(listed)

    kind = "key long, start long, n_tokens long, ids_crc32 long"
    whole = rows.where("here = length").select("key", "start", F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    crossing = rows.where("here < length").repartition("start").sortWithinPartitions("start", "before").mapInArrow(_joined, kind)  # a document has a row for each of its parts
    return whole.union(crossing).withColumnRenamed("key", key)
