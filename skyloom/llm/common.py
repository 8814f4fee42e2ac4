"""What several corpus operators share: the shared folder, lineage cuts, words, components.

Shared folder.  Everything an operator writes between jobs goes below the folder
named by ``spark.checkpoint.dir``; only where that is unset and the master is local
is a temporary folder of this machine taken.
"""

from __future__ import annotations

import ctypes
import gc
import json
import math
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows and bytes of an Arrow batch that goes to Python.
ARROW_ROWS, ARROW_BYTES = 20_000, 8 << 20


_local: dict[str, str] = {}
#: What empties the cache that each operator's tasks keep in a worker.
_caches: dict[str, Callable[[], None]] = {}


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of bounded bytes, whatever their length.

    All operators set the same two values, so that it doesn't matter which did last.
    """
    ship(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that are over: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of this machine only where the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "at" not in _local:
        _local["at"] = tempfile.mkdtemp(prefix="skyloom-")
    return _local["at"]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote below the shared folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write and reread: the lineage ends in files that survive lost executors."""
    at = fresh_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(at)
    again = df.sparkSession.read.schema(df.schema).parquet(at)
    again._skyloom_path = at
    return again


def discard(df: DataFrame) -> None:
    """Remove the files behind a frame made by :func:`stored`; it can't be read any more."""
    remove_dir(df.sparkSession, df._skyloom_path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def spread(docs: DataFrame) -> DataFrame:
    """The rows dealt over all cores where a scan has fewer parts, as one of a file with one row group."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores else docs


def percentiles(key: str, count: int) -> Column:
    """An aggregate: at most ``count`` - 1 ascending bounds that split the keys about evenly."""
    shares = ", ".join(str(i / count) for i in range(1, count))
    return F.array_sort(F.array_distinct(F.expr(f"approx_percentile({key}, array({shares}), {20 * count})")))


def constant(values: list, kind: str) -> Column:
    """A list as one literal."""
    return F.from_json(F.lit(json.dumps(values)), kind)


class KeyRanges:
    """Ranges of a long key with about equally many rows, found and looked up in two levels.

    ``bounds[g]`` are the bounds inside the g-th coarse range, ``coarse`` those between
    coarse ranges; a bound belongs to the range below it, and null to the first range.
    Both lists have about the root of ``count`` members.
    """

    def __init__(self, docs: DataFrame, key: str, count: int):
        side = math.ceil(math.sqrt(max(count, 1)))
        keys = docs.select(F.col(key).cast("long").alias("k")).where("k is not null")
        self.coarse = keys.agg(percentiles("k", side).alias("b")).first()["b"] or [] if side > 1 else []
        self.bounds: list[list[int]] = [[] for _ in range(len(self.coarse) + 1)]
        if side > 1:
            for row in keys.groupBy(self._coarse(F.col("k")).alias("g")).agg(percentiles("k", side).alias("b")).collect():  # a row a coarse range
                self.bounds[row["g"]] = [x for x in row["b"] if x not in self.coarse]
        self.before = [0]
        for b in self.bounds:
            self.before.append(self.before[-1] + len(b) + 1)

    @property
    def count(self) -> int:
        return self.before[-1]

    def flat(self) -> list[int]:
        """All bounds in order."""
        out = list(self.bounds[0])
        for edge, inner in zip(self.coarse, self.bounds[1:], strict=True):
            out += [edge, *inner]
        return out

    def _coarse(self, key: Column) -> Column:
        return F.size(F.filter(constant(self.coarse, "array<bigint>"), lambda b: b < key)) if self.coarse else F.lit(0)

    def place(self, key: Column) -> Column:
        """Number of the range that holds a key."""
        if self.count == 1:
            return F.lit(0)
        g = self._coarse(key)
        return (F.get(constant(self.before, "array<int>"), g) + F.size(F.filter(F.get(constant(self.bounds, "array<array<bigint>>"), g), lambda b: b < key))).cast("int")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null has none."""
    return [] if text is None else utf8(text).lower().split()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def sliding(op: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over each window of ``width``; doubling, so log2(width) passes."""
    done = 1
    while done * 2 <= width:
        values = op(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return op(values[:-rest], values[rest:]) if rest else values


def components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(a, b) links between longs -> (node, root): root is the smallest node of the component.

    Alternating large-star and small-star steps; each round is written to the
    shared folder.  Nothing is collected but two numbers a round.  Raises if
    ``most_rounds`` don't suffice, rather than return an unfinished labelling.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = stored(small.where("a <> b").distinct(), name)
        discard(edges)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def trim_memory() -> None:
    """Give freed memory of this worker back to the machine, which it shares with the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def keeps_cache(owner: str, empty: Callable[[], None]) -> None:
    """Name what empties an operator's cache in this worker."""
    _caches[owner] = empty


def drop_caches(but: str | None = None) -> None:
    """Empty what tasks of other operators have left in this worker, which Spark uses again for theirs."""
    for owner, empty in _caches.items():
        if owner != but:
            empty()
    trim_memory()


def by_bucket(sent: DataFrame, count: int, judge, kind: str) -> DataFrame:
    """``judge`` (pandas in and out) over all rows of each bucket, which column 0 numbers from 0 to ``count`` - 1.

    A bucket is a partition of its own, so that nothing needs sorting; a task holds
    the packed rows of one bucket.
    """
    names = [f.split()[0] for f in kind.split(",")]

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for b in np.unique(at).tolist():
                held.setdefault(b, []).append(batch.filter(pa.array(at == b)))
        for b in sorted(held):
            out = judge(pa.Table.from_batches(held.pop(b)).to_pandas())
            yield from pa.Table.from_pandas(out[names], preserve_index=False).to_batches()
            del out
            trim_memory()

    return sent.repartitionById(count, F.col(sent.columns[0])).mapInArrow(run, kind)


def text_batches(batches, text: str = "text"):
    """(record batch, list of texts) for each Arrow batch."""
    for batch in batches:
        yield batch, batch.column(batch.schema.get_field_index(text)).to_pylist()


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
