"""Byte-level BPE: overlapping chunks are pre-tokenised on their own, stitched, and the pieces encoded.

The splitter reads forward only, so from a position where a piece starts its later
pieces don't depend on what came before.  Two neighbouring chunks overlap; where
both have a boundary in the overlap (and the left chunk has a further whole piece
behind it, so that its end had no say) the left chunk's pieces end and the right
chunk's go on.  Where the overlap has no such position, the left pieces are made
anew over the chunks together.  Decoding concatenates the tokens' raw bytes.

Documents longer than ``LONG`` code points are dealt as chunk rows over all tasks
and stitched by document; shorter ones are chunked within their task.

Defined cases: null is the empty text and has no ids; rows of equal key (null too) are
encoded each; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8
from .token_ids import groups_by_size

CHUNK, OVERLAP, LONG, REMEMBERED = 16_384, 256, 65_536, 600_000

_made: dict[tuple[str, str], ByteBpe] = {}


class ByteBpe:
    """Encoder and decoder by a rank file; one per worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes[rank] = raw
        self.pattern, self.known = regex.compile(pattern), {}

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in _made:
            _made[path, pattern] = cls(path, pattern)
        return _made[path, pattern]

    def split(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        """Pieces of a text by way of chunks; equal to one pass over the whole."""
        if len(text) <= chunk + overlap:
            return self.pattern.findall(text)
        spans = [(a, text[a : a + chunk + overlap]) for a in range(0, len(text), chunk)]
        return stitch([(a, t, self.pattern.findall(t)) for a, t in spans], self.pattern.findall)

    def ids(self, pieces: list[str]) -> bytes:
        """Little-endian unsigned 32-bit ids of the pieces in order."""
        known, core = self.known, self.core
        if len(known) > REMEMBERED:
            known.clear()
        for p in set(pieces):
            if p not in known:
                known[p] = np.array(core.encode_single_piece(utf8(p)), "<u4").tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def starts_of(at: int, pieces: list[str]) -> np.ndarray:
    """Absolute start of each piece, and the end of the last."""
    return at + np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)


def stitch(chunks: list[tuple[int, str, list[str]]], findall) -> list[str]:
    """One list of pieces from (start, text, pieces) of overlapping chunks, in order.

    Where a chunk has no common boundary with what stands so far, the open text is
    split anew only when it has doubled, so that a long run takes time in proportion.
    """
    at, text, pieces = chunks[0]
    out: list[str] = []
    held, size = [text], len(text)  # the open text in parts, and how much of it ``pieces`` split
    done = size
    for next_at, next_text, next_pieces in chunks[1:]:
        common = np.zeros(0, np.int64)
        if done == size:
            left, right = starts_of(at, pieces), starts_of(next_at, next_pieces)
            common = np.intersect1d(left[:-1][left[1:] < at + size], right[:-1])
        if len(common):
            cut = int(common[0])
            out += pieces[: int(np.searchsorted(left, cut))]
            at, held, pieces = cut, [next_text[cut - next_at :]], next_pieces[int(np.searchsorted(right, cut)) :]
            size = done = len(held[0])
            continue
        more = next_text[at + size - next_at :]
        held.append(more)
        size += len(more)
        if size >= 2 * done:
            held = ["".join(held)]
            pieces, done = findall(held[0]), size
    if done < size:
        pieces = findall("".join(held))
    return out + pieces


RESULT = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NAMES = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]


def digest(coder: ByteBpe, raw: bytes) -> tuple[int, str, str]:
    return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(coder.decode(np.frombuffer(raw, "<u4"))).hexdigest()


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every document."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches):
        coder = ByteBpe.of(ranks, pattern)
        for batch, texts in groups_by_size(batches):
            got = [digest(coder, coder.ids(coder.split(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in zip(*got, strict=True)]], names=NAMES)

    short = docs.where(F.length("t") <= LONG).mapInArrow(run, RESULT)

    step, width = LONG // 2, LONG // 2 + OVERLAP
    rows = docs.where(F.length("t") > LONG).withColumn("row", F.monotonically_increasing_id())
    parts = rows.select("key", "row", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("t") - 1, F.lit(step)), lambda a: F.struct(a.alias("a"), F.substring(F.col("t"), a + 1, F.lit(width)).alias("t")))).alias("k", "c")).select("key", "row", F.col("c.a").alias("a"), F.col("c.t").alias("t"))

    def cut(batches):
        coder = ByteBpe.of(ranks, pattern)
        for batch in batches:
            sizes = [[len(p) for p in coder.split(t)] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.list_(pa.int32()))], names=["key", "row", "a", "t", "sizes"])

    def join(part: pd.DataFrame) -> pd.DataFrame:
        coder = ByteBpe.of(ranks, pattern)
        chunks = []
        for a, t, sizes in part.sort_values("a")[["a", "t", "sizes"]].itertuples(index=False):
            ends = np.cumsum(sizes).tolist()
            chunks.append((int(a), t, [t[e - n : e] for n, e in zip(sizes, ends, strict=True)]))
        raw = coder.ids(stitch(chunks, coder.pattern.findall))
        return pd.DataFrame([(part["key"].iloc[0], *digest(coder, raw))], columns=NAMES)

    dealt = parts.repartition("row", "a").mapInArrow(cut, "key long, row long, a int, t string, sizes array<int>")
    long = dealt.groupBy("row").applyInPandas(join, RESULT)
    return short.union(long).withColumnRenamed("key", key)
