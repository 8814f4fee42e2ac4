"""Document fingerprints: a threshold-scaled sketch of word shingles, in Spark expressions only.

A sketch keeps every distinct hash of five-word shingles that lies below a fixed
share of the hash range, and always the smallest hash, so that no text with a
word has an empty sketch.  Both parts merge: the union of two sketches' kept
hashes, with the smaller minimum, is the sketch of the joined shingle sets.
Containment of one text in another is the share of its hashes below the bound that
the other has; it needs no equal sizes.  A minimum above the bound is not compared,
as the other text needn't keep it: where a sketch has fewer than ``ENOUGH`` hashes
below the bound, the full shingle sets are compared, so that short texts are compared
whole.  The query keeps one hash in ``QUERY_SHARE``; a share of one keeps all, and
likenesses are then exact.

Defined cases: null is the empty text; a text of fewer than five words is one
shingle; a text without a word has the empty sketch, which is like itself (1.0)
and unlike any other (0.0); rows of equal id stand next to each other in the
order of their texts' hashes; a null id is lower than all others; columns of other
names aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyRanges, constant
from .quality_rules import words

WIDTH, SHARE = 5, 1
#: The query's share, and the hashes of a sketch that are enough to tell a likeness from.
QUERY_SHARE, ENOUGH = 4, 64
LOWEST = -(1 << 63)


def below(h: Column, share: int) -> Column:
    """Whether a hash lies in the kept part of the range; a share of one keeps all."""
    return h < LOWEST + (1 << 64) // share if share > 1 else h.isNotNull()


def sketch(text: Column, width: int = WIDTH, share: int = SHARE) -> Column:
    """Sorted array of the kept hashes; ``share`` 8 keeps one hash in eight."""

    def of(ws):
        count = F.greatest(F.size(ws) - (width - 1), F.lit(1))
        hashes = F.transform(F.slice(ws, 1, count), lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, width)]))
        return F.transform(F.array(hashes), lambda h: F.sort_array(F.array_distinct(F.concat(F.filter(h, lambda x: below(x, share)), F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull())))))

    return F.flatten(F.flatten(F.transform(F.array(words(text)), lambda ws: of(ws))))


def scaled(full: Column, share: int) -> Column:
    """The sketch of a text of which all hashes are at hand."""
    return F.filter(full, lambda x, i: below(x, share) | (i == 0)) if share > 1 else full


def merge(a: Column, b: Column, share: int = SHARE) -> Column:
    """The sketch of two shingle sets taken together."""
    both = F.sort_array(F.array_union(a, b))
    return F.filter(both, lambda x, i: below(x, share) | (i == 0))


def compared(kept: Column, share: int) -> Column:
    """The part of a sketch that any text with these shingles keeps."""
    return F.filter(kept, lambda x: below(x, share)) if share > 1 else kept


def likeness(a: Column, b: Column, share: int = SHARE) -> Column:
    """Estimated containment of the smaller set in the larger, 0 to 1; null where a sketch has nothing to compare."""
    empty, none = (F.size(a) == 0) & (F.size(b) == 0), (F.size(a) == 0) | (F.size(b) == 0)
    x, y = compared(a, share), compared(b, share)
    least = F.least(F.size(x), F.size(y))
    return F.when(empty, 1.0).when(none, 0.0).when(least > 0, F.size(F.array_intersect(x, y)) / least)


def settled(a: Column, b: Column, whole: Column, share: int, enough: int) -> Column:
    """:func:`likeness` of two sketches, or ``whole`` where one of them has fewer than ``enough`` hashes to compare."""
    sizes = F.least(F.size(compared(a, share)), F.size(compared(b, share)))
    return F.when(sizes >= enough, likeness(a, b, share)).otherwise(whole)


def text_likeness(s: Column, t: Column, a: Column, b: Column, share: int = SHARE, enough: int = ENOUGH) -> Column:
    """:func:`likeness` of two texts' sketches, or of their full shingle sets where a sketch has too few hashes to compare."""
    return likeness(a, b, share) if share == 1 else settled(a, b, likeness(sketch(s, share=1), sketch(t, share=1), 1), share, enough)


def containment(a: Column, b: Column, share: int = SHARE) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; null where ``a`` has nothing to compare."""
    x = compared(a, share)
    return F.when(F.size(a) == 0, 1.0).when(F.size(x) > 0, F.size(F.array_intersect(x, b)) / F.size(x))


def fingerprint_string(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """Each row with the text of the row of next lower key (after the lowest: the highest).

    Rows go to key ranges; the highest row of each range is also dealt to the
    range above as a guest, so that a range's lowest row meets its successor there.
    """
    ids = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    ranges = KeyRanges(ids, "k", buckets)
    tops = ids.groupBy(ranges.place(F.col("k")).alias("b")).agg(F.max(F.struct("k", "h")).alias("top")).orderBy("b").collect()  # one row a range
    top: list = [None] * ranges.count
    for at, row in enumerate(tops):
        top[row["b"]] = {"k": row["top"]["k"], "h": row["top"]["h"], "above": tops[(at + 1) % len(tops)]["b"]}
    rows = docs.select(F.col(key).cast("long").alias("d_key"), F.coalesce(F.col(text), F.lit("")).alias("d_text")).withColumns({"d_hash": F.xxhash64("d_text"), "d_place": ranges.place(F.col("d_key"))})
    mine = F.get(constant(top, "array<struct<k:bigint,h:bigint,above:int>>"), F.col("d_place"))
    highest = mine["k"].eqNullSafe(F.col("d_key")) & (mine["h"] == F.col("d_hash"))
    own = F.struct(F.col("d_place").alias("b"), F.lit(False).alias("guest"))
    dealt = rows.select("*", F.inline(F.when(highest, F.array(own, F.struct(mine["above"].alias("b"), F.lit(True).alias("guest")))).otherwise(F.array(own))))
    # within a range: own rows by falling key, then one guest row (of equal guests the first serves)
    w = Window.partitionBy("b").orderBy("guest", F.desc("d_key"), F.desc("d_hash"))
    return dealt.withColumn("next_text", F.lead("d_text").over(w)).where("not guest")


def sketch_and_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", bytes_a_range: int = 8 << 20, share: int = SHARE) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last half replaced by the next row's first code points."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    near = with_next(docs, key, text, 1 + total // bytes_a_range)
    half = (F.length("d_text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("d_text"), F.lit(1), F.length("d_text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    # sketches are made behind the exchange: with all hashes they are larger than the texts
    # each text is hashed once: short ones are compared whole
    out = near.select("d_key", "d_text", "next_text", edited.alias("e_text"))
    out = out.withColumns({"d_all": sketch(F.col("d_text"), share=1), "n_all": sketch(F.col("next_text"), share=1), "e_all": sketch(F.col("e_text"), share=1)})
    if share > 1:
        out = out.withColumns({f"{x}_kept": scaled(F.col(f"{x}_all"), share) for x in "dne"})
    kept = lambda x: F.col(f"{x}_kept" if share > 1 else f"{x}_all")

    def like(x, y):
        whole = likeness(F.col(f"{x}_all"), F.col(f"{y}_all"), 1)
        return whole if share == 1 else settled(kept(x), kept(y), whole, share, ENOUGH)

    return out.select(
        F.col("d_key").alias(key), F.length("d_text").cast("long").alias("n_chars"), F.sha2(F.encode("e_text", "utf-8"), 256).alias("edited_sha256"), fingerprint_string(kept("d")).alias("fingerprint"), fingerprint_string(kept("e")).alias("edited_fingerprint"),
        like("d", "e").alias("near_edited"), like("d", "n").alias("near_next"),
    )
