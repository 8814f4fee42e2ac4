"""Quality rules as a short-circuit cascade, in Spark expressions only.

Each rule is a condition under which a document is rejected.  On a sample, the time
that each rule takes is measured, and which rules reject each document.  The rule of
most rejections per second comes first; then, of the documents that are left, the one
of most rejections per second, and so on.  The rules stand in one CASE in that order,
so that a document pays only for the rules up to the first that rejects it.  The order
never changes a verdict.

Defined cases: a null or empty text has no words and is rejected by
``min_words``; repeated rows are judged alike; columns of other names, also
clashing ones, are kept as they are; an empty table stays empty.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_dup_lines(text: Column) -> Column:
    """Lines (split at \\n) with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(ws: Column, width: int = 3) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more in the text.

    Windows are compared by their 64-bit hash: sorted (hash, position) pairs put
    equal windows side by side, and the covered positions are summed in order.
    """
    count = F.size(ws) - (width - 1)
    keys = F.transform(F.slice(ws, 1, F.greatest(count, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, width)]).alias("h"), i.alias("i")))
    pairs = F.sort_array(keys)

    def hits(p):
        same = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(at):
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
                           lambda s, i: F.struct((s["n"] + (i + width) - F.greatest(s["end"], i)).cast("long").alias("n"), (i + width).alias("end")), lambda s: s["n"])

    # each helper array is bound once by a one-element transform, so it isn't computed again for every element
    bound = F.transform(F.array(pairs), lambda p: F.transform(F.array(hits(p)), covered))
    return F.when(count > 1, F.get(F.get(bound, F.lit(0)), F.lit(0))).otherwise(F.lit(0)).cast("long")


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the base verdict and most rules read (``q_words`` is the word list)."""
    ws = F.col("q_words")
    return docs.withColumn("q_words", words(F.col(text))).select(
        "*",
        F.size(ws).cast("long").alias("n_words"),
        F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        n_dup_lines(F.col(text)).alias("n_dup_lines"),
        n_repeat_words(ws).alias("n_repeat_words"),
    )


def count_expressions(text: Column, ws: Column) -> dict[str, Column]:
    """The base counts as expressions, which only the rules that read them compute."""
    whole = F.coalesce(text, F.lit(""))
    return {"n_words": F.size(ws), "word_chars": F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w)), "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)), "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(ws)}


def rules(text: Column, ws: Column, counts: dict[str, Column]) -> dict[str, Column]:
    """Production rules: name -> condition of rejection.  ``counts``: the base counts, as columns or expressions."""
    n = F.greatest(F.size(ws), F.lit(1))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return {
        "min_words": counts["n_words"] < 50,
        "repeat_words": 100 * counts["n_repeat_words"] > 50 * counts["n_words"],
        "symbols": 10 * counts["n_symbols"] > counts["n_words"],
        "dup_lines": 10 * counts["n_dup_lines"] > 3 * (F.regexp_count(text, F.lit("\n")) + 1),
        "word_length": ~(counts["word_chars"] / n).between(2, 14),
        "capitals": 10 * F.regexp_count(text, F.lit(r"\p{Lu}")) > 4 * letters,
        "shouting": 10 * F.regexp_count(text, F.lit("[!?]")) > 2 * counts["n_words"],
        "letters": 10 * F.size(F.filter(ws, lambda w: F.rlike(w, F.lit(r"\p{L}")))) < 7 * n,
    }


def greedy_order(patterns: dict[frozenset[str], int], cost: dict[str, float]) -> list[str]:
    """Rules by rejections per cost among the documents that the rules before have left, ties by name.

    ``patterns``: how many documents of the sample each set of rules rejects.
    """
    left, order = dict(patterns), []
    while len(order) < len(cost):
        gain = {n: sum(k for p, k in left.items() if n in p) / cost[n] for n in cost if n not in order}
        best = min(gain, key=lambda n: (-gain[n], cost[n] if not gain[n] else 0.0, n))
        order.append(best)
        left = {p: k for p, k in left.items() if best not in p}
    return order


def measured(sample: DataFrame, conditions: dict[str, Column], ready: Column) -> tuple[dict[frozenset[str], int], dict[str, float]]:
    """(documents by the set of rules that reject them, seconds of each rule beyond those of its input) on a sample.

    ``ready``: what all rules read; it is computed, so that its time can be taken off.
    """
    names = sorted(conditions)
    flags = sample.select(*[F.coalesce(conditions[n], F.lit(False)).alias(n) for n in names])
    patterns = {frozenset(n for n in names if r[n]): r["count"] for r in flags.groupBy(*names).count().collect()}  # at most two to the number of rules

    def seconds(x: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.max(x)).collect()
        return time.perf_counter() - began

    seconds(ready)  # compiled
    nothing = seconds(ready)
    return patterns, {n: max(seconds(F.struct(ready, conditions[n])) - nothing, 1e-3) for n in names}


def cascade_order(docs: DataFrame, key: str, text: str, conditions: dict[str, Column], ws: str, share: int) -> list[str]:
    """The order by one document in ``share`` (by hash), which is written once and read by every job; all documents where that is none."""
    drawn = docs.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(F.col(text).alias("q_sample"))
    sample = stored(drawn, "rules-sample")
    counted = sample.withColumn(text, F.col("q_sample")).withColumn(ws, F.when(F.monotonically_increasing_id() >= 0, words(F.col("q_sample"))))
    patterns, cost = measured(counted, conditions, F.size(F.col(ws)))
    discard(sample)
    return greedy_order(patterns, cost)


def cascade(conditions: dict[str, Column], order: list[str]) -> Column:
    """The first rule of the order that rejects, or null; later rules aren't evaluated."""
    out = F
    for name in order:
        out = out.when(conditions[name], F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def quality_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_share: int = 128) -> DataFrame:
    """(key, counts, base_failed, kept) of every document.  One document in ``sample_share``, by hash, sets the order."""
    docs = docs.select(F.col(key).alias("q_key"), F.col(text).alias("q_text"))
    scored = base_columns(docs, "q_text")
    whole, ws = F.coalesce(F.col("q_text"), F.lit("")), F.col("q_words")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = cascade_order(docs, "q_key", "q_text", rules(whole, ws, count_expressions(F.col("q_text"), ws)), "q_words", sample_share)
    conditions = rules(whole, ws, {c: F.col(c) for c in counts})
    first = cascade(conditions, order)
    failed = conditions["min_words"] | conditions["repeat_words"]
    return scored.select(F.col("q_key").alias(key), *counts, failed.alias("base_failed"), (~failed & first.isNull()).alias("kept"))


def quality_filter(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_share: int = 128) -> DataFrame:
    """The documents that no rule rejects, with all their columns.  Counts are computed only as far as the cascade goes."""
    held = "q_words"
    while held in {c.lower() for c in docs.columns}:  # a column of the table may have this name
        held += "_"
    whole, ws = F.coalesce(F.col(text), F.lit("")), F.col(held)
    conditions = rules(whole, ws, count_expressions(F.col(text), ws))
    order = cascade_order(docs, key, text, conditions, held, sample_share)
    # a filter would be pushed below the word list and repeat it inside every lambda; the row number, which is never negative, holds it back
    with_words = docs.withColumn(held, F.when(F.monotonically_increasing_id() >= 0, words(F.col(text))))
    return with_words.where(cascade(conditions, order).isNull()).drop(held)
