"""Language ID: which languages a document mixes, and how much of each.

A language is a distribution over hashed byte trigrams of lower-cased letters.  A
document's trigrams are taken to come from a mixture of languages;
expectation-maximisation finds the shares.  The set of languages grows one at a
time, as long as the log-likelihood gains more than ``PENALTY`` * log(n) / 2.

Learning reads about ``SAMPLE`` labelled documents in all (a hash of the id
decides, evenly over the languages); prediction reads the text alone.

Defined cases: null, empty and letterless texts are ``und`` with score 0; without
a labelled document all are ``und``; rows of equal id, or of null id, are judged by
their texts alone; an empty table gives an empty result; columns of other names aren't
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8
from .token_ids import groups_by_size

BINS, SAMPLE, PENALTY, ROUNDS = 1 << 15, 12_000, 12.0, 25
#: Bytes to letters: A-Z lowered, other ASCII to a blank.
FOLD = bytes((b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def grams(text: str | None) -> np.ndarray:
    """Bins of a text's byte trigrams, white space and signs as one blank each."""
    raw = b" ".join((b" " + utf8(text).translate(FOLD) + b" ").split()) if text else b""
    if not raw:
        return np.zeros(0, np.int64)
    x = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64)


def learn(docs: DataFrame, trained: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each bin by language)."""
    small_batches(docs.sparkSession)
    labelled = docs.where(trained & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), F.col(key).alias("k"))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row a language
    names = sorted(sizes)
    if not names:
        return [], np.zeros((0, BINS))
    share = {n: min(1.0, sample / len(names) / sizes[n]) for n in names}
    bound = F.lit(0.0)
    for n in names:
        bound = F.when(F.col("l") == n, F.lit(share[n])).otherwise(bound)
    drawn = labelled.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < bound * (1 << 20)).select("l", "t")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[l] = total.get(l, 0) + np.bincount(grams(t), minlength=BINS)
        for l, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["l", "b", "n"])

    counts = np.zeros((len(names), BINS))
    for r in drawn.mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toLocalIterator():  # languages x bins at most
        counts[names.index(r["l"]), r["b"]] = r["n"]
    probability = (counts + 0.02) / (counts.sum(axis=1, keepdims=True) + 0.02 * BINS)
    return names, np.log(probability)


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares and log-likelihood of a mixture of the rows of ``p`` (languages x distinct grams) for gram counts ``n``."""
    share = np.full(len(p), 1 / len(p))
    total = n.sum()
    for _ in range(rounds):
        joint = share[:, None] * p
        new = (joint / joint.sum(axis=0)) @ n / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(np.log(share @ p) @ n)


def languages(text: str | None, logp: np.ndarray) -> list[tuple[int, float]]:
    """(language, share), largest first; empty if the text has no letter or nothing was learned."""
    if not text or not len(logp) or not any(c.isalpha() for c in text):
        return []
    bins, n = np.unique(grams(text), return_counts=True)
    l = logp[:, bins]
    single = l @ n
    chosen, best = [int(single.argmax())], float(single.max())
    shares = np.ones(1)
    p = np.exp(l)
    cost = PENALTY * np.log(max(n.sum(), 2)) / 2
    while len(chosen) < len(logp):
        tried = [(mixture(p[[*chosen, k]], n), k) for k in range(len(logp)) if k not in chosen]
        (new, likelihood), k = max(tried, key=lambda x: x[0][1])
        if likelihood - best <= cost:
            break
        chosen, shares, best = [*chosen, k], new, likelihood
    order = np.argsort(-shares, kind="stable")
    return [(chosen[i], float(shares[i])) for i in order]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, langs): langs lists all languages found, as ``name:share``."""
    small_batches(docs.sparkSession)
    names, logp = model
    sent = docs.sparkSession.sparkContext.broadcast(logp.astype(np.float32))  # languages x BINS

    def run(batches):
        table = sent.value.astype(np.float64)
        for batch, texts in groups_by_size(batches):
            got = [languages(t, table) for t in texts]
            size = [len(t or "") for t in texts]
            top = [names[g[0][0]] if g else "und" for g in got]
            score = [g[0][1] * s / (s + 10) if g else 0.0 for g, s in zip(got, size, strict=True)]
            listed = [",".join(f"{names[k]}:{s:.3f}" for k, s in g) for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top), pa.array(score, pa.float64()), pa.array(listed)], names=["key", "lang_pred", "score", "langs"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t")).mapInArrow(run, "key long, lang_pred string, score double, langs string").withColumnRenamed("key", key)
