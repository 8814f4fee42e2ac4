"""Eigenmodes of blocks with many rows and few samples, from sums of outer products.

The strong modes of a block d (rows, samples) are those of d @ d.T or of d.T @ d alike.
The latter is a sum over rows, and so is all else that a model needs of the whole block;
rows are then treated one by one.  No task holds a block, and nothing has the size of its
rows squared.  What comes to the driver is a few (samples, samples) matrices for each block
of over ``WIDE`` rows; smaller blocks are taken whole, by a kernel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

#: Rows of a block that one task takes whole, and blocks whose sums a task holds at once.
WIDE, HELD = 1 << 15, 128


def blocks(e: DataFrame, most: int = WIDE) -> dict[int, int]:
    """Rows of each block that has more than ``most``; ``e`` is (tod, det, embedding)."""
    return {r["tod"]: r["count"] for r in e.groupBy("tod").count().where(F.col("count") > most).collect()}


def split(e: DataFrame, wide: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """(rows of wide blocks, the other rows)"""
    among = F.coalesce(F.col("tod").isin(list(wide)), F.lit(False))
    return e.where(among), e.where(~among)


def by_block(f):
    """A function of (tod, det, x) on batches of rows, for ``mapInPandas``."""

    def run(frames):
        for frame in frames:
            for tod, part in frame.groupby("tod"):
                yield f(int(tod), part["det"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(float))

    return run


def grams(e: DataFrame, weighed) -> dict[int, np.ndarray]:
    """For each block the sums of x.T @ (w * x) over its rows, one for each row w of weights; ``weighed`` gives (x, weights) of (tod, det, x)."""

    def sums(tod, det, x):
        x, weights = weighed(tod, det, x)
        return tod, np.concatenate([x.T @ (w[:, None] * x) for w in weights])

    def frame(tod, total):
        return pd.DataFrame({"tod": tod, "k": range(len(total)), "row": list(total)})

    def parts(frames):
        held: dict = {}
        for tod, got in by_block(sums)(frames):
            held[tod] = held[tod] + got if tod in held else got
            if len(held) > HELD:
                yield from (frame(*x) for x in held.items())
                held = {}
        yield from (frame(*x) for x in held.items())

    def totals(frames):  # rows come sorted by block
        at, total = None, {}

        def done():
            return pd.DataFrame({"tod": [at], "n": [len(total[0])], "total": [np.stack([total[k] for k in sorted(total)]).tobytes()]})

        for f in frames:
            for tod, k, row in zip(f["tod"], f["k"], f["row"], strict=True):
                if tod != at:
                    if total:
                        yield done()
                    at, total = tod, {}
                total[k] = total[k] + row if k in total else np.array(row)
        if total:
            yield done()

    part = e.mapInPandas(parts, "tod int, k int, row array<double>")
    got = part.repartition("tod").sortWithinPartitions("tod").mapInPandas(totals, "tod int, n int, total binary").collect()
    return {r["tod"]: np.frombuffer(bytes(r["total"])).reshape(-1, r["n"], r["n"]) for r in got}


def binned_noise(e: DataFrame, rows: dict[int, int], freqs, thresh: float, dt: float = 1.0) -> DataFrame:
    """(tod, det, w, chisq): :class:`kernels.BinnedEig` of each block, its detectors' weights and chi squared."""
    send = e.sparkSession.sparkContext.broadcast
    modes = {tod: K.modes_in_time(g[0], rows[tod], thresh) for tod, g in grams(e, plain).items()}
    along = send({tod: (v, K.dct1(v.T)) for tod, (_, v) in modes.items()})

    def powers(tod, x):
        v, shape = along.value[tod]
        y = K.dct1(x)
        edges = K.bins_of(freqs, x.shape[1], dt)
        return y, edges, K.binned_power(y - (x @ v) @ shape, edges)

    def weighed(tod, det, x):
        return x, K.inverted(powers(tod, x)[2]).T

    gains = {}
    for tod, sums in grams(e, weighed).items():
        power, v = modes[tod]
        n, size = v.shape[0], np.sqrt(np.maximum(power, 1e-300))
        edges, of, basis = K.bins_of(freqs, n, dt), v / size, K.dct1(np.eye(n))
        mode = K.binned_power(size[:, None] * K.dct1(v.T), edges)
        gains[tod] = np.hstack([of @ np.linalg.inv(np.diag(1 / np.maximum(mode[:, k], 1e-300)) + of.T @ sums[k] @ of) @ (of.T @ sums[k] @ basis[:, a:b]) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
    sent = send(gains)

    def run(tod, det, x):
        y, edges, power = powers(tod, x)
        ni = np.repeat(K.inverted(power), np.diff(edges), axis=1) * (y - x @ sent.value[tod])
        chisq = (x * K.halved(K.dct1(ni))).sum(axis=1) / (2 * (x.shape[1] - 1))
        return pd.DataFrame({"tod": tod, "det": det, "w": (1 / np.maximum(power, 1e-300)).mean(axis=1), "chisq": chisq})

    return e.mapInPandas(by_block(run), "tod int, det long, w double, chisq double")


def gapfill(e: DataFrame, rows: dict[int, int], bad, thresh: float = 5.0, rounds: int = 3, inner: int = 3) -> DataFrame:
    """(tod, det, samp, dat): :func:`kernels.gapfill_eig` of each block; ``bad`` gives the bad samples of (det, sample count)."""
    send = e.sparkSession.sparkContext.broadcast
    found: dict = {tod: [] for tod in rows}
    for _ in range(rounds):
        sent = send(found)

        def weighed(tod, det, x, sent=sent):
            return plain(tod, det, K.fill_rows(x, bad(det, x.shape[1]), sent.value[tod], inner))

        found = {tod: [*found[tod], K.modes_in_time(g[0], rows[tod], thresh)[1]] for tod, g in grams(e, weighed).items()}
    sent = send(found)

    def run(tod, det, x):
        n = x.shape[1]
        y = K.fill_rows(x, bad(det, n), sent.value[tod], inner)
        return pd.DataFrame({"tod": tod, "det": np.repeat(det, n), "samp": np.tile(np.arange(n), len(y)), "dat": y.ravel()})

    return e.mapInPandas(by_block(run), "tod int, det long, samp long, dat double")


def plain(tod, det, x):
    return x, np.ones((1, len(x)))
