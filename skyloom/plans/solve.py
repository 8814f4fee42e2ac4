"""Conjugate gradients over timestreams whose noise needs a whole timestream: each step is one pass over stored blocks.

The noise model of a timestream is fitted once and kept beside its data.  The map is a
vector on the driver, which is sent to all tasks: for maps of over ``LARGEST`` pixels
use :mod:`skyloom.plans.mapset`, whose vectors are tables.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import NOISE
from ..operators import maps as M
from .mapset import kept

#: Pixels of the largest map that is sent to every task.
LARGEST = 20_000_000


def blocks(samples: DataFrame) -> DataFrame:
    """One row a detector: (tod, det, dat, ipix) with arrays by sample."""
    return samples.groupBy("tod", "det").agg(F.sort_array(F.collect_list(F.struct("samp", "dat", "ipix"))).alias("s")).select("tod", "det", F.col("s.dat").alias("dat"), F.col("s.ipix").alias("ipix"))


def rectangle(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, pixels, mask) of one timestream, as long as its longest detector: what a shorter one lacks is zero and False in the mask."""
    part = part.sort_values("det")
    sizes = part["dat"].map(len).to_numpy()
    mask = np.arange(sizes.max()) < sizes[:, None]
    d, pix = np.zeros(mask.shape), np.zeros(mask.shape, np.int64)
    d[mask], pix[mask] = (np.concatenate([np.asarray(x) for x in part[c]]) for c in ("dat", "ipix"))
    return d, pix, mask


def fitted(rows: DataFrame, noise: str = "white", **options) -> DataFrame:
    """(tod, det, w, held): each timestream's data with its fitted noise model, and its detectors' weights; ``held`` stands in one row of a timestream."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        d, pix, mask = rectangle(part)
        model = NOISE[noise](d, mask=mask, **options)
        det = part["det"].sort_values().to_numpy()
        held = [pickle.dumps((d, pix, mask, model))] + [None] * (len(det) - 1)
        return pd.DataFrame({"tod": part["tod"].iloc[0], "det": det, "w": model.det_weights(), "held": held})

    return rows.groupBy("tod").applyInPandas(run, f"tod {rows.schema['tod'].dataType.simpleString()}, det long, w double, held binary")


def normal_product(held: DataFrame, image: np.ndarray | None) -> DataFrame:
    """Scattered, noise-weighted data (``image`` None), or the same of a gathered map: no shuffle but that of the sums by pixel."""
    if image is not None and len(image) > LARGEST:
        raise ValueError("the map is too large to be sent to every task; solve it with skyloom.plans.mapset")
    sent = held.sparkSession.sparkContext.broadcast(image)

    def run(frames):
        for frame in frames:
            for raw in frame["held"]:
                d, pix, mask, model = pickle.loads(raw)
                out = model.apply(d if sent.value is None else sent.value[pix] * mask)
                some, inverse = np.unique(pix[mask], return_inverse=True)
                yield pd.DataFrame({"ipix": some, "val": np.bincount(inverse, out[mask])})

    return held.where("held is not null").select("held").mapInPandas(run, "ipix long, val double").groupBy("ipix").agg(F.sum("val").alias("val"))


def vector(image: DataFrame, npix: int) -> np.ndarray:
    """A map table on the driver; it has ``npix`` pixels at most."""
    out = np.zeros(npix)
    got = image.toPandas()
    out[got["ipix"].to_numpy()] = got["val"].to_numpy()
    return out


def pcg(rows: DataFrame, npix: int, noise: str = "white", iterations: int = 10, precon: np.ndarray | None = None, mask: np.ndarray | None = None, prior=None, x0: np.ndarray | None = None, tolerance: float = 0.0, **options) -> tuple[np.ndarray, list[float]]:
    """The map that solves the normal equations, and the residual after each step.  ``prior``: a function x -> Qx to be added."""
    mask = np.ones(npix) if mask is None else mask
    m = np.ones(npix) if precon is None else precon
    held = kept(fitted(rows, noise, **options), "timestreams")

    def a(x):
        y = mask * vector(normal_product(held, mask * x), npix)
        return y if prior is None else y + prior(x)

    b = mask * vector(normal_product(held, None), npix)
    x = np.zeros(npix) if x0 is None else x0.copy()
    r = b - (a(x) if x.any() else 0)
    z = m * r
    p, zr, left = z.copy(), float(z @ r), [float(r @ r)]
    for _ in range(iterations):
        if zr == 0 or left[-1] <= tolerance * left[0]:
            break
        ap = a(p)
        step = zr / float(p @ ap)
        x += step * p
        r -= step * ap
        z = m * r
        zr, before = float(z @ r), zr
        p = z + zr / before * p
        left.append(float(r @ r))
    return x, left


def damping(value: float, success: bool) -> float:
    if success:
        return 0.0 if value < 0.2 else value / np.sqrt(2)
    return 1.0 if value == 0 else 2 * value


def gauss_derivs(p, x, y):
    """Value and derivatives by x0, y0, sigma, amplitude."""
    c = np.cos(p[1])
    dx, dy = (x - p[0]) * c, y - p[1]
    r2 = dx**2 + dy**2
    f = p[3] * np.exp(-0.5 * r2 / p[2] ** 2)
    by_y = f * (dy + dx * (x - p[0]) * np.sin(p[1])) / p[2] ** 2
    return f, np.stack([f * dx * c / p[2] ** 2, by_y, f * r2 / p[2] ** 3, f / p[3] if p[3] else np.exp(-0.5 * r2 / p[2] ** 2)])


def isobeta_derivs(p, x, y):
    """Value and derivatives by x0, y0, theta, beta, amplitude."""
    c = np.cos(p[1])
    dx, dy = (x - p[0]) * c, y - p[1]
    g = 1 + (dx**2 + dy**2) / p[2] ** 2
    e = 0.5 - 1.5 * p[3]
    f = p[4] * g**e
    by_r2 = f * e / g / p[2] ** 2
    return f, np.stack([-2 * by_r2 * dx * c, by_r2 * (-2 * dx * (x - p[0]) * np.sin(p[1]) - 2 * dy), -2 * by_r2 * (g - 1) * p[2], -1.5 * f * np.log(g), g**e])


def ellipse(p, x, y):
    """Squared elliptical radius about (x0, y0) with two axes and an angle, and its derivatives by these five."""
    (x0, y0, a, b, psi), off = p[:5], x - p[0]
    c, co, si = np.cos(y0), np.cos(psi), np.sin(psi)
    u, v = off * c * co + (y - y0) * si, (y - y0) * co - off * c * si
    ku, kv = 2 * u / a**2, 2 * v / b**2
    shift = off * np.sin(y0)
    by = [c * (kv * si - ku * co), -ku * (shift * co + si) + kv * (shift * si - co), -ku * u / a, -kv * v / b, ku * v - kv * u]
    return u * u / a**2 + v * v / b**2, np.stack(by)


def elliptical_gauss_derivs(p, x, y):
    """Value and derivatives by x0, y0, two widths, angle, amplitude."""
    q, by = ellipse(p, x, y)
    shape = np.exp(-0.5 * q)
    return p[5] * shape, np.concatenate([-0.5 * p[5] * shape * by, shape[None]])


def elliptical_isobeta_derivs(p, x, y):
    """Value and derivatives by x0, y0, two core radii, angle, beta, amplitude."""
    q, by = ellipse(p, x, y)
    e = 0.5 - 1.5 * p[5]
    shape = (1 + q) ** e
    f = p[6] * shape
    return f, np.concatenate([f * e / (1 + q) * by, np.stack([-1.5 * f * np.log1p(q), shape])])


MODELS = {"gauss": gauss_derivs, "isobeta": isobeta_derivs, "elliptical_gauss": elliptical_gauss_derivs, "elliptical_isobeta": elliptical_isobeta_derivs}


def freedom(free) -> np.ndarray:
    """(parameters, fitted) matrix: 0 is fixed, 1 moves alone, parameters of one greater number move as one."""
    free = np.asarray(free, int)
    columns = [[i] for i in np.flatnonzero(free == 1)] + [np.flatnonzero(free == g) for g in np.unique(free[free > 1])]
    out = np.zeros((len(free), len(columns)))
    for k, rows in enumerate(columns):
        out[rows, k] = 1
    return out


def normal_equations(samples: DataFrame, parts: list[str], counts: list[int], q, windows: list[tuple[int, int]] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(chi squared, gradient, curvature) of summed source models at parameters ``q``: one job, partitions emit their sums."""

    def run(frames):
        total = np.zeros(1 + len(q) + len(q) ** 2)
        for f in frames:
            x, y, d, w = (f[c].to_numpy() for c in ("dx", "dy", "dat", "w"))
            at, value, derivs = 0, 0, []
            for k, (kind, n) in enumerate(zip(parts, counts, strict=True)):
                v, g = MODELS[kind](q[at : at + n], x, y)
                if windows:
                    inside = f["samp"].between(windows[k][0], windows[k][1] - 1).to_numpy()
                    v, g = v * inside, g * inside
                value, at = value + v, at + n
                derivs.append(g)
            g, res = np.concatenate(derivs), d - value
            total += np.concatenate([[(w * res * res).sum()], g @ (w * res), ((g * w) @ g.T).ravel()])
        yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    rows = samples.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
    return float(rows[0]), rows[1 : 1 + len(q)], rows[1 + len(q) :].reshape(len(q), len(q))


def safe_inverse(matrix: np.ndarray, thresh: float = 1e-14) -> np.ndarray:
    """Inverse by singular values; those below ``thresh`` of the largest are left out."""
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    keep = np.abs(s) >= thresh * s.max()
    return vt.T @ (np.where(keep, 1 / np.where(keep, s, 1), 0)[:, None] * u.T)


def scaled_inverse(matrix: np.ndarray, safe: bool = False) -> np.ndarray:
    """Inverse of a matrix that is first scaled to a diagonal of ones."""
    d = np.abs(np.diag(matrix))
    scale = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 1e-10)
    both = np.outer(scale, scale)
    return both * (safe_inverse(both * matrix) if safe else np.linalg.pinv(both * matrix))


def fit(samples: DataFrame, parts: list[str], start: np.ndarray, counts: list[int], free: np.ndarray | None = None, iterations: int = 10, tolerance: float = 1e-4, limits: dict[int, tuple[float, float]] | None = None, windows: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """Damped least squares of summed source models to (tod, det, dx, dy, dat, w) samples: (parameters, chi squared, errors).

    Each step is one job: partitions emit their normal equations, which are summed.
    ``free``: what :func:`freedom` takes.  ``limits``: parameter -> (low, high); one that reaches an end stays there, and those tied to it.
    ``windows``: for each part the samples [first, end) in which it shines, as for a light curve; then the samples have a column ``samp``.
    """
    samples = kept(samples.select("dx", "dy", "dat", "w", *(["samp"] if windows else [])), "fit")  # read again in each step
    p = np.array(start, float)
    free = np.ones(len(p), int) if free is None else np.asarray(free, int)
    move = freedom(free)

    def equations(q):
        return normal_equations(samples, parts, counts, q, windows)

    chi, grad, curve = equations(p)
    lam = 0.0
    for _ in range(iterations):
        if not move.shape[1]:
            break
        c = move.T @ curve @ move
        scale = np.sqrt(np.maximum(np.diag(c), 1e-300))
        c = c / np.outer(scale, scale)
        step = np.linalg.solve(c + lam * np.diag(np.diag(c)), move.T @ grad / scale) / scale
        q = p + move @ step
        ends = [i for i, (lo, hi) in (limits or {}).items() if not lo < q[i] < hi]
        for i in ends:
            q = q + (move @ move[i]) * (np.clip(q[i], *limits[i]) - q[i])
        new = equations(q)
        good = new[0] < chi
        done = good and chi - new[0] < tolerance and lam == 0
        if good:
            p, (chi, grad, curve) = q, new
            move = move[:, ~move[ends].any(axis=0)] if ends else move
        lam = damping(lam, bool(good))
        if done:
            break
    errors = np.zeros(len(p))
    errors[:] = move @ np.sqrt(np.diag(np.linalg.pinv(move.T @ curve @ move)))
    return p, float(chi), errors


def map_derivatives(samples: DataFrame, draw, parameters, steps, symmetric: bool = False, npix: int | None = None) -> DataFrame:
    """Samples with ``pred``, the gathered map ``draw(parameters)``, and ``d0``, ``d1``...: its numeric derivatives by each parameter."""
    p = np.array(parameters, float)
    image = draw(p).withColumnRenamed("val", "pred")
    for k, step in enumerate(steps):
        move = np.eye(len(p))[k] * step
        ahead = draw(p + move).withColumnRenamed("val", "_a")
        image = image.join(ahead, "ipix")
        if symmetric:
            image = image.join(draw(p - move).withColumnRenamed("val", "_b"), "ipix").withColumn(f"d{k}", (F.col("_a") - F.col("_b")) / (2 * step)).drop("_a", "_b")
        else:
            image = image.withColumn(f"d{k}", (F.col("_a") - F.col("pred")) / step).drop("_a")
    names = ["pred", *[f"d{k}" for k in range(len(p))]]
    small = npix is not None and npix <= M.SMALL_MAP
    return samples.join(F.broadcast(image) if small else image, "ipix", "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
