"""Named queries of transforms, smoothing and noise of vectors, a batch of rows at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import kernels as K
from .functions import transforms as X
from .operators import maps as M
from .plans import solve
from .registry import named, query, r, rounded
from .sources import samples as src


def by_rows(spark, d: str, f, kind: str) -> DataFrame:
    """A kernel over batches of vectors; it gives a frame from (label, vec_id, array)."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("tod"), F.col("vec_id").alias("det"), "embedding")

    def run(frames):
        for x in frames:
            if len(x):
                yield f(x["tod"].to_numpy(), x["det"].to_numpy(), np.stack(x["embedding"].to_numpy()).astype(float))

    return e.mapInPandas(run, kind)


def grid(det: np.ndarray, names: dict[str, np.ndarray], digits: int = 5) -> pd.DataFrame:
    """Long form of arrays (vector, place...): det, the places k0, k1..., and the rounded values."""
    shape = next(iter(names.values())).shape
    places = np.indices(shape).reshape(len(shape), -1)
    return pd.DataFrame({"det": det[places[0]]} | {f"k{i}": p for i, p in enumerate(places[1:])} | {n: np.round(v.ravel(), digits) + 0.0 for n, v in names.items()})


def complex_grid(det: np.ndarray, ft: np.ndarray) -> pd.DataFrame:
    return grid(det, {"re": ft.real, "im": ft.imag})


def fourier_sql(sizes: tuple[int, ...], half: int) -> str:
    """Direct sums of the transform of vectors reshaped to ``sizes``."""
    parts, rest = [], 64
    for n in sizes:
        rest //= n
        parts.append(f"(samp // {rest}) % {n}")
    ks = [f"k{i}" for i in range(len(sizes))]
    limits = [*sizes[:-1], half]
    phase = " + ".join(f"{k} * ({p}) / {n}.0::DOUBLE" for k, p, n in zip(ks, parts, sizes, strict=True))
    tables = ", ".join(f"(SELECT unnest(generate_series(0, {m - 1})) AS {k})" for k, m in zip(ks, limits, strict=True))
    keys = ", ".join(f"CAST({k} AS BIGINT) AS {k}" for k in ks)
    return f"SELECT det, {keys}, {r(f'sum(dat * cos(2 * pi() * ({phase})))', 're', 5)}, {r(f'-sum(dat * sin(2 * pi() * ({phase})))', 'im', 5)} FROM samples, {tables} GROUP BY det, {', '.join(ks)}"


@query(fourier_sql((64,), 33), src.VECTORS_SQL)
def fft_rows(spark, d):
    """Half the transform of each vector."""
    return by_rows(spark, d, lambda tod, det, x: complex_grid(det, X.rows_to_half(x)), "det long, k0 long, re double, im double")


@query(fourier_sql((8, 8), 5), src.VECTORS_SQL)
def fft_planes(spark, d):
    """Transform of each vector as a plane of 8 by 8."""

    def run(tod, det, x):
        return complex_grid(det, np.stack([X.real_to_half(v.reshape(8, 8)) for v in x]))

    return by_rows(spark, d, run, "det long, k0 long, k1 long, re double, im double")


@query(fourier_sql((4, 4, 4), 3), src.VECTORS_SQL)
def fft_cubes(spark, d):
    """Transform of each vector as a cube of 4 by 4 by 4."""

    def run(tod, det, x):
        return complex_grid(det, np.stack([X.cube_to_half(v.reshape(4, 4, 4)) for v in x]))

    return by_rows(spark, d, run, "det long, k0 long, k1 long, k2 long, re double, im double")


SAME = f"SELECT det, samp AS k0, {r('dat', 'val', 5)} FROM samples"


@query(SAME, src.VECTORS_SQL)
def fft_rows_back(spark, d):
    return by_rows(spark, d, lambda tod, det, x: grid(det, {"val": X.half_to_rows(X.rows_to_half(x), 64)}), "det long, k0 long, val double")


@query(f"{SAME} WHERE samp < 63", src.VECTORS_SQL)
def fft_planes_back(spark, d):
    """Planes of 7 by 9 (an odd last axis), transformed and back."""

    def run(tod, det, x):
        return grid(det, {"val": np.stack([X.half_to_real(X.real_to_half(v[:63].reshape(7, 9)), even=False).ravel() for v in x])})

    return by_rows(spark, d, run, "det long, k0 long, val double")


@query(SAME, src.VECTORS_SQL)
def fft_cubes_back(spark, d):
    def run(tod, det, x):
        return grid(det, {"val": np.stack([X.half_to_cube(X.cube_to_half(v.reshape(4, 4, 4))).ravel() for v in x])})

    return by_rows(spark, d, run, "det long, k0 long, val double")


#: Basis of each kind in SQL, of a vector of 64 (j: place, k: frequency).
KINDS = {
    2: "2 * cos(pi() * (samp + 0.5::DOUBLE) * k / 64)", 3: "CASE WHEN samp = 0 THEN 1 ELSE 2 END * cos(pi() * samp * (k + 0.5::DOUBLE) / 64)", 4: "2 * cos(pi() * (samp + 0.5::DOUBLE) * (k + 0.5::DOUBLE) / 64)",
    11: "2 * sin(pi() * (samp + 1) * (k + 1) / 65)", 12: "2 * sin(pi() * (samp + 0.5::DOUBLE) * (k + 1) / 64)", 13: "CASE WHEN samp = 63 THEN 1 - 2 * (k % 2) ELSE 2 * sin(pi() * (samp + 1) * (k + 0.5::DOUBLE) / 64) END", 14: "2 * sin(pi() * (samp + 0.5::DOUBLE) * (k + 0.5::DOUBLE) / 64)",
}

for _kind, _basis in KINDS.items():

    def _transform(spark, d, kind=_kind):
        return by_rows(spark, d, lambda tod, det, x: grid(det, {"val": K.r2r(x, kind)}), "det long, k0 long, val double")

    query(f", q AS (SELECT unnest(generate_series(0, 63)) AS k) SELECT det, CAST(k AS BIGINT) AS k0, {r(f'sum(dat * {_basis})', 'val', 5)} FROM samples, q GROUP BY det, k", src.VECTORS_SQL)(named(f"r2r_kind_{_kind}", _transform))


DCT = "q AS (SELECT unnest(generate_series(0, 63)) AS k), y AS (SELECT tod, det, k, sum(CASE WHEN samp IN (0, 63) THEN 1 ELSE 2 END * dat * cos(pi() * samp * k / 63)) AS v FROM samples, q GROUP BY tod, det, k)"
#: A DCT-I back from columns k, v of a table f, halved at both ends where h is 0.5 there.
BACK = "sum(CASE WHEN k IN (0, 63) THEN 1 ELSE 2 END * v * cos(pi() * samp * k / 63)) / 126"


@query(f", {DCT} SELECT det, CAST(i AS BIGINT) AS k0, {r('sum(CASE WHEN k IN (0, 15) THEN 1 ELSE 2 END * v * cos(pi() * i * k / 15)) / 126', 'val', 5)}, 0.04::DOUBLE AS dt FROM y, (SELECT unnest(generate_series(0, 15)) AS i) WHERE k < 16 GROUP BY det, i", src.VECTORS_SQL)
def downsample(spark, d):
    """Vectors of a quarter of the length, from the lowest frequencies; the time between samples (0.01 before) grows as much."""
    return by_rows(spark, d, lambda tod, det, x: grid(det, {"val": K.downsample(x, 4)}), "det long, k0 long, val double").withColumn("dt", F.lit(0.01) * 4)


@query(f", {DCT}, kn AS (SELECT k AS j, exp(-0.5 * pow(k * sqrt(8 * ln(2)) / 8, 2)) AS g FROM q), s AS (SELECT sum(CASE WHEN j IN (0, 63) THEN 1 ELSE 2 END * g) AS t FROM kn), kd AS (SELECT k, sum(CASE WHEN j IN (0, 63) THEN 1 ELSE 2 END * g / t * cos(pi() * j * k / 63)) AS w FROM kn, s, q GROUP BY k), f AS (SELECT det, k, v * w AS v FROM y JOIN kd USING (k)) SELECT det, CAST(samp AS BIGINT) AS k0, {r(BACK, 'val', 5)} FROM f, (SELECT unnest(generate_series(0, 63)) AS samp) GROUP BY det, samp", src.VECTORS_SQL)
def smooth_vectors(spark, d):
    """Vectors convolved with a Gaussian under even reflection."""
    return by_rows(spark, d, lambda tod, det, x: grid(det, {"val": K.smooth(x, 8.0)}), "det long, k0 long, val double")


STEPS = "st AS (SELECT tod, det, abs(dat - lag(dat) OVER (PARTITION BY det ORDER BY samp)) AS s FROM samples), wt AS (SELECT tod, det, pow(median(s) / (2 * 0.4769362762044699), -2) AS w FROM st GROUP BY tod, det)"


def noise_rows(name: str, digits: tuple[int, int], **options):
    def run(tod, det, x):
        out = []
        for t, k, row in zip(tod, det, x, strict=True):  # a detector's noise is its own
            m = K.NOISE[name](row[None], **options)
            out.append((t, k, m.det_weights()[0], float((row[None] * m.apply(row[None])).sum())))
        return pd.DataFrame(out, columns=["tod", "det", "w", "chisq"])

    return lambda spark, d: rounded(rounded(by_rows(spark, d, run, "tod int, det long, w double, chisq double"), "w", digits=digits[0]), "chisq", digits=digits[1])


FILTERED = "o AS (SELECT det, samp, CASE WHEN samp IN (0, 63) THEN 0.5 ELSE 1 END * sum(CASE WHEN k IN (0, 63) THEN 1 ELSE 2 END * v * g * cos(pi() * samp * k / 63)) / 126 AS n FROM f, (SELECT unnest(generate_series(0, 63)) AS samp) GROUP BY det, samp)"

query(f", {STEPS}, {DCT}, f AS (SELECT det, k, v, CASE WHEN k BETWEEN 12 AND 26 THEN 0 ELSE 1 END AS g FROM y), {FILTERED} SELECT tod, det, {r('w', 'w', 6)}, {r('w * c', 'chisq', 4)} FROM (SELECT det, sum(dat * n) AS c FROM samples JOIN o USING (det, samp) GROUP BY det) JOIN wt USING (det)", src.VECTORS_SQL)(named("noise_model_white_notch", noise_rows("white_notch", (6, 4), low=0.1, high=0.2)))

query(f", {DCT}, b AS (SELECT tod, det, CASE WHEN k < 6 THEN 0 WHEN k < 25 THEN 1 ELSE 2 END AS b, k, v FROM y), m AS (SELECT det, b, avg(v * v) AS p FROM b GROUP BY det, b), f AS (SELECT tod, det, k, v, 1 / p AS g FROM b JOIN m USING (det, b)), {FILTERED} SELECT tod, det, {r('w', 'w', 5)}, {r('c', 'chisq', 4)} FROM (SELECT det, sum(dat * n) AS c FROM samples JOIN o USING (det, samp) GROUP BY det) JOIN (SELECT tod, det, avg(g) AS w FROM f GROUP BY tod, det) USING (det)", src.VECTORS_SQL)(named("noise_model_binned_det", noise_rows("binned_det", (5, 4), freqs=(0.05, 0.2))))


@query()
def power_spectrum_fit(spark, d):
    """White and red noise of each vector."""
    return by_rows(spark, d, lambda tod, det, x: pd.DataFrame({"tod": tod, "det": det} | dict(zip(("white", "red", "slope"), K.power_law_fit(x).T, strict=True))), "tod int, det long, white double, red double, slope double")


@query()
def power_components(spark, d):
    """Weights of a flat and a falling component in each vector's power."""
    shapes = np.stack([np.ones(63), 1 / np.arange(1, 64)])

    def run(tod, det, x):
        fit = np.stack([K.linear_power_fit(y, shapes) for y in K.dct1(x)[:, 1:] ** 2])
        return pd.DataFrame({"tod": tod, "det": det, "flat": fit[:, 0], "falling": fit[:, 1]})

    return by_rows(spark, d, run, "tod int, det long, flat double, falling double")


@query()
def common_and_scaled_polynomials(spark, d):
    """Polynomials that all vectors of a label share, and polynomials times a given matrix (here the labels' median)."""
    from .catalog import _per_tod

    def run(tod, det, x):
        scale = np.median(x, axis=0) * (1 + np.arange(len(x))[:, None] % 3)
        _, common, scaled, _ = K.fit_scaled_polynomials(x, scale, 2, 1)
        return pd.DataFrame({"tod": tod, "part": ["common"] * len(common) + ["scaled"] * len(scaled), "k": [*range(len(common)), *range(len(scaled))], "coef": np.concatenate([common, scaled])})

    return _per_tod(spark, d, run, "tod int, part string, k int, coef double")


_RING = "gr AS (SELECT i // 24 - 16 AS x, i % 24 - 12 AS y FROM (SELECT unnest(generate_series(0, 767)) AS i)), bm AS (SELECT sum(exp(-(x * x + y * y) / 2.0::DOUBLE)) AS s FROM gr), rg AS (SELECT CAST(floor(sqrt(x * x + y * y) / 3) AS INT) AS ring, x, y FROM gr WHERE sqrt(x * x + y * y) < 12), cv AS (SELECT ring, p.x, p.y, sum(exp(-(pow((p.x - q.x + 48) % 32 - 16, 2) + pow((p.y - q.y + 36) % 24 - 12, 2)) / 2.0::DOUBLE)) / any_value(s) AS v FROM rg q, gr p, bm GROUP BY ring, p.x, p.y), im AS (SELECT tod, ipix // 24 - 16 AS x, ipix % 24 - 12 AS y, sum(dat) AS m FROM samples GROUP BY tod, ipix)"


@query(f", {_RING} SELECT tod, ring, {r('sum(v * m)', 'val', 3)} FROM cv JOIN im USING (x, y) GROUP BY tod, ring")
def ring_sums(spark, d):
    """Sums of each map over beam-smoothed annuli."""
    from .catalog import _grid, _per_map

    x, y = _grid()
    beam = np.fft.ifftshift(np.exp(-(x**2 + y**2) / 2.0))
    rings = K.rings([0, 3, 6, 9, 12], x, y, (0, 0), beam)
    return rounded(_per_map(spark, d, lambda tod, image: pd.DataFrame({"tod": tod, "ring": range(len(rings)), "val": (rings * image).sum(axis=(1, 2))}), "tod string, ring int, val double"), "val", digits=3)


@query()
def sloped_ring_sums(spark, d):
    """Sums of each map over elliptical, tilted annuli that fall off from the ring values of a profile."""
    from .catalog import _grid, _per_map

    x, y = _grid()
    beam = np.fft.ifftshift(np.exp(-(x**2 + y**2) / 2.0))
    rings = K.sloped_rings([0, 3, 6, 9, 12], np.array([-4.0, -3.0, -1.0, -0.5]), x, y, (0, 0), beam, 1.2, 0.8, 0.3)
    return _per_map(spark, d, lambda tod, image: pd.DataFrame({"tod": tod, "ring": range(len(rings)), "val": (rings * image).sum(axis=(1, 2))}), "tod string, ring int, val double")


_N = 16
_SKY = "sk AS (SELECT event_id, radians(az) / (pi() / 2) AS tt, sin(asin((event_id % 1999) / 1000.0::DOUBLE - 0.999::DOUBLE)) AS z FROM samples), ud AS (SELECT event_id, tt, z, abs(z) AS za, floor(16 * (0.5 + tt - z * 0.75::DOUBLE)) AS u, floor(16 * (0.5 + tt + z * 0.75::DOUBLE)) AS w, 16 * sqrt(3 * (1 - abs(z))) AS side FROM sk)"


@query(f", {_SKY}, b AS (SELECT *, 17 + u - w AS ring, floor((tt - floor(tt)) * side) AS jp, floor((1 - (tt - floor(tt))) * side) AS jm FROM ud) SELECT event_id, CAST(CASE WHEN za <= 2.0::DOUBLE / 3 THEN 480 + (ring - 1) * 64 + floor((u + w - 14 - (((ring - 16) % 2 + 2) % 2)) / 2) % 64 WHEN z > 0 THEN 2 * (jp + jm + 1) * (jp + jm) + floor(tt * (jp + jm + 1)) % (4 * (jp + jm + 1)) ELSE 3072 - 2 * (jp + jm + 1) * (jp + jm + 2) + floor(tt * (jp + jm + 1)) % (4 * (jp + jm + 1)) END AS BIGINT) AS ipix FROM b")
def pixels_healpix(spark, d):
    """Equal-area pixels in rings."""
    e = src.events(spark, d)
    return e.select("event_id", C.healpix_ring(F.radians(F.col("az")), F.asin((F.col("event_id") % 1999) / 1000.0 - 0.999), _N).alias("ipix"))


_BITS = " + ".join(f"(((CAST(fx AS BIGINT) >> {k}) & 1) << {2 * k}) + (((CAST(fy AS BIGINT) >> {k}) & 1) << {2 * k + 1})" for k in range(4))


@query(f", {_SKY}, b AS (SELECT *, least(floor(tt), 3) AS qt, floor(u / 16) AS fd, floor(w / 16) AS fu FROM ud), c AS (SELECT *, least(floor((tt - qt) * side), 15) AS a, least(floor((1 - tt + qt) * side), 15) AS bb FROM b), e AS (SELECT event_id, CASE WHEN za <= 2.0::DOUBLE / 3 THEN CASE WHEN fd = fu THEN fd % 4 + 4 WHEN fd < fu THEN fd ELSE fu + 8 END WHEN z > 0 THEN qt ELSE qt + 8 END AS face, CASE WHEN za <= 2.0::DOUBLE / 3 THEN (w % 16 + 16) % 16 WHEN z > 0 THEN 15 - bb ELSE a END AS fx, CASE WHEN za <= 2.0::DOUBLE / 3 THEN 15 - (u % 16 + 16) % 16 WHEN z > 0 THEN 15 - a ELSE bb END AS fy FROM c) SELECT event_id, CAST(face AS BIGINT) * 256 + {_BITS} AS ipix FROM e")
def pixels_healpix_nest(spark, d):
    """Equal-area pixels in nested order."""
    e = src.events(spark, d)
    return e.select("event_id", C.healpix_nest(F.radians(F.col("az")), F.asin((F.col("event_id") % 1999) / 1000.0 - 0.999), _N).alias("ipix"))


@query(", c AS (SELECT event_id, 3.0::DOUBLE - samp % 200 * 0.0001::DOUBLE AS ra, 0.7::DOUBLE + det * 0.001::DOUBLE AS dec, pi() / 2 - 0.7::DOUBLE AS dp FROM samples), n AS (SELECT event_id, atan2(-cos(dec) * sin(ra - (3.0::DOUBLE + pi())), sin(dec) * cos(dp) - cos(dec) * sin(dp) * cos(ra - (3.0::DOUBLE + pi()))) AS phi, asin(greatest(-1, least(1, sin(dec) * sin(dp) + cos(dec) * cos(dp) * cos(ra - (3.0::DOUBLE + pi()))))) AS theta FROM c) SELECT event_id, CAST(round_even(-atan2(sin(phi), cos(phi)) / 0.0001::DOUBLE, 0) AS INT) * 400 + CAST(round_even(theta / 0.0001::DOUBLE, 0) AS INT) AS ipix FROM n")
def pixels_oblique(spark, d):
    """Plate carree about a reference point off the equator."""
    e = src.events(spark, d)
    ra, dec = 3.0 - F.col("samp") % 200 * 1e-4, 0.7 + F.col("det") * 1e-3
    return e.select("event_id", C.oblique_car_pixel(ra, dec, (2.98, 3.0, 0.7, 0.71), 1e-4, 400).alias("ipix"))


def _gauss_map(spark, p):
    """A Gaussian drawn on the grid: height, column, row, width."""
    i = spark.range(src.NX * src.NY)
    x, y = F.floor(F.col("id") / src.NY) - p[1], F.col("id") % src.NY - p[2]
    return i.select(F.col("id").alias("ipix"), (p[0] * F.exp(-(x * x + y * y) / (2 * p[3] * p[3]))).alias("val"))


def _gauss_sql(p) -> str:
    return f"{p[0]} * exp(-(pow(ipix // 24 - {p[1]}::DOUBLE, 2) + pow(ipix % 24 - {p[2]}::DOUBLE, 2)) / (2 * {p[3]}::DOUBLE * {p[3]}::DOUBLE))"


_P, _STEP = (3.0, 15.5, 11.5, 4.0), 0.5


@query(f"SELECT tod, det, samp, {r(_gauss_sql(_P), 'pred', 9)}, " + ", ".join(r(f"({_gauss_sql([v + _STEP * (i == k) for i, v in enumerate(_P)])} - {_gauss_sql([v - _STEP * (i == k) for i, v in enumerate(_P)])}) / {2 * _STEP}", f"d{k}", 9) for k in range(4)) + " FROM samples")
def map_function_derivatives(spark, d):
    """A map drawn from parameters, gathered, with two-sided numeric derivatives by each parameter."""
    got = solve.map_derivatives(src.events(spark, d), lambda p: _gauss_map(spark, p), _P, [_STEP] * 4, symmetric=True, npix=src.NX * src.NY)
    return rounded(got.select("tod", "det", "samp", "pred", "d0", "d1", "d2", "d3"), "pred", "d0", "d1", "d2", "d3", digits=9)


@query()
def fit_light_curve(spark, d):
    """A source whose height differs in three parts of each timestream, fitted with one Gaussian a part."""
    s = src.events(spark, d).select("tod", "det", ((F.col("az") - 180) / 100).alias("dx"), (F.col("event_id") % 41 / 20.0 - 1).alias("dy"), F.pmod(F.col("event_id"), F.lit(3)).alias("samp"))
    amp = F.element_at(F.array(F.lit(5.0), F.lit(3.0), F.lit(1.0)), (F.col("samp") + 1).cast("int"))
    s = s.withColumn("dat", amp * C.gauss(F.col("dx"), F.col("dy"), 0.2, 0.1, 0.3, 1.0)).withColumn("w", F.lit(100.0))
    p, chi, _ = solve.fit(s, ["gauss"] * 3, [0.1, 0.0, 0.4, 2.0] * 3, [4] * 3, free=[2, 3, 4, 1] * 3, iterations=20, windows=[(0, 1), (1, 2), (2, 3)])
    return spark.createDataFrame([(k, float(p[4 * k + 3]), chi) for k in range(3)], "part int, amp double, chisq double")


@query(f", m AS (SELECT ipix, avg(dat) AS v FROM samples GROUP BY ipix) SELECT tod, {r('sum(pow(dat - v, 2)) / 100', 'chisq', 4)} FROM samples JOIN m USING (ipix) GROUP BY tod")
def model_chisq(spark, d):
    """Chi squared of the data less a model's signal, by timestream."""
    s = src.events(spark, d)
    m = s.groupBy("ipix").agg(F.avg("dat").alias("val"))
    got = M.gather(s, m, npix=src.NX * src.NY)
    return rounded(got.groupBy("tod").agg((F.sum((F.col("dat") - F.col("val")) * (F.col("dat") - F.col("val"))) / 100).alias("chisq")), "chisq", digits=4)


def _sources(spark, d):
    """Two sources on pointing made of the events, without noise, and their samples' weight."""
    s = src.events(spark, d)
    s = s.select("tod", "det", ((F.col("az") - 180) / 100).alias("dx"), (F.col("event_id") % 41 / 20.0 - 1).alias("dy"), (F.col("dat") / 100).alias("dat"))
    return s.withColumn("w", F.lit(2.0))


_SOURCE = "sm AS (SELECT tod, (az - 180) / 100 AS x, (event_id % 41) / 20.0::DOUBLE - 1 AS y, dat / 100 AS d FROM samples)"
_GAUSS = "3.0::DOUBLE * exp(-0.5::DOUBLE * (pow((x - 0.2::DOUBLE) * cos(0.1::DOUBLE), 2) + pow(y - 0.1::DOUBLE, 2)) / pow(0.3::DOUBLE, 2))"


@query(f", {_SOURCE} SELECT {r(f'sum(2 * pow(d - {_GAUSS} - 2.0::DOUBLE * pow(1 + (pow((x + 0.1::DOUBLE) * cos(-0.2::DOUBLE), 2) + pow(y + 0.2::DOUBLE, 2)) / 0.25::DOUBLE, 0.5::DOUBLE - 1.5::DOUBLE * 0.7::DOUBLE), 2))', 'chisq', 3)} FROM sm")
def source_chisq(spark, d):
    """Chi squared of the data less an isobeta model and a Gaussian source."""
    chi, _, _ = solve.normal_equations(_sources(spark, d), ["isobeta", "gauss"], [5, 4], [-0.1, -0.2, 0.5, 0.7, 2.0, 0.2, 0.1, 0.3, 3.0])
    return spark.createDataFrame([(round(chi, 3),)], "chisq double")


_DERIVS = f"g AS (SELECT d, x, y, {_GAUSS} AS f FROM sm), dv AS (SELECT d - f AS res, f * (x - 0.2::DOUBLE) * pow(cos(0.1::DOUBLE), 2) / 0.09::DOUBLE AS p0, f * (y - 0.1::DOUBLE + pow(x - 0.2::DOUBLE, 2) * cos(0.1::DOUBLE) * sin(0.1::DOUBLE)) / 0.09::DOUBLE AS p1, f * (pow((x - 0.2::DOUBLE) * cos(0.1::DOUBLE), 2) + pow(y - 0.1::DOUBLE, 2)) / 0.027::DOUBLE AS p2, f / 3 AS p3 FROM g)"


@query(f", {_SOURCE}, {_DERIVS} SELECT " + ", ".join(r(f"sum(2 * res * p{i})", f"g{i}", 3) for i in range(4)) + ", " + ", ".join(r(f"sum(2 * p{i} * p{j})", f"c{i}{j}", 3) for i in range(4) for j in range(i, 4)) + " FROM dv")
def source_normal_equations(spark, d):
    """Gradient and curvature of a Gaussian source's four parameters."""
    _, g, c = solve.normal_equations(_sources(spark, d), ["gauss"], [4], [0.2, 0.1, 0.3, 3.0])
    row = {f"g{i}": g[i] for i in range(4)} | {f"c{i}{j}": c[i, j] for i in range(4) for j in range(i, 4)}
    return spark.createDataFrame([tuple(round(float(v), 3) + 0.0 for v in row.values())], ", ".join(f"{n} double" for n in row))
