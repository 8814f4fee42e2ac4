"""Named queries of map geometry, polarised maps, masks, and maps written to files and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geometry as G
from .operators import maps as M
from .plans.mapset import shared_folder
from .registry import query, r, rounded
from .sources import maps as files
from .sources import samples as src


def angle():
    return F.radians(F.col("az"))


WEIGHTS = "st AS (SELECT tod, det, abs(dat - lag(dat) OVER (PARTITION BY tod, det ORDER BY samp)) AS s FROM samples), wt AS (SELECT tod, det, 1 / (sigma * sigma) AS w FROM (SELECT tod, det, median(s) / (2 * 0.4769362762044699) AS sigma FROM st GROUP BY tod, det) WHERE sigma > 0)"
GRID = G.MapGrid.make((2.98, 3.02, 0.70, 0.73), 1e-4, equatorial=True)


def _pointing(spark, d):
    s = src.events(spark, d)
    ra = F.lit(2.98) + F.col("samp") % 397 * F.lit(1e-4) + F.lit(0.00003)
    return s, ra, F.lit(0.70) + F.floor(F.col("samp") / 7) % 293 * F.lit(1e-4) + F.lit(0.00004)


D = "(2.98::DOUBLE + (samp % 397) * 0.0001::DOUBLE + 0.00003::DOUBLE)", "(0.70::DOUBLE + ((samp // 7) % 293) * 0.0001::DOUBLE + 0.00004::DOUBLE)"


@query(f"SELECT event_id, CAST(round_even((3.02::DOUBLE - {D[0]}) / 0.0001::DOUBLE, 0) * {GRID.ny} + round_even(({D[1]} - 0.70::DOUBLE) / 0.0001::DOUBLE, 0) AS BIGINT) AS ipix FROM samples")
def pixels_equatorial(spark, d):
    """Plate carree whose reference point is on the equator."""
    s, ra, dec = _pointing(spark, d)
    return s.select("event_id", GRID.pixel(ra, dec).cast("long").alias("ipix"))


@query(f"SELECT event_id, CAST(trunc(round_even(({D[0]} - 2.98::DOUBLE) * 0.75::DOUBLE / 0.0001::DOUBLE, 0) * 300 + ({D[1]} - 0.70::DOUBLE) / 0.0001::DOUBLE + 0.5) AS BIGINT) AS ipix FROM samples")
def pixels_car_rounded(spark, d):
    """Linear plate: nearest column, truncated row."""
    s, ra, dec = _pointing(spark, d)
    return s.select("event_id", G.car_rounded(ra, dec, (2.98, 3.02, 0.70, 0.73), 1e-4, 300, 0.75).cast("long").alias("ipix"))


@query(f"SELECT event_id, CAST(round_even(({D[0]} - 2.98::DOUBLE) * cos(0.715::DOUBLE) / 0.0001::DOUBLE, 0) * 300 + round_even(({D[1]} - 0.70::DOUBLE) / 0.0001::DOUBLE, 0) AS BIGINT) AS ipix FROM samples")
def pixels_car_nearest(spark, d):
    """Linear plate: nearest column and row, of a grid as large as its limits."""
    s, ra, dec = _pointing(spark, d)
    grid = G.plain_grid((2.98, 3.02, 0.70, 0.73), 1e-4)
    return s.select("event_id", G.car_nearest(ra, dec, (2.98, 3.02, 0.70, 0.73), 1e-4, grid[1]).cast("long").alias("ipix"))




@query("SELECT * FROM (SELECT 'plain' AS name, 402 AS nx, 302 AS ny UNION ALL SELECT 'square', 402, 402 UNION ALL SELECT 'multiple', 408, 312 UNION ALL SELECT 'smooth', 405, 315 UNION ALL SELECT 'given', 77, 302)", None)
def map_geometry(spark, d):
    """Sizes of grids by their limits: padded, square, a multiple of 24, of small prime factors, given."""
    lims = (2.98, 3.02, 0.70, 0.73)
    made = {"plain": {}, "square": {"square": True}, "multiple": {"multiple": 24}, "smooth": {"primes": (3, 5, 7)}, "given": {"nx": 77}}
    grids = {n: G.MapGrid.make(lims, 1e-4, equatorial=True, pad=1, **o) for n, o in made.items()}
    return spark.createDataFrame([(n, g.nx, g.ny) for n, g in grids.items()], "name string, nx int, ny int")


@query("SELECT CAST(x * 24 + y AS BIGINT) AS ipix, round(sqrt((x - 15.5) * (x - 15.5) + (y - 11.5) * (y - 11.5)), 9) AS r, round(atan2((x - 15.5)::DOUBLE, (y - 11.5)::DOUBLE), 9) AS th FROM (SELECT i // 24 AS x, i % 24 AS y FROM (SELECT unnest(generate_series(0, 767)) AS i))", None)
def radius_angle_map(spark, d):
    return rounded(G.radius_angle(spark, src.NX, src.NY), "r", "th", digits=9)


@query("SELECT CAST(i AS BIGINT) AS i, CAST(CASE WHEN i > 12 THEN i - 25 ELSE i END AS BIGINT) AS odd, CAST(CASE WHEN i > 12 THEN i - 24 ELSE i END AS BIGINT) AS even FROM (SELECT unnest(generate_series(0, 23)) AS i)", None)
def fourier_index(spark, d):
    """Frequencies of 25 and 24 points in the order of the transform."""
    i = spark.range(24).select(F.col("id").alias("i"))
    return i.select("i", G.fourier_index(F.col("i"), 25).cast("long").alias("odd"), G.fourier_index(F.col("i"), 24).cast("long").alias("even"))


@query("SELECT 100 AS x0, 50 AS y0, 104 AS nx, 56 AS ny, 2.5e-5::DOUBLE AS pixel", None)
def aligned_subregion(spark, d):
    """A part of a grid in finer pixels, whose edges are edges of the larger pixels."""
    big = G.MapGrid.make((2.98, 3.02, 0.70, 0.73), 1e-4, equatorial=True)
    fine, corner = big.subregion((3.00753, 3.00995, 0.70504, 0.70626), 4)
    return spark.createDataFrame([(corner[0], corner[1], fine.nx, fine.ny, round(fine.pixel_size, 12))], "x0 int, y0 int, nx int, ny int, pixel double")


@query(f"SELECT ipix, {r('sum(dat * cos(radians(az)))', 'q')}, {r('sum(dat * sin(radians(az)))', 'u')} FROM samples GROUP BY ipix")
def tod_to_map_qu(spark, d):
    return rounded(M.scatter_pol(src.events(spark, d), "QU", angle()), "q", "u")


@query(f", m AS (SELECT ipix, sum(dat * cos(radians(az))) AS q, sum(dat * sin(radians(az))) AS u FROM samples GROUP BY ipix) SELECT tod, det, samp, {r('q * cos(radians(az)) + u * sin(radians(az))', 'val', 5)} FROM samples JOIN m USING (ipix)")
def map_to_tod_qu(spark, d):
    s = src.events(spark, d)
    return rounded(M.gather_qu(s, M.scatter_qu(s, angle()), angle()).select("tod", "det", "samp", "val"), "val", digits=5)


@query(f"SELECT ipix, {r('sum(pow(cos(radians(az)), 2))', 'qq')}, {r('sum(pow(sin(radians(az)), 2))', 'uu')}, {r('sum(cos(radians(az)) * sin(radians(az)))', 'qu')} FROM samples GROUP BY ipix")
def precon_qu(spark, d):
    return rounded(M.scatter_pol(src.events(spark, d), "QU_PRECON", angle()), "qq", "uu", "qu")


BLOCKS = "p AS (SELECT ipix, CAST(count(*) AS DOUBLE) AS ii, sum(cos(radians(az))) AS iq, sum(sin(radians(az))) AS iu, sum(cos(radians(az)) * cos(radians(az))) AS qq, sum(cos(radians(az)) * sin(radians(az))) AS qu, sum(sin(radians(az)) * sin(radians(az))) AS uu FROM samples GROUP BY ipix), c AS (SELECT *, qq * uu - qu * qu AS mii, iu * qu - iq * uu AS miq, iq * qu - iu * qq AS miu, ii * uu - iu * iu AS mqq, iq * iu - ii * qu AS mqu, ii * qq - iq * iq AS muu FROM p), t AS (SELECT *, ii * mii + iq * miq + iu * miu AS dt FROM c), inv AS (SELECT ipix, CASE WHEN good THEN mii / dt ELSE 1 / ii END AS ii, CASE WHEN good THEN miq / dt ELSE 0 END AS iq, CASE WHEN good THEN miu / dt ELSE 0 END AS iu, CASE WHEN good THEN mqq / dt ELSE 0 END AS qq, CASE WHEN good THEN mqu / dt ELSE 0 END AS qu, CASE WHEN good THEN muu / dt ELSE 0 END AS uu FROM (SELECT *, dt >= 0.001 * (SELECT max(dt) FROM t) AS good FROM t))"
SIX = M.POLS["IQU_PRECON"]


@query(f", {BLOCKS} SELECT ipix, {', '.join(r(x, x, 6) for x in SIX)} FROM inv")
def invert_iqu(spark, d):
    return rounded(M.invert_iqu(M.scatter_pol(src.events(spark, d), "IQU_PRECON", angle()), 0.001), *SIX)


@query(f", {BLOCKS}, m AS (SELECT ipix, sum(dat) AS i, sum(dat * cos(radians(az))) AS q, sum(dat * sin(radians(az))) AS u FROM samples GROUP BY ipix) SELECT ipix, {r('ii * i + iq * q + iu * u', 'i', 3)}, {r('iq * i + qq * q + qu * u', 'q', 3)}, {r('iu * i + qu * q + uu * u', 'u', 3)} FROM inv JOIN m USING (ipix)")
def block_times_iqu(spark, d):
    """The inverse blocks times the polarised map: each pixel's I, Q and U."""
    s = src.events(spark, d)
    inverse = M.invert_iqu(M.precon_iqu(s, angle()), 0.001)
    return rounded(M.block_times(inverse, M.scatter_iqu(s, angle()), "IQU"), "i", "q", "u", digits=3)


@query(f", p AS (SELECT ipix, sum(pow(cos(radians(az)), 2)) AS qq, sum(pow(sin(radians(az)), 2)) AS uu, sum(cos(radians(az)) * sin(radians(az))) AS qu, sum(dat * cos(radians(az))) AS q, sum(dat * sin(radians(az))) AS u FROM samples GROUP BY ipix) SELECT ipix, {r('qq * q + qu * u', 'q', 3)}, {r('qu * q + uu * u', 'u', 3)} FROM p")
def block_times_qu(spark, d):
    s = src.events(spark, d)
    return rounded(M.block_times(M.precon_qu(s, angle()), M.scatter_qu(s, angle()), "QU"), "q", "u", digits=3)


LONG = "m AS (SELECT ipix, sum(dat) AS i, sum(dat * cos(radians(az))) AS q, sum(dat * sin(radians(az))) AS u FROM samples GROUP BY ipix), h AS (SELECT ipix, CAST(count(*) AS DOUBLE) AS i, sum(cos(radians(az))) AS q, sum(sin(radians(az))) AS u FROM samples GROUP BY ipix), x AS (UNPIVOT m ON i, q, u INTO NAME pol VALUE val), y AS (UNPIVOT h ON i, q, u INTO NAME pol VALUE val)"


def _pol_maps(spark, d):
    s = src.events(spark, d)
    ones = s.withColumn("dat", F.lit(1.0))
    return M.melt(M.scatter_iqu(s, angle()), M.POLS["IQU"]), M.melt(M.scatter_iqu(ones, angle()), M.POLS["IQU"])


@query(f", {LONG} SELECT ipix, pol, {r('x.val - 2 * y.val', 'val', 5)} FROM x JOIN y USING (ipix, pol)")
def polmap_axpy(spark, d):
    return rounded(M.axpy(*_pol_maps(spark, d), -2.0, key=("ipix", "pol")), "val", digits=5)


@query(f", {LONG} SELECT {r('sum(x.val * y.val)', 'dot', 2)} FROM x JOIN y USING (ipix, pol)")
def polmap_dot(spark, d):
    return rounded(M.dot(*_pol_maps(spark, d), key=("ipix", "pol")), "dot", digits=2)


@query(f", {WEIGHTS} SELECT ipix, {r('sum(CASE WHEN event_id % 11 > 0 THEN w ELSE 0 END)', 'val')} FROM samples JOIN wt USING (tod, det) GROUP BY ipix")
def masked_hits_map(spark, d):
    """Weights by pixel; masked samples count as zero."""
    s = src.events(spark, d)
    return rounded(M.hits(s, M.white_weights(s), F.expr("event_id % 11 > 0")), "val")


GRADIENT = "g AS (SELECT CAST(i // 24 AS INT) AS x, CAST(i % 24 AS INT) AS y, coalesce(v, 0) AS v FROM (SELECT unnest(generate_series(0, 767)) AS i) LEFT JOIN (SELECT ipix, avg(dat) AS v FROM samples GROUP BY ipix) ON i = ipix), gr AS (SELECT CAST(a.x * 24 + a.y AS BIGINT) AS ipix, 0.5 * sqrt(sum((a.v - b.v) * (a.v - b.v))) AS grad FROM g a JOIN g b ON (b.y = a.y AND b.x IN ((a.x + 1) % 32, (a.x + 31) % 32)) OR (b.x = a.x AND b.y IN ((a.y + 1) % 24, (a.y + 23) % 24)) GROUP BY a.x, a.y)"


@query(f", {WEIGHTS}, {GRADIENT}, n AS (SELECT ipix, sqrt(1 / sum(w)) * sqrt(count(*)) AS noise FROM samples JOIN wt USING (tod, det) GROUP BY ipix) SELECT ipix, {r('CASE WHEN grad > 0.3 * coalesce(noise, 0) THEN grad ELSE 0 END', 'grad', 3)} FROM gr LEFT JOIN n USING (ipix)")
def gradient_mask(spark, d):
    """The mean map's gradient where it stands out of a sample's noise in the pixel."""
    s = src.events(spark, d)
    mean = s.groupBy("ipix").agg(F.avg("dat").alias("val"))
    return rounded(M.gradient_mask(mean, M.hits(s, M.white_weights(s)), M.hits(s), src.NX, src.NY, 0.3), "grad", digits=3)


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT ipix, {r('sum(dat)', 'val')} FROM samples GROUP BY ipix")
def map_written(spark, d):
    """A map written as a table with its geometry, and read again."""
    at = _folder(spark, "map")
    files.write_map(M.scatter(src.events(spark, d), F.col("dat")), at, G.MapGrid.make((2.98, 3.02, 0.70, 0.73), 1e-4))
    return rounded(files.read_map(spark, at)[0], "val")


@query(f", {LONG} SELECT ipix, pol, {r('val', 'val')} FROM x")
def polmap_written(spark, d):
    """A polarised map written with a folder for each component, and read again."""
    at = _folder(spark, "polmap")
    files.write_map(_pol_maps(spark, d)[0], at, by="pol")
    return rounded(files.read_map(spark, at)[0].select("ipix", "pol", "val"), "val")


@query(f", m AS (SELECT event_id % 3072 AS ipix, sum(dat) AS val FROM samples GROUP BY 1) SELECT CAST(ipix AS BIGINT) AS ipix, {r('val', 'val')}, 16 AS nside, 'RING' AS ordering FROM m")
def healmap_written(spark, d):
    """An equal-area map written with its resolution and order, and read again."""
    at = _folder(spark, "healmap")
    m = src.events(spark, d).withColumn("ipix", F.col("event_id") % (12 * 16 * 16))
    files.write_map(M.scatter(m, F.col("dat")), at, G.HealGrid(16, "RING"))
    found, grid = files.read_map(spark, at)
    return rounded(found, "val").select("ipix", "val", F.lit(int(grid["nside"])).alias("nside"), F.lit(grid["ordering"]).alias("ordering"))


@query(f", m AS (SELECT ipix, sum(dat) AS v FROM samples GROUP BY ipix) SELECT CAST(i // 24 AS INT) AS ix, CAST(i % 24 AS INT) AS iy, {r('coalesce(v, 0)', 'val')} FROM (SELECT unnest(generate_series(0, 767)) AS i) LEFT JOIN m ON i = ipix")
def fits_map_written(spark, d):
    """A map written as a FITS image, and read again as a table."""
    at = _folder(spark, "fits")
    files.write_fits_map(M.scatter(src.events(spark, d), F.col("dat")), f"{at}/map.fits", src.NX, src.NY, {"CRVAL1": 1.5})
    return rounded(files.read_fits_map(spark, f"{at}/map.fits").select("ix", "iy", "val"), "val")


@query(f", m AS (SELECT ipix, sum(dat) AS v FROM samples GROUP BY ipix) SELECT CAST(i // 24 AS INT) AS ix, CAST(i % 24 AS INT) AS iy, {r('coalesce(v, 0) - (SELECT sum(v) / 768 FROM m)', 'val', 4)} FROM (SELECT unnest(generate_series(0, 767)) AS i) LEFT JOIN m ON i = ipix")
def wavelet_map_written(spark, d):
    """Wavelet coefficients put together to a map and written: bands whose squares sum to one, so the map less its mean."""
    import numpy as np

    from .functions import kernels as K

    at = _folder(spark, "wavmap")
    k = np.hypot(np.fft.fftfreq(src.NX)[:, None] * src.NX, np.fft.fftfreq(src.NY)[None, :] * src.NY)
    bands = K.needlet_bands(range(5), 16.0, k)
    norm = np.sqrt((bands**2).sum(axis=0))
    bands = np.where(norm > 0, bands / np.where(norm > 0, norm, 1), 0)
    bands[-1][(norm == 0) & (k > 0)] = 1.0
    files.write_wavelet_map(M.scatter(src.events(spark, d), F.col("dat")), bands, at, src.NX, src.NY)
    return rounded(files.read_map(spark, at)[0].select(F.floor(F.col("ipix") / src.NY).cast("int").alias("ix"), (F.col("ipix") % src.NY).cast("int").alias("iy"), "val"), "val", digits=4)


REGIONS = """# Region file format
image
epanda(16,12,0,360,2,2,1.5,10,7.5,4,0) # color=green
circle(8, 6, 3.5)
"""


@query(f", m AS (SELECT ipix // 24 + 0.25::DOUBLE - 16 AS x, ipix % 24 + 0.25::DOUBLE - 12 AS y, sum(dat) AS v FROM samples GROUP BY ipix), k AS (SELECT unnest(generate_series(0, 3)) AS ring), e AS (SELECT ring * 2 + CASE WHEN y >= 0 THEN 0 ELSE 1 END AS region, v, abs(v) AS a FROM m, k WHERE x * x / pow(2 + 2 * ring, 2) + y * y / pow(1.5::DOUBLE + 1.5::DOUBLE * ring, 2) >= 1 AND x * x / pow(4 + 2 * ring, 2) + y * y / pow(3 + 1.5::DOUBLE * ring, 2) < 1 UNION ALL SELECT 8, v, abs(v) FROM m WHERE pow(x + 8, 2) + pow(y + 6, 2) < 12.25) SELECT CAST(region AS BIGINT) AS region, count(*) AS n, {r('avg(v)', 'mean', 5)}, CASE WHEN region = 8 THEN 1.75 ELSE 3.0 + 2 * (region // 2) END AS radius FROM e WHERE a > 1e-10 GROUP BY region")
def region_file_means(spark, d):
    """Means of a map over the regions of a file: an elliptical annulus in rings and halves, and a circle; zero pixels don't count."""
    from .sources import regions as R

    some = R.parse_regions(REGIONS)
    m = M.scatter(src.events(spark, d), F.col("dat")).where(F.abs("val") > 1e-10)
    x, y = F.floor(F.col("ipix") / src.NY) + 0.25, F.col("ipix") % src.NY + 0.25
    got = m.select("val", F.explode(R.region_of(x, y, some)).alias("region")).groupBy("region").agg(F.count("*").alias("n"), F.avg("val").alias("mean"))
    radius = F.element_at(F.array(*[F.lit(s.radius) for s in some]), F.col("region") + 1)
    return rounded(got.select(F.col("region").cast("long").alias("region"), "n", "mean", radius.alias("radius")), "mean", digits=5)
