"""Named queries of the map-making operators, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import kernels as K
from .operators import maps as M
from .operators import streams as S
from .plans import eigen, solve
from .registry import OFFSETS_SQL, QUERIES, SQL, query, r, rounded
from .sources import samples as src
from .plans.mapset import shared_folder
from .streaming.hits import event_pixels, whole_map, write_batches

NPIX = src.NX * src.NY
def angle():
    return F.radians(F.col("az"))


WEIGHTS_SQL = "st AS (SELECT tod, det, abs(dat - lag(dat) OVER (PARTITION BY tod, det ORDER BY samp)) AS s FROM samples), wt AS (SELECT tod, det, sigma, 1 / (sigma * sigma) AS w FROM (SELECT tod, det, median(s) / (2 * 0.4769362762044699) AS sigma FROM st GROUP BY tod, det) WHERE sigma > 0)"


@query(f"{WEIGHTS_SQL} SELECT ipix, count(*) AS hits, {r('sum(w)', 'weight')}, {r('sum(w * dat) / sum(w)', 'val')} FROM samples JOIN wt USING (tod, det) GROUP BY ipix")
def ml_map_white(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.white_map(src.events(spark, d)), "weight", "val")


@query(f"SELECT ipix, {r('sum(dat)', 'val')} FROM samples GROUP BY ipix")
def tod_to_map(spark, d):
    return rounded(M.scatter(src.events(spark, d), F.col("dat")), "val")


@query(f", m AS (SELECT ipix, avg(dat) AS val FROM samples GROUP BY ipix HAVING avg(dat) < 60) SELECT tod, det, {r('sum(coalesce(val, 0))', 'total')}, {r('max(coalesce(val, 0))', 'top')} FROM samples LEFT JOIN m USING (ipix) GROUP BY tod, det")
def map_to_tod(spark, d):
    s = src.events(spark, d)
    image = s.groupBy("ipix").agg(F.avg("dat").alias("val")).where("val < 60")
    return rounded(M.gather(s, image, npix=NPIX).groupBy("tod", "det").agg(F.sum("val").alias("total"), F.max("val").alias("top")), "total", "top")


@query("SELECT ipix, CAST(count(*) AS DOUBLE) AS val FROM samples GROUP BY ipix")
def hits_map(spark, d):
    return M.hits(src.events(spark, d))


@query(f"{WEIGHTS_SQL} SELECT ipix, {r('sum(w)', 'val')} FROM samples JOIN wt USING (tod, det) GROUP BY ipix")
def weighted_hits_map(spark, d):
    s = src.events(spark, d)
    return rounded(M.hits(s, M.white_weights(s)), "val")


@query(f"{WEIGHTS_SQL} SELECT tod, det, {r('sigma', 'sigma')}, {r('w', 'w', 9)} FROM wt")
def noise_white(spark, d):
    return rounded(rounded(M.white_weights(src.events(spark, d)), "sigma"), "w", digits=9)


@query(f"{WEIGHTS_SQL} SELECT tod, {r('sum(w * dat * dat)', 'chisq', 4)} FROM samples JOIN wt USING (tod, det) GROUP BY tod")
def timestream_chisq(spark, d):
    s = src.events(spark, d)
    return rounded(s.join(M.white_weights(s), ["tod", "det"]).groupBy("tod").agg(F.sum(F.col("w") * F.col("dat") * F.col("dat")).alias("chisq")), "chisq", digits=4)


@query(f"SELECT ipix, {r('sum(dat)', 'i')}, {r('sum(dat * cos(radians(az)))', 'q')}, {r('sum(dat * sin(radians(az)))', 'u')} FROM samples GROUP BY ipix")
def tod_to_map_iqu(spark, d):
    return rounded(M.scatter_iqu(src.events(spark, d), angle()), "i", "q", "u")


PRECON_SQL = "p AS (SELECT ipix, CAST(count(*) AS DOUBLE) AS ii, sum(cos(radians(az))) AS iq, sum(sin(radians(az))) AS iu, sum(cos(radians(az)) * cos(radians(az))) AS qq, sum(cos(radians(az)) * sin(radians(az))) AS qu, sum(sin(radians(az)) * sin(radians(az))) AS uu FROM samples GROUP BY ipix)"


@query(f"{PRECON_SQL} SELECT ipix, ii, {', '.join(r(x, x) for x in ('iq', 'iu', 'qq', 'qu', 'uu'))} FROM p")
def precon_iqu(spark, d):
    return rounded(M.precon_iqu(src.events(spark, d), angle()), "iq", "iu", "qq", "qu", "uu")


@query(f"{PRECON_SQL}, t AS (SELECT *, qq * uu - qu * qu AS det, qq * uu - qu * qu > 1e-6 * pow(qq + uu, 2) AS good FROM p) SELECT ipix, {r('CASE WHEN good THEN uu / det ELSE 0 END', 'qq', 5)}, {r('CASE WHEN good THEN qq / det ELSE 0 END', 'uu', 5)}, {r('CASE WHEN good THEN -qu / det ELSE 0 END', 'qu', 5)} FROM t")
def invert_qu(spark, d):
    return rounded(M.invert_qu(M.precon_iqu(src.events(spark, d), angle())), "qq", "uu", "qu", digits=5)


@query(f", m AS (SELECT ipix, sum(dat) AS i, sum(dat * cos(radians(az))) AS q, sum(dat * sin(radians(az))) AS u FROM samples GROUP BY ipix) SELECT tod, det, {r('sum(i + q * cos(radians(az)) + u * sin(radians(az)))', 'total', 3)} FROM samples JOIN m USING (ipix) GROUP BY tod, det")
def map_to_tod_iqu(spark, d):
    s = src.events(spark, d)
    return rounded(M.gather_iqu(s, M.scatter_iqu(s, angle()), angle()).groupBy("tod", "det").agg(F.sum("val").alias("total")), "total", digits=3)


@query("SELECT event_id, CAST(trunc((CAST(event_id % 1000 AS DOUBLE) / 1000 - 0.0::DOUBLE) * 0.9::DOUBLE / 0.02::DOUBLE + 0.5) * 50 + trunc((CAST(user_id % 97 AS DOUBLE) / 97 - 0.0::DOUBLE) / 0.02::DOUBLE + 0.5) AS BIGINT) AS ipix FROM events", None)
def pixels_car(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", C.car_pixel(F.col("event_id") % 1000 / F.lit(1000.0), F.col("user_id") % 97 / F.lit(97.0), (0.0, 1.0, 0.0, 1.0), 0.02, 50, 0.9).cast("long").alias("ipix"))


@query("SELECT tod, min(az) AS lo, max(az) AS hi, min(dat) AS lo_dat, max(dat) AS hi_dat, count(*) AS nsamp, count(DISTINCT det) AS ndet, max(samp) + 1 AS ndata FROM samples GROUP BY tod")
def tod_limits(spark, d):
    return src.events(spark, d).groupBy("tod").agg(F.min("az").alias("lo"), F.max("az").alias("hi"), F.min("dat").alias("lo_dat"), F.max("dat").alias("hi_dat"), F.count("*").alias("nsamp"), F.countDistinct("det").alias("ndet"), (F.max("samp") + 1).alias("ndata"))


BAD = "event_id % 50 < 3"
RUNS_SQL = "b AS (SELECT tod, det, samp, samp - row_number() OVER (PARTITION BY tod, det ORDER BY samp) AS g FROM samples WHERE event_id % 50 < 3), cuts AS (SELECT tod, det, min(samp) AS start, max(samp) + 1 AS stop FROM b GROUP BY tod, det, g)"


@query(f"{RUNS_SQL} SELECT tod, det, start, stop FROM cuts")
def cut_runs(spark, d):
    return S.runs(src.events(spark, d), F.expr(BAD))


@query(f"{RUNS_SQL}, p AS (SELECT tod, det, start - 20 AS start, stop + 20 AS stop FROM cuts), q AS (SELECT *, CASE WHEN start > coalesce(max(stop) OVER (PARTITION BY tod, det ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS f FROM p), g AS (SELECT *, sum(f) OVER (PARTITION BY tod, det ORDER BY start, stop) AS n FROM q) SELECT tod, det, min(start) AS start, max(stop) AS stop FROM g GROUP BY tod, det, n")
def cut_merge(spark, d):
    c = S.runs(src.events(spark, d), F.expr(BAD))
    return S.merge_cuts(c.withColumns({"start": F.col("start") - 20, "stop": F.col("stop") + 20}))


@query(f"{RUNS_SQL} SELECT tod, det, unnest(generate_series(start, stop - 1)) AS samp FROM cuts")
def cut_expand(spark, d):
    return S.expand_cuts(S.runs(src.events(spark, d), F.expr(BAD)))


@query("SELECT tod, det, samp, dat FROM samples WHERE event_id % 50 < 3")
def cuts_gather(spark, d):
    return src.events(spark, d).where(BAD).select("tod", "det", "samp", "dat")


@query("SELECT tod, det, samp, dat FROM samples SEMI JOIN (SELECT tod, det FROM samples GROUP BY tod, det HAVING avg(dat) > 50) AS g USING (tod, det)")
def cut_detectors(spark, d):
    s = src.events(spark, d)
    good = s.groupBy("tod", "det").agg(F.avg("dat").alias("m")).where("m > 50").select("tod", "det")
    return s.join(good, ["tod", "det"], "left_semi").select("tod", "det", "samp", "dat")


@query("SELECT tod, det, samp // 2 AS samp, round(avg(dat), 6) + 0.0 AS dat FROM samples GROUP BY tod, det, samp // 2 HAVING count(*) = 2")
def decimate(spark, d):
    return rounded(S.decimate(src.events(spark, d)), "dat")


MOMENTS_SQL = "m AS (SELECT tod, det, avg(dat * dat * dat) / pow(stddev_pop(dat), 1.5) AS skew, avg(dat * dat * dat * dat) / pow(stddev_pop(dat), 2) - 3 AS kurt FROM samples GROUP BY tod, det), h AS (SELECT tod, median(abs(skew)) AS ms, median(abs(kurt)) AS mk FROM m GROUP BY tod)"


@query(f"{MOMENTS_SQL} SELECT tod, det, {r('skew', 'skew', 4)}, {r('kurt', 'kurt', 4)}, abs(skew) > 6 * ms OR abs(kurt) > 5 * mk AS bad FROM m JOIN h USING (tod)")
def skew_kurt(spark, d):
    return rounded(S.moments(src.events(spark, d)), "skew", "kurt", digits=4)


@query(f", s AS (SELECT tod, det, samp, CASE WHEN event_id % 97 > 0 THEN dat END AS dat FROM samples), k AS (SELECT *, last_value(CASE WHEN dat IS NOT NULL THEN samp END IGNORE NULLS) OVER w AS bs, last_value(dat IGNORE NULLS) OVER w AS bd, first_value(CASE WHEN dat IS NOT NULL THEN samp END IGNORE NULLS) OVER v AS a_s, first_value(dat IGNORE NULLS) OVER v AS ad FROM s WINDOW w AS (PARTITION BY tod, det ORDER BY samp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY tod, det ORDER BY samp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT tod, det, samp, {r('coalesce(dat, bd + (ad - bd) * (samp - bs) / nullif(a_s - bs, 0), bd, ad)', 'dat')} FROM k")
def gapfill_linear(spark, d):
    s = src.events(spark, d).select("tod", "det", "samp", F.when(F.col("event_id") % 97 > 0, F.col("dat")).alias("dat"))
    return rounded(S.fill_linear(s), "dat")


@query("SELECT tod, samp, round(median(dat), 6) + 0.0 AS cm FROM samples GROUP BY tod, samp")
def common_mode_median(spark, d):
    return rounded(S.common_mode(src.events(spark, d)), "cm")


@query("SELECT tod, samp, round(sum(dat), 6) + 0.0 AS val FROM samples GROUP BY tod, samp")
def template_common(spark, d):
    return rounded(S.project(src.events(spark, d), "tod", "samp"), "val")


@query("SELECT tod, det, round(sum(dat), 6) + 0.0 AS val FROM samples GROUP BY tod, det")
def template_offset(spark, d):
    return rounded(S.project(src.events(spark, d), "tod", "det"), "val")


@query(", n AS (SELECT tod, det, greatest(1, count(*) // 100) AS n, count(*) AS c FROM samples GROUP BY tod, det), s AS (SELECT samples.*, c // n AS e, c % n AS x FROM samples JOIN n USING (tod, det)), t AS (SELECT *, CASE WHEN samp < x * (e + 1) THEN samp // (e + 1) ELSE x + (samp - x * (e + 1)) // e END AS seg FROM s) SELECT tod, det, seg, round(sum(dat), 6) + 0.0 AS val FROM t GROUP BY tod, det, seg")
def template_stripes(spark, d):
    return rounded(S.project(S.segments(src.events(spark, d), 100), "tod", "det", "seg"), "val")


@query("SELECT tod, det, CAST(trunc(az * 36 / 360.0) AS INT) AS bin, round(sum(dat), 6) + 0.0 AS val FROM samples GROUP BY ALL")
def template_azimuth(spark, d):
    return rounded(S.project(src.events(spark, d).withColumn("bin", S.az_bin(F.col("az"), 0.0, 360.0, 36)), "tod", "det", "bin"), "val")


@query(", n AS (SELECT tod, det, samp, dat, CASE WHEN count(*) OVER w > 1 THEN 2.0 * samp / greatest(count(*) OVER w - 1, 1) - 1 ELSE -1 END AS x FROM samples WINDOW w AS (PARTITION BY tod, det)) SELECT tod, det, round(sum(dat), 4) + 0.0 AS p0, round(sum(dat * x), 4) + 0.0 AS p1, round(sum(dat * (3 * x * x - 1) / 2), 4) + 0.0 AS p2, round(sum(dat * (5 * x * x * x - 3 * x) / 2), 4) + 0.0 AS p3 FROM n GROUP BY tod, det")
def template_legendre(spark, d):
    return rounded(S.legendre_project(src.events(spark, d), 3), "p0", "p1", "p2", "p3", digits=4)


@query(", m AS (SELECT ipix, avg(dat) AS p FROM samples GROUP BY ipix) SELECT tod, det, round(sum(dat * p), 3) + 0.0 AS val FROM samples JOIN m USING (ipix) GROUP BY tod, det")
def template_calibration(spark, d):
    s = src.events(spark, d)
    m = s.groupBy("ipix").agg(F.avg("dat").alias("p"))
    return rounded(S.project(s.join(m, "ipix"), "tod", "det", value=F.col("dat") * F.col("p")), "val", digits=3)


@query(", a AS (SELECT tod, dat, 1 / cos(radians(az / 6)) - avg(1 / cos(radians(az / 6))) OVER (PARTITION BY tod) AS am FROM samples) SELECT tod, round(sum(dat * am), 4) + 0.0 AS a1, round(sum(dat * am * am), 4) + 0.0 AS a2 FROM a GROUP BY tod")
def template_airmass(spark, d):
    s = src.events(spark, d).withColumn("x", 1 / F.cos(F.radians(F.col("az") / 6)))
    mean = s.groupBy("tod").agg(F.avg("x").alias("mx"))  # joined, so that no window gathers a timestream
    am = F.col("x") - F.col("mx")
    return rounded(s.join(mean, "tod").groupBy("tod").agg(F.sum(F.col("dat") * am).alias("a1"), F.sum(F.col("dat") * am * am).alias("a2")), "a1", "a2", digits=4)


@query(", s AS (SELECT tod, det, samp, coalesce(CASE WHEN ctime - lag(ctime) OVER (PARTITION BY tod, det ORDER BY samp) > 3600 THEN 1 ELSE 0 END, 0) AS j FROM samples) SELECT tod, det, samp, CAST(sum(j) OVER (PARTITION BY tod, det ORDER BY samp) AS BIGINT) AS piece FROM s")
def split_by_gap(spark, d):
    return S.gap_pieces(src.events(spark, d), 3600).select("tod", "det", "samp", "piece")


MAPS_SQL = "x AS (SELECT ipix, sum(dat) AS val FROM samples GROUP BY ipix), y AS (SELECT ipix, sum(dat * az) / 100 AS val FROM samples GROUP BY ipix)"


def _two(spark, d):
    s = src.events(spark, d)
    return M.scatter(s, F.col("dat")), M.scatter(s, F.col("dat") * F.col("az")).withColumn("val", F.col("val") / 100)


@query(f"{MAPS_SQL} SELECT ipix, {r('sum(val)', 'val')} FROM (SELECT * FROM x UNION ALL SELECT ipix, -0.5 * val FROM y) GROUP BY ipix")
def map_axpy(spark, d):
    x, y = _two(spark, d)
    return rounded(M.axpy(x, y, -0.5), "val")


@query(f"{MAPS_SQL} SELECT {r('sum(x.val * y.val)', 'dot', 2)} FROM x JOIN y USING (ipix)")
def map_dot(spark, d):
    return rounded(M.dot(*_two(spark, d)), "dot", digits=2)


@query(f"{MAPS_SQL} SELECT ipix, {r('x.val * y.val', 'val', 1)} FROM x JOIN y USING (ipix)")
def map_times(spark, d):
    return rounded(M.times(*_two(spark, d)), "val", digits=1)


@query(f"{MAPS_SQL} SELECT ipix, {r('CASE WHEN val <> 0 THEN 1 / val ELSE 0 END', 'val', 9)} FROM x")
def map_invert(spark, d):
    return rounded(M.invert(_two(spark, d)[0]), "val", digits=9)


@query(", g AS (SELECT CAST(i // 24 AS INT) AS x, CAST(i % 24 AS INT) AS y, coalesce(v, 0) AS v FROM (SELECT unnest(generate_series(0, 767)) AS i) LEFT JOIN (SELECT ipix, sum(dat) AS v FROM samples GROUP BY ipix) ON i = ipix) SELECT CAST(a.x * 24 + a.y AS BIGINT) AS ipix, round(0.5 * sqrt(sum((a.v - b.v) * (a.v - b.v))), 4) + 0.0 AS grad FROM g a JOIN g b ON (b.y = a.y AND b.x IN ((a.x + 1) % 32, (a.x + 31) % 32)) OR (b.x = a.x AND b.y IN ((a.y + 1) % 24, (a.y + 23) % 24)) GROUP BY a.x, a.y")
def map_gradient(spark, d):
    return rounded(M.gradient(M.scatter(src.events(spark, d), F.col("dat")), src.NX, src.NY), "grad", digits=4)


@query(f"SELECT CAST(floor(ipix / 24 / 4) AS BIGINT) AS cx, CAST(floor((ipix % 24) / 4) AS BIGINT) AS cy, {r('sum(dat) / 16', 'val')} FROM samples GROUP BY ALL")
def map_coarsen(spark, d):
    return rounded(M.coarsen(M.scatter(src.events(spark, d), F.col("dat")), src.NY, 4).withColumns({"cx": F.col("cx").cast("long"), "cy": F.col("cy").cast("long")}), "val")


@query(f"SELECT tod, det, samp, {r('3.0 * exp(-0.5 * (pow((az / 100 - 1.5) * cos(0.2), 2) + pow(det - 0.2, 2)) / 4)', 'gauss')}, {r('2.0 * pow(1 + (pow((az / 100 - 1.5) * cos(0.2), 2) + pow(det - 0.2, 2)) / 0.25, 0.5 - 1.5 * 0.7)', 'isobeta')} FROM samples")
def source_models(spark, d):
    s = src.events(spark, d)
    x, y = F.col("az") / 100, F.col("det")
    return rounded(s.select("tod", "det", "samp", C.gauss(x, y, 1.5, 0.2, 2.0, 3.0).alias("gauss"), C.isobeta(x, y, 1.5, 0.2, 0.5, 0.7, 2.0).alias("isobeta")), "gauss", "isobeta")


@query("SELECT tod, det, samp // 120 AS bin, round(sum(dat * exp(-0.5 * pow(az / 100 - 1.5, 2))), 5) + 0.0 AS amp FROM samples GROUP BY ALL")
def light_curve_bins(spark, d):
    s = src.events(spark, d)
    return rounded(s.groupBy("tod", "det", F.floor(F.col("samp") / 120).alias("bin")).agg(F.sum(F.col("dat") * F.exp(-0.5 * F.pow(F.col("az") / 100 - 1.5, F.lit(2)))).alias("amp")), "amp", digits=5)


@query("SELECT ghz, round(x * x * exp(x) / pow(exp(x) - 1, 2), 9) AS planck, round(2.725 * x * x * exp(x) / pow(exp(x) - 1, 2) * (x * (exp(x) + 1) / (exp(x) - 1) - 4), 9) AS y2rj FROM (SELECT ghz, ghz * (1e9 * 6.62607004e-27 / (1.38064852e-16 * 2.725)) AS x FROM (SELECT CAST(unnest(generate_series(10, 400, 10)) AS BIGINT) AS ghz))", None)
def unit_factors(spark, d):
    g = spark.range(10, 401, 10).select(F.col("id").alias("ghz"))
    f = F.col("ghz").cast("double")
    return g.select("ghz", F.round(C.planck_g(f), 9).alias("planck"), F.round(C.y_to_rj(f), 9).alias("y2rj"))


@query("SELECT CAST(n AS BIGINT) AS n FROM (SELECT unnest(generate_series(1, 300)) AS n) WHERE list_reduce(list_prepend(n, [2,2,2,2,2,2,2,2,3,3,3,3,3,5,5,5,7,7]), lambda a, p: CASE WHEN a % p = 0 THEN a // p ELSE a END) = 1", None)
def good_lengths(spark, d):
    return spark.createDataFrame([(n,) for n in K.good_lengths(300)], "n long")


@query("SELECT s_name AS name, 'src/' || s_name || '/v' || max(CAST(s_suppkey % 3 AS VARCHAR)) AS path FROM supplier WHERE s_suppkey % 7 > 0 GROUP BY s_name", None)
def file_blacklist(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    paths = s.select(F.concat(F.lit("src/"), F.col("s_suppkey") % 3, F.lit("/"), F.col("s_name")).alias("path"))
    out = src.without_blacklisted(paths, s.where("s_suppkey % 7 = 0").select(F.col("s_name").alias("name")))
    return out.select("name", F.concat(F.lit("src/"), "name", F.lit("/v"), F.element_at(F.split("path", "/"), 2)).alias("path"))


@query(", v AS (SELECT det, samp, dat FROM samples), k AS (SELECT unnest(generate_series(0, 63)) AS k) SELECT det, CAST(k AS BIGINT) AS k, round(sum(CASE WHEN samp IN (0, 63) THEN 1 ELSE 2 END * dat * cos(pi() * samp * k / 63)), 5) + 0.0 AS val FROM v, k GROUP BY det, k", src.VECTORS_SQL)
def dct1_vectors(spark, d):
    """Discrete cosine transform of each vector, a batch of rows at a time."""
    import pandas as pd

    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")

    def run(frames):
        for f in frames:
            if len(f):
                y = np.round(K.dct1(np.stack(f["embedding"].to_numpy()).astype(float)), 5) + 0.0
                yield pd.DataFrame({"det": np.repeat(f["vec_id"].to_numpy(), y.shape[1]), "k": np.tile(np.arange(y.shape[1]), len(y)), "val": y.ravel()})

    return e.mapInPandas(run, "det long, k long, val double")


def _vectors(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("tod"), F.col("vec_id").alias("det"), "embedding")


def _per_tod(spark, d, f, kind: str, wide=None, most: int = eigen.WIDE) -> DataFrame:
    """A kernel over each label's block of vectors; ``wide``: the same of (rows, their counts) for blocks of over ``most`` rows, by sums over rows."""
    import pandas as pd

    e = _vectors(spark, d)
    if wide and (counts := eigen.blocks(e, most)):
        large, e = eigen.split(e, counts)
        large = wide(large, counts)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("det")
        return f(int(part["tod"].iloc[0]), part["det"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(float))

    got = e.groupBy("tod").applyInPandas(run, kind)
    return got.union(large) if wide and counts else got


def _noise(name: str, wide=None, **options):
    def f(spark, d, most=eigen.WIDE):
        import pandas as pd

        def run(tod, det, x):
            m = K.NOISE[name](x, **options)
            return pd.DataFrame({"tod": tod, "det": det, "w": m.det_weights(), "chisq": (x * m.apply(x)).sum(axis=1)})

        return _per_tod(spark, d, run, "tod int, det long, w double, chisq double", wide and (lambda e, counts: wide(e, counts, **options)), most)

    f.__name__ = f"noise_model_{name}"
    return query()(f)


for _name, _options in (("common_white", {}), ("binned_eig", {"wide": eigen.binned_noise, "freqs": (0.05, 0.2), "thresh": 3.0}), ("smoothed_svd", {"fwhm": 10.0})):
    _noise(_name, **_options)


@query()
def clean_common_poly(spark, d):
    import pandas as pd

    def run(tod, det, x):
        return pd.DataFrame({"tod": tod, "det": det, "rms": K.common_and_poly(x, 2).std(axis=1), "n_spikes": [len(s) for s in K.spikes(x)], "n_jumps": [len(j) for j in K.jumps(x)]})

    return _per_tod(spark, d, run, "tod int, det long, rms double, n_spikes int, n_jumps int")


def _per_map(spark, d, f, kind: str) -> DataFrame:
    """A kernel over each timestream's map; a task holds one map, whose grid is fixed."""
    m = M.scatter(src.events(spark, d), F.col("dat"), ("tod", "ipix"))

    def run(part):
        image = np.zeros(NPIX)
        image[part["ipix"].to_numpy()] = part["val"].to_numpy()
        return f(part["tod"].iloc[0], image.reshape(src.NX, src.NY))

    return m.groupBy("tod").applyInPandas(run, kind)


def _grid():
    """Coordinates of the map's pixels about its middle."""
    return np.meshgrid(np.arange(src.NX) - src.NX // 2, np.arange(src.NY) - src.NY // 2, indexing="ij")


@query()
def needlet_power(spark, d):
    """Power of each map in needlet bands."""
    import pandas as pd

    k = np.hypot(np.fft.fftfreq(src.NX)[:, None] * src.NX, np.fft.fftfreq(src.NY)[None, :] * src.NY)
    bands = K.needlet_bands(range(5), 16.0, k)
    return _per_map(spark, d, lambda tod, image: pd.DataFrame({"tod": tod, "band": range(len(bands)), "power": (K.map_to_wavelets(image, bands) ** 2).sum(axis=(1, 2))}), "tod string, band int, power double")


@query()
def two_resolution_rhs(spark, d):
    """Right-hand side of the prior of a fine map in the middle of each coarse map."""
    import pandas as pd

    x, y = _grid()
    two = K.TwoResolution((src.NX, src.NY), (np.hypot(x, y) < 6).astype(float), 2, 3.0, np.ones((src.NX, src.NY)))

    def run(tod, image):
        coarse, _ = two.rhs(image)
        return pd.DataFrame({"tod": tod, "ipix": np.arange(NPIX), "val": coarse.ravel()})

    return _per_map(spark, d, run, "tod string, ipix long, val double")


@query()
def zernike_fit(spark, d):
    """Least-squares Zernike coefficients up to degree 3 of each map's inner disc."""
    import pandas as pd

    x, y = _grid()
    inside = np.hypot(x, y) <= 10
    z = K.zernike(3, np.hypot(x, y)[inside] / 10, np.arctan2(y, x)[inside])
    return _per_map(spark, d, lambda tod, image: pd.DataFrame({"tod": tod, "k": range(len(z)), "coef": np.linalg.lstsq(z.T, image[inside], rcond=None)[0]}), "tod string, k int, coef double")


@query()
def gapfill_eigenmodes(spark, d, most=eigen.WIDE):
    """Vectors with a run of bad samples filled from their label's strong modes."""
    import pandas as pd

    def bad(det, n):
        return (det[:, None] * 7 + np.arange(n)) % 50 < 3

    def run(tod, det, x):
        y = K.gapfill_eig(x, bad(det, x.shape[1]))
        return pd.DataFrame({"tod": tod, "det": np.repeat(det, y.shape[1]), "samp": np.tile(np.arange(y.shape[1]), len(y)), "dat": y.ravel()})

    return _per_tod(spark, d, run, "tod int, det long, samp long, dat double", lambda e, counts: eigen.gapfill(e, counts, bad), most)


@query()
def steps_taken_off(spark, d):
    """Vectors with a step in the middle of every seventh, which is fitted beside the common mode and taken off."""
    import pandas as pd

    def run(tod, det, x):
        step = (det % 7 == 0)[:, None] * (np.arange(x.shape[1]) >= 32) * 5.0
        y = K.steps_beside_common(x + step, [[32] if k % 7 == 0 else [] for k in det], np.median(x, axis=0))
        return pd.DataFrame({"tod": tod, "det": det, "left": y[:, 32:].mean(axis=1) - y[:, :32].mean(axis=1)})

    return _per_tod(spark, d, run, "tod int, det long, left double")


@query("SELECT CAST(trunc(az * 36 / 360.0) AS INT) AS bin, det, round(sum(dat), 5) + 0.0 AS val FROM samples GROUP BY ALL")
def template_azimuth_shared(spark, d):
    """Azimuth bins of each detector over all timestreams."""
    return rounded(S.project(src.events(spark, d).withColumn("bin", S.az_bin(F.col("az"), 0.0, 360.0, 36)), "det", "bin"), "val", digits=5)


@query(", e AS (SELECT tod, min(az) AS lo, max(az) AS hi FROM samples GROUP BY tod), s AS (SELECT tod, det, dat, 2 * (az - lo) / (hi - lo) - 1 AS x FROM samples JOIN e USING (tod)) SELECT tod, det, round(sum(dat * x), 4) + 0.0 AS t1, round(sum(dat * (2 * x * x - 1)), 4) + 0.0 AS t2, round(sum(dat * (4 * x * x * x - 3 * x)), 4) + 0.0 AS t3 FROM s GROUP BY tod, det")
def template_chebyshev(spark, d):
    return rounded(S.chebyshev_project(src.events(spark, d)), "t1", "t2", "t3", digits=4)


@query(", s AS (SELECT tod, det, samp, dat, lead(ctime) OVER (PARTITION BY tod, det ORDER BY samp) - ctime AS step FROM samples), u AS (SELECT tod, det, median(step) AS usual FROM s GROUP BY tod, det), p AS (SELECT tod, det, samp, dat, sum(CASE WHEN samp > 0 AND abs(step) > 4 * usual THEN 1 ELSE 0 END) OVER (PARTITION BY tod, det ORDER BY samp) AS piece FROM s JOIN u USING (tod, det)), n AS (SELECT *, samp - min(samp) OVER w AS i, count(*) OVER w AS c, greatest(1, count(*) OVER w // 20) AS n FROM p WINDOW w AS (PARTITION BY tod, det, piece)), t AS (SELECT *, c // n AS e, c % n AS x FROM n) SELECT tod, det, CAST(piece AS BIGINT) AS piece, CASE WHEN i < x * (e + 1) THEN i // (e + 1) ELSE x + (i - x * (e + 1)) // e END AS seg, round(sum(dat), 6) + 0.0 AS val FROM t GROUP BY ALL")
def template_gap_stripes(spark, d):
    return rounded(S.project(S.gap_segments(src.events(spark, d), 20, 4.0), "tod", "det", "piece", "seg"), "val")


@query(f", e AS (SELECT tod, min(ctime) AS t0, CAST(greatest(1, ceil(2 * 0.00001::DOUBLE * (max(ctime) - min(ctime)))) AS INT) AS n FROM samples GROUP BY tod), k AS (SELECT tod, t0, n, unnest(generate_series(0, n - 1)) AS k FROM e), s AS (SELECT tod, det, k, dat, (ctime - t0) * (0.00001::DOUBLE + 0.00001::DOUBLE * k / greatest(n - 1, 1)) AS a FROM samples JOIN k USING (tod)) SELECT tod, det, CAST(k AS INT) AS k, {r('sum(dat * cos(a))', 'c', 3)}, {r('sum(dat * sin(a))', 's', 3)} FROM s GROUP BY tod, det, k")
def template_notch(spark, d):
    return rounded(S.notch_project(src.events(spark, d), 0.00001, 0.00002), "c", "s", digits=3)


@query(f", {OFFSETS_SQL} SELECT tod, det, round(sum(dat), 4) + 0.0 AS p0, round(sum(dat * a), 4) + 0.0 AS p1, round(sum(dat * (3 * a * a - 1) / 2), 4) + 0.0 AS p2, round(sum(dat * (5 * a * a * a - 3 * a) / 2), 4) + 0.0 AS p3 FROM ap GROUP BY tod, det")
def template_bowl(spark, d):
    """Legendre polynomials in each detector's elevation offset; azimuth stands for elevation."""
    return rounded(S.polynomial_project(S.elevation_offsets(src.events(spark, d), "az"), "apix"), "p0", "p1", "p2", "p3", digits=4)


def _regions(spark, d):
    m = M.scatter(src.events(spark, d), F.col("dat"))
    x, y = F.floor(F.col("ipix") / src.NY) - 15.5, F.col("ipix") % src.NY - 11.5
    return m, C.sector(x, y, (0.0, 0.0), (1.0, 4.2, 8.3, 11.1), 4)


@query(", m AS (SELECT ipix // 24 - 15.5::DOUBLE AS x, ipix % 24 - 11.5::DOUBLE AS y, sum(dat) AS val FROM samples GROUP BY ipix), r AS (SELECT val, sqrt(x * x + y * y) AS r, CASE WHEN x > 0 AND y > 0 THEN 0 WHEN y > 0 THEN 1 WHEN x < 0 THEN 2 ELSE 3 END AS a FROM m) SELECT CAST(CASE WHEN r < 4.2 THEN 0 WHEN r < 8.3 THEN 4 ELSE 8 END + a AS BIGINT) AS region, count(*) AS n, round(avg(val), 6) + 0.0 AS mean FROM r WHERE r >= 1.0 AND r < 11.1 GROUP BY 1")
def region_means(spark, d):
    return rounded(S.region_means(*_regions(spark, d)), "mean")


@query()
def region_bootstrap(spark, d):
    return S.region_bootstrap(*_regions(spark, d))


@query()
def pcg_map(spark, d):
    """The map under common-mode noise, by conjugate gradients with the hits as preconditioner."""
    s = src.events(spark, d)
    hits = solve.vector(M.hits(s), NPIX)
    x, _ = solve.pcg(solve.blocks(s), NPIX, "common_white", 8, precon=np.where(hits > 0, 1 / np.maximum(hits, 1), 0))
    return spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(x) if v], "ipix long, val double")


@query()
def fit_source(spark, d):
    """A Gaussian source injected in white noise and fitted again."""
    s = src.events(spark, d).select("tod", "det", ((F.col("az") - 180) / 100).alias("dx"), (F.col("event_id") % 41 / 20.0 - 1).alias("dy"), (F.pmod(F.xxhash64("event_id"), F.lit(2001)) / 1000.0 - 1).alias("noise"))
    s = s.select("tod", "det", "dx", "dy", (C.gauss(F.col("dx"), F.col("dy"), 0.2, 0.1, 0.3, 5.0) + 0.1 * F.col("noise")).alias("dat"), F.lit(300.0).alias("w"))
    p, chi, err = solve.fit(s, ["gauss"], [0.1, 0.0, 0.4, 3.0], [4], iterations=20)
    return spark.createDataFrame([(n, float(a), float(b), chi) for n, a, b in zip(("x0", "y0", "sigma", "amp"), p, err, strict=True)], "par string, val double, err double, chisq double")


@query("SELECT (event_id * 7 % 32) * 24 + user_id * 13 % 24 AS ipix, count(*) AS hits, round(sum(value), 6) + 0.0 AS val FROM events GROUP BY ALL", None)
def streaming_hits(spark, d):
    """The event map from a stream of the same files; each batch's sums by pixel go to a table, and are summed when it is read."""
    import uuid

    kind = spark.read.parquet(f"{d}/events.parquet").schema
    at = f"{shared_folder(spark)}/hits-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d)
    run = write_batches(event_pixels(stream), f"{at}/table", f"{at}/checkpoint")
    run.awaitTermination()
    return rounded(whole_map(spark, f"{at}/table"), "val")


from . import catalog_arrays, catalog_maps, catalog_templates  # noqa: E402, F401  they register their queries


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
