"""Named queries of templates in both directions, and of systems of several components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import maps as M
from .operators import streams as S
from .operators import templates as T
from .plans import mapset
from .registry import OFFSETS_SQL, named, query, r, rounded
from .sources import samples as src

#: What follows a table g (tod, det, samp, dat, idx, w): parameters from the data, and the signal that they give.
BACK = "p AS (SELECT idx, sum(w * dat) AS v FROM g GROUP BY idx)"

DESIGNS: dict = {}


def template(name: str, sql: str, digits: int = 2, signal=None):
    """Register ``<name>_to_tod``: each sample's signal from the parameters that the data project on; ``signal`` gives it without the design's rows."""

    def add(design):
        DESIGNS[name] = design

        def run(spark, d):
            s = src.events(spark, d)
            if signal:
                return rounded(signal(s), "val", digits=digits)
            g = design(s)
            return rounded(T.spread(g, T.project(g, s)), "val", digits=digits)

        query(f", {sql}, {BACK} SELECT tod, det, samp, {r('sum(w * v)', 'val', digits)} FROM g JOIN p USING (idx) GROUP BY tod, det, samp")(named(f"{name}_to_tod", run))
        return design

    return add


@template("offset", "g AS (SELECT tod, det, samp, dat, tod || '/' || det AS idx, 1.0 AS w FROM samples)")
def offset(s):
    return T.offset(s)


@template("common", "g AS (SELECT tod, det, samp, dat, tod || '/' || samp AS idx, 1.0 AS w FROM samples)", 4)
def common(s):
    return T.common(s)


@template("stripes", "n AS (SELECT tod, det, greatest(1, count(*) // 100) AS n, count(*) AS c FROM samples GROUP BY tod, det), q AS (SELECT samples.*, c // n AS e, c % n AS x FROM samples JOIN n USING (tod, det)), g AS (SELECT tod, det, samp, dat, tod || '/' || det || '/' || CASE WHEN samp < x * (e + 1) THEN samp // (e + 1) ELSE x + (samp - x * (e + 1)) // e END AS idx, 1.0 AS w FROM q)")
def stripes(s):
    return T.stripes(s, 100)


@template("azimuth", "g AS (SELECT tod, det, samp, dat, tod || '/' || det || '/' || CAST(trunc(az * 36 / 360.0) AS INT) AS idx, 1.0 AS w FROM samples)")
def azimuth(s):
    return T.azimuth(s, 36)


@template("azimuth_shared", "g AS (SELECT tod, det, samp, dat, det || '/' || CAST(trunc(az * 36 / 360.0) AS INT) AS idx, 1.0 AS w FROM samples)")
def azimuth_shared(s):
    return T.azimuth(s, 36, shared=True)


@template("gain", "m AS (SELECT ipix, avg(dat) AS p FROM samples GROUP BY ipix), g AS (SELECT tod, det, samp, dat, tod || '/' || det AS idx, p AS w FROM samples JOIN m USING (ipix))", 0)
def gain(s):
    return T.gain(s.join(s.groupBy("ipix").agg(F.avg("dat").alias("p")), "ipix"), "p")


@template("chebyshev", "e AS (SELECT tod, min(az) AS lo, max(az) AS hi FROM samples GROUP BY tod), q AS (SELECT tod, det, samp, dat, 2 * (az - lo) / (hi - lo) - 1 AS x FROM samples JOIN e USING (tod)), g AS (SELECT tod, det, samp, dat, tod || '/' || det || '/' || k AS idx, CASE k WHEN 1 THEN x WHEN 2 THEN 2 * x * x - 1 ELSE 4 * x * x * x - 3 * x END AS w FROM q, (SELECT unnest([1, 2, 3]) AS k))")
def chebyshev(s):
    return T.chebyshev(s, 4)


@template("polynomial", "n AS (SELECT tod, det, count(*) AS c FROM samples GROUP BY tod, det), q AS (SELECT tod, det, samp, dat, CASE WHEN c > 1 THEN 2.0::DOUBLE * samp / greatest(c - 1, 1) - 1 ELSE -1 END AS x FROM samples JOIN n USING (tod, det)), g AS (SELECT tod, det, samp, dat, tod || '/' || det || '/' || k AS idx, CASE k WHEN 0 THEN 1 WHEN 1 THEN x WHEN 2 THEN (3 * x * x - 1) / 2 ELSE (5 * x * x * x - 3 * x) / 2 END AS w FROM q, (SELECT unnest([0, 1, 2, 3]) AS k))")
def polynomial(s):
    return T.polynomial(s, 3)


@template("airmass", "a AS (SELECT tod, det, samp, dat, 1 / cos(radians(az / 6)) - avg(1 / cos(radians(az / 6))) OVER (PARTITION BY tod) AS am FROM samples), g AS (SELECT tod, det, samp, dat, tod || '/' || k AS idx, pow(am, k + 1) AS w FROM a, (SELECT unnest([0, 1]) AS k))")
def airmass(s):
    return T.airmass(s, 2, F.radians(F.col("az") / 6))


@template("notch", "e AS (SELECT tod, min(ctime) AS t0, CAST(greatest(1, ceil(2 * 0.00001::DOUBLE * (max(ctime) - min(ctime)))) AS INT) AS n FROM samples GROUP BY tod), k AS (SELECT tod, t0, n, unnest(generate_series(0, n - 1)) AS k FROM e), q AS (SELECT tod, det, samp, dat, k, (ctime - t0) * (0.00001::DOUBLE + 0.00001::DOUBLE * k / greatest(n - 1, 1)) AS a FROM samples JOIN k USING (tod)), g AS (SELECT tod, det, samp, dat, tod || '/' || det || '/' || k || f AS idx, CASE f WHEN 'c' THEN cos(a) ELSE sin(a) END AS w FROM q, (SELECT unnest(['c', 's']) AS f))", signal=lambda s: T.notch_signal(s, 0.00001, 0.00002))
def notch(s):
    return T.notch(s, 0.00001, 0.00002)


@template("cuts", "g AS (SELECT tod, det, samp, dat, tod || '/' || det || '/' || samp AS idx, 1.0 AS w FROM samples WHERE event_id % 50 < 3)", 6)
def cut_samples(s):
    return T.cuts(s, F.expr("event_id % 50 < 3"))


@template("vectors", "g AS (SELECT tod, det, samp, dat, tod || '/' || det || '/' || k AS idx, cos(samp * k / 40.0::DOUBLE) AS w FROM samples, (SELECT unnest([1, 2]) AS k))")
def given_vectors(s):
    basis = s.select("tod", "samp").distinct().withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("v", F.cos(F.col("samp") * F.col("k") / 40.0))
    return T.vectors(s, basis)


@template("tagged", "g AS (SELECT tod, det, samp, dat, CAST(length(tod) % 2 AS VARCHAR) || '/' || det AS idx, 1.0 AS w FROM samples)")
def tagged(s):
    tags = s.select("tod").distinct().withColumn("tag", (F.length("tod") % 2).cast("string"))
    return T.routed(s, tags, "det")


@template("bowl", f"{OFFSETS_SQL}, g AS (SELECT tod, det, samp, dat, tod || '/' || det || '/' || k AS idx, CASE k WHEN 0 THEN 1 WHEN 1 THEN a WHEN 2 THEN (3 * a * a - 1) / 2 ELSE (5 * a * a * a - 3 * a) / 2 END AS w FROM ap, (SELECT unnest([0, 1, 2, 3]) AS k))")
def bowl(s):
    return T.bowl(s, 3, "az")


@query(f", n AS (SELECT tod, det, greatest(1, count(*) // 50) AS n, count(*) AS c FROM samples GROUP BY tod, det), q AS (SELECT samples.*, c // n AS e, c % n AS x FROM samples JOIN n USING (tod, det)), t AS (SELECT *, CASE WHEN samp < x * (e + 1) THEN samp // (e + 1) ELSE x + (samp - x * (e + 1)) // e END AS seg FROM q), l AS (SELECT tod, det, seg, dat, CASE WHEN max(samp) OVER w > min(samp) OVER w THEN 2.0::DOUBLE * (samp - min(samp) OVER w) / greatest(max(samp) OVER w - min(samp) OVER w, 1) - 1 ELSE 0 END AS x FROM t WINDOW w AS (PARTITION BY tod, det, seg)) SELECT tod, det, seg, {r('sum(dat)', 'level', 5)}, {r('sum(dat * x)', 'slope', 2)} FROM l GROUP BY tod, det, seg")
def template_stripe_slopes(spark, d):
    s = src.events(spark, d)
    got = T.project(T.stripes(s, 50, slope=True), s)
    p = F.split("idx", "/")
    got = got.groupBy(p[0].alias("tod"), p[1].cast("long").alias("det"), p[3].cast("long").alias("seg")).agg(F.sum(F.when(p[4] == "0", F.col("val"))).alias("level"), F.sum(F.when(p[4] == "1", F.col("val"))).alias("slope"))
    return rounded(rounded(got, "level", digits=5), "slope", digits=2)


@query("SELECT tod, det, samp, CASE WHEN event_id % 50 < 3 THEN 0.0 ELSE dat END AS dat FROM samples")
def cuts_replace(spark, d):
    """Cut samples overwritten by their parameters, which are zero here."""
    s = src.events(spark, d)
    zero = T.cuts(s, F.expr("event_id % 50 < 3")).select(*T.SAMPLE, F.lit(0.0).alias("val"))
    return T.add_to(s, zero, replace=True).select("tod", "det", "samp", "dat")


@query(f", m AS (SELECT ipix, avg(dat) AS v FROM samples GROUP BY ipix HAVING avg(dat) > 60) SELECT tod, det, samp, {r('1 / (v * v)', 'val', 9)} FROM samples JOIN m USING (ipix)")
def cut_prior(spark, d):
    """Prior of a deviation of each sample on pixels that a thresholded map keeps."""
    s = src.events(spark, d)
    m = s.groupBy("ipix").agg(F.avg("dat").alias("val")).where("val > 60")
    p = F.split("idx", "/")
    return rounded(T.cut_prior(s, m).select(p[0].alias("tod"), p[1].cast("long").alias("det"), p[2].cast("long").alias("samp"), "val"), "val", digits=9)


WEIGHTS = "st AS (SELECT tod, det, abs(dat - lag(dat) OVER (PARTITION BY tod, det ORDER BY samp)) AS s FROM samples), wt AS (SELECT tod, det, 1 / (sigma * sigma) AS w FROM (SELECT tod, det, median(s) / (2 * 0.4769362762044699) AS sigma FROM st GROUP BY tod, det) WHERE sigma > 0)"
SYSTEM = "n AS (SELECT tod, det, greatest(1, count(*) // 100) AS n, count(*) AS c FROM samples GROUP BY tod, det), q AS (SELECT samples.*, c // n AS e, c % n AS x FROM samples JOIN n USING (tod, det)), g AS (SELECT tod, det, samp, dat, 'sky' AS comp, CAST(ipix AS VARCHAR) AS idx FROM samples UNION ALL SELECT tod, det, samp, dat, 'stripes', tod || '/' || det || '/0/' || CASE WHEN samp < x * (e + 1) THEN samp // (e + 1) ELSE x + (samp - x * (e + 1)) // e END FROM q UNION ALL SELECT tod, det, samp, dat, 'cuts', tod || '/' || det || '/' || samp FROM samples WHERE event_id % 50 < 3)"
RIGHT = "b AS (SELECT comp, idx, sum(w * dat) AS val FROM g JOIN wt USING (tod, det) GROUP BY comp, idx)"


def system(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, design of sky, stripes and cuts, white weights)"""
    s = src.events(spark, d)
    design = T.together(T.sky(s), T.stripes(s, 100), T.cuts(s, F.expr("event_id % 50 < 3")))
    return s, design, M.white_weights(s)


@query(f", {WEIGHTS}, {SYSTEM}, {RIGHT} SELECT comp, idx, {r('val', 'val', 4)} FROM b")
def mapset_rhs(spark, d):
    """The noise-weighted data of each parameter of three components."""
    s, design, w = system(spark, d)
    return rounded(mapset.right_side(design, s, mapset.white(w)), "val", digits=4)


@query(f", {WEIGHTS}, {SYSTEM}, {RIGHT}, sg AS (SELECT tod, det, samp, sum(val) AS v FROM g JOIN b USING (comp, idx) GROUP BY tod, det, samp) SELECT comp, idx, {r('sum(w * v) + 0.25 * any_value(val)', 'val', 4)} FROM g JOIN sg USING (tod, det, samp) JOIN wt USING (tod, det) JOIN b USING (comp, idx) GROUP BY comp, idx")
def mapset_product(spark, d):
    """The system times its right-hand side, with a prior of a quarter on all parameters."""
    s, design, w = system(spark, d)
    b = mapset.right_side(design, s, mapset.white(w))
    prior = b.select(*T.PARAM, F.lit(0.25).alias("val"))
    return rounded(mapset.applied(design, b, mapset.white(w), prior), "val", digits=4)


ALGEBRA = f", {WEIGHTS}, {SYSTEM}, x AS (SELECT comp, idx, sum(dat) AS val FROM g GROUP BY comp, idx), {RIGHT}"


def _two(spark, d):
    s, design, w = system(spark, d)
    return T.project(design, s), mapset.right_side(design, s, mapset.white(w))


@query(f"{ALGEBRA} SELECT {r('sum(x.val * b.val)', 'dot', 1)} FROM x JOIN b USING (comp, idx)")
def mapset_dot(spark, d):
    x, y = _two(spark, d)
    return rounded(mapset.product(x, y).agg(F.sum("val").alias("dot")), "dot", digits=1)


for _name, _a, _sql in (("axpy", -0.5, "x.val - 0.5 * b.val"), ("add", 1.0, "x.val + b.val"), ("subtract", -1.0, "x.val - b.val")):

    def _run(spark, d, a=_a):
        x, y = _two(spark, d)
        return rounded(mapset.combine(x, y, 1.0, a), "val", digits=4)

    query(f"{ALGEBRA} SELECT comp, idx, {r(_sql, 'val', 4)} FROM x JOIN b USING (comp, idx)")(named(f"mapset_{_name}", _run))


@query(f"{ALGEBRA} SELECT comp, idx, {r('x.val * b.val', 'val', 1)} FROM x JOIN b USING (comp, idx)")
def mapset_times(spark, d):
    return rounded(mapset.product(*_two(spark, d)), "val", digits=1)


@query(f"{ALGEBRA} SELECT comp, idx, 0.0::DOUBLE AS val FROM x")
def mapset_clear(spark, d):
    return mapset.cleared(_two(spark, d)[0])


@query(f", {WEIGHTS}, {SYSTEM}, {RIGHT}, di AS (SELECT comp, idx, sum(w) + CASE comp WHEN 'sky' THEN 0 ELSE 0.25 END AS dv FROM g JOIN wt USING (tod, det) GROUP BY comp, idx), z AS (SELECT comp, idx, val, val / dv AS z FROM b JOIN di USING (comp, idx)), sg AS (SELECT tod, det, samp, sum(z) AS v FROM g JOIN z USING (comp, idx) GROUP BY tod, det, samp), pap AS (SELECT sum(w * v * v) AS a FROM sg JOIN wt USING (tod, det)), pr AS (SELECT sum(val * z) AS zr, sum(CASE comp WHEN 'sky' THEN 0 ELSE 0.25 * z * z END) AS q FROM z) SELECT comp, idx, {r('z * zr / (a + q)', 'val', 5)} FROM z, pap, pr")
def mapset_first_step(spark, d):
    """One step of preconditioned conjugate gradients for a map, stripes and cuts with a prior on the latter two."""
    return rounded(_solved(spark, d, 1)[0], "val", digits=5)


def _solved(spark, d, steps):
    s, design, w = system(spark, d)
    design, w = mapset.kept(design, "design"), mapset.kept(w, "weights")
    noise = mapset.white(w)
    b = mapset.right_side(design, s, noise)
    prior = design.where("comp <> 'sky'").select(*T.PARAM).distinct().withColumn("val", F.lit(0.25))
    precon = mapset.inverse(mapset.diagonal(design, w, prior))
    return mapset.solve(design, b, noise, steps, mapset.kept(precon, "precon"), mapset.kept(prior, "prior"))


@query()
def mapset_solve(spark, d):
    """A map, stripes and cut samples solved together (tests compare with a dense solution)."""
    return _solved(spark, d, 6)[0]


@query(f", {WEIGHTS} SELECT tod, det, samp, {r('w * dat', 'val', 7)} FROM samples JOIN wt USING (tod, det) WHERE event_id % 11 > 0")
def noise_white_masked(spark, d):
    """White noise that gives masked samples no weight, kept out of the result."""
    s = src.events(spark, d).withColumn("mask", F.expr("event_id % 11 > 0"))
    return rounded(mapset.white_masked(s, M.white_weights(s))(s.select(*T.SAMPLE, F.col("dat").alias("val"))), "val", digits=7)


@query(f", v AS (SELECT tod, det, avg(dat) / 50 AS v, 1 / var_pop(dat) AS w FROM samples GROUP BY tod, det), c AS (SELECT tod, samp, sum(v * w * dat) / sum(v * v * w) AS cm FROM samples JOIN v USING (tod, det) GROUP BY tod, samp) SELECT tod, det, samp, {r('w * (dat - v * cm)', 'val', 7)} FROM samples JOIN v USING (tod, det) JOIN c USING (tod, samp)")
def noise_common_white_apply(spark, d):
    """Noise with one given common mode, applied by two aggregations."""
    s = src.events(spark, d)
    modes = s.groupBy("tod", "det").agg((F.avg("dat") / 50).alias("v"), (1 / F.var_pop("dat")).alias("w"))
    return rounded(mapset.common_white(modes)(s.select(*T.SAMPLE, F.col("dat").alias("val"))), "val", digits=7)


@query(f", m AS (SELECT ipix, var_pop(dat) AS v, avg(dat) AS val FROM samples GROUP BY ipix) SELECT ipix, {r('CASE WHEN v > 0 THEN 1 / v ELSE v END * 2 * val', 'val', 6)} FROM m")
def map_noise_white(spark, d):
    """A map weighted by an inverse variance for each pixel, given as variances and scaled by two."""
    m = src.events(spark, d).groupBy("ipix").agg(F.var_pop("dat").alias("v"), F.avg("dat").alias("val"))
    return rounded(M.pixel_noise(m.select("ipix", "val"), m.select("ipix", F.col("v").alias("val")), inverse=False, factor=2.0), "val")


@query("SELECT min(az) AS lo, max(az) AS hi, min(dat) AS lo_dat, max(dat) AS hi_dat, count(*) AS nsamp, count(DISTINCT tod) AS ntod FROM samples")
def all_limits(spark, d):
    """Limits and sample count over all timestreams."""
    return src.events(spark, d).agg(F.min("az").alias("lo"), F.max("az").alias("hi"), F.min("dat").alias("lo_dat"), F.max("dat").alias("hi_dat"), F.count("*").alias("nsamp"), F.countDistinct("tod").alias("ntod"))


@query("SELECT tod, dense_rank() OVER (ORDER BY tod) - 1 AS tag, ndet, nsamp FROM (SELECT tod, count(DISTINCT det) AS ndet, count(*) AS nsamp FROM samples GROUP BY tod)")
def timestream_tags(spark, d):
    """Timestreams numbered in order, as they are added to a set."""
    return S.numbered(src.events(spark, d)).select("tod", F.col("tag").cast("long").alias("tag"), "ndet", "nsamp")


@query("SELECT tod, det, samp, ipix AS ipix_fine, (ipix // 24 // 4) * 6 + ipix % 24 // 4 AS ipix_coarse FROM samples")
def saved_pixels(spark, d):
    """Pixels of two maps kept beside the samples, each under its map's tag; one that isn't needed any more is dropped."""
    s = S.save_pixels(src.events(spark, d), "fine", F.col("ipix"))
    coarse = F.floor(F.col("ipix") / 24 / 4) * 6 + F.floor(F.col("ipix") % 24 / 4)
    s = S.save_pixels(S.save_pixels(s, "coarse", coarse), "unused", F.lit(0))
    return S.clear_pixels(s, "unused").select("tod", "det", "samp", "ipix_fine", F.col("ipix_coarse").cast("long").alias("ipix_coarse"))


@query("SELECT tod, det, samp, 0.0::DOUBLE AS dat FROM samples")
def empty_like(spark, d):
    return S.empty_like(src.events(spark, d)).select("tod", "det", "samp", "dat")


@query(", j AS (SELECT tod, det, samp FROM samples WHERE event_id % 500 = 0), p AS (SELECT tod, det, samp, dat, sum(CASE WHEN event_id % 500 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY tod, det ORDER BY samp) AS piece FROM samples) SELECT tod, det, CAST(piece AS BIGINT) AS piece, count(*) AS n, round(avg(dat), 6) AS level FROM p GROUP BY ALL")
def jumps_attached(spark, d):
    """Levels between the jumps of a side table (tod, det, samp)."""
    s = src.events(spark, d)
    jumps = s.where("event_id % 500 = 0").select("tod", "det", "samp")
    return rounded(S.with_jumps(s, jumps).groupBy("tod", "det", "piece").agg(F.count("*").alias("n"), F.avg("dat").alias("level")), "level")


SMOOTH_LENGTHS = [n for n in range(1, 200) if not [p for p in range(13, n + 1) if n % p == 0 and all(p % q for q in range(2, int(p**0.5) + 1))]]


@query(f", n AS (SELECT tod, min(c) AS c FROM (SELECT tod, det, count(*) AS c FROM samples GROUP BY tod, det) GROUP BY tod), g AS (SELECT unnest({SMOOTH_LENGTHS}) AS k), t AS (SELECT tod, max(k) + 1 AS n FROM n JOIN g ON k <= least(c, 200) - 1 GROUP BY tod) SELECT tod, det, samp, dat FROM samples JOIN t USING (tod) WHERE samp < n")
def truncate_timestreams(spark, d):
    """Timestreams cut to one more than the largest length of small prime factors that fits, at most 200 samples here."""
    s = src.events(spark, d)
    return S.truncate(s, most=200).select("tod", "det", "samp", "dat")


@query(", h AS (SELECT tod, det, samp // 2 AS samp, avg(dat) AS dat FROM samples GROUP BY tod, det, samp // 2 HAVING count(*) = 2) SELECT tod, det, samp // 2 AS samp, round(avg(dat), 6) + 0.0 AS dat FROM h GROUP BY tod, det, samp // 2 HAVING count(*) = 2")
def decimate_twice(spark, d):
    return rounded(S.decimate(src.events(spark, d), 2), "dat")


@query("WITH lower AS (SELECT s_suppkey, lower(trim('_' FROM '_' || s_name || '__')) AS name FROM supplier) SELECT name, 'file-' || s_suppkey || '.fits' AS file FROM lower WHERE s_suppkey % 5 = 0", None)
def bad_files(spark, d):
    """Files that a blacklist by source name holds; names are compared in small letters without outer underscores."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    listed = s.where("s_suppkey % 5 = 0").select(F.upper("s_name").alias("source"), F.concat(F.lit("file-"), "s_suppkey", F.lit(".fits")).alias("file"))
    asked = s.select(F.concat(F.lit("_"), "s_name", F.lit("__")).alias("source"))
    return src.bad_files(asked, listed)


#: Edges of rings in seconds of arc (fixed values): the widest set, the middle and the narrow one end earlier.
_FINE = [0, 5, 15, 25, 35, 45, 55, 65, 75, 85, 95, 105, 120, 135, 150, 165, 180]
_TENS = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 105, 120, 135, 150, 165, 180]
_TAILS = {"max": [210, 240, 270, 330], "medium": [240], "narrow": []}


def ring_edges(size: str = "narrow", tens: bool = False) -> np.ndarray:
    """Ring edges by name: max, medium, narrow (of ten seconds each if ``tens``), wide or ultrawide."""
    if size == "wide":
        return np.array([0, 10, 30, 50, 70, 90, 120, 150, 180, 240], float)
    if size == "ultrawide":
        return np.array([0, 10, 30, 50, 70, 100, 130, 190, 280], float)
    return np.array([*(_TENS if tens else _FINE), *_TAILS[size]], float)


@query(f", e AS (SELECT unnest({ring_edges('max')[:-1].tolist()}) AS lo, unnest({ring_edges('max')[1:].tolist()}) AS hi) SELECT CAST(row_number() OVER (ORDER BY lo) - 1 AS BIGINT) AS ring, n, val FROM (SELECT lo, count(*) AS n, round(avg(dat), 6) + 0.0 AS val FROM samples JOIN e ON az >= lo AND az < hi GROUP BY lo)")
def ring_edge_means(spark, d):
    """Means over the rings of the widest set of edges; azimuth stands for the radius."""
    edges = ring_edges("max").tolist()
    s = src.events(spark, d).select("dat", (F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("az"))) - 1).cast("long").alias("ring")).where(f"ring < {len(edges) - 1}")
    got = s.groupBy("ring").agg(F.count("*").alias("n"), F.avg("dat").alias("val"))
    from pyspark.sql import Window

    return rounded(got.withColumn("ring", (F.row_number().over(Window.orderBy("ring")) - 1).cast("long")), "val")
