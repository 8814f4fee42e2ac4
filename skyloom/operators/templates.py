"""Templates as rows of a design matrix: (tod, det, samp, comp, idx, w).

Parameter ``idx`` of component ``comp`` enters a sample with weight ``w``.  Projecting
data on parameters is a sum by (comp, idx); spreading parameters over samples is an
equi-join and a sum by sample.  Both directions follow from the same rows, so they are
transposes of each other.  Components of one system are put together by ``union``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import streams as S

SAMPLE, PARAM = ("tod", "det", "samp"), ("comp", "idx")


def rows(samples: DataFrame, comp: str, *key: str | Column, weight: Column | float = 1.0) -> DataFrame:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return samples.select(*SAMPLE, F.lit(comp).alias("comp"), F.concat_ws("/", *key).alias("idx"), w.cast("double").alias("w"))


def many(samples: DataFrame, comp: str, key: tuple, weights: list[Column], names: list[str] | None = None) -> DataFrame:
    """A parameter for each of several weights."""
    names = names or [str(k) for k in range(len(weights))]
    each = F.array(*[F.struct(F.lit(n).alias("k"), w.cast("double").alias("w")) for n, w in zip(names, weights, strict=True)])
    return samples.select(*SAMPLE, *[k for k in key if k not in SAMPLE], F.explode(each).alias("e")).select(*SAMPLE, F.lit(comp).alias("comp"), F.concat_ws("/", *key, "e.k").alias("idx"), F.col("e.w").alias("w"))


def sky(samples: DataFrame, comp: str = "sky", pixel: str = "ipix") -> DataFrame:
    return rows(samples, comp, pixel)


def offset(samples: DataFrame, comp: str = "offset") -> DataFrame:
    return rows(samples, comp, "tod", "det")


def common(samples: DataFrame, comp: str = "common") -> DataFrame:
    """A value for each sample of a timestream, which all detectors share."""
    return rows(samples, comp, "tod", "samp")


def stripes(samples: DataFrame, seg_len: int = 500, gap: float | None = None, slope: bool = False, comp: str = "stripes") -> DataFrame:
    """Offsets of near-equal segments, which don't cross a gap of over ``gap`` median steps; with ``slope`` a line in each as well."""
    s = S.segments(samples, seg_len).withColumn("piece", F.lit(0)) if gap is None else S.gap_segments(samples, seg_len, gap)
    if not slope:
        return rows(s, comp, "tod", "det", "piece", "seg")
    ends = s.groupBy("tod", "det", "piece", "seg").agg(F.min("samp").alias("lo"), F.max("samp").alias("hi"))
    x = F.when(F.col("hi") > F.col("lo"), 2.0 * (F.col("samp") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) - 1).otherwise(0.0)
    return many(s.join(ends, ["tod", "det", "piece", "seg"]), comp, ("tod", "det", "piece", "seg"), [F.lit(1.0), x])


def azimuth(samples: DataFrame, bins: int = 360, lo: float = 0.0, hi: float = 360.0, shared: bool = False, at: str = "az", comp: str = "azimuth") -> DataFrame:
    """A value for each azimuth bin of a detector, of one timestream or shared by all."""
    s = samples.withColumn("bin", S.az_bin(F.col(at), lo, hi, bins))
    return rows(s, comp, "det", "bin") if shared else rows(s, comp, "tod", "det", "bin")


def gain(samples: DataFrame, predicted: str, comp: str = "gain") -> DataFrame:
    """A factor of the predicted signal for each detector."""
    return rows(samples, comp, "tod", "det", weight=F.col(predicted))


def chebyshev(samples: DataFrame, count: int = 4, at: str = "az", comp: str = "chebyshev") -> DataFrame:
    """Chebyshev polynomials 1 to ``count`` - 1 in ``at``, scaled to -1 to 1 over the timestream."""
    ends = samples.groupBy("tod").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    x = F.col("x")
    p = [F.lit(1.0), x]
    for _ in range(2, count):
        p.append(2 * x * p[-1] - p[-2])
    scaled = samples.join(ends, "tod").withColumn("x", F.coalesce(F.try_divide(F.col(at) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * 2 - 1)
    return many(scaled, comp, ("tod", "det"), p[1:count], [str(k) for k in range(1, count)])


def legendre_terms(x: Column, order: int) -> list[Column]:
    p = [F.lit(1.0), x]
    for k in range(1, order):
        p.append(((2 * k + 1) * x * p[k] - k * p[k - 1]) / (k + 1))
    return p[: order + 1]


def polynomial(samples: DataFrame, order: int = 10, comp: str = "polynomial") -> DataFrame:
    """Legendre polynomials over each detector's samples."""
    size = samples.groupBy("tod", "det").agg(F.count("*").alias("n"))
    x = F.when(F.col("n") > 1, 2.0 * F.col("samp") / F.greatest(F.col("n") - 1, F.lit(1)) - 1).otherwise(-1.0)
    return many(samples.join(size, ["tod", "det"]).withColumn("x", x), comp, ("tod", "det"), legendre_terms(F.col("x"), order))


def bowl(samples: DataFrame, order: int = 3, elev: str = "elev", comp: str = "bowl") -> DataFrame:
    """Legendre polynomials in each detector's elevation offset."""
    return many(S.elevation_offsets(samples, elev), comp, ("tod", "det"), legendre_terms(F.col("apix"), order))


def airmass(samples: DataFrame, order: int = 3, elev: Column | None = None, comp: str = "airmass") -> DataFrame:
    """Powers of a timestream's scaled airmass, 1 / cos of elevation less its mean."""
    s = samples.withColumn("x", 1 / F.cos(F.col("elev") if elev is None else elev))
    mean = s.groupBy("tod").agg(F.avg("x").alias("mx"))
    am = F.col("am")
    return many(s.join(mean, "tod").withColumn("am", F.col("x") - F.col("mx")), comp, ("tod",), [F.pow(am, F.lit(k + 1)) for k in range(order)])


def notch_ends(samples: DataFrame, low: float, high: float) -> DataFrame:
    """(tod, t0, nfreq): start and number of frequencies of each timestream."""
    return samples.groupBy("tod").agg(F.min("ctime").alias("t0"), F.greatest(F.lit(1), F.ceil(2 * (high - low) * (F.max("ctime") - F.min("ctime")))).cast("int").alias("nfreq"))


def notch_angle(low: float, high: float, k: Column) -> Column:
    return (F.col("ctime") - F.col("t0")) * (low + (high - low) * k / F.greatest(F.col("nfreq") - 1, F.lit(1)))


def notch(samples: DataFrame, low: float, high: float, comp: str = "notch") -> DataFrame:
    """Cosine and sine of time at each timestream's evenly spaced frequencies from ``low`` to ``high``.

    The rows are many times the samples, which size estimates don't see: they are never broadcast.
    """
    s = samples.join(notch_ends(samples, low, high), "tod").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nfreq") - 1)))
    return many(s.withColumn("angle", notch_angle(low, high, F.col("k"))), comp, ("tod", "det", "k"), [F.cos("angle"), F.sin("angle")], ["c", "s"]).hint("merge")


def notch_signal(samples: DataFrame, low: float, high: float) -> DataFrame:
    """(tod, det, samp, val): what ``notch``'s parameters of the data give each sample, without a row for each sample and parameter.

    The data are summed by detector and frequency; then a detector's sums stand beside each of its samples.
    """
    sums = S.notch_project(samples, low, high).groupBy("tod", "det").agg(F.sort_array(F.collect_list(F.struct("k", "c", "s"))).alias("sums"))
    angle = lambda p: notch_angle(low, high, p["k"])
    val = F.aggregate("sums", F.lit(0.0), lambda v, p: v + F.cos(angle(p)) * p["c"] + F.sin(angle(p)) * p["s"])
    return samples.join(notch_ends(samples, low, high), "tod").join(sums, ["tod", "det"]).select(*SAMPLE, val.alias("val"))


def cuts(samples: DataFrame, bad: Column, comp: str = "cuts") -> DataFrame:
    """A value of its own for each bad sample."""
    return rows(samples.where(bad), comp, "tod", "det", "samp")


def vectors(samples: DataFrame, basis: DataFrame, comp: str = "vectors") -> DataFrame:
    """Given vectors, (tod, samp, k, v), with a parameter for each detector and k."""
    return samples.join(basis, ["tod", "samp"]).select(*SAMPLE, F.lit(comp).alias("comp"), F.concat_ws("/", "tod", "det", "k").alias("idx"), F.col("v").cast("double").alias("w"))


def routed(samples: DataFrame, tags: DataFrame, *key: str | Column, weight: Column | float = 1.0, comp: str = "tagged") -> DataFrame:
    """Parameters by tag instead of timestream: ``tags`` is (tod, tag); all timestreams of a tag share them, one without a tag has none."""
    return rows(samples.join(tags, "tod"), comp, "tag", *key, weight=weight)


def together(*designs: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, designs)


def project(design: DataFrame, data: DataFrame, value: str = "dat") -> DataFrame:
    """(comp, idx, val): the data of each parameter, weighted and summed."""
    return design.join(data.select(*SAMPLE, F.col(value).alias("d")), list(SAMPLE)).groupBy(*PARAM).agg(F.sum(F.col("w") * F.col("d")).alias("val"))


def spread(design: DataFrame, params: DataFrame, small: bool = False) -> DataFrame:
    """(tod, det, samp, val): what parameters (comp, idx, val) give each sample; ``small``: known to fit in every task."""
    params = params.select(*PARAM, "val")
    return design.join(F.broadcast(params) if small else params, list(PARAM)).groupBy(*SAMPLE).agg(F.sum(F.col("w") * F.col("val")).alias("val"))


def add_to(samples: DataFrame, signal: DataFrame, replace: bool = False, value: str = "dat") -> DataFrame:
    """Samples with a signal (tod, det, samp, val) added, or put in place of their data; samples without one keep theirs."""
    got = samples.join(signal.select(*SAMPLE, F.col("val").alias("_val")), list(SAMPLE), "left")
    new = F.coalesce(F.col("_val"), F.col(value)) if replace else F.col(value) + F.coalesce("_val", F.lit(0.0))
    return got.withColumn(value, new).drop("_val")


def cut_prior(samples: DataFrame, image: DataFrame, comp: str = "cuts") -> DataFrame:
    """(comp, idx, val): for samples on pixels where a map isn't zero, one over the map's square."""
    some = samples.join(image.where("val <> 0").select("ipix", F.col("val").alias("m")), "ipix")
    return some.select(F.lit(comp).alias("comp"), F.concat_ws("/", *SAMPLE).alias("idx"), (1 / (F.col("m") * F.col("m"))).alias("val"))
