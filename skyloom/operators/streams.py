"""Timestream operators as windows and aggregates: cuts, gaps, statistics, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY_DET = ("tod", "det")


def _along(order: str = "samp"):
    return Window.partitionBy(*BY_DET).orderBy(order)


def runs(samples: DataFrame, bad: Column) -> DataFrame:
    """(tod, det, start, stop) of each run of bad samples, half open."""
    marked = samples.where(bad).select(*BY_DET, "samp", (F.col("samp") - F.row_number().over(_along())).alias("island"))
    return marked.groupBy(*BY_DET, "island").agg(F.min("samp").alias("start"), (F.max("samp") + 1).alias("stop")).drop("island")


def merge_cuts(cuts: DataFrame) -> DataFrame:
    """Overlapping or touching intervals joined."""
    before = Window.partitionBy(*BY_DET).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("int")
    numbered = cuts.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(Window.partitionBy(*BY_DET).orderBy("start", "stop")))
    return numbered.groupBy(*BY_DET, "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("g")


def expand_cuts(cuts: DataFrame) -> DataFrame:
    return cuts.where("stop > start").select(*BY_DET, F.explode(F.sequence("start", F.col("stop") - 1)).alias("samp"))


def fill_linear(samples: DataFrame) -> DataFrame:
    """Null samples on the line between the nearest valid ones; at an end the nearest valid value."""
    w = _along()
    known = F.when(F.col("dat").isNotNull(), F.struct("samp", "dat"))
    back = F.last(known, ignorenulls=True).over(w)
    # looked at backwards, so that the frame grows by a row; one that shrinks is scanned anew for every row
    ahead = F.last(known, ignorenulls=True).over(Window.partitionBy(*BY_DET).orderBy(F.desc("samp")))
    s = samples.withColumns({"b": back, "a": ahead})
    span = (F.col("a.samp") - F.col("b.samp")).cast("double")
    line = F.col("b.dat") + F.try_divide((F.col("a.dat") - F.col("b.dat")) * (F.col("samp") - F.col("b.samp")), span)
    return s.withColumn("dat", F.coalesce("dat", line, "b.dat", "a.dat")).drop("a", "b")


def moments(samples: DataFrame, skew_thresh: float = 6.0, kurt_thresh: float = 5.0) -> DataFrame:
    """(tod, det, skew, kurt, bad): raw moments over powers of the deviation, flagged against their medians in the timestream."""
    d = F.col("dat")
    m = samples.groupBy(*BY_DET).agg((F.avg(d * d * d) / F.pow(F.stddev_pop(d), F.lit(1.5))).alias("skew"), (F.avg(d * d * d * d) / F.pow(F.stddev_pop(d), F.lit(2.0)) - 3).alias("kurt"))
    mid = m.groupBy("tod").agg(F.median(F.abs("skew")).alias("ms"), F.median(F.abs("kurt")).alias("mk"))
    return m.join(mid, "tod").select(*BY_DET, "skew", "kurt", ((F.abs("skew") > skew_thresh * F.col("ms")) | (F.abs("kurt") > kurt_thresh * F.col("mk"))).alias("bad"))


def common_mode(samples: DataFrame) -> DataFrame:
    return samples.groupBy("tod", "samp").agg(F.median("dat").alias("cm"))


def decimate(samples: DataFrame, times: int = 1) -> DataFrame:
    """Means of pairs, taken ``times`` times; a last odd sample is dropped."""
    if times > 1:
        samples = decimate(samples, times - 1)
    return samples.groupBy(*BY_DET, F.floor(F.col("samp") / 2).alias("samp")).agg(F.avg("dat").alias("dat"), F.count("*").alias("n")).where("n = 2").drop("n")


def numbered(samples: DataFrame) -> DataFrame:
    """(tod, ndet, nsamp, tag): timestreams numbered from 0 in order of their names; a row each, so one task numbers them."""
    each = samples.groupBy("tod").agg(F.countDistinct("det").alias("ndet"), F.count("*").alias("nsamp"))
    return each.withColumn("tag", F.dense_rank().over(Window.orderBy("tod")) - 1)


def save_pixels(samples: DataFrame, tag: str, pixel: Column) -> DataFrame:
    """Pixels kept beside the samples under a map's tag; those under the same tag are replaced."""
    return samples.withColumn(f"ipix_{tag}", pixel)


def clear_pixels(samples: DataFrame, tag: str) -> DataFrame:
    return samples.drop(f"ipix_{tag}")


def saved_pixels(samples: DataFrame, tag: str, otherwise: Column) -> Column:
    """The pixels under a tag, or the expression that makes them where there are none."""
    return F.col(f"ipix_{tag}") if f"ipix_{tag}" in samples.columns else otherwise


def empty_like(samples: DataFrame, value: str = "dat") -> DataFrame:
    """The same samples without signal."""
    return samples.withColumn(value, F.lit(0).cast(samples.schema[value].dataType))


def with_jumps(samples: DataFrame, jumps: DataFrame) -> DataFrame:
    """``piece``: the number of jumps of a side table (tod, det, samp) at or before a sample."""
    marked = samples.join(jumps.select(*BY_DET, "samp", F.lit(1).alias("jump")).distinct(), [*BY_DET, "samp"], "left")
    return marked.withColumn("piece", F.sum(F.coalesce("jump", F.lit(0))).over(_along().rowsBetween(Window.unboundedPreceding, 0))).drop("jump")


def truncate(samples: DataFrame, primes=(2, 3, 5, 7, 11), most: int | None = None) -> DataFrame:
    """Samples of each timestream below one more than the largest length of these prime factors that is shorter than its shortest detector (and ``most``)."""
    from ..functions.kernels import truncated_length

    size = samples.groupBy(*BY_DET).agg(F.count("*").alias("n")).groupBy("tod").agg(F.min("n").alias("n"))
    size = size if most is None else size.withColumn("n", F.least("n", F.lit(most)))
    cut = [(r["tod"], truncated_length(r["n"])) for r in size.collect()]  # a row a timestream
    if not cut:
        return samples
    lengths = samples.sparkSession.createDataFrame(cut, f"tod {samples.schema['tod'].dataType.simpleString()}, _n long")
    return samples.join(lengths, "tod").where("samp < _n").drop("_n")


def gap_pieces(samples: DataFrame, thresh: float) -> DataFrame:
    """``piece`` counts time gaps longer than ``thresh`` before a sample."""
    jump = (F.col("ctime") - F.lag("ctime").over(_along()) > thresh).cast("int")
    return samples.withColumn("jump", F.coalesce(jump, F.lit(0))).withColumn("piece", F.sum("jump").over(_along().rowsBetween(Window.unboundedPreceding, 0))).drop("jump")


def segments(samples: DataFrame, seg_len: int = 100) -> DataFrame:
    """``seg``: near-equal parts of about ``seg_len`` samples, the first ones longer."""
    return samples.withColumn("seg", near_equal(F.col("samp"), F.count("*").over(Window.partitionBy(*BY_DET)), seg_len))


def near_equal(at: Column, size: Column, seg_len: int) -> Column:
    n = F.greatest(F.lit(1), F.floor(size / seg_len))
    each, extra = F.floor(size / n), size % n
    return F.when(at < extra * (each + 1), F.floor(at / (each + 1))).otherwise(extra + F.floor((at - extra * (each + 1)) / each)).cast("long")


def gap_segments(samples: DataFrame, seg_len: int = 500, thresh: float = 10.0) -> DataFrame:
    """``piece`` and ``seg`` (within the piece): near-equal parts that don't cross a time gap.

    The sample before a step of over ``thresh`` times the detector's median step begins a piece, the first sample aside.
    """
    steps = samples.withColumn("step", F.lead("ctime").over(_along()) - F.col("ctime"))
    usual = steps.groupBy(*BY_DET).agg(F.median("step").alias("usual"))
    cut = F.coalesce((F.abs("step") > thresh * F.col("usual")) & (F.col("samp") > 0), F.lit(False)).cast("int")
    pieces = steps.join(usual, list(BY_DET)).withColumn("cut", cut).withColumn("piece", F.sum("cut").over(_along().rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*BY_DET, "piece")
    at = F.col("samp") - F.min("samp").over(whole)
    return pieces.withColumn("seg", near_equal(at, F.count("*").over(whole), seg_len)).drop("step", "usual", "cut")


def elevation_offsets(samples: DataFrame, elev: str = "elev") -> DataFrame:
    """``apix``: elevation less a parabola in time through the detectors' mean, over the timestream's largest such offset."""
    mean = samples.groupBy("tod", "samp").agg(F.avg(elev).alias("y"))
    long = mean.groupBy("tod").agg((F.max("samp") + 1).alias("n"))
    x, y = F.col("samp") / F.col("n") - 0.5, F.col("y")
    sums = mean.join(long, "tod").groupBy("tod", "n").agg(*[F.sum(F.pow(x, F.lit(k))).alias(f"s{k}") for k in range(5)], *[F.sum(y * F.pow(x, F.lit(k))).alias(f"y{k}") for k in range(3)])

    def det(columns):
        a, b, c = columns
        return a[0] * (b[1] * c[2] - b[2] * c[1]) - b[0] * (a[1] * c[2] - a[2] * c[1]) + c[0] * (a[1] * b[2] - a[2] * b[1])

    powers = [[F.col(f"s{i + j}") for j in range(3)] for i in range(3)]
    right = [F.col(f"y{j}") for j in range(3)]
    fit = sums.select("tod", "n", *[F.coalesce(F.try_divide(det([right if i == k else powers[i] for i in range(3)]), det(powers)), F.lit(0.0)).alias(f"c{k}") for k in range(3)])
    off = samples.join(fit, "tod").withColumn("off", F.col(elev) - (F.col("c0") + F.col("c1") * x + F.col("c2") * x * x))
    most = off.groupBy("tod").agg(F.max(F.abs("off")).alias("most"))
    return off.join(most, "tod").withColumn("apix", F.coalesce(F.try_divide(F.col("off"), F.col("most")), F.lit(0.0))).drop("n", "c0", "c1", "c2", "off", "most")


def notch_project(samples: DataFrame, low: float, high: float) -> DataFrame:
    """(tod, det, k, c, s): sums of data times cosine and sine of time since the start, for each timestream's evenly spaced frequencies from ``low`` to ``high``."""
    ends = samples.groupBy("tod").agg(F.min("ctime").alias("t0"), F.greatest(F.lit(1), F.ceil(2 * (high - low) * (F.max("ctime") - F.min("ctime")))).cast("int").alias("nfreq"))
    each = samples.join(ends, "tod").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nfreq") - 1)))
    angle = (F.col("ctime") - F.col("t0")) * (low + (high - low) * F.col("k") / F.greatest(F.col("nfreq") - 1, F.lit(1)))
    return each.groupBy(*BY_DET, "k").agg(F.sum(F.col("dat") * F.cos(angle)).alias("c"), F.sum(F.col("dat") * F.sin(angle)).alias("s"))


def project(samples: DataFrame, *key: str, value: Column | None = None) -> DataFrame:
    """A template's parameters: sums by its key (segment, bin, detector, sample...)."""
    return samples.groupBy(*key).agg(F.sum(F.col("dat") if value is None else value).alias("val"))


def legendre_project(samples: DataFrame, order: int = 3) -> DataFrame:
    """Sums of data times Legendre polynomials over each detector's samples."""
    n = F.count("*").over(Window.partitionBy(*BY_DET))
    return polynomial_project(samples.withColumn("x", F.when(n > 1, 2.0 * F.col("samp") / F.greatest(n - 1, F.lit(1)) - 1).otherwise(-1.0)), "x", order)


def polynomial_project(samples: DataFrame, at: str, order: int = 3) -> DataFrame:
    """Sums of each detector's data times Legendre polynomials in the column ``at``."""
    p = [F.lit(1.0), F.col(at)]
    for k in range(1, order):
        p.append(((2 * k + 1) * F.col(at) * p[k] - k * p[k - 1]) / (k + 1))
    return samples.groupBy(*BY_DET).agg(*[F.sum(F.col("dat") * p[k]).alias(f"p{k}") for k in range(order + 1)])


def az_bin(az: Column, lo: float, hi: float, bins: int) -> Column:
    return ((az - lo) * bins / (hi - lo)).cast("int")


def chebyshev_project(samples: DataFrame, count: int = 4, at: str = "az") -> DataFrame:
    """Sums of data times the Chebyshev polynomials 1 to ``count`` - 1 in ``at``, scaled to -1 to 1 over each timestream."""
    ends = samples.groupBy("tod").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))  # joined, so that no window gathers a timestream
    x = F.col("x")
    p = [F.lit(1.0), x]
    for _ in range(2, count):
        p.append(2 * x * p[-1] - p[-2])
    scaled = samples.join(ends, "tod").withColumn("x", F.coalesce(F.try_divide(F.col(at) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * 2 - 1)
    return scaled.groupBy(*BY_DET).agg(*[F.sum(F.col("dat") * p[k]).alias(f"t{k}") for k in range(1, count)])


def region_means(points: DataFrame, region: Column, value: str = "val") -> DataFrame:
    """(region, n, mean) of points in regions."""
    return points.select(region.alias("region"), F.col(value).alias("v")).where("region is not null").groupBy("region").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def region_bootstrap(points: DataFrame, region: Column, value: str = "val", resamples: int = 200) -> DataFrame:
    """(region, n, mean, boot_var) of points in regions: the variance of the mean over resamples.

    A resample draws each point as often as a Poisson variable of mean 1 says, whose
    seed is the point's hash, so the draw needs neither order nor a shuffle of points.
    """
    p = points.select(region.alias("region"), F.col(value).alias("v"), F.xxhash64(*points.columns).alias("h")).where("region is not null")
    u = (F.xxhash64("h", "draw").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).alias("u")
    cdf, times, term = 0.0, F.lit(0), 0.36787944117144233
    for k in range(1, 9):
        cdf += term
        term /= k
        times = times + (F.col("u") >= cdf).cast("int")
    drawn = p.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).select("region", "draw", "v", u).withColumn("w", times)
    boot = drawn.groupBy("region", "draw").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w").cast("double")).alias("m")).groupBy("region").agg(F.var_pop("m").alias("boot_var"))
    return region_means(points, region, value).join(boot, "region")
