"""Maps as tables: scatter (sum by pixel), gather (lookup by pixel), hits, polarisation, algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A map is sent to all tasks if it has so many pixels at most; larger ones are joined by shuffle.
SMALL_MAP = 200_000


def scatter(samples: DataFrame, value: Column, key=("ipix",), name: str = "val") -> DataFrame:
    return samples.groupBy(*key).agg(F.sum(value).alias(name))


def gather(samples: DataFrame, image: DataFrame, key: str = "ipix", npix: int | None = None) -> DataFrame:
    """Each sample with its pixel's ``val``, 0 where the map has none.  ``npix``: the size of the map's grid, if known."""
    image = F.broadcast(image) if npix is not None and npix <= SMALL_MAP else image
    return samples.join(image, key, "left").withColumn("val", F.coalesce("val", F.lit(0.0)))


def hits(samples: DataFrame, weights: DataFrame | None = None, mask: Column | None = None) -> DataFrame:
    """Counts, or summed detector weights, by pixel; masked samples (``mask`` false) count as zero."""
    share = F.lit(1.0) if mask is None else mask.cast("double")
    if weights is None:
        return scatter(samples, share)
    return scatter(samples.join(weights, ["tod", "det"]), F.col("w") * share)


def white_weights(samples: DataFrame) -> DataFrame:
    """(tod, det, sigma, w) from the median step between samples."""
    from pyspark.sql import Window

    from ..functions.kernels import ERFINV_HALF

    w = Window.partitionBy("tod", "det").orderBy("samp")
    step = samples.select("tod", "det", F.abs(F.col("dat") - F.lag("dat").over(w)).alias("step"))
    sigma = step.groupBy("tod", "det").agg((F.median("step") / (2 * ERFINV_HALF)).alias("sigma"))
    return sigma.withColumn("w", F.try_divide(F.lit(1.0), F.col("sigma") * F.col("sigma"))).where("w is not null")


def white_map(samples: DataFrame) -> DataFrame:
    """(ipix, hits, weight, val): the maximum-likelihood map under white noise, weighted mean by pixel."""
    joined = samples.join(white_weights(samples), ["tod", "det"])
    return joined.groupBy("ipix").agg(F.count("*").alias("hits"), F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col("dat")) / F.sum("w")).alias("val"))


def scatter_iqu(samples: DataFrame, angle: Column) -> DataFrame:
    d = F.col("dat")
    return samples.groupBy("ipix").agg(F.sum(d).alias("i"), F.sum(d * F.cos(angle)).alias("q"), F.sum(d * F.sin(angle)).alias("u"))


def precon_iqu(samples: DataFrame, angle: Column) -> DataFrame:
    c, s = F.cos(angle), F.sin(angle)
    return samples.groupBy("ipix").agg(F.count("*").cast("double").alias("ii"), F.sum(c).alias("iq"), F.sum(s).alias("iu"), F.sum(c * c).alias("qq"), F.sum(c * s).alias("qu"), F.sum(s * s).alias("uu"))


def gather_iqu(samples: DataFrame, image: DataFrame, angle: Column) -> DataFrame:
    joined = samples.join(image, "ipix", "left")
    return joined.withColumn("val", F.coalesce("i", F.lit(0.0)) + F.coalesce("q", F.lit(0.0)) * F.cos(angle) + F.coalesce("u", F.lit(0.0)) * F.sin(angle))


def scatter_qu(samples: DataFrame, angle: Column) -> DataFrame:
    d = F.col("dat")
    return samples.groupBy("ipix").agg(F.sum(d * F.cos(angle)).alias("q"), F.sum(d * F.sin(angle)).alias("u"))


def gather_qu(samples: DataFrame, image: DataFrame, angle: Column) -> DataFrame:
    joined = samples.join(image, "ipix", "left")
    return joined.withColumn("val", F.coalesce("q", F.lit(0.0)) * F.cos(angle) + F.coalesce("u", F.lit(0.0)) * F.sin(angle))


def precon_qu(samples: DataFrame, angle: Column) -> DataFrame:
    c, s = F.cos(angle), F.sin(angle)
    return samples.groupBy("ipix").agg(F.sum(c * c).alias("qq"), F.sum(s * s).alias("uu"), F.sum(c * s).alias("qu"))


#: Components by the tag of a polarised map.
POLS = {"I": ["i"], "QU": ["q", "u"], "IQU": ["i", "q", "u"], "QU_PRECON": ["qq", "uu", "qu"], "IQU_PRECON": ["ii", "iq", "iu", "qq", "qu", "uu"]}


def scatter_pol(samples: DataFrame, tag: str, angle: Column) -> DataFrame:
    """Polarised scatter by the map's tag."""
    by_tag = {"I": lambda: scatter(samples, F.col("dat"), name="i"), "QU": lambda: scatter_qu(samples, angle), "IQU": lambda: scatter_iqu(samples, angle), "QU_PRECON": lambda: precon_qu(samples, angle), "IQU_PRECON": lambda: precon_iqu(samples, angle)}
    if tag not in by_tag:
        raise ValueError(f"unknown polarisation {tag}")
    return by_tag[tag]()


def blank(spark, npix: int, tag: str = "I") -> DataFrame:
    """(ipix, pol, val): a map of zeros with the components of its tag."""
    pols = F.array(*[F.lit(p) for p in POLS[tag]])
    return spark.range(npix).select(F.col("id").alias("ipix"), F.explode(pols).alias("pol"), F.lit(0.0).alias("val"))


def melt(image: DataFrame, pols: list[str]) -> DataFrame:
    """(ipix, pol, val) of a map with a column for each component."""
    return image.unpivot(["ipix"], pols, "pol", "val")


def invert_iqu(precon: DataFrame, thresh: float = 1e-6) -> DataFrame:
    """3x3 blocks inverted; one whose determinant is below ``thresh`` of the largest keeps 1 / ii (if positive) alone."""
    ii, iq, iu, qq, qu, uu = (F.col(c) for c in POLS["IQU_PRECON"])
    minors = {"ii": qq * uu - qu * qu, "iq": iu * qu - iq * uu, "iu": iq * qu - iu * qq, "qq": ii * uu - iu * iu, "qu": iq * iu - ii * qu, "uu": ii * qq - iq * iq}
    with_det = precon.withColumn("_det", ii * minors["ii"] + iq * minors["iq"] + iu * minors["iu"])
    top = with_det.agg(F.max("_det")).first()[0]
    good = F.col("_det") >= thresh * (top or 0.0)
    alone = F.when(ii > 0, F.try_divide(F.lit(1.0), ii)).otherwise(0.0)
    return with_det.select("ipix", *[F.when(good, F.try_divide(m, F.col("_det"))).otherwise(alone if n == "ii" else F.lit(0.0)).alias(n) for n, m in minors.items()])


def block_times(precon: DataFrame, image: DataFrame, tag: str = "IQU") -> DataFrame:
    """Each pixel's symmetric block times its vector."""
    if f"{tag}_PRECON" not in POLS:
        raise ValueError(f"no blocks for polarisation {tag}")
    joined = precon.join(image, "ipix")
    entry = lambda a, b: F.col(a + b if a + b in precon.columns else b + a)
    return joined.select("ipix", *[sum((entry(a, b) * F.col(b) for b in POLS[tag][1:]), entry(a, POLS[tag][0]) * F.col(POLS[tag][0])).alias(f"{a}") for a in POLS[tag]])


def pixel_noise(image: DataFrame, variance: DataFrame, inverse: bool = True, factor: float = 1.0) -> DataFrame:
    """A map times its pixels' inverse variance; ``inverse`` false: variances are given, and those above zero are inverted."""
    v = F.col("_v")
    w = v if inverse else F.when(v > 0, F.try_divide(F.lit(1.0), v)).otherwise(v)
    return image.join(variance.select("ipix", F.col("val").alias("_v")), "ipix").select("ipix", (F.col("val") * w * factor).alias("val"))


def gradient_mask(image: DataFrame, weight: DataFrame, hit: DataFrame, nx: int, ny: int, thresh: float = 4.0) -> DataFrame:
    """(ipix, grad): the gradient where it is over ``thresh`` times a sample's noise in the pixel, elsewhere 0.

    A sample's noise is the map's noise (the root of the inverse weight) times the root of the hits.
    """
    grad = gradient(image, nx, ny)
    noise = invert(weight).select("ipix", F.sqrt("val").alias("_noise")).join(hit.select("ipix", F.col("val").alias("_hits")), "ipix")
    level = F.coalesce(F.col("_noise") * F.sqrt("_hits"), F.lit(0.0))
    return grad.join(noise, "ipix", "left").select("ipix", F.when(F.col("grad") > thresh * level, F.col("grad")).otherwise(0.0).alias("grad"))


def invert_qu(precon: DataFrame, thresh: float = 1e-6) -> DataFrame:
    """2x2 blocks inverted; blocks whose determinant is below ``thresh`` of their squared trace are zero."""
    det = F.col("qq") * F.col("uu") - F.col("qu") * F.col("qu")
    good = det > thresh * F.pow(F.col("qq") + F.col("uu"), 2)
    return precon.select("ipix", *[F.when(good, x / det).otherwise(0.0).alias(n) for n, x in (("qq", F.col("uu")), ("uu", F.col("qq")), ("qu", -F.col("qu")))])


def axpy(x: DataFrame, y: DataFrame, a: float, key=("ipix",)) -> DataFrame:
    return x.select(*key, "val").unionByName(y.select(*key, (a * F.col("val")).alias("val"))).groupBy(*key).agg(F.sum("val").alias("val"))


def dot(x: DataFrame, y: DataFrame, key=("ipix",)) -> DataFrame:
    return x.select(*key, F.col("val").alias("a")).join(y.select(*key, F.col("val").alias("b")), list(key)).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("dot"))


def times(x: DataFrame, y: DataFrame, key=("ipix",)) -> DataFrame:
    return x.select(*key, F.col("val").alias("a")).join(y.select(*key, F.col("val").alias("b")), list(key)).select(*key, (F.col("a") * F.col("b")).alias("val"))


def invert(x: DataFrame) -> DataFrame:
    return x.withColumn("val", F.when(F.col("val") != 0, F.try_divide(F.lit(1.0), F.col("val"))).otherwise(0.0))


def gradient(image: DataFrame, nx: int, ny: int) -> DataFrame:
    """(ipix, grad): half the root of the summed squared differences to the four periodic neighbours; absent pixels are 0."""
    spark = image.sparkSession
    grid = spark.range(nx * ny).select(F.col("id").alias("ipix")).join(image.select("ipix", "val"), "ipix", "left").select((F.col("ipix") / ny).cast("int").alias("x"), (F.col("ipix") % ny).cast("int").alias("y"), F.coalesce("val", F.lit(0.0)).alias("v"))
    out = grid
    # every pixel is sent to its neighbours: one aggregation by pixel
    moves = F.array(*[F.struct(F.pmod(F.col("x") + dx, F.lit(nx)).alias("px"), F.pmod(F.col("y") + dy, F.lit(ny)).alias("py"), F.lit(own).alias("own")) for dx, dy, own in ((0, 0, True), (1, 0, False), (-1, 0, False), (0, 1, False), (0, -1, False))])
    sent = out.select("v", F.explode(moves).alias("m")).select("v", "m.*").groupBy("px", "py").agg(F.sum(F.when(F.col("own"), F.col("v"))).alias("c"), F.sum(F.when(~F.col("own"), F.col("v"))).alias("s1"), F.sum(F.when(~F.col("own"), F.col("v") * F.col("v"))).alias("s2"))
    return sent.select((F.col("px") * ny + F.col("py")).cast("long").alias("ipix"), (0.5 * F.sqrt(F.greatest(F.lit(0.0), 4 * F.col("c") * F.col("c") - 2 * F.col("c") * F.col("s1") + F.col("s2")))).alias("grad"))


def coarsen(image: DataFrame, ny: int, osamp: int) -> DataFrame:
    """Mean over blocks of osamp x osamp pixels, absent ones 0."""
    x, y = F.floor(F.col("ipix") / ny / osamp), F.floor(F.col("ipix") % ny / osamp)
    return image.groupBy(x.alias("cx"), y.alias("cy")).agg((F.sum("val") / osamp**2).alias("val"))
