"""Systems of several components (maps, stripes, cuts, gains...) with priors, solved by conjugate gradients.

All vectors are tables (comp, idx, val): nothing but two numbers a step comes to the
driver, so a system may have as many parameters as a table has rows.  A step spreads the
parameters over samples, applies the noise and projects back; its vectors are written
to the shared folder, so that the lineage of a step is one step long.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import templates as T

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local.setdefault("at", tempfile.mkdtemp(prefix="skyloom-"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written and reread."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def combine(x: DataFrame, y: DataFrame, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """a x + b y; a parameter that one of them lacks is zero there."""
    both = x.select(*T.PARAM, (F.lit(a) * F.col("val")).alias("val")).union(y.select(*T.PARAM, (F.lit(b) * F.col("val")).alias("val")))
    return both.groupBy(*T.PARAM).agg(F.sum("val").alias("val"))


def product(x: DataFrame, y: DataFrame) -> DataFrame:
    """Parameter by parameter; zero (absent) where one of them has none."""
    return x.select(*T.PARAM, F.col("val").alias("a")).join(y.select(*T.PARAM, F.col("val").alias("b")), list(T.PARAM)).select(*T.PARAM, (F.col("a") * F.col("b")).alias("val"))


def inner(x: DataFrame, y: DataFrame) -> float:
    """Sum over all components of the products."""
    return float(product(x, y).agg(F.sum("val")).first()[0] or 0.0)


def cleared(x: DataFrame) -> DataFrame:
    return x.select(*T.PARAM, F.lit(0.0).alias("val"))


def white(weights: DataFrame):
    """Noise of independent samples: (tod, det, w)."""
    return lambda signal: signal.join(weights.select("tod", "det", F.col("w").alias("_w")), ["tod", "det"]).select(*T.SAMPLE, (F.col("val") * F.col("_w")).alias("val"))


def white_masked(samples: DataFrame, weights: DataFrame | None = None, mask: str = "mask"):
    """White noise that gives masked samples no weight; without ``weights`` all others have weight one."""
    good = samples.where(F.col(mask)).select(*T.SAMPLE)

    def apply(signal: DataFrame) -> DataFrame:
        some = signal.join(good, list(T.SAMPLE), "left_semi").select(*T.SAMPLE, "val")
        return some if weights is None else white(weights)(some)

    return apply


def common_white(modes: DataFrame):
    """White noise beside one common mode: (tod, det, v, w).  A sample's common mode is fitted to the detectors that have it, and taken out."""

    def apply(signal: DataFrame) -> DataFrame:
        s = signal.join(modes.select("tod", "det", "v", F.col("w").alias("_w")), ["tod", "det"])
        cm = s.groupBy("tod", "samp").agg((F.sum(F.col("v") * F.col("_w") * F.col("val")) / F.sum(F.col("v") * F.col("v") * F.col("_w"))).alias("cm"))
        return s.join(cm, ["tod", "samp"]).select(*T.SAMPLE, (F.col("_w") * (F.col("val") - F.col("v") * F.coalesce("cm", F.lit(0.0)))).alias("val"))

    return apply


def modelled(models: DataFrame):
    """Any noise model that needs a whole timestream: ``models`` is what :func:`skyloom.plans.solve.fitted` gives.  A task holds one timestream."""

    def run(signal: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(signal) or not len(own):
            return pd.DataFrame({"tod": [], "det": [], "samp": [], "val": []})
        _, _, mask, model = pickle.loads(own["held"].dropna().iloc[0])
        row = signal["det"].map({d: k for k, d in enumerate(sorted(own["det"]))}).to_numpy()
        at = signal["samp"].to_numpy()
        whole = np.zeros(mask.shape)
        whole[row, at] = signal["val"]
        return pd.DataFrame({"tod": signal["tod"], "det": signal["det"], "samp": at, "val": (model.apply(whole) * mask)[row, at]})

    def apply(signal: DataFrame) -> DataFrame:
        kind = signal.schema["tod"].dataType.simpleString()
        return signal.select(*T.SAMPLE, "val").groupBy("tod").cogroup(models.groupBy("tod")).applyInPandas(run, f"tod {kind}, det long, samp long, val double")

    return apply


def right_side(design: DataFrame, data: DataFrame, noise, value: str = "dat") -> DataFrame:
    """b: the noise-weighted data of each parameter."""
    return T.project(design, noise(data.select(*T.SAMPLE, F.col(value).alias("val"))), "val")


def applied(design: DataFrame, x: DataFrame, noise, prior=None) -> DataFrame:
    """A x: parameters spread over samples, weighted by the noise, projected back; a prior is added.

    ``prior``: a diagonal (comp, idx, val), a function from parameters to Q x, or a list of such, as of several components.
    """
    out = T.project(design, noise(T.spread(design, x)), "val")
    for q in prior if isinstance(prior, list) else [] if prior is None else [prior]:
        out = combine(out, q(x) if callable(q) else product(q, x))
    return out


def stripe_prior(spectrum: np.ndarray, comp: str = "stripes"):
    """Q x of stripes whose covariance depends on their distance: ``spectrum`` are the DCT-I weights of :func:`skyloom.functions.kernels.stripe_prior`.

    A task holds one detector's stripes of a timestream; they must be as many as the weights.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        place = part["idx"].str.split("/").map(lambda p: (int(p[2]), int(p[3])))
        part = part.iloc[np.argsort(place.map(lambda p: p[0] * (1 << 40) + p[1]).to_numpy(), kind="stable")]
        val = K.apply_stripe_prior(spectrum, part["val"].to_numpy()[None])[0]
        return pd.DataFrame({"comp": part["comp"], "idx": part["idx"], "val": val})

    def apply(x: DataFrame) -> DataFrame:
        own = x.where(F.col("comp") == comp).select(*T.PARAM, "val", F.substring_index("idx", "/", 2).alias("detector"))
        return own.groupBy("detector").applyInPandas(run, "comp string, idx string, val double")

    return apply


def diagonal(design: DataFrame, weights: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """The system's diagonal under white noise."""
    own = design.join(weights.select("tod", "det", F.col("w").alias("_w")), ["tod", "det"]).groupBy(*T.PARAM).agg(F.sum(F.col("w") * F.col("w") * F.col("_w")).alias("val"))
    if prior is None:
        return own
    return combine(own, prior.join(own.select(*T.PARAM), list(T.PARAM), "left_semi"))


def inverse(x: DataFrame) -> DataFrame:
    return x.select(*T.PARAM, F.when(F.col("val") != 0, F.try_divide(F.lit(1.0), F.col("val"))).otherwise(0.0).alias("val"))


def solve(design: DataFrame, b: DataFrame, noise, iterations: int = 25, precon: DataFrame | None = None, prior=None, x0: DataFrame | None = None, mask: DataFrame | None = None, tolerance: float = 0.0) -> tuple[DataFrame, list[float]]:
    """The parameters that solve (P' N^-1 P + Q) x = b, and the squared residual after each step.

    ``precon``: an approximate inverse of the diagonal.  ``prior``: see :func:`applied`.  ``mask``: (comp, idx, val) factors of
    the unknowns.  ``tolerance``: the share of the first residual at which to stop.
    """
    limited = (lambda v: v) if mask is None else (lambda v: product(v, mask))
    a = lambda v: limited(applied(design, limited(v), noise, prior))
    b = limited(b)
    r = b if x0 is None else combine(b, a(x0), 1.0, -1.0)
    state = r.select(*T.PARAM, F.col("val").alias("r"))
    for name, table, other in (("m", precon, 1.0 if precon is None else 0.0), ("x", x0, 0.0)):
        found = state if table is None else state.join(table.select(*T.PARAM, F.col("val").alias(name)), list(T.PARAM), "left")
        state = found.withColumn(name, F.lit(other) if table is None else F.coalesce(name, F.lit(other)))
    # one table holds all vectors, so that a step writes it once; the next direction is an expression on it
    state = kept(state.withColumn("p", F.col("m") * F.col("r")), "state")

    def sums(t: DataFrame) -> tuple[float, float]:
        row = t.agg(F.sum(F.col("m") * F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("r"))).first()
        return float(row[0] or 0.0), float(row[1] or 0.0)

    zr, rr = sums(state)
    left = [rr]
    for _ in range(iterations):
        if zr == 0 or left[-1] <= tolerance * left[0]:
            break
        ap = kept(a(state.select(*T.PARAM, F.col("p").alias("val"))).select(*T.PARAM, F.col("val").alias("ap")), "ap")
        both = state.join(ap, list(T.PARAM), "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
        step = zr / float(both.agg(F.sum(F.col("p") * F.col("ap"))).first()[0])
        after = kept(both.select(*T.PARAM, (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("ap")).alias("r"), "m", "p"), "state")
        (zr, rr), before = sums(after), zr
        state = after.withColumn("p", F.col("m") * F.col("r") + (zr / before) * F.col("p"))
        left.append(rr)
    return state.select(*T.PARAM, F.col("x").alias("val")), left
