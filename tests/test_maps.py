import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from skyloom import catalog
from skyloom.functions import kernels as K
from skyloom.plans import solve
from skyloom.sources import samples as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("supplier", "events", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    a = catalog.queries()[name](spark, SF).toPandas()
    b = con.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c], rtol=1e-7, atol=1e-4)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_dct_is_its_own_inverse():
    x = np.random.default_rng(1).normal(size=(3, 17))
    assert np.allclose(K.dct1(K.dct1(x)) / 32, x)
    for kind, back, scale in ((2, 3, 34), (4, 4, 34), (11, 11, 36), (12, 13, 34), (14, 14, 34)):
        assert np.allclose(K.r2r(K.r2r(x, kind), back) / scale, x)


def test_good_lengths():
    def smooth(n):
        for p in (2, 3, 5, 7):
            while n % p == 0:
                n //= p
        return n == 1

    assert K.good_lengths(123) == [n for n in range(1, 124) if smooth(n)]


@pytest.mark.parametrize("name", sorted(K.NOISE))
def test_noise_is_symmetric_and_not_negative(name):
    rng = np.random.default_rng(2)
    d = rng.normal(size=(4, 30)) + rng.normal(size=30)
    m = K.NOISE[name](d, dt=1.0, low=0.1, high=0.2, freqs=(0.1, 0.3))
    a = np.stack([m.apply(e.reshape(4, 30)).ravel() for e in np.eye(120)])
    assert np.allclose(a, a.T, atol=1e-9 * np.abs(a).max())
    assert np.linalg.eigvalsh((a + a.T) / 2).min() > -1e-9 * np.abs(a).max()


@pytest.mark.parametrize("name, p", [("gauss", [0.1, 0.2, 0.3, 2.0]), ("isobeta", [0.1, 0.2, 0.3, 0.7, 2.0]), ("elliptical_gauss", [0.1, 0.2, 0.9, 0.6, 0.4, 2.0]), ("elliptical_isobeta", [0.1, 0.2, 0.9, 0.6, 0.4, 0.7, 2.0])])
def test_derivatives(name, p):
    x, y = np.random.default_rng(3).normal(size=(2, 20))
    _, g = solve.MODELS[name](np.array(p), x, y)
    for k in range(len(p)):
        e = np.zeros(len(p))
        e[k] = 1e-6
        num = (solve.MODELS[name](np.array(p) + e, x, y)[0] - solve.MODELS[name](np.array(p) - e, x, y)[0]) / 2e-6
        assert np.allclose(g[k], num, rtol=1e-4, atol=1e-6)


def test_pcg_reaches_weighted_mean(spark):
    s = src.events(spark, SF).where("samp < 30")
    x, left = solve.pcg(solve.blocks(s), catalog.NPIX, "white", 60, tolerance=1e-20)
    assert left[-1] <= 1e-10 * left[0]


@pytest.mark.parametrize("name", K.NOISE)
def test_normal_product_keeps_all_samples(spark, name):
    rng = np.random.default_rng(11)
    rows = [(0, det, i, float(rng.normal() + 3 * np.sin(i)), int(rng.integers(6)) if i < 25 else 6) for det, n in enumerate((30, 26, 27, 1)) for i in range(n)]
    cells = solve.blocks(spark.createDataFrame(rows, "tod long, det long, samp long, dat double, ipix long"))
    d, mask, pix = np.zeros((4, 30)), np.zeros((4, 30), bool), np.zeros((4, 30), int)
    for _, det, i, x, p in rows:
        d[det, i], mask[det, i], pix[det, i] = x, True, p
    model, options = K.NOISE[name], {"low": 0.1, "high": 0.2, "freqs": (0.1, 0.3)}
    m = model(d, mask=mask, **options)
    x = rng.normal(size=7)
    for image, given in ((None, d), (x, x[pix] * mask)):
        want = np.bincount(pix[mask], (m.apply(given) * mask)[mask], minlength=7)
        got = solve.vector(solve.normal_product(solve.fitted(cells, name, **options), image), 7)
        assert np.allclose(got, want, rtol=1e-9) and np.isfinite(got).all() and got[6] != 0
    a = np.stack([(m.apply(e.reshape(4, 30) * mask) * mask).ravel() for e in np.eye(120)])
    assert np.allclose(a, a.T, atol=1e-9 * np.abs(a).max())


def test_common_mode_with_missing_samples_is_the_masked_inverse():
    """With a very strong common mode, the inverse of the covariance of the samples that there are."""
    d = np.random.default_rng(12).normal(size=(3, 40))
    mask = np.arange(40) < np.array([[40], [30], [35]])
    m = K.CommonWhite(d * mask, mask=mask)
    for t in (10, 33, 38):
        on = mask[:, t]
        cov = np.diag(1 / m.weights[on]) + 1e6 * np.outer(m.v[on], m.v[on])
        x = np.zeros((3, 40))
        x[on, t] = d[on, t]
        assert np.allclose(m.apply(x)[on, t], np.linalg.solve(cov, d[on, t]), atol=1e-3)


def test_fit_finds_source(spark):
    got = {r["par"]: r["val"] for r in catalog.queries()["fit_source"](spark, SF).collect()}
    assert abs(got["x0"] - 0.2) < 0.05 and abs(got["amp"] - 5) < 0.3


def test_needlets_and_zernike():
    k = np.hypot(np.fft.fftfreq(32)[:, None], np.fft.fftfreq(32)[None, :]) * 32
    f = K.needlet_bands(range(0, 6), 16.0, k)
    inside = (k >= 1) & (k < 16)
    assert np.allclose((f**2).sum(axis=0)[inside], 1, atol=1e-6)
    r, th = np.meshgrid(np.linspace(0, 1, 5), np.linspace(0, 6, 5))
    z = K.zernike(2, r, th)
    assert len(z) == 6 and np.allclose(z[4], 2 * r**2 - 1)


def test_spikes_and_jumps():
    d = np.random.default_rng(4).normal(size=(2, 400))
    d[0, 100] += 500
    d[1, 200:] += 50
    assert 100 in K.spikes(d)[0]
    assert any(abs(j - 200) < 12 for j in K.jumps(d)[1])


def test_fits_and_tagged_files():
    image = np.arange(6.0).reshape(2, 3)
    (head, body), *_ = src.parse_fits(src.fits_image(image, {"CRVAL1": 1.5}))
    assert head["CRVAL1"] == 1.5 and (body.T == image).all()
    data = np.array([1], "<i4").tobytes() + b"x\n" + np.array([2, 3, 2, 8], "<i4").tobytes() + np.arange(6.0).tobytes()
    assert (src.parse_tagged(data)["x"] == np.arange(6.0).reshape(2, 3)).all()


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_tied_and_limited_fits(spark):
    rng = np.random.default_rng(5)
    xy = rng.uniform(-1, 1, (2, 400))
    truth = np.array([0.1, 0.05, 0.4, 0.4, 0.0, 3.0])
    d = solve.elliptical_gauss_derivs(truth, *xy)[0] + 0.01 * rng.normal(size=400)
    s = spark.createDataFrame([(0, 0, float(a), float(b), float(v), 1e4) for a, b, v in zip(*xy, d, strict=True)], "tod int, det int, dx double, dy double, dat double, w double")
    p, _, err = solve.fit(s, ["elliptical_gauss"], [0.0, 0.0, 0.5, 0.5, 0.0, 2.0], [6], free=[1, 1, 2, 2, 0, 1], iterations=15)
    assert p[2] == p[3] and p[4] == 0 and err[4] == 0 and np.allclose(p, truth, atol=0.02)
    p, _, _ = solve.fit(s, ["elliptical_gauss"], [0.0, 0.0, 0.5, 0.5, 0.0, 2.0], [6], free=[1, 1, 2, 2, 0, 1], iterations=15, limits={5: (0.0, 2.5)})
    assert p[5] == 2.5


def test_nested_and_ring_pixels_are_the_same_pixels(spark):
    from pyspark.sql import functions as F

    from skyloom.functions import columns as C

    n, rng = 8, np.random.default_rng(6)
    s = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(0, 2 * np.pi, 20000), np.arcsin(rng.uniform(-1, 1, 20000)), strict=True)], "ra double, dec double")
    got = s.select(C.healpix_ring(F.col("ra"), F.col("dec"), n).alias("r"), C.healpix_nest(F.col("ra"), F.col("dec"), n).alias("k")).distinct().toPandas()
    assert len(got) == got["r"].nunique() == got["k"].nunique() == 12 * n * n
    assert got["k"].min() == 0 and got["k"].max() == 12 * n * n - 1


def test_polarimeter_file(spark, tmp_path):
    n = 10
    t = np.zeros(n, [(c, "f8") for c in ("RA", "DEC", "I1", "I2", "Q1", "Q2", "U1", "U2", "MJD", "AZ", "EL")] + [("FLAG", "i2")])
    t["Q1"], t["U1"], t["I1"], t["FLAG"][4], t["MJD"] = 2, 4, 6, 1, 55977.0 + np.arange(n) / 86400
    cut = np.array([(1, 3), (2, 6)], [("START", "i4"), ("END", "i4")])
    path = tmp_path / "a.fits"
    path.write_bytes(src.fits_table(t) + src.fits_table(t, False) + src.fits_table(cut, False))
    got = src.read_polarimeter(spark, str(path), polarised=True, intervals=True).toPandas()
    assert len(got) == 2 * n and set(got[got["det"] == 0]["dat"]) == {-2.0} and set(got[got["det"] == 1]["dat"]) == {1.0}
    assert sorted(got[got["mask"] & (got["det"] == 0)]["samp"]) == [1, 2, 3, 5]
    assert set(src.read_polarimeter(spark, str(path)).toPandas()["dat"]) == {3.0}


def test_power_law_fit_and_stripe_prior():
    rng = np.random.default_rng(7)
    n = 4000
    f = np.arange(1, n) / (2 * (n - 1))
    scale = np.concatenate([[0], np.sqrt(1 + (f / 0.05) ** -2.0)])
    d = K.dct1(rng.normal(size=(3, n)) * scale) / (2 * (n - 1))
    assert np.allclose(K.power_law_fit(d)[:, 2], -2, atol=0.2)
    corr = np.exp(-np.arange(20) / 3.0)[None, :].repeat(2, 0)
    x = rng.normal(size=(2, 20))
    covered = K.dct1(K.dct1(x) * K.dct1(corr)) / (2 * 19)
    assert np.allclose(K.apply_stripe_prior(K.stripe_prior(corr, 0), covered), x)


def test_region_bootstrap_is_near_the_standard_error(spark):
    from pyspark.sql import functions as F

    from skyloom.operators import streams as S

    v = np.random.default_rng(8).normal(size=500)
    got = S.region_bootstrap(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, val double"), F.lit(1)).first()
    assert got["n"] == 500 and abs(got["mean"] - v.mean()) < 1e-9
    assert 0.6 < got["boot_var"] / (v.var() / 500) < 1.5


def test_elevation_offsets(spark):
    from skyloom.operators import streams as S

    x = np.arange(40) / 40
    e = 3 + x - 2 * x**2 + np.random.default_rng(9).normal(size=(3, 40)) * 0.1
    s = spark.createDataFrame([(0, i, j, float(e[i, j])) for i in range(3) for j in range(40)], "tod int, det int, samp long, elev double")
    got = np.zeros((3, 40))
    for r in S.elevation_offsets(s).collect():
        got[r["det"], r["samp"]] = r["apix"]
    off = e - np.polyval(np.polyfit(x, e.mean(axis=0), 2), x)
    assert np.allclose(got, off / np.abs(off).max())
