"""Values of operators that SQL can't express, against plain versions written otherwise."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import catalog
from skyloom.functions import kernels as K
from skyloom.functions import transforms as X
from skyloom.functions.geometry import MapGrid
from skyloom.operators import maps as M
from skyloom.operators import templates as T
from skyloom.plans import mapset, solve
from skyloom.sources import samples as src

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shape", [(19, 1439), (19, 1440), (10, 10, 9), (10, 10, 10)])
def test_transforms_and_back(shape):
    x = np.random.default_rng(0).random(shape)
    n = np.arange(shape[-1])
    ft = X.real_to_half(x)
    direct = (x * np.exp(-2j * np.pi * 3 * n / shape[-1])).sum()
    assert np.isclose(ft[(0,) * (len(shape) - 1) + (3,)], direct)
    assert np.allclose(X.half_to_real(ft, shape[-1] % 2 == 0), x)
    assert np.allclose(X.half_to_rows(np.concatenate([X.rows_to_half(x), np.full((*shape[:-1], 2), np.nan)], axis=-1), shape[-1]), x)
    if len(shape) == 3:
        assert np.allclose(X.half_to_cube(X.cube_to_half(x), shape[-1] % 2 == 0), x)
    else:
        with pytest.raises(ValueError):
            X.cube_to_half(x)
    single = X.rows_to_half(x.astype(np.float32))
    assert single.dtype == np.complex64 and np.allclose(single, X.rows_to_half(x), rtol=1e-3, atol=1e-2)


def test_power_components():
    rng = np.random.default_rng(1)
    vecs = np.stack([np.ones(400), 100 / np.arange(1, 401)])
    truth = np.array([2.0, 5.0])
    y2 = (truth @ vecs) * rng.chisquare(1, 400)
    fit = K.linear_power_fit(y2, vecs)
    like = lambda p: (np.log(p @ vecs) + y2 / (p @ vecs)).sum()
    # the fit is at the minimum of the likelihood
    for move in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        assert like(fit) <= like(fit + np.array(move)) + 1e-9
    assert np.allclose(fit, truth, rtol=0.5)


def test_wavelets_and_back():
    rng = np.random.default_rng(2)
    image = rng.normal(size=(32, 24))
    k = np.hypot(np.fft.fftfreq(32)[:, None] * 32, np.fft.fftfreq(24)[None, :] * 24)
    bands = K.needlet_bands(range(5), 16.0, k)
    waves = K.map_to_wavelets(image, bands)
    ft = np.fft.fft2(image)
    assert np.allclose(waves[2], np.fft.ifft2(ft * bands[2]).real)
    back = K.wavelets_to_map(waves, bands)
    # both ways: each frequency times the sum of the squared bands
    assert np.allclose(np.fft.fft2(back), ft * (bands**2).sum(axis=0))


def test_two_resolutions_are_transposes():
    rng = np.random.default_rng(3)
    x, y = np.meshgrid(np.arange(8) - 4, np.arange(6) - 3, indexing="ij")
    two = K.TwoResolution((8, 6), (np.hypot(x, y) < 2).astype(float), 2, 3.0, rng.random((8, 6)))
    c, f, m = rng.normal(size=(8, 6)), rng.normal(size=(16, 12)), rng.normal(size=(8, 6))
    a, b = two.split(m)
    assert np.isclose((two.join(c, f) * m).sum(), (c * a).sum() + (f * b).sum())
    c2, f2 = two.prior(c, f)
    assert (c * c2).sum() + (f * f2).sum() >= 0
    # without a beam, a fine map that copies the coarse one joins to the same
    two.beam[:] = 1
    whole = np.repeat(np.repeat(c * two.share, 2, 0), 2, 1)
    assert np.allclose(two.join(c, whole), c)


def test_gaps_are_filled_from_modes_in_time():
    t = np.arange(200)
    modes = np.stack([np.sin(t / 9), np.cos(t / 23)])
    rng = np.random.default_rng(4)
    d = rng.normal(size=(12, 2)) @ modes * 10 + rng.normal(size=(12, 200))
    bad = np.zeros(d.shape, bool)
    bad[3, 50:60] = bad[7, 120:140] = True
    got = K.gapfill_eig(np.where(bad, 1e4, d), bad, rounds=6, inner=20)
    assert (got[~bad] == d[~bad]).all() and np.abs(got - d)[bad].mean() < 0.5 * np.abs(d)[bad].mean()
    # one round, one step: the least squares of the rows on the modes found
    one = K.gapfill_eig(d, bad, rounds=1, inner=1)
    cut = np.where(bad, 0, d)
    value, vector = np.linalg.eigh(cut @ cut.T)
    u = vector[:, value > 25 * np.median(value)].T @ cut
    want = np.linalg.lstsq(u.T, cut.T, rcond=None)[0].T @ u
    assert np.allclose(one[bad], want[bad])


def test_steps_and_common_polynomials():
    rng = np.random.default_rng(5)
    common = rng.normal(size=100).cumsum()
    d = np.outer([1.0, 2.0, 0.5], common) + np.array([[1.0], [0], [3]]) * (np.arange(100) >= 40)
    got = K.steps_beside_common(d, [[40], [], [40]], common)
    assert np.allclose(got, np.outer([1.0, 2.0, 0.5], common))
    x = np.linspace(-1, 1, 100)
    poly = np.stack([1 + x, 2 - x * x, 3 * x])
    flat = rng.normal(size=(1, 100)).repeat(3, 0) * 5
    clean, model = K.common_and_poly(flat + poly - np.median(poly, axis=0), 2, full=True)
    assert clean.shape == model.shape == (3, 100) and np.isfinite(clean).all()
    p = np.polynomial.legendre.legvander((np.arange(100) - 49.5) / 49.5, 2)
    data = flat + poly
    design = np.column_stack([p, np.median(data, axis=0)])
    fit = np.linalg.lstsq(design, data.T, rcond=None)[0]
    assert np.allclose(K.common_and_poly(data, 2), data - (p @ fit[:3]).T)


def test_downsample_keeps_slow_waves():
    t = np.arange(201)
    x = np.cos(np.pi * t * 3 / 200)[None]
    assert np.allclose(K.downsample(x, 2)[0], np.cos(np.pi * np.arange(100) * 3 / 99) * 1.0, atol=1e-9)


def test_jumps_and_dejump():
    rng = np.random.default_rng(6)
    d = rng.normal(size=(3, 600))
    d[0, 300:] += 50
    d[1, 300] += 60  # a spike
    got, clean = K.jumps(d, dejump=True)
    assert len(got[0]) == 1 and abs(got[0][0] - 300) <= 2 and got[1] == [] and got[2] == []
    assert abs(clean[0, 320:].mean() - clean[0, :280].mean()) < 8


def test_dead_detectors_have_no_weight():
    d = np.random.default_rng(7).normal(size=(3, 50))
    d[1] = 4.0
    for name, options in (("white", {}), ("white_notch", {"low": 0.1, "high": 0.2})):
        m = K.NOISE[name](d, **options)
        assert m.det_weights()[1] == 0 and np.isfinite(m.apply(d)).all() and (m.apply(d)[1] == 0).all()


def test_common_white_and_binned_eig_by_dense_matrices():
    rng = np.random.default_rng(8)
    d = rng.normal(size=(5, 40)) + np.outer(rng.normal(size=5), rng.normal(size=40)) * 20
    m = K.CommonWhite(d)
    u, s, vt = np.linalg.svd(d)
    v = u[:, 0]
    w = 1 / (d - np.outer(v, v @ d)).var(axis=1)
    strong = np.linalg.inv(np.diag(1 / w) + 1e9 * np.outer(v, v))
    assert np.allclose(m.weights, w) and np.allclose(m.apply(d), strong @ d, atol=1e-4 * np.abs(w).max())
    e = K.BinnedEig(d, freqs=(0.1, 0.3), thresh=3.0)
    y, out = K.dct1(d), np.zeros_like(d)
    for k, (a, b) in enumerate(zip(e.edges[:-1], e.edges[1:], strict=True)):
        cov = np.diag(e.det[:, k]) + e.modes @ np.diag(e.mode[:, k]) @ e.modes.T
        out[:, a:b] = np.linalg.solve(cov, y[:, a:b])
    assert np.allclose(e.apply(d), K.halved(K.dct1(out)) / 78)
    f = K.SmoothedSvd(d, fwhm=5.0)
    power = K.smooth(K.dct1(np.linalg.svd(d, full_matrices=False)[0].T @ d) ** 2, 5.0)
    want = f.u @ (K.halved(K.dct1(np.where(np.arange(40) > 0, 1 / power, 0) * K.dct1(f.u.T @ d))) / 78)
    assert np.allclose(f.apply(d), want)


def test_sloped_rings():
    x, y = np.meshgrid(np.arange(32) - 16, np.arange(24) - 12, indexing="ij")
    point = np.zeros((32, 24))
    point[0, 0] = 1
    got = K.sloped_rings([0, 4, 8], np.array([-3.0, -1.0]), x, y, (0, 0), point)
    r, level = np.hypot(x, y), np.array([-2.0, 0.0]) - 2 / 50
    inner = np.where(r < 4, (level[0] - r * (level[0] - level[1]) / 4) / level[0], 0)
    assert np.allclose(got[0], inner) and np.allclose(got[1], ((r >= 4) & (r < 8)).astype(float))
    wide = K.sloped_rings([0, 4], np.array([0.0]), x, y, (0, 0), point, 2.0, 1.0, np.pi / 2)
    assert np.allclose(wide[0], np.hypot(y / 2, x) < 4)


def test_scaled_polynomials():
    rng = np.random.default_rng(9)
    scale = rng.normal(size=(4, 60))
    p = np.polynomial.legendre.legvander(np.linspace(-1, 1, 60), 2).T
    d = (np.array([1.0, -2.0]) @ p[:2]) + (np.array([0.5, 1.5, -1.0]) @ p) * scale
    model, common, scaled, _ = K.fit_scaled_polynomials(d, scale, 2, 1)
    assert np.allclose(common, [1, -2]) and np.allclose(scaled, [0.5, 1.5, -1]) and np.allclose(model, d)


def test_fits_samples_and_tagged_arrays(spark, tmp_path):
    n = 4
    t = np.zeros(2 * n, [("PIXID", "i4"), ("DX", "f8"), ("DY", "f8"), ("TIME", "f8"), ("FNU", "f8"), ("UFNU", "f8"), ("ELEV", "f8")])
    t["PIXID"], t["DX"], t["TIME"], t["FNU"], t["ELEV"] = np.repeat([3, 5], n), [6.2] * n + [0.1] * n, np.tile(np.arange(n), 2), np.arange(2 * n), 90
    t["UFNU"][2] = 1e6
    (tmp_path / "a.fits").write_bytes(src.fits_table(t))
    got = src.read_fits_samples(spark, str(tmp_path / "a.fits"), branch=np.pi).toPandas()
    assert got["det"].tolist() == [3] * n + [5] * n and got["samp"].tolist() == list(range(n)) * 2 and got["dat"].tolist() == list(range(2 * n))
    assert np.allclose(got["dx"], [6.2 - 2 * np.pi] * n + [0.1] * n) and np.allclose(got["elev"], np.pi / 2) and got["mask"].tolist() == [True, True, False] + [True] * 5
    data = np.array([2], "<i4").tobytes() + b"x\n" + np.array([2, 3, 2, 8], "<i4").tobytes() + np.arange(6.0).tobytes() + b"name\n" + np.array([1, 3, 1], "<i4").tobytes() + b"abc"
    (tmp_path / "b.bin").write_bytes(data)
    rows = {r["key"]: (r["dims"], r["values"]) for r in src.read_tagged(spark, str(tmp_path / "b.bin")).collect()}
    assert rows["x"] == ([2, 3], list(map(float, range(6)))) and rows["name"] == ([3], [])


def dense(spark):
    """A small system of a map, stripes and cuts with white noise: samples, design, weights, and the dense matrices."""
    rng = np.random.default_rng(10)
    rows = [(t, det, i, float(rng.normal() + 5 * det), int(rng.integers(5)), bool(rng.random() < 0.1)) for t in ("a", "b") for det in range(2) for i in range(16)]
    s = spark.createDataFrame(rows, "tod string, det long, samp long, dat double, ipix long, bad boolean")
    design = T.together(T.sky(s), T.stripes(s, 8), T.cuts(s, F.col("bad")))
    weights = spark.createDataFrame([(t, det, 1.0 + det) for t in ("a", "b") for det in range(2)], "tod string, det long, w double")
    g = design.toPandas()
    place = {r[:3]: k for k, r in enumerate(rows)}
    names = sorted({(c, i) for c, i in zip(g["comp"], g["idx"], strict=True)})
    number = {n: k for k, n in enumerate(names)}
    p = np.zeros((len(rows), len(names)))
    for t, det, i, c, idx, w in g[["tod", "det", "samp", "comp", "idx", "w"]].itertuples(index=False):
        p[place[t, det, i], number[c, idx]] += w
    w = np.array([1.0 + r[1] for r in rows])
    return s, design, weights, p, w, np.array([r[3] for r in rows]), names


def test_mapset_solution_is_the_dense_one(spark):
    s, design, weights, p, w, d, names = dense(spark)
    noise = mapset.white(weights)
    prior = design.where("comp <> 'sky'").select(*T.PARAM).distinct().withColumn("val", F.lit(0.5))
    q = np.diag([0.0 if c == "sky" else 0.5 for c, _ in names])
    b = mapset.right_side(design, s, noise)
    got, left = mapset.solve(design, b, noise, 20, mapset.inverse(mapset.diagonal(design, weights, prior)), prior, tolerance=1e-24)
    found = {(r["comp"], r["idx"]): r["val"] for r in got.collect()}
    want = np.linalg.lstsq(p.T @ (w[:, None] * p) + q, p.T @ (w * d), rcond=None)[0]
    assert np.allclose([found[n] for n in names], want, atol=1e-6) and left[-1] < 1e-12 * left[0]
    start = mapset.combine(got, mapset.cleared(got), 1.01, 1.0)
    again, _ = mapset.solve(design, b, noise, 20, mapset.inverse(mapset.diagonal(design, weights, prior)), prior, x0=start, tolerance=1e-20)
    assert np.allclose([{(r["comp"], r["idx"]): r["val"] for r in again.collect()}[n] for n in names], want, atol=1e-5)


def test_mapset_noise_with_a_common_mode(spark):
    s, _, _, _, _, _, _ = dense(spark)
    modes = spark.createDataFrame([(t, det, 1.0 + det, 2.0 - det) for t in ("a", "b") for det in range(2)], "tod string, det long, v double, w double")
    got = {(r["tod"], r["det"], r["samp"]): r["val"] for r in mapset.common_white(modes)(s.select(*T.SAMPLE, F.col("dat").alias("val"))).collect()}
    v, w = np.array([1.0, 2.0]), np.array([2.0, 1.0])
    for t in ("a", "b"):
        d = np.array([[r["dat"] for r in s.where(f"tod = '{t}' and det = {k}").orderBy("samp").collect()] for k in range(2)])
        cm = (v * w) @ d / (v * v * w).sum()
        want = w[:, None] * (d - np.outer(v, cm))
        assert np.allclose([[got[t, k, i] for i in range(16)] for k in range(2)], want)


def test_pcg_map_is_the_dense_solution(spark):
    s = src.events(spark, SF).where("samp < 12")
    hits = solve.vector(M.hits(s), catalog.NPIX)
    x, left = solve.pcg(solve.blocks(s), catalog.NPIX, "white", 60, precon=np.where(hits > 0, 1 / np.maximum(hits, 1), 0), tolerance=1e-22)
    w = {(r["tod"], r["det"]): r["w"] for r in M.white_weights(s).collect()}
    top, bottom = np.zeros(catalog.NPIX), np.zeros(catalog.NPIX)
    for r in s.collect():
        top[r["ipix"]] += w.get((r["tod"], r["det"]), 0) * r["dat"]
        bottom[r["ipix"]] += w.get((r["tod"], r["det"]), 0)
    some = bottom > 0
    assert np.allclose(x[some], top[some] / bottom[some], rtol=1e-6)
    with pytest.raises(ValueError):
        solve.normal_product(s, np.zeros(solve.LARGEST + 1))


def test_light_curve_fit(spark):
    got = {r["part"]: r["amp"] for r in catalog.queries()["fit_light_curve"](spark, SF).collect()}
    assert np.allclose([got[k] for k in range(3)], [5, 3, 1], atol=0.05)


def test_bowl_and_its_signal(spark):
    rng = np.random.default_rng(11)
    e = rng.normal(size=(3, 30)) * 0.1 + 1
    d = rng.normal(size=(3, 30))
    s = spark.createDataFrame([("a", i, j, float(e[i, j]), float(d[i, j])) for i in range(3) for j in range(30)], "tod string, det long, samp long, elev double, dat double")
    x = np.arange(30) / 30
    off = e - np.polyval(np.polyfit(x, e.mean(axis=0), 2), x)
    apix = off / np.abs(off).max()
    basis = np.polynomial.legendre.legvander(apix, 3)
    par = np.einsum("ijk,ij->ik", basis, d)
    g = T.bowl(s, 3)
    got = {r["idx"]: r["val"] for r in T.project(g, s).collect()}
    assert np.allclose([[got[f"a/{i}/{k}"] for k in range(4)] for i in range(3)], par)
    back = {(r["det"], r["samp"]): r["val"] for r in T.spread(g, T.project(g, s)).collect()}
    assert np.allclose([[back[i, j] for j in range(30)] for i in range(3)], np.einsum("ijk,ik->ij", basis, par))


def test_projection_and_spread_are_transposes(spark):
    s, design, *_ = dense(spark)
    x = design.select(*T.PARAM).distinct().withColumn("val", F.hash("idx") % 7 / 3.0)
    a = T.spread(design, x).join(s, list(T.SAMPLE)).agg(F.sum(F.col("val") * F.col("dat"))).first()[0]
    assert np.isclose(a, mapset.inner(T.project(design, s), x))


def test_oblique_grid_holds_its_limits():
    g = MapGrid.make((2.98, 3.0, 0.7, 0.71), 1e-4)
    x, y = g.place(2.98, 0.71)
    assert g.nx >= round(x) + 1 and g.ny >= round(y) + 1 and abs(g.place(3.0, 0.7)[0]) < 1e-9
    assert g.header()["CRVAL2"] == np.degrees(0.7) and MapGrid.make((2.98, 3.0, 0.7, 0.71), 1e-4, equatorial=True).header()["CRVAL1"] == 0
    with pytest.raises(ValueError):
        g.subregion((2.99, 3.0, 0.7, 0.705))


def test_unknown_polarisations_are_refused(spark):
    s = src.events(spark, SF)
    with pytest.raises(ValueError):
        M.scatter_pol(s, "V", F.lit(0.0))
    with pytest.raises(ValueError):
        M.block_times(s, s, "IQUV")


def test_zernike_fit_against_its_own_basis(spark):
    got = catalog.queries()["zernike_fit"](spark, SF).toPandas()
    x, y = np.meshgrid(np.arange(32) - 16, np.arange(24) - 12, indexing="ij")
    r, th = np.hypot(x, y) / 10, np.arctan2(y, x)
    on = r <= 1
    # degree by degree: sines and cosines times radial polynomials, written out
    basis = [np.ones_like(r), r * np.sin(th), r * np.cos(th), r**2 * np.sin(2 * th), 2 * r**2 - 1, r**2 * np.cos(2 * th), r**3 * np.sin(3 * th), (3 * r**3 - 2 * r) * np.sin(th), (3 * r**3 - 2 * r) * np.cos(th), r**3 * np.cos(3 * th)]
    a = np.stack([b[on] for b in basis], axis=1)
    s = src.events(spark, SF).select("tod", "ipix", "dat").toPandas()
    for tod, g in s.groupby("tod"):
        image = np.bincount(g["ipix"], g["dat"], 768).reshape(32, 24)
        want = a @ np.linalg.lstsq(a, image[on], rcond=None)[0]
        coef = got[got["tod"] == tod].sort_values("k")["coef"].to_numpy()
        order = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
        assert np.allclose(np.abs(a[:, order] @ coef - want).max(), 0, atol=1e-6)


def idl_file(scan: dict) -> bytes:
    """An IDL save file with one structure ``scan`` of arrays, written from the format's description."""
    import struct

    i = lambda *v: struct.pack(f">{len(v)}i", *v)
    string = lambda s: i(len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    dims = lambda a: i(8, a.itemsize, a.nbytes, a.size, a.ndim, 0, 0, 8) + i(*a.shape[::-1], *[1] * (8 - a.ndim))
    code = {"f8": 5, "f4": 4, "i4": 3, "i2": 2}
    arrays = {k: np.asarray(v) for k, v in scan.items()}
    kinds = {k: code[a.dtype.str[1:]] for k, a in arrays.items()}
    whole = i(8, 0, 0, 1, 1, 0, 0, 8) + i(*[1] * 8)
    head = string("SCAN") + i(8, 36) + whole + i(9) + string("") + i(0, len(arrays), 0)
    head += b"".join(i(0, kinds[k], 4) for k in arrays) + b"".join(map(string, arrays)) + b"".join(dims(a) for a in arrays.values()) + i(7)
    for k, a in arrays.items():
        if kinds[k] == 2:
            head += a.astype(">i4").tobytes()
        else:
            head += a.astype(a.dtype.newbyteorder(">")).tobytes()
    out, records = b"SR\x00\x04", ((10, b"\0" * 8), (2, head))
    for kind, body in records:
        out += struct.pack(">iII4x", kind, len(out) + 16 + len(body), 0) + body
    return out + struct.pack(">iII4x", 6, 0, 0)


def test_idl_scans(spark, tmp_path):
    from skyloom.sources import idl

    signal = np.arange(15.0).reshape(3, 5)
    signal[1] = np.nan
    signal[2, 1:3] = np.nan
    scan = {"SIGNAL_PLW": signal, "IND_SUBSCANS": np.array([1, 1, 2, 2, 3], "i2"), "XRA_BOLOS_PLW": np.full((3, 5), -10.0, "f4"), "YDEC_BOLOS_PLW": np.full((3, 5), 45.0), "TIME_S": np.arange(5.0)}
    assert (idl.parse(idl_file(scan))["scan"][0]["IND_SUBSCANS"] == [1, 1, 2, 2, 3]).all()
    (tmp_path / "a.sav").write_bytes(idl_file(scan))
    got = idl.read_scans(spark, str(tmp_path / "a.sav")).toPandas().sort_values(["det", "samp"])
    assert got["det"].tolist() == [0] * 5 + [2] * 5 and np.allclose(got["dat"], [0, 1, 2, 3, 4, 10, 11, 12, 13, 14])
    assert got["cut"].sum() == 2 and np.allclose(got["dx"], np.radians(350)) and np.allclose(got["dy"], np.pi / 4)
    assert got[got["det"] == 0]["turn"].tolist() == [False, True, False, True, False]
    with pytest.raises(ValueError):
        idl.parse(b"SR\x00\x06")


def test_region_shapes(spark):
    from skyloom.sources import regions as R

    some = R.parse_regions("image; panda(0,0,0,90,3,1,5,2)\nannulus(1,2,3,4,5)\nellipse(0,0,4,2,90)\nbox(1,2,3,4)\n# circle(9,9,1)")
    assert len(some) == 6 + 2 + 1
    rng = np.random.default_rng(12)
    xy = rng.uniform(-6, 6, (400, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in xy], "x double, y double")
    for r in df.select("x", "y", R.region_of(F.col("x"), F.col("y"), some).alias("k")).collect():
        radius, angle = np.hypot(r["x"], r["y"]), np.degrees(np.arctan2(r["y"], r["x"])) % 360
        want = [ring * 3 + s for ring in range(2) for s in range(3) if 1 + 2 * ring <= radius < 3 + 2 * ring and 30 * s <= angle < 30 * s + 30]
        want += [6 + k for k in range(2) if 3 + k <= np.hypot(r["x"] - 1, r["y"] - 2) < 4 + k]
        want += [8] if r["x"] ** 2 / 4 + r["y"] ** 2 / 16 < 1 else []
        assert r["k"] == want


def test_small_matrix_tools():
    rng = np.random.default_rng(13)
    m = rng.normal(size=(4, 4))
    m = m @ m.T * np.outer([1, 1e3, 1e-3, 1], [1, 1e3, 1e-3, 1])
    assert np.allclose(solve.scaled_inverse(m) @ m, np.eye(4), atol=1e-6) and np.allclose(solve.scaled_inverse(m, True) @ m, np.eye(4), atol=1e-6)
    flat = np.outer([1.0, 2.0], [1.0, 2.0])
    assert np.allclose(solve.safe_inverse(flat), np.linalg.pinv(flat))
    a, b, d = rng.normal(size=(2, 30)), rng.normal(size=(1, 30)), rng.normal(size=(3, 30))
    x, y = K.two_basis_fit(d, a, b)
    assert np.allclose((d - x @ a - y @ b) @ np.vstack([a, b]).T, 0)
    radius, top = K.k_radius(6)
    assert radius[3, 3] == 0 and radius[0, 0] == top == np.hypot(3, 3)
    found, rest = K.spikes(np.append(rng.normal(size=200), 500.0)[None], full=True)
    assert 200 in found[0] and (rest[0, found[0]] == 0).all()


def test_power_law_noise_model():
    rng = np.random.default_rng(14)
    n = 600
    f = np.arange(1, n) / (2 * (n - 1))
    shape = np.concatenate([[0], np.sqrt(1 + (f / 0.05) ** -2.0)])
    d = K.dct1(rng.normal(size=(3, n)) * shape) / (2 * (n - 1))
    fit = K.power_law_spectrum(d)
    want = (K.dct1(d)[:, 1:] ** 2 / (shape[1:] ** 2)).mean(axis=1)[:, None] * shape[1:] ** 2
    away = np.abs(np.log(fit[:, 1:] / want))
    assert np.median(away) < 0.3 and away[:, 5:].max() < 1
    m = K.SmoothedSvd(d, power_law=True)
    assert np.isfinite(m.apply(d)).all() and (m.weight[:, 0] == 0).all() and (m.weight[:, 1:] > 0).all()


def test_stripe_prior_in_a_system(spark):
    """Stripes with a prior by distance: the product of the same dense system."""
    s, _, weights, *_ = dense(spark)
    design = T.together(T.sky(s), T.stripes(s, 4))
    corr = np.exp(-np.arange(4) / 2.0)[None]
    spectrum = K.stripe_prior(corr, 0)[0]
    noise = mapset.white(weights)
    x = design.select(*T.PARAM).distinct().withColumn("val", F.hash("idx") % 11 / 3.0)
    given = {(r["comp"], r["idx"]): r["val"] for r in x.collect()}
    got = {(r["comp"], r["idx"]): r["val"] for r in mapset.applied(design, x, noise, [mapset.stripe_prior(spectrum)]).collect()}
    names = sorted(got, key=lambda n: (n[0], [int(p) if p.isdigit() else p for p in n[1].split("/")]))
    number = {n: k for k, n in enumerate(names)}
    rows = {}
    for r in design.collect():
        rows.setdefault((r["tod"], r["det"], r["samp"]), []).append(number[r["comp"], r["idx"]])
    a = np.zeros((len(names), len(names)))
    for k, cols in rows.items():
        for i in cols:
            for j in cols:
                a[i, j] += 1 + k[1]
    own = np.stack([K.apply_stripe_prior(spectrum, e[None])[0] for e in np.eye(4)], axis=1)
    groups = {}
    for c, idx in names:
        if c == "stripes":
            groups.setdefault(idx.rsplit("/", 2)[0], []).append(number[c, idx])
    for at in groups.values():
        a[np.ix_(at, at)] += own
    assert np.allclose([got[n] for n in names], a @ np.array([given[n] for n in names]))


def test_blank_polarised_map(spark):
    got = M.blank(spark, 3, "IQU").collect()
    assert len(got) == 9 and {r["pol"] for r in got} == {"i", "q", "u"} and all(r["val"] == 0 for r in got)


def test_any_noise_model_in_a_system(spark):
    """A fitted model applied to a signal given as a table: the same as to the array."""
    rng = np.random.default_rng(15)
    sizes = (20, 17, 20)
    rows = [("a", 3 * k, i, float(rng.normal() + np.sin(i)), int(i % 4)) for k, n in enumerate(sizes) for i in range(n)]
    s = spark.createDataFrame(rows, "tod string, det long, samp long, dat double, ipix long")
    models = mapset.kept(solve.fitted(solve.blocks(s), "binned_eig", freqs=(0.1, 0.3)), "models")
    got = {(r["det"], r["samp"]): r["val"] for r in mapset.modelled(models)(s.withColumn("val", F.col("samp") * 1.0)).collect()}
    d, mask = np.zeros((3, 20)), np.arange(20) < np.array(sizes)[:, None]
    for _, det, i, x, _ in rows:
        d[det // 3, i] = x
    want = K.BinnedEig(d, freqs=(0.1, 0.3), mask=mask).apply(np.arange(20.0) * mask) * mask
    assert np.allclose([got[3 * k, i] for k, n in enumerate(sizes) for i in range(n)], [want[k, i] for k, n in enumerate(sizes) for i in range(n)])
    assert len(got) == len(rows)


def tall(count, seed=21):
    """Many detectors of few samples: two strong modes and noise."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(count, 2)) @ np.stack([np.sin(np.arange(64) / 5), np.cos(np.arange(64) / 9)]) * 10 + rng.normal(size=(count, 64))


def test_more_detectors_than_samples():
    """Nothing has the size of the detectors squared, and detectors beyond the samples add no median of zero."""
    d = tall(300)
    e = K.BinnedEig(d, freqs=(0.05, 0.2), thresh=3.0)
    u, s, _ = np.linalg.svd(d, full_matrices=False)
    assert e.modes.shape == (300, 2) and np.allclose(np.abs(u[:, 1::-1].T @ e.modes), np.eye(2), atol=1e-9)
    y, out = K.dct1(d), np.zeros_like(d)
    for k, (a, b) in enumerate(zip(e.edges[:-1], e.edges[1:], strict=True)):
        out[:, a:b] = np.linalg.solve(np.diag(e.det[:, k]) + e.modes @ np.diag(e.mode[:, k]) @ e.modes.T, y[:, a:b])
    assert np.allclose(e.apply(d), K.halved(K.dct1(out)) / 126)
    bad = (np.arange(300)[:, None] * 7 + np.arange(64)) % 50 < 3
    got = K.gapfill_eig(d, bad)
    assert (got[~bad] == d[~bad]).all() and np.abs(got - d)[bad].mean() < 0.3 * np.abs(d)[bad].mean()


def test_eigenvalues_beyond_the_samples_are_zero():
    value = np.arange(1.0, 9)
    assert K.strong(value, 8, 1.0).tolist() == (value > 4.5).tolist()
    assert K.strong(value, 12, 1.0).tolist() == (value > 2.5).tolist()  # the median of four zeros and these
    assert K.strong(value, 10**6, 1.0).tolist() == (value > 4.5).tolist()


@pytest.mark.parametrize("count", [40, 300])
def test_binned_noise_by_sums_over_rows(spark, tmp_path, count):
    d = np.concatenate([tall(count), tall(count, 22)])
    rows = [(i, row.tolist(), i // count) for i, row in enumerate(d)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    query = catalog.queries()["noise_model_binned_eig"]
    a, b = (query(spark, str(tmp_path), most).toPandas().sort_values("det") for most in (10**6, 0))
    assert len(a) == len(b) == 2 * count
    for c in a.columns:
        assert np.allclose(a[c], b[c])
    mixed = query(spark, str(tmp_path), count - 1).count()
    assert mixed == 2 * count


@pytest.mark.parametrize("count", [40, 300])
def test_gaps_filled_by_sums_over_rows(spark, tmp_path, count):
    d = np.concatenate([tall(count), tall(50, 22)])
    rows = [(i, row.tolist(), int(i >= count)) for i, row in enumerate(d)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    query = catalog.queries()["gapfill_eigenmodes"]
    a, b, c = (query(spark, str(tmp_path), most).toPandas().sort_values(["det", "samp"]) for most in (10**6, 0, 100))
    assert len(a) == len(b) == len(c) == 64 * len(d)
    assert np.allclose(a["dat"], b["dat"], atol=1e-6) and np.allclose(a["dat"], c["dat"], atol=1e-6)


def test_notch_without_design_rows(spark):
    """The same signal as by the design's rows; those, many times the samples, are not sent to all tasks."""
    e = src.events(spark, SF)
    design = T.notch(e, 1e-5, 2e-5)
    rows = T.spread(design, T.project(design, e))
    for df in (rows, catalog.queries()["notch_to_tod"](spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastExchange.*\n.*Project.*\n.*Generate", plan)
    a, b = (x.toPandas().sort_values(["tod", "det", "samp"]) for x in (rows, T.notch_signal(e, 1e-5, 2e-5)))
    assert len(a) == len(b) == e.count() and np.allclose(a["val"], b["val"], atol=1e-6)
