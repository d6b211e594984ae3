"""Transforms, fits and random parts against numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from starloom.functions.fourier import fft2, long_fft
from starloom.operators import background as B
from starloom.operators import chains as C
from starloom.operators import ellipses as E
from starloom.operators import maps as G
from starloom.operators import spectra as Z


def test_long_fft(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(2, 60)) + 1j * rng.normal(size=(2, 60))
    pdf = pd.DataFrame([(s, i, z[s, i].real, z[s, i].imag) for s in range(2) for i in range(60)], columns=["s", "i", "re", "im"])
    got = long_fft(spark.createDataFrame(pdf), ["s"], "i", 8, 8).orderBy("s", "i").toPandas()
    want = np.fft.fft(np.pad(z, ((0, 0), (0, 4))), axis=1)
    np.testing.assert_allclose(got.re + 1j * got.im, want.ravel(), atol=1e-10)


def test_fft2(spark):
    m = np.random.default_rng(1).normal(size=(6, 5))
    pdf = pd.DataFrame([(0, r, c, m[r, c], 0.0) for r in range(6) for c in range(5)], columns=["m", "r", "c", "re", "im"])
    got = fft2(spark.createDataFrame(pdf), ["m"], "r", "c", 6, 5).orderBy("r", "c").toPandas()
    np.testing.assert_allclose(got.re + 1j * got.im, np.fft.fft2(m).ravel(), atol=1e-10)


def test_autocorrelation(spark):
    rng = np.random.default_rng(2)
    chains = {k: np.cumsum(rng.normal(size=n)) for k, n in enumerate((101, 64))}
    pdf = pd.concat([pd.DataFrame({"chain_id": k, "i": np.arange(len(v)), "value": v}) for k, v in chains.items()])
    got = C.autocorr(spark.createDataFrame(pdf)).toPandas()
    tau = C.tau(C.autocorr(spark.createDataFrame(pdf))).toPandas().set_index("chain_id")["tau"]
    for k, v in chains.items():
        f = np.fft.fft(v - v.mean())
        a = np.fft.ifft(f * f.conj()).real
        a = (a / a.max())[: len(v) // 2]
        np.testing.assert_allclose(got[got.chain_id == k].sort_values("lag")["xi"], a, atol=1e-10)
        assert tau[k] == (a > 0.2).sum() - 1


def test_rhat_of_identical_chains_tends_to_one(spark):
    v = np.random.default_rng(3).normal(size=400)
    pdf = pd.concat([pd.DataFrame({"chain_id": k, "i": np.arange(400), "value": v}) for k in range(3)])
    r = C.rhat(spark.createDataFrame(pdf)).first()
    assert r.m == 3 and abs(r.rhat - np.sqrt(399 / 400)) < 1e-12


def test_ridge_fit_and_synthesis(spark):
    rng = np.random.default_rng(4)
    n, h, w = 2, 12, 10
    y, x = np.mgrid[:h, :w]
    basis = []
    for i in range(n):
        for j in range(n):
            ax, ay = (i + 1) * np.pi * x / w, (j + 1) * np.pi * y / h
            basis += [np.sin(ax) * np.sin(ay), np.sin(ax) * np.cos(ay), np.cos(ax) * np.sin(ay), np.cos(ax) * np.cos(ay)]
    b = np.array([t.ravel() for t in basis])
    img, err = rng.normal(size=h * w), rng.random(h * w) + 0.5
    err[::7], img[5] = 0.0, np.nan
    ok = (err != 0) & ~np.isnan(img)
    px = spark.createDataFrame(pd.DataFrame({"map_id": 0, "row_": y.ravel(), "col_": x.ravel(), "image": img, "error": err}))
    wts = err[ok] ** -2.0
    k = np.hypot(*[np.repeat(a.ravel(), 4) for a in np.mgrid[1 : n + 1, 1 : n + 1]]) / np.sqrt(2)
    want = np.linalg.solve((b[:, ok] * wts) @ b[:, ok].T + np.diag(3.0 * k**1.5), b[:, ok] @ (wts * img[ok]))
    fit = B.ridge_fit(B.normal_sums(px, n, h, w), n, 3.0, 1.5)
    got = fit.orderBy("i", "j", "k").toPandas()["value"]
    np.testing.assert_allclose(got, want, atol=1e-9)
    model = B.synthesise(fit, h, w, keys=["map_id"]).orderBy("row_", "col_").toPandas()["model"]
    np.testing.assert_allclose(model, want @ b, atol=1e-9)


def test_cov_matrix(spark):
    v = np.random.default_rng(5).normal(size=(50, 4)).cumsum(axis=1)
    pdf = pd.DataFrame([(s, p, v[s, p]) for s in range(50) for p in range(4)], columns=["sample_id", "param", "value"])
    for r in C.cov_matrix(spark.createDataFrame(pdf), 4).collect():
        assert abs(r["cov"] - np.cov(v.T)[r.i, r.j]) < 1e-10
        assert abs(r["corr"] - np.corrcoef(v.T)[r.i, r.j]) < 1e-10


def test_ellipse_of_exact_points(spark):
    t = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    pdf = []
    for g, (a, b, phi) in enumerate([(3.0, 1.0, 0.4), (1.5, 1.2, -0.3)]):
        u, v = a * np.cos(t), b * np.sin(t)
        pdf.append(pd.DataFrame({"g": g, "x": u * np.cos(phi) - v * np.sin(phi) + 7, "y": u * np.sin(phi) + v * np.cos(phi) - 2}))
    got = E.fit_ellipse(spark.createDataFrame(pd.concat(pdf)), ["g"]).orderBy("g").collect()
    for r, (a, b, phi) in zip(got, [(3.0, 1.0, 0.4), (1.5, 1.2, -0.3)]):
        np.testing.assert_allclose([r.x0, r.y0, r.phi, r.axis_1, r.axis_2], [7, -2, phi, a, b], atol=1e-6)


def test_corrected_posterior_moments(spark):
    v = np.random.default_rng(6).normal(5.0, 1.0, 20000)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(v)), "value": v}))
    got = C.corrected_posterior(df, 2.0, 0.5, 0.25, seed=3).toPandas()["corrected"]
    assert abs(got.mean() - (v.mean() + 2.0)) < 0.02
    assert abs(got.var() - (v.var() + 0.5**2 + 0.25**2)) < 0.03


def test_smoothing_in_stretches_moves_each_pixel_once(spark, monkeypatch):
    """Long lines in stretches give the same; lines that fit are never copied."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame([(0, i, j, rng.normal()) for i in range(3) for j in range(101) if (i + j) % 7], columns=["map_id", "row_", "col_", "v"])
    df = spark.createDataFrame(pdf)
    whole = G.smooth(df, "v", 1.0, 3, 101)
    assert "explode(sequence" not in whole._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(G, "STRETCH", 20)
    cut = G.smooth(df, "v", 1.0, 3, 101)
    a, b = (d.orderBy("row_", "col_").toPandas()["v"] for d in (whole, cut))
    np.testing.assert_allclose(a, b, atol=1e-13)


def test_smoothing_wider_than_the_map(spark):
    m = np.random.default_rng(7).normal(size=(5, 4))
    sigma, w = 2.0, np.array(G.gaussian_weights(2.0))
    r = len(w) // 2
    def pass_(a):
        p = np.pad(a, ((r, r), (0, 0)), mode="symmetric")
        return sum(w[k] * p[k : k + len(a)] for k in range(2 * r + 1))
    want = pass_(pass_(m).T).T
    pdf = pd.DataFrame([(0, i, j, m[i, j]) for i in range(5) for j in range(4)], columns=["map_id", "row_", "col_", "v"])
    got = G.smooth(spark.createDataFrame(pdf), "v", sigma, 5, 4).orderBy("row_", "col_").toPandas()["v"]
    np.testing.assert_allclose(got, want.ravel(), atol=1e-12)


def test_upsampled_edges_and_corners(spark):
    pdf = pd.DataFrame([(0, i, j, float(3 * i + j)) for i in range(3) for j in range(4)], columns=["map_id", "row_", "col_", "image"])
    got = G.upsample(spark.createDataFrame(pdf), 2, 3, 4).toPandas()
    assert len(got) == 48 and got["image"].min() == 0.0 and abs(got["image"].max() - 9.0) < 1e-12
    np.testing.assert_allclose(G.upsample_edges([0.0, 1.0, 2.0], 2), np.linspace(0, 2, 6))


def test_tile_weights_share_each_pixel_once(spark):
    grid = spark.range(49).select(F.lit(0).alias("map_id"), F.floor(F.col("id") / 7.0).alias("row_"), (F.col("id") % 7).alias("col_"))
    got = G.tile_templates(grid, 3, 7, 7).groupBy("row_", "col_").agg(F.sum("weight").alias("w")).toPandas()
    assert len(got) == 49
    np.testing.assert_allclose(got["w"], 1.0)


def test_log_multipole_edges_hold_every_mode(spark):
    m = np.random.default_rng(8).normal(size=(8, 8))
    pdf = pd.DataFrame([(0, i, j, m[i, j]) for i in range(8) for j in range(8)], columns=["map_id", "row_", "col_", "image"])
    ps = Z.cross_power(spark.createDataFrame(pdf), "image", "image", 8, 8)
    got = Z.radial_average(ps, Z.ell_edges(8, 8, 7.0, 6)).toPandas()
    assert got["modes"].sum() == 63


def test_medians_over_very_many_samples(spark):
    """One coefficient with a million samples: ranks are selected among cells, no aggregate holds all values."""
    df = spark.range(1_000_000).selectExpr("id as sample_id", "0L as i", "0L as j", "0L as k", "cast((id * 7919) % 1000003 as double) as value")
    df = df.unionByName(spark.range(5).selectExpr("id as sample_id", "0L as i", "1L as j", "0L as k", "cast(id * id as double) as value"))
    out = B.median_coeffs(df)
    want = np.median((np.arange(1_000_000, dtype=np.int64) * 7919) % 1000003)
    assert {r.j: r.value for r in out.collect()} == {0: want, 1: 4.0}
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    power = B.mode_power(df, [0.0, 2.0, 9.0]).collect()
    assert {r.bin: r.median for r in power} == {0: np.median(((np.arange(1_000_000, dtype=np.int64) * 7919) % 1000003).astype(float) ** 2), 1: 16.0}
