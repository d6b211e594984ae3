"""Archives, text formats and the streaming monitor on small files."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom import schema
from starloom.operators.chains import rhat, rhat_of_state
from starloom.sources import archives, sinks, text
from starloom.sources.pixels import read_pixels
from starloom.streaming import monitor as S


def test_run_archives_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    want = {}
    for run in ("20210401-120000", "20210402-120000"):
        n = np.array([3, 0, 2], dtype=np.int32)
        x, y, f = (np.zeros(s, np.float32) for s in ((3, 5), (3, 5), (2, 3, 5)))
        for s, k in enumerate(n):
            x[s, :k], y[s, :k], f[:, s, :k] = rng.random(k), rng.random(k), rng.random((2, k)) + 0.1
        bkg, tmpl = rng.random((3, 2)), rng.random((3, 1, 2))
        resid = rng.random((2, 4, 3))
        (tmp_path / run).mkdir()
        np.savez(tmp_path / run / "chain.npz", n=n, x=x, y=y, f=f, bkg=bkg, template_amplitudes=tmpl, residuals0=resid)
        want[run] = (n, x, f, bkg, tmpl, resid)
    got = archives.read_chain(spark, f"{tmp_path}/*/chain.npz")
    src = got["sources"].toPandas()
    assert sorted((r.run_id, r.sample_id, r.n) for r in got["samples"].collect()) == sorted((run, s, k) for run in want for s, k in enumerate((3, 0, 2)))
    flat = archives.as_ensemble(got["sources"], 2).orderBy("field_id", "sample_id", "src").collect()
    assert flat[0].asDict().keys() == {"field_id", "sample_id", "src", "x", "y", "f0", "f1"} and len(flat) == 10
    for run, (n, x, f, bkg, tmpl, resid) in want.items():
        mine = src[src.run_id == run].sort_values(["sample_id", "src"])
        assert mine.groupby("sample_id").size().to_dict() == {0: 3, 2: 2}
        np.testing.assert_allclose(mine["x"], np.concatenate([x[0, :3], x[2, :2]]))
        np.testing.assert_allclose(np.stack(mine["flux"]), np.concatenate([f[:, 0, :3].T, f[:, 2, :2].T]))
        sc = got["scalars"].where(F.col("run_id") == run)
        b = sc.where("param = 'bkg'").orderBy("sample_id", "idx").toPandas()["value"]
        np.testing.assert_allclose(b, bkg.ravel())
        t = sc.where("param = 'template_amplitudes' and idx = array(0L, 1L)").orderBy("sample_id").toPandas()["value"]
        np.testing.assert_allclose(t, tmpl[:, 0, 1])
        m = got["maps"].where(F.col("run_id") == run).orderBy("sample_id", "row_", "col_").toPandas()
        assert sorted(m.sample_id.unique()) == [1, 2] and m.kind.unique().tolist() == ["residuals"]
        np.testing.assert_allclose(m["value"], resid.ravel())


def test_array_catalogs_refuse_pickles(spark, tmp_path):
    (tmp_path / "a").mkdir()
    np.save(tmp_path / "a" / "cat.npy", np.array([[1.0, 2.0, 3.0]]))
    assert archives.read_array_catalog(spark, f"{tmp_path}/a/cat.npy", ["x", "y", "f0"]).first().asDict() == {"run_id": "a", "x": 1.0, "y": 2.0, "f0": 3.0}
    np.save(tmp_path / "a" / "bad.npy", np.array({"x": 1}, dtype=object), allow_pickle=True)
    with pytest.raises(Exception):
        archives.read_array_catalog(spark, f"{tmp_path}/a/bad.npy", ["x"]).collect()


def test_text_catalogs(spark, tmp_path):
    path = tmp_path / "cat.txt"
    path.write_text("  1.0 2.0   3.5\n\n4 5 6e1 7 8\n")
    rows = text.read_text_catalog(spark, str(path)).orderBy("x").collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.0, 3.5, None, None), (4.0, 5.0, 60.0, 7.0, 8.0)]
    cond = text.read_text_catalog(spark, str(path), text.CONDENSED_COLUMNS).orderBy("x").collect()
    assert (cond[1].x, cond[1].y, cond[1].f0) == (4.0, 60.0, 8.0)


def test_curves_headers_and_runs(spark, tmp_path):
    (tmp_path / "curve.csv").write_text("1.0,2.0\n3.0,4.5\n")
    assert [tuple(r) for r in text.read_curve(spark, str(tmp_path / "curve.csv")).orderBy("x").collect()] == [(1.0, 2.0, "curve.csv"), (3.0, 4.5, "curve.csv")]
    (tmp_path / "pixr.txt").write_text("100 90\t1\n1044.0 4.62\n0.005 179.0\n")
    (tmp_path / "pixg.txt").write_text("100 90 1\n0.5 2.0")
    heads = {r.file: r for r in text.read_pix_header(spark, [str(tmp_path / "pixr.txt"), str(tmp_path / "pixg.txt")]).collect()}
    assert tuple(heads["pixr.txt"])[1:] == (100, 90, 1, 1044.0, 4.62, 0.005, 179.0) or heads["pixr.txt"].background == 179.0
    assert heads["pixg.txt"].gain == 2.0 and heads["pixg.txt"].k is None
    for run, sim in (("20210401-120000", "300"), ("20210402-130000", "301")):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "params_read.txt").write_text(f"tail_name: rx: sim{sim}\nnsamp: 500\n")
        (tmp_path / "runs" / run / "params.txt").write_bytes(b"\x80not read")
    runs = {r.run_id: r for r in text.read_runs(spark, str(tmp_path / "runs")).collect()}
    assert runs["20210401-120000"].params == {"nsamp": "500", "tail_name": "rx: sim300"}
    assert runs["20210402-130000"].started.hour == 13


def test_photometry_uses_the_band_asked_for(spark):
    words = [str(k) for k in range(40)]
    words[20], words[21], words[22], words[15] = "30", "40", "20.0", "17.5"
    got = text.parse_photometry(spark.createDataFrame([(" ".join(words),)], "value string"), {"g": 0.5}, (20, 50, 20, 50)).first()
    assert (got.x, got.y) == (9.0, 19.0) and abs(got.counts_g - 200.0) < 1e-9


def test_pixel_planes(spark, tmp_path):
    rows = [(0, 0, 0, p, v) for p, v in (("SIGNAL", 1.0), ("DUST", float("nan")), ("ERROR", 0.5), ("MASK", 0.0), ("SZ", 2.0), ("OTHER", 9.0))]
    spark.createDataFrame(rows, "map_id long, row_ long, col_ long, plane string, value double").write.parquet(str(tmp_path / "p"))
    got = read_pixels(spark, str(tmp_path / "p"), ["SIGNAL", "DUST"], templates=["SZ"]).first()
    assert (got.image, got.error, got["mask"], got.tmpl) == (1.0, 0.5, 0, {"SZ": 2.0})


def test_sink_appends(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "run_id string, v double")
    for _ in range(2):
        sinks.write_table(df, str(tmp_path / "t"), ["run_id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    sinks.write_table(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def sample_rows(n, start):
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(start + np.arange(n) * 7, unit="min")
    k = np.arange(n)
    return pd.DataFrame({"run_id": k % 3, "ts": t, "move": np.where(k % 2, "P", "BD"), "accepted": (k % 5 < 2) * 1.0, "out_of_bounds": (k % 11 == 0) * 1.0, "chi2": k * 1.5, "nsrc": 100 + k, "ms": k * 0.25})


def test_replayed_stream_equals_batch(spark):
    """Three arrivals and three restarts; also for no samples and samples of one instant."""
    rows = spark.createDataFrame(pd.concat([sample_rows(300, 0), sample_rows(200, 40000)]), schema.SAMPLES)
    for some in (rows, rows.limit(1), rows.where("false")):
        got, want = (d.toPandas().sort_values(["run_id", "window_start"]).reset_index(drop=True) for d in (S.monitored(some, ["P", "BD"]), S.monitor(some, ["P", "BD"])))
        pd.testing.assert_frame_equal(got, want)
    state = S.running_states(rows.selectExpr("ts", "run_id as chain_id", "chi2 as value"), ["chain_id", "value"])
    whole = S.running_state(rows.selectExpr("run_id as chain_id", "chi2 as value"))
    a, b = (d.toPandas().sort_values("chain_id").reset_index(drop=True) for d in (state, whole))
    pd.testing.assert_frame_equal(a, b)


def test_monitor_stream_equals_batch(spark, tmp_path):
    parts = [sample_rows(200, 0), sample_rows(200, 1500), sample_rows(1, 20000)]
    src = str(tmp_path / "in")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for part in parts:
        spark.createDataFrame(part, schema.SAMPLES).coalesce(1).write.mode("append").parquet(src)
        # One run of the query per arrival; it goes on from its checkpoint.
        q = S.start_monitor(S.monitor(S.watch_samples(spark, src, schema.SAMPLES), ["P", "BD"]), out, ckpt)
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(out).toPandas().sort_values(["run_id", "window_start"]).reset_index(drop=True)
    whole = spark.createDataFrame(pd.concat(parts[:2]), schema.SAMPLES)
    want = S.monitor(whole, ["P", "BD"]).toPandas().sort_values(["run_id", "window_start"]).reset_index(drop=True)
    # The last row only moves the watermark past all other windows.
    pd.testing.assert_frame_equal(got, want)


def test_late_samples_are_dropped(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    for part in (sample_rows(10, 5000), sample_rows(3, 0), sample_rows(1, 20000)):
        spark.createDataFrame(part, schema.SAMPLES).coalesce(1).write.mode("append").parquet(src)
        q = S.start_monitor(S.monitor(S.watch_samples(spark, src, schema.SAMPLES), ["P"]), out, ckpt)
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(out).agg(F.sum("steps")).first()[0] == 10


def test_running_state_gives_rhat(spark, tmp_path):
    rng = np.random.default_rng(1)
    pdf = pd.concat([pd.DataFrame({"chain_id": np.int64(k), "i": np.arange(100), "value": rng.normal(k, 1, 100)}) for k in range(3)])
    src = str(tmp_path / "in")
    for half in (pdf[pdf.i < 50], pdf[pdf.i >= 50]):
        spark.createDataFrame(half).write.mode("append").parquet(src)
    stream = spark.readStream.schema("chain_id long, i long, value double").option("maxFilesPerTrigger", 2).parquet(src)
    q = S.running_state(stream).writeStream.outputMode("complete").format("memory").queryName("chain_state_test").start()
    q.processAllAvailable()
    q.stop()
    streamed = rhat_of_state(spark.table("chain_state_test")).first()
    batch = rhat(spark.createDataFrame(pdf)).first()
    assert streamed.n == batch.n and abs(streamed.rhat - batch.rhat) < 1e-12
