"""Ordering, percentiles, tile joins and bins against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.operators.bins import bin_index, linear_edges
from starloom.operators.chains import moving_average
from starloom.operators.histograms import hdpi, histogram
from starloom.operators.matching import associate, match_completeness, match_nearest
from starloom.operators.ordering import position_in_group
from starloom.operators.quantiles import exact_quantiles
from starloom.operators.spatial import radius_pairs


def test_position_in_group_of_a_dominant_key(spark):
    rng = np.random.default_rng(1)
    # One group holds most rows, and many values are equal.
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.8, 0, rng.integers(1, 9, 3000)), "v": rng.integers(0, 40, 3000) / 4.0, "id": np.arange(3000)})
    got = position_in_group(spark.createDataFrame(pdf), ["g"], -F.floor("v"), [F.desc("v"), F.asc("id")], "pos").toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("g").cumcount()
    assert got.set_index("id")["pos"].sort_index().tolist() == want.sort_index().tolist()


@pytest.mark.parametrize("ties", [True, False])
def test_exact_quantiles(spark, ties):
    rng = np.random.default_rng(2)
    v = rng.exponential(size=5000)
    v = np.round(v, 1) if ties else v
    v[::500] = 1e6
    pdf = pd.DataFrame({"g": np.where(rng.random(5000) < 0.7, 0, rng.integers(1, 5, 5000)), "v": v})
    probs = {"a": 0.05, "b": 0.5, "c": 0.84, "d": 1.0, "e": 0.0}
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).toPandas().set_index("g")
    for g, part in pdf.groupby("g")["v"]:
        assert got.loc[g, "n"] == len(part)
        np.testing.assert_allclose(got.loc[g, list(probs)].to_numpy(float), np.percentile(part, [100 * p for p in probs.values()]), rtol=1e-12)
    whole = exact_quantiles(spark.createDataFrame(pdf), [], "v", probs).toPandas()
    np.testing.assert_allclose(whole[list(probs)].to_numpy(float)[0], np.percentile(v, [100 * p for p in probs.values()]), rtol=1e-12)


@pytest.mark.parametrize("inclusive,salts,tile", [(True, 1, None), (False, 4, 0.3), (True, 3, 2.0)])
def test_radius_pairs_equals_theta_join(spark, inclusive, salts, tile):
    rng = np.random.default_rng(3)
    def side(n, p):
        # A lattice, so that many pairs lie exactly at the radius and on tile borders.
        return pd.DataFrame({"k": rng.integers(0, 2, n), f"{p}id": np.arange(n), f"{p}x": rng.integers(-8, 8, n) * 0.25, f"{p}y": rng.integers(-8, 8, n) * 0.25})
    a, b = side(300, "a"), side(200, "b")
    got = radius_pairs(spark.createDataFrame(a), spark.createDataFrame(b), 0.5, ["k"], inclusive=inclusive, salts=salts, tile=tile)
    got = sorted((r.aid, r.bid) for r in got.collect())
    m = a.merge(b, on="k")
    d2 = (m.ax - m.bx) ** 2 + (m.ay - m.by) ** 2
    m = m[d2 <= 0.25] if inclusive else m[d2 < 0.25]
    assert got == sorted(zip(m.aid, m.bid))


def test_bins_close_the_last_bar_only_when_asked(spark):
    edges = [0.0, 1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.0, 2.0, float("nan"))], "v double")
    rows = df.select(bin_index(F.col("v"), edges).alias("o"), bin_index(F.col("v"), edges, True).alias("c")).collect()
    assert [r.o for r in rows] == [None, 0, 1, None, None]
    assert [r.c for r in rows] == [None, 0, 1, 1, None]


def test_histogram_sums_to_the_rows(spark):
    v = np.random.default_rng(4).normal(size=1000)
    edges = linear_edges(-10, 10, 20)
    got = histogram(spark.createDataFrame(pd.DataFrame({"v": v})), "v", edges, density=True).orderBy("bin").toPandas()
    n, _ = np.histogram(v, edges)
    assert got["n"].tolist() == n.tolist()
    assert abs(got["density"].sum() * 1.0 - 1.0) < 1e-12


def test_hdpi_stops_at_the_edges(spark):
    rows = [("left", b, float(b), p) for b, p in enumerate((0.5, 0.3, 0.2))] + [("flat", b, float(b), 0.25) for b in range(3)]
    got = {r.g: r for r in hdpi(spark.createDataFrame(rows, "g string, bin long, t double, p double"), 0.79, ["g"]).collect()}
    assert (got["left"].t_lo, got["left"].t_hi) == (0.0, 1.0)
    assert (got["flat"].t_lo, got["flat"].t_hi, got["flat"].bars) == (0.0, 2.0, 3)


def test_moving_average_over_block_borders(spark):
    v = np.random.default_rng(5).random(500)
    df = spark.createDataFrame(pd.DataFrame({"chain_id": 0, "i": np.arange(500), "value": v}))
    got = moving_average(df, 7, block=10).orderBy("i").toPandas()
    np.testing.assert_allclose(got["average"], np.convolve(v, np.ones(7) / 7, "valid"), rtol=1e-12)
    assert got["i"].tolist() == list(range(6, 500))


def catalogs(spark, seed):
    rng = np.random.default_rng(seed)
    t = pd.DataFrame({"field_id": rng.integers(0, 2, 60), "truth_id": np.arange(60), "x": rng.random(60) * 10, "y": rng.random(60) * 10, "f0": rng.random(60) * 10 + 1})
    e = pd.DataFrame({"field_id": rng.integers(0, 2, 900), "sample_id": rng.integers(0, 5, 900), "x": rng.random(900) * 10, "y": rng.random(900) * 10, "f0": rng.random(900) * 10 + 1})
    return t, e


def test_match_nearest_brute_force(spark):
    t, e = catalogs(spark, 6)
    got = match_nearest(spark.createDataFrame(t), spark.createDataFrame(e), 1.0, 0.5).toPandas()
    m = t.merge(e, on="field_id", suffixes=("", "_d"))
    m["d2"] = (m.x - m.x_d) ** 2 + (m.y - m.y_d) ** 2
    m = m[(m.d2 < 1.0) & ((m.f0_d - m.f0).abs() / m.f0 < 0.5)].sort_values("d2").groupby(["sample_id", "truth_id"]).first().reset_index()
    got = got.sort_values(["sample_id", "truth_id"]).reset_index(drop=True)
    np.testing.assert_allclose(got["flux"], m["f0_d"])
    share = match_completeness(spark.createDataFrame(t), spark.createDataFrame(e), spark.createDataFrame(got)).toPandas()
    assert len(share) == len(t) and share["completeness"].between(0, 1).all()


def test_associate_reports_zero_and_infinity_without_match(spark):
    a = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0), (0, 2, 5.0, 5.0, 1.0)], "field_id long, truth_id long, x double, y double, mag double")
    b = spark.createDataFrame([(0, 0.3, 0.4, 1.1, 0.9, 0.2), (0, 0.0, 0.1, 1.2, 0.4, 0.1), (0, 0.0, 0.0, 9.0, 1.0, 0.0)], "field_id long, x double, y double, mag double, c double, s double")
    got = {r.truth_id: r for r in associate(a, b, 0.5, dmag=0.5, conf="c", sig="s").collect()}
    assert (got[1].matched, got[1].best_conf, got[1].best_sig) == (True, 0.9, 0.1)
    assert (got[2].matched, got[2].best_conf, got[2].best_sig) == (False, 0.0, float("inf"))


def test_ranks_where_most_fluxes_are_nearly_the_same(spark):
    """90% of a sample in one flux unit: no cell that a task sorts holds 2% of it."""
    from starloom.operators.ordering import quantile_cells
    from starloom.operators.ranking import rank_flux

    rng = np.random.default_rng(1)
    n = 20_000
    f0 = np.where(np.arange(n) % 10 > 0, 5.0 + rng.random(n), rng.random(n) * 500)
    df = spark.createDataFrame(pd.DataFrame({"field_id": 0, "sample_id": 1, "x": rng.random(n), "y": 0.0, "f0": f0}))
    cells = quantile_cells(df, ["field_id", "sample_id"], -F.col("f0"), "cell").groupBy("cell").count()
    assert cells.agg(F.max("count")).first()[0] < 0.02 * n
    got = rank_flux(df).toPandas().sort_values("slot")
    assert list(got.slot) == list(range(n)) and (np.diff(got.f0) <= 0).all()


def test_templates_without_broadcast(spark):
    """With broadcasts off the pixels are dealt to blocks, not to bands."""
    from starloom.operators.lookups import apply_templates

    planes = spark.range(64 * 64).selectExpr("cast(id % 1 as int) as band", "id % 1 as map_id", "id div 64 as row_", "id % 64 as col_", "0L as tmpl", "cast(id as double) as value")
    amps = spark.range(600).selectExpr("id as sample_id", "0 as band", "0L as tmpl", "cast(id as double) as amp")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = apply_templates(amps, planes, (0,))
        assert out.count() == 64 * 64 * 600
        assert out.where("value <> sample_id * (row_ * 64 + col_)").count() == 0
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_br" in next(line for line in plan.splitlines() if "Join" in line)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_detections_are_numbered_once(spark, tmp_path):
    """Repeated lines count once, repeated parts as often as they are there; uses read the numbered rows."""
    from starloom.sources.fixtures import detections

    lines = [(o, o % 7, 1 + o % 3, float(o % 50), 0.01 * (o % 5), 0.02) for o in range(600)]
    names = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame([*lines, *lines[:200]], names).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 5, 5)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    det = detections(spark, str(tmp_path), slots=True)
    assert not any("lineitem" in f for f in det.inputFiles())
    got = det.toPandas()
    assert len(got) == sum((k % 7 < 6) + (k % 7 == 5) for k in range(600))
    for _, group in got.groupby(["field_id", "sample_id"]):
        group = group.sort_values("src")
        assert list(group.src) == list(range(len(group))) and group.f0.is_monotonic_decreasing
