"""Nothing is lost: whole tables, NULL keys and values, empty samples and fields, large slot numbers."""

import os
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions import gram
from starloom.operators import chains as C, condensing, histograms as H, lookups as L, matching as M
from starloom.operators.neighbours import neighbour_weight
from starloom.operators.ordering import position_in_group
from starloom.operators.quantiles import exact_quantiles
from starloom.operators import quantiles
from starloom.operators.runsets import runs_by_sim
from starloom.sources import fixtures as X

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("view,name", [(X.chain, "events"), (X.pixels, "orders"), (X.coefficients, "events"), (X.proposals, "events"), (X.photons, "events"), (X.truth, "part")])
def test_views_are_whole(spark, view, name):
    assert view(spark, SF).count() == X.table(spark, SF, name).count()


def test_positions_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (1, 3.0), (None, 5.0), (None, None)], "k int, v double")
    got = position_in_group(df, ["k"], -F.floor("v"), [F.desc("v")], "pos").collect()
    assert sorted((str(r.k), str(r.v), r.pos) for r in got) == sorted([("1", "3.0", 0), ("1", "2.0", 1), ("1", "None", 2), ("None", "5.0", 0), ("None", "None", 1)])
    runs = spark.createDataFrame([("a", None, "x_001"), ("b", 7, "x_001"), ("c", 3, None)], "run_id string, started long, tail_name string")
    assert sorted((str(r.sim), r.place, r.run_id) for r in runs_by_sim(runs).collect()) == [("001", 0, "a"), ("001", 1, "b"), ("None", 0, "c")]


def test_percentiles_of_a_null_group_and_of_a_dominant_one(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "CELL_VALUES", 4)
    rng = np.random.default_rng(1)
    rows = [(None, float(v)) for v in rng.random(5000)] + [(1, float(v)) for v in rng.integers(0, 5, 50)] + [(1, None), (2, 1e308), (2, -1e308)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"lo": 0.16, "mid": 0.5, "hi": 0.975}).collect()}
    for k in (None, 1):
        values = [v for q, v in rows if q == k and v is not None]
        assert got[k].n == len(values)
        assert np.allclose([got[k].lo, got[k].mid, got[k].hi], np.quantile(values, [0.16, 0.5, 0.975]), rtol=1e-12)
    assert got[2].n == 2


def test_covariance_of_incomplete_samples(spark):
    rng = np.random.default_rng(3)
    table = rng.random((40, 3))
    table[5, 1] = table[7, 0] = table[7, 2] = np.nan
    rows = [(s, p, float(table[s, p])) for s in range(40) for p in range(3) if not np.isnan(table[s, p])]
    got = {(r.i, r.j): r for r in C.cov_matrix(spark.createDataFrame(rows, "sample_id long, param long, value double"), 3).collect()}
    assert len(got) == 6
    for (i, j), r in got.items():
        both = ~np.isnan(table[:, i]) & ~np.isnan(table[:, j])
        assert np.isclose(r["cov"], np.cov(table[both, i], table[both, j])[0, 1]) and np.isclose(r["corr"], np.corrcoef(table[both, i], table[both, j])[0, 1])


def test_node_numbers_do_not_collide(spark):
    det = spark.createDataFrame([(0, 0, 1_000_000, 0.0, 0.0, 1.0), (0, 1, 0, 0.1, 0.0, 2.0), (0, 1, 2_000_000, 5.0, 5.0, 3.0)], "field_id long, sample_id long, src long, x double, y double, f0 double")
    nodes = condensing.stacked(det)
    assert nodes.select("id").distinct().count() == 3
    seeds = condensing.seed_catalog(det, 0.5).collect()
    assert sorted(r.degree for r in seeds) == [0, 1]
    with pytest.raises(Exception):
        condensing.stacked(det.withColumn("src", F.lit(1 << 40))).collect()


@pytest.fixture
def sky(spark):
    """Two fields, the second without any detection; three samples each, of which one is empty in the first field."""
    truth = spark.createDataFrame([(0, 1, 1.0, 1.0, 5.0), (0, 2, 9.0, 9.0, 5.0), (1, 3, 1.0, 1.0, 5.0)], "field_id long, truth_id long, x double, y double, f0 double")
    det = spark.createDataFrame([(0, s, 0, 1.0, 1.1, 5.0) for s in (0, 1)], "field_id long, sample_id long, src long, x double, y double, f0 double")
    samples = spark.range(2).select(F.col("id").alias("field_id")).join(spark.range(3).select(F.col("id").alias("sample_id")), how="cross")
    return truth, det, samples


def test_denominators_count_empty_samples_and_fields(spark, sky):
    truth, det, samples = sky
    matches = M.match_nearest(truth, det, 1.0, 0.5)
    got = {r.truth_id: (r.nsamp, r.completeness) for r in M.match_completeness(truth, det, matches, samples=samples).collect()}
    assert got == {1: (3, 2 / 3), 2: (3, 0.0), 3: (3, 0.0)}
    without = {r.truth_id: r.completeness for r in M.match_completeness(truth, det, matches).collect()}
    assert without == {1: 1.0, 2: 0.0, 3: 0.0}
    bright = truth.withColumn("mag", F.col("f0")), det.withColumn("mag", F.col("f0"))
    assert {r.truth_id: r.completeness for r in M.completeness(*bright, 1.0, frac=0.5, samples=samples).collect()} == {1: 2 / 3, 2: 0.0, 3: 0.0}
    bar = M.recovery(truth, det, 1.0, 0.5, [1.0, 10.0], samples=samples).collect()[0]
    assert bar.n == 3 and abs(bar.prevalence - 2 / 9) < 1e-12
    counts = H.number_counts(det, [2.0, 4.0], 1.0, samples=samples).collect()
    assert {r.field_id: r.median > 0 for r in counts} == {0: True, 1: False}
    medians = {r.field_id: r.median for r in H.sample_posterior(det, "f0", [0.0, 10.0], samples=samples).collect()}
    assert np.allclose([medians[0], medians[1]], [statistics.median([1, 1, 0]) + 0.01, 0.01])
    pixels = spark.createDataFrame([(f, 1, 1, 1, 0.1) for f in (0, 1)], "map_id long, row_ long, col_ long, mask int, error double")
    seen = {(r.field_id, r.sample_id): (r.nsrc, r.median) for r in L.source_number(det, pixels, samples).collect()}
    assert len(seen) == 6 and seen[0, 2] == (0, 1.0) and seen[1, 0] == (0, 0.0)


def test_confidence_counts_empty_samples(spark, sky):
    _, det, samples = sky
    claims = det.select("field_id", "sample_id", F.lit(0).alias("seed"), "src")
    assert condensing.condense(claims, det, "seed", samples=samples).collect()[0].confidence == 2 / 3


def test_draws_do_not_depend_on_the_partitioning(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("chain_id"), F.col("id").alias("i"), F.lit(1.0).alias("value"))
    draw = lambda d: sorted((r.i, r.corrected) for r in C.corrected_posterior(d, 0.0, 1.0, 0.0, 7, ["chain_id"]).collect())
    one = draw(df)
    assert one == draw(df.repartition(7, "i")) and one != sorted((r.i, r.corrected) for r in C.corrected_posterior(df, 0.0, 1.0, 0.0, 8, ["chain_id"]).collect())
    noise = np.array([v - 1.0 for _, v in one])
    assert abs(noise.mean()) < 0.05 and abs(noise.std() - 1) < 0.05


def test_neighbours_beyond_five_widths_count(spark):
    cat = spark.createDataFrame([(0, 0, 0, 0.0, 0.0), (0, 0, 1, 6.0, 0.0), (0, 0, 2, 40.0, 0.0)], "field_id long, sample_id long, src long, x double, y double")
    got = {r.src: r.weight for r in neighbour_weight(cat, 1.0).collect()}
    assert np.isclose(got[0], np.exp(-18.0)) and got[2] == 0.0


def test_held_sums_are_sent_on(spark, monkeypatch):
    monkeypatch.setattr(gram, "HELD", 4096)
    df = spark.range(600).select((F.col("id") % 50).alias("k"), F.col("id").cast("double").alias("v"))
    sums = gram.outer_sums(df, ["k"], ["v"], lambda pdf: (np.column_stack([np.ones(len(pdf)), pdf["v"], pdf["v"]]), np.ones(len(pdf))))
    got = {(r.k, r.p, r.q): r.s for r in sums.collect()}
    assert len(got) == 50 * 6 and all(got[k, 0, 1] == sum(range(k, 600, 50)) for k in range(50))


def test_autocorrelation_pads_each_chain_to_its_own_length(spark):
    rng = np.random.default_rng(5)
    sizes = {0: 3, 1: 20_000, 2: 64, 3: 65}
    rows = [(c, i, float(v)) for c, n in sizes.items() for i, v in enumerate(rng.random(n))]
    df = spark.createDataFrame(rows, "chain_id long, i long, value double")
    got = {(r.chain_id, r.lag): r.xi for r in C.autocorr(df).collect()}
    for c, n in sizes.items():
        v = np.array([x for k, _, x in rows if k == c])
        v = v - v.mean()
        want = np.fft.ifft(np.abs(np.fft.fft(v)) ** 2).real
        assert np.allclose([got[c, lag] for lag in range(n // 2)], (want / want[0])[: n // 2], atol=1e-9)
    # Lines sent to the transform are those of each chain's own length, at most four times the data in all.
    n1, n2 = C.split_columns(2 * F.col("n"))
    padded = spark.createDataFrame([(n,) for n in sizes.values()], "n long").select((n1 * n2).alias("p")).collect()
    assert all(2 * n <= r.p <= 4 * n or r.p <= 16 for n, r in zip(sizes.values(), padded))


def test_histogram_over_edge_rows(spark):
    rng = np.random.default_rng(6)
    values = np.r_[rng.random(500) * 12 - 1, 0.0, 10.0, 3.0]
    edges = np.unique(np.r_[0.0, 3.0, 10.0, rng.random(2000) * 10])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    rows = spark.createDataFrame([(float(e),) for e in rng.permutation(edges)], "edge double")
    got = H.histogram_over(df, "v", rows).orderBy("bin").collect()
    assert [r.n for r in got] == np.histogram(values, edges)[0].tolist() and [r.lo for r in got] == edges[:-1].tolist()
