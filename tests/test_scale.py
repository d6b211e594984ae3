"""What a task holds and a shuffle carries follows the rows, not their copies, pixels or products."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import background as B, histograms as H, lookups as L, maps as G, matching as M
from starloom.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.fixture
def catalogs(spark, tmp_path):
    """A reference small enough to be broadcast, and its detections in two samples."""
    rng = np.random.default_rng(8)
    truth = [(0, k, float(x), float(y), 10.0, 11.0) for k, (x, y) in enumerate(rng.random((40, 2)) * 20)]
    det = [(0, s, x + dx, y, 10.0 + s, 100.0 if k % 2 else 11.5) for s in (0, 1) for _, k, x, y, _, _ in truth for dx in (0.1, 0.3)]
    spark.createDataFrame(truth, "field_id long, truth_id long, x double, y double, f0 double, f1 double").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame(det, "field_id long, sample_id long, x double, y double, f0 double, f1 double").write.parquet(f"{tmp_path}/d")
    return spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/d")


def test_copied_references_are_not_broadcast(catalogs, capsys):
    truth, det = catalogs
    for out in (
        M.associate(truth, det, 0.5, frac=0.5, value="f0"),
        M.match_nearest(truth, det, 0.5, 0.5),
        M.false_discoveries(det, truth, 0.5, 0.5),
    ):
        joins = [line for line in plan(out, capsys).splitlines() if "Join" in line and "_tx" in line]
        assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_bands_of_a_pair_are_one_row_until_the_nearest_is_known(catalogs, capsys):
    truth, det = catalogs
    out = M.match_nearest(truth, det, 0.5, 0.2, ("f0", "f1"))
    text = plan(out, capsys)
    # From the top: the bands become rows above the first minimum, not below it.
    assert text.index("Generate inline") < text.index("min(CASE WHEN")
    t, d = truth.collect(), det.collect()
    want = {}
    for s in (0, 1):
        for a in t:
            near = [((a.x - b.x) ** 2 + (a.y - b.y) ** 2, -b.f0, b.f1, b) for b in d if b.sample_id == s]
            for k, c in enumerate(("f0", "f1")):
                fit = [n[:3] + (n[3][c],) for n in near if n[0] < 0.25 and abs(n[3][c] - a[c]) / a[c] < 0.2]
                if fit:
                    want[s, a.truth_id, k] = (a[c], min(fit)[3])
    assert {(r.sample_id, r.truth_id, r.band): (r.true_flux, r.flux) for r in out.collect()} == want
    assert any(k for *_, k in want) and len(want) < 160


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_tasks_of_the_detections_follow_the_table(spark, monkeypatch):
    before = sorted(map(str, X.detections(spark, SF).collect()))
    monkeypatch.setattr(X, "TASK_ROWS", 100)
    lines = X.table(spark, SF, "lineitem")
    assert X.spread(lines, ["l_orderkey", "l_linenumber"]).rdd.getNumPartitions() >= lines.count() / 100
    assert sorted(map(str, X.detections(spark, SF).collect())) == before


def test_padded_pixels_are_summed_after_the_shuffle(spark, capsys):
    px = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 0, 2.0), (0, 1, 1, None), (0, 3, 3, 9.0), (None, 1, 0, 4.0)], "map_id long, row_ long, col_ long, image double")
    out = G.pad(px, 5, ["image"], pivot=3)
    text = plan(out, capsys)
    assert text.index("partial_sum") < text.index("REPARTITION_BY_COL")
    got = {(r.map_id, r.row_, r.col_): r.image for r in out.collect()}
    assert len(got) == 50 and {k: v for k, v in got.items() if v} == {(0, 0, 0): 3.0, (None, 1, 0): 4.0} and None not in got.values()


@pytest.mark.parametrize("held", [1, 1 << 17])
def test_synthesis_shuffles_coefficients_only(spark, capsys, monkeypatch, held):
    monkeypatch.setattr(B, "HELD", held, raising=False)
    rng = np.random.default_rng(9)
    rows = [(s, i, j, k, float(rng.random())) for s in range(7) for i in range(s % 3 + 1) for j in range(2) for k in range(4)]
    rows += [(3, 0, 0, 0, 2.0), (3, 0, 0, 1, None), (8, None, 0, 0, 1.0), (9, 0, None, 0, 1.0), (None, 0, 0, 3, 1.5)]
    out = B.synthesise(spark.createDataFrame(rows, "sample_id long, i long, j long, k long, value double"), 6, 5)
    assert "sum(" not in plan(out, capsys)
    got = {(r.sample_id, r.row_, r.col_): r.model for r in out.collect()}
    assert len(got) == 10 * 30
    for (s, y, x), v in got.items():
        if s == 8:
            assert v is None
            continue
        want = 0.0
        for q, i, j, k, c in rows:
            if q == s and None not in (i, j, c):
                ax, ay = (i + 1) * math.pi * x / 5, (j + 1) * math.pi * y / 6
                want += c * (math.sin(ax) if k < 2 else math.cos(ax)) * (math.sin(ay) if k % 2 == 0 else math.cos(ay))
        assert abs(v - want) < 1e-9


def test_amplitudes_are_copied_to_a_fixed_number_of_shares(spark, monkeypatch, capsys):
    monkeypatch.setattr(L, "SHARES", 3, raising=False)
    amps = spark.createDataFrame([(s, t, b, s + 0.5 * t + b) for s in range(5) for t in (0, 1) for b in (0, 1)], "sample_id long, tmpl long, band long, amp double")
    planes = spark.createDataFrame([(m % 2, m, r, c, t, float(m + r - c + t)) for m in range(4) for r in range(40) for c in range(2) for t in (0, 1)], "band long, map_id long, row_ long, col_ long, tmpl long, value double")
    out = L.apply_templates(amps, planes, (0, 1))
    text = plan(out, capsys)
    assert "Join" in text and not any("hashpartitioning(band" in line and "map_id" in line for line in text.splitlines())
    got = {(r.sample_id, r.map_id, r.row_, r.col_): r.value for r in out.collect()}
    assert len(got) == 5 * 4 * 80
    assert all(abs(v - sum((s + 0.5 * t + m % 2) * (m + r - c + t) for t in (0, 1))) < 1e-9 for (s, m, r, c), v in got.items())


@pytest.mark.parametrize("stamped", [1, 1 << 20])
def test_rendering_shuffles_sources_only(spark, capsys, monkeypatch, stamped):
    monkeypatch.setattr(G, "STAMPED", stamped, raising=False)
    monkeypatch.setattr(G, "BLOCK", 4, raising=False)
    rng = np.random.default_rng(10)
    h, w, phases = 9, 11, 2
    rows = [(s, float(x), float(y), float(f), None if n % 5 == 0 else float(f) * 2) for s in (0, 1) for n, (x, y, f) in enumerate(rng.random((30, 3)) * [w, h, 5])]
    rows += [(0, 3.25, 3.25, 1.0, 1.0)] * 3 + [(2, 4.5, 4.5, 1.0, None), (None, 5.0, 5.0, 1.0, 1.0)]
    ens = spark.createDataFrame(rows, "sample_id long, x double, y double, f0 double, f1 double")
    cells = [(p, q, dr, dc, p + 0.5 * q + 0.1 * dr + 0.01 * dc + 1.0) for p in (0, 1) for q in (0, 1) for dr in (-1, 0, 1) for dc in (-2, 0, 1)]
    psf = spark.createDataFrame(cells, "phase_x long, phase_y long, drow long, dcol long, w double")
    # Sample 2 has no background, the third a level that is not known.
    levels = {0: (0.5, 0.25), 1: (1.0, 1.5), None: (None, None)}
    bkg = spark.createDataFrame([(s, *v) for s, v in levels.items()], "sample_id long, f0 double, f1 double")
    spots = [(0, 2, 2, 7.0, 8.0), (1, 8, 10, 1.0, None)]
    out = G.render(ens, psf, bkg, h, w, phases, ("f0", "f1"), ["sample_id"], spark.createDataFrame(spots, "sample_id long, row_ long, col_ long, f0 double, f1 double"))
    assert not any("hashpartitioning(" in line and "row_" in line for line in plan(out, capsys).splitlines())
    want = {(s, r, c): list(v) for s, v in levels.items() for r in range(h) for c in range(w)}

    def add(s, r, c, *v):
        known = want.setdefault((s, r, c), [None, None])
        want[s, r, c] = [a if b is None else b + (a or 0.0) for a, b in zip(known, v)]

    for s, x, y, a, b in rows:
        if 0 < x < w - 1 and 0 < y < h - 1:
            ix, iy = math.ceil(x), math.ceil(y)
            px, py = (min(int((i - v) * phases), phases - 1) for i, v in ((ix, x), (iy, y)))
            for p, q, dr, dc, wt in cells:
                if (p, q) == (px, py) and 0 <= iy + dr < h and 0 <= ix + dc < w:
                    add(s, iy + dr, ix + dc, *(None if f is None else f * wt for f in (a, b)))
    for s, r, c, a, b in spots:
        add(s, r, c, a, b)
    got = {(r.sample_id, r.row_, r.col_): (r.f0, r.f1) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for k, v in want.items() for a, b in zip(got[k], v))


def test_values_to_bin_are_made_once(spark, capsys):
    edges = [0.0, 1.0, 2.5, 3.0, 7.0, 10.0]
    values = [-0.1, 0.0, 0.99, 1.0, 2.5, 3.0, 6.0, 10.0, 10.1, float("nan"), None]
    df = spark.createDataFrame([(v, w) for v in values for w in values], "a double, b double")
    made = df.select(F.sqrt(F.col("a") * F.col("a") * F.sign("a")).alias("x"), F.col("b").alias("y"))
    out = H.density2d(made, edges, edges)
    filters = [line for line in plan(out, capsys).splitlines() if "Filter" in line]
    assert filters and all(line.count("SQRT") <= 2 for line in filters)
    xy = np.array([v for v in values if v is not None and v == v and 0 <= v <= 10])
    want = np.histogram2d(np.repeat(xy, len(xy)), np.tile(xy, len(xy)), [edges, edges])[0]
    assert {(r.bx, r.by_): r.n for r in out.collect()} == {(i, j): want[i, j] for i in range(5) for j in range(5)}
    assert [r.n for r in H.histogram(made, "y", edges).orderBy("bin").collect()] == (np.histogram(xy, edges)[0] * len(values)).tolist()
