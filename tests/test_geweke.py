"""Geweke scores from sums between break points."""

import numpy as np
import pandas as pd

from starloom.operators import chains as C


def score(x, first=0.1, last=0.5, intervals=20):
    def spectrum(s):
        s = s - s.mean()
        r = [(s[k:] * s[: len(s) - k]).sum() / (len(s) - k) for k in range(3)]
        b = np.linalg.solve([[r[0], r[1]], [r[1], r[0]]], r[1:])
        return (r[0] - r[1] * b[0] - r[2] * b[1]) / (1 - b.sum()) ** 2

    out = []
    for s in np.linspace(0, int(len(x) * (1 - last)), intervals).astype(int):
        rest = x[s:]
        a, b = rest[: int(first * len(rest))], rest[int(last * len(rest)) :]
        out.append((s, (a.mean() - b.mean()) / np.sqrt(spectrum(a) / len(a) + spectrum(b) / len(b))))
    return out


def test_geweke_of_chains_of_different_length(spark):
    rng = np.random.default_rng(0)
    chains = {k: np.cumsum(rng.normal(size=n)) * 0.05 + rng.normal(size=n) for k, n in enumerate((1000, 1703, 401))}
    rows = pd.DataFrame([(k, i, v) for k, x in chains.items() for i, v in enumerate(x)], columns=["chain_id", "i", "value"])
    for block in (64, 4096):
        got = C.geweke(spark.createDataFrame(rows), block=block)
        for k, x in chains.items():
            mine = got.where(f"chain_id = {k}").orderBy("k").collect()
            want = score(x)
            assert [r.start for r in mine] == [s for s, _ in want]
            np.testing.assert_allclose([r.z for r in mine], [z for _, z in want], rtol=1e-9)


def test_rows_are_not_copied_per_start(spark):
    """What is shuffled for the sums follows the rows: only the slices, a few per chain, are multiplied."""
    df = spark.range(5000).selectExpr("0L as chain_id", "id as i", "cast(id % 17 as double) as value")
    plan = C.geweke(df, block=512)._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "Generate" in line and "value" in line]
    assert all("_block" in line for line in rows)  # the halo of a block, two rows
