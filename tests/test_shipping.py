"""Worker functions must run where the package is not installed."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import numpy as np, pandas as pd
from starloom.session import local_session
from starloom.operators.background import normal_sums, ridge_fit
from starloom.operators.neighbours import blend_odds
from starloom.sources.archives import read_array_catalog
spark = local_session("2", partitions=2)
px = spark.createDataFrame(pd.DataFrame({{"map_id": 0, "row_": np.arange(64) // 8, "col_": np.arange(64) % 8, "image": np.random.rand(64), "error": 1.0}}))
assert ridge_fit(normal_sums(px, 1, 8, 8), 1, 1.0).count() == 4
cat = spark.createDataFrame([(0, 1, 0.0, 0.0, 5.0), (0, 2, 1.0, 0.0, 3.0)], "field_id long, truth_id long, x double, y double, f0 double")
assert blend_odds(cat, 2.0, 3.0, 1.0, 1.0).count() == 2
np.save("cat.npy", np.ones((2, 3)))
assert read_array_catalog(spark, "cat.npy", ["x", "y", "f0"]).count() == 2
"""


def test_functions_travel_with_their_tasks(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=root))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
