"""Sums of outer products: per-batch matrix products, added up by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


HELD = 1 << 25  # bytes of sums a task holds before it sends them on


def outer_sums(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str],
    design: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]],
) -> DataFrame:
    """sum over rows of w * v v^T per group, as rows (keys, p, q >= p, s).

    `design` turns a batch into vectors v and weights w. A task adds up its
    own batches first and sends one matrix per group it saw, so for few large
    groups the shuffle does not grow with the rows, and a hot group is shared by
    all the tasks that read it. Many small groups should come clustered by key.
    It sends what it has, once that reaches 32 MB, and starts anew.
    """
    names = list(keys)
    fields = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        held = 0
        for pdf in batches:
            if pdf.empty:
                continue
            v, w = design(pdf)
            for key, at in pdf.groupby(names, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                part = (v[at] * w[at, None]).T @ v[at]
                known = key in sums
                sums[key] = sums[key] + part if known else part
                held += 0 if known else part.nbytes
            if held >= HELD:
                yield from _long(sums, names)
                sums, held = {}, 0
        if sums:
            yield from _long(sums, names)

    partial = df.select(*names, *columns).mapInPandas(run, f"{fields}, p bigint, q bigint, s double")
    return partial.groupBy(*names, "p", "q").agg(F.sum("s").alias("s"))


def _long(sums: dict[tuple, np.ndarray], names: list[str]) -> Iterator[pd.DataFrame]:
    """One frame per few megabytes of sums."""
    frames, size = [], 0
    for key, m in sums.items():
        p, q = np.triu_indices(len(m))
        frame = pd.DataFrame({"p": p, "q": q, "s": m[p, q]})
        for name, part in zip(names, key):
            frame[name] = part
        frames.append(frame)
        size += m.nbytes
        if size >= HELD // 8:
            yield pd.concat(frames)[[*names, "p", "q", "s"]]
            frames, size = [], 0
    if frames:
        yield pd.concat(frames)[[*names, "p", "q", "s"]]
