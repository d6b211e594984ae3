"""Fourier transforms as Spark jobs: short lines are transformed in batches by
numpy, and Spark does the transposes between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def line_transform(
    df: DataFrame, keys: Sequence[str], along: str, length: int | str, fn: Callable[[np.ndarray, pd.DataFrame], np.ndarray]
) -> DataFrame:
    """Apply `fn` to every line of complex numbers (re, im) indexed by `along`.

    A line has at most `length` numbers, missing ones are zero; `length` may be
    one of the keys, and each line then has its own. Lines arrive as array rows,
    so one call of `fn` gets those of one length in a batch as a 2-D array.
    Returns keys, `along`, re, im.
    """
    lines = df.groupBy(*keys).agg(F.collect_list(F.struct(along, "re", "im")).alias("_line"))
    packed = lines.select(
        *keys, F.col(f"_line.{along}").alias("at"), F.col("_line.re").alias("re"), F.col("_line.im").alias("im")
    )
    fields = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            parts = whole.groupby(length, sort=False) if isinstance(length, str) else [(length, whole)]
            for size, pdf in parts:
                if len(pdf) == 0:
                    continue
                z = np.zeros((len(pdf), int(size)), dtype=complex)
                row = np.repeat(np.arange(len(pdf)), [len(a) for a in pdf["at"]])
                at, re, im = (np.concatenate(pdf[c].to_list()) for c in ("at", "re", "im"))
                z[row, at] = re + 1j * im
                out = fn(z, pdf[names])
                yield pdf[names].assign(re=list(out.real), im=list(out.imag))

    done = packed.mapInPandas(run, f"{fields}, re array<double>, im array<double>")
    both = done.withColumn("_z", F.arrays_zip("re", "im"))
    return both.select(*keys, F.posexplode("_z").alias("_at", "_z")).select(
        *keys, F.col("_at").cast("bigint").alias(along), F.col("_z.re").alias("re"), F.col("_z.im").alias("im")
    )


def split_length(n: int) -> tuple[int, int]:
    """Powers of two n1 >= n2 with n1 * n2 >= n."""
    bits = max(2, int(np.ceil(np.log2(max(n, 2)))))
    return 1 << ((bits + 1) // 2), 1 << (bits // 2)


def split_columns(n: Column) -> tuple[Column, Column]:
    """split_length of a column."""
    bits = F.greatest(F.lit(2), F.length(F.bin(F.greatest(n, F.lit(2)) - 1)))
    power = lambda k: F.pow(F.lit(2.0), F.floor(k)).cast("bigint")
    return power((bits + 1) / 2), power(bits / 2)


def long_fft(df: DataFrame, keys: Sequence[str], index: str, n1: int | str, n2: int | str) -> DataFrame:
    """DFT of length n1 * n2 of each series (keys, index, re, im). n1 and n2 may
    be two of the keys, so that each series has a length of its own.

    A long series is laid out as an n1 x n2 table. Columns are transformed,
    turned by their twiddle factors, and then rows are: each task holds lines
    of about the square root of the length, never a series.
    """
    wide, high = (F.col(n) if isinstance(n, str) else F.lit(n) for n in (n1, n2))

    def first(z, keyed):
        spun, rows = np.fft.fft(z, axis=1), keyed[n2].to_numpy() if isinstance(n2, str) else np.full(len(z), n2)
        turn = np.outer(keyed["_b"].to_numpy(), np.arange(z.shape[1]))
        return spun * np.exp(-2j * np.pi * turn / (z.shape[1] * rows[:, None]))

    table = df.select(
        *keys, (F.col(index) % high).alias("_b"), F.floor(F.col(index) / high.cast("double")).alias("_a"), "re", "im"
    )
    columns = line_transform(table, [*keys, "_b"], "_a", n1, first)
    rows = line_transform(columns, [*keys, "_a"], "_b", n2, lambda z, _: np.fft.fft(z, axis=1))
    return rows.select(*keys, (F.col("_a") + F.col("_b") * wide).alias(index), "re", "im")


def fft2(df: DataFrame, keys: Sequence[str], row: str, col: str, height: int, width: int) -> DataFrame:
    """2-D DFT of each map: along the rows, then along the columns."""
    along_rows = line_transform(df, [*keys, row], col, width, lambda z, _: np.fft.fft(z, axis=1))
    return line_transform(along_rows, [*keys, col], row, height, lambda z, _: np.fft.fft(z, axis=1))
