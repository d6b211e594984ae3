"""Run archives: one .npz of dense, zero-padded arrays per run."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from starloom import schema

# Names of the arrays in an archive.
SCALAR_ARRAYS = (
    "n", "chi2", "times", "accept", "diff2s", "rtypes", "accepts", "bkg", "template_amplitudes",
    "fourier_coeffs", "fc_rel_amps", "binned_cib_coeffs",
)
MAP_ARRAYS = ("residuals", "model_images")


def _files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    # One file is one row, and an archive is bounded by samples x slots.
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"), "content")


def _arrays(content: bytes) -> np.lib.npyio.NpzFile:
    return np.load(io.BytesIO(content), allow_pickle=False)


def _source_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for run, content in zip(pdf["run_id"], pdf["content"]):
            z = _arrays(content)
            n, x, y, f = z["n"], z["x"], z["y"], z["f"]
            f = f if f.ndim == 3 else f[None]
            for sample in range(len(n)):
                # Zero flux marks padding, so it never becomes a row.
                live = np.flatnonzero(f[0, sample, : n[sample]] > 0)
                if len(live) == 0:
                    continue
                yield pd.DataFrame(
                    {
                        "run_id": run, "sample_id": sample, "src": live,
                        "x": x[sample, live].astype(float), "y": y[sample, live].astype(float),
                        "flux": list(np.ascontiguousarray(f[:, sample, live].T, dtype=float)),
                    }
                )


def _sample_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for run, content in zip(pdf["run_id"], pdf["content"]):
            n = _arrays(content)["n"]
            yield pd.DataFrame({"run_id": run, "sample_id": np.arange(len(n)), "n": n.astype(np.int64)})


def _scalar_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for run, content in zip(pdf["run_id"], pdf["content"]):
            z = _arrays(content)
            for name in SCALAR_ARRAYS:
                if name not in z.files or z[name].ndim == 0:
                    continue
                values = z[name]
                for sample in range(len(values)):
                    flat = np.atleast_1d(values[sample])
                    at = np.stack(np.unravel_index(np.arange(flat.size), flat.shape), 1)
                    yield pd.DataFrame(
                        {"run_id": run, "sample_id": sample, "param": name, "idx": list(at), "value": flat.ravel().astype(float)}
                    )


def _map_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for run, content in zip(pdf["run_id"], pdf["content"]):
            z = _arrays(content)
            for name in z.files:
                kind = next((k for k in MAP_ARRAYS if name.startswith(k)), None)
                if kind is None or z[name].ndim != 3:
                    continue
                planes, total = z[name], len(z["n"]) if "n" in z.files else len(z[name])
                band = int(name[len(kind):] or 0)
                row, col = (a.ravel() for a in np.indices(planes.shape[1:]))
                # Only the last maps are kept, so they end at the last sample.
                first = total - len(planes)
                for k, plane in enumerate(planes):
                    yield pd.DataFrame(
                        {
                            "run_id": run, "sample_id": first + k, "kind": kind, "band": band,
                            "row_": row, "col_": col, "value": plane.ravel().astype(float),
                        }
                    )


def read_chain(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, DataFrame]:
    """Tables of run archives laid out as <run_id>/<file>.npz; see parse_chain."""
    return parse_chain(_files(spark, paths))


def parse_chain(files: DataFrame) -> dict[str, DataFrame]:
    """Tables `samples`, `sources`, `scalars` and `maps` of archives given as rows
    (run_id, content). `samples` has the number of sources of every sample, 0
    too. Rows leave a task one sample at a time. Each table in use reads the
    files, so they are meant to be written as Parquet once (see
    sinks.write_table), by run_id."""
    return {
        "samples": files.mapInPandas(_sample_rows, "run_id string, sample_id long, n long"),
        "sources": files.mapInPandas(_source_rows, schema.SOURCES),
        "scalars": files.mapInPandas(_scalar_rows, schema.SCALARS),
        "maps": files.mapInPandas(_map_rows, schema.MAPS),
    }


def as_ensemble(sources: DataFrame, bands: int, run: str = "run_id", field: str = "field_id") -> DataFrame:
    """Sources of archives as the rows that matching, condensing and ranking
    take: (field, sample_id, src, x, y, f0 .. f<bands - 1>). `run` names the
    column that tells catalogs apart; it becomes the field."""
    flux = [F.get("flux", k).alias(f"f{k}") for k in range(bands)]
    return sources.select(F.col(run).alias(field), "sample_id", "src", "x", "y", *flux)


def as_samples(samples: DataFrame, run: str = "run_id", field: str = "field_id") -> DataFrame:
    """The samples of archives as the operators' table of all samples."""
    return samples.select(F.col(run).alias(field), "sample_id")


def pack_chain(ens: DataFrame, bands: int, samples: int, field: str = "field_id") -> DataFrame:
    """Archives (run_id, content) of an ensemble with slots, one per field; sample
    numbers from 0 to samples - 1. An archive is made in one task, as it is one
    file; a field is bounded by samples x slots."""
    names = [f"f{k}" for k in range(bands)]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        slots = int(pdf["src"].max()) + 1
        n, x, y, f = np.zeros(samples, np.int64), np.zeros((samples, slots)), np.zeros((samples, slots)), np.zeros((bands, samples, slots))
        s, k = pdf["sample_id"].to_numpy(), pdf["src"].to_numpy()
        np.maximum.at(n, s, k + 1)
        x[s, k], y[s, k] = pdf["x"], pdf["y"]
        f[:, s, k] = pdf[names].to_numpy().T
        out = io.BytesIO()
        np.savez(out, n=n, x=x, y=y, f=f)
        return pd.DataFrame({"run_id": [str(pdf[field].iloc[0])], "content": [out.getvalue()]})

    return ens.select(field, "sample_id", "src", "x", "y", *names).groupBy(field).applyInPandas(pack, "run_id string, content binary")


def read_array_catalog(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Catalogs saved as 2-D .npy arrays, one row per source. Pickled objects
    are refused."""
    fields = ", ".join(["run_id string", *[f"{c} double" for c in columns]])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run, content in zip(pdf["run_id"], pdf["content"]):
                table = np.load(io.BytesIO(content), allow_pickle=False)[:, : len(columns)].astype(float)
                out = pd.DataFrame(table, columns=list(columns))
                out.insert(0, "run_id", run)
                yield out

    return _files(spark, paths).mapInPandas(rows, fields)
