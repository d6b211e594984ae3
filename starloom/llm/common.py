"""What the operators of this subpackage share: reading, worker state, text batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE = 256  # rows turned into Python objects at a time


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def per_process(owner: str, key: object, make: Callable[[], object]) -> object:
    """make()'s result, kept in the Python worker until another owner keeps something there.

    Functions travel to workers by value, so their modules' globals last for one
    task only; tokenizers and caches should last for all tasks of an operator, but
    not beyond: workers go on to the next operator with their memory.
    """
    place = sys.modules.setdefault("_starloom_llm_worker", types.ModuleType("_starloom_llm_worker")).__dict__
    if place.get("owner") != owner:
        place["owner"], place["kept"] = owner, {}
    kept = place["kept"]
    if key not in kept:
        kept[key] = make()
    return kept[key]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Columns of a few hundred rows at a time, as Python lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield {name: part.column(k).to_pylist() for k, name in enumerate(part.schema.names)}


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, object]], schema: str) -> DataFrame:
    """mapInArrow over slices: fn takes lists by column name and returns columns in schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = fn(part)
            columns = [pa.array(out[f.name], type=f.type) for f in arrow]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)
