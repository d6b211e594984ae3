"""Result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "append"
) -> None:
    """Write or append a result table as Parquet or CSV. Rows are left where
    they are: a rearrangement by partition would put a hot run in one task."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(path)


def write_text_catalog(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """Headerless whitespace rows."""
    from pyspark.sql import functions as F

    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])).write.mode(mode).text(path)
