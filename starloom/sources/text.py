"""Text formats: catalogs, photometry, curves, headers, run parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# 0-based columns of the wide photometry rows.
PHOTOMETRY_XY = (20, 21)
PHOTOMETRY_BANDS = {"r": 22, "i": 29, "g": 15, "z": 36}
# Columns of the two catalog layouts.
TRUTH_COLUMNS = {"x": 0, "y": 1, "f0": 2, "f1": 3, "f2": 4}
CONDENSED_COLUMNS = {"x": 0, "y": 2, "f0": 4}


def _words(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def _field(words: Column, index: int) -> Column:
    # A short row has no such column: NULL, not an error.
    return F.try_element_at(words, F.lit(index + 1)).cast("double")


def parse_catalog(lines: DataFrame, columns: Mapping[str, int], value: str = "value") -> DataFrame:
    """Named columns of whitespace rows, by position; blank rows are skipped."""
    keep = [c for c in lines.columns if c != value]
    words = lines.where(F.length(F.trim(F.col(value))) > 0).select(*keep, _words(F.col(value)).alias("_w"))
    return words.select(*keep, *[_field(F.col("_w"), k).alias(name) for name, k in columns.items()])


def read_text_catalog(spark: SparkSession, path: str, columns: Mapping[str, int] = TRUTH_COLUMNS) -> DataFrame:
    """Headerless whitespace catalog."""
    return parse_catalog(spark.read.text(path), columns)


def parse_photometry(
    lines: DataFrame, units: Mapping[str, float], box: Sequence[float], bands: Mapping[str, int] = PHOTOMETRY_BANDS,
    value: str = "value",
) -> DataFrame:
    """Sources in the box, 0-based from its corner, each band's magnitude (its
    own column) as counts through the band's unit."""
    x0, x1, y0, y1 = map(float, box)
    names = {"_x": PHOTOMETRY_XY[0], "_y": PHOTOMETRY_XY[1], **{f"_{b}": k for b, k in bands.items() if b in units}}
    rows = parse_catalog(lines, names, value)
    inside = rows.where((F.col("_x") > x0) & (F.col("_x") < x1) & (F.col("_y") > y0) & (F.col("_y") < y1))
    counts = [
        (F.pow(F.lit(10.0), (F.lit(22.5) - F.col(f"_{b}")) / 2.5) / F.lit(float(units[b]))).alias(f"counts_{b}")
        for b in bands if b in units
    ]
    keep = [c for c in lines.columns if c != value]
    return inside.select(*keep, (F.col("_x") - x0 - 1.0).alias("x"), (F.col("_y") - y0 - 1.0).alias("y"), *counts)


def read_photometry(spark: SparkSession, path: str, units: Mapping[str, float], box: Sequence[float]) -> DataFrame:
    return parse_photometry(spark.read.text(path), units, box)


def read_curve(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Headerless two-column reference curve."""
    curve = spark.read.schema("x double, y double").csv(path, header=False)
    return curve.withColumn("name", F.lit(name) if name else F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def parse_pix_header(texts: DataFrame, value: str = "value") -> DataFrame:
    """`w h nb / bias gain / unit [background]`; the last line may be missing."""
    keep = [c for c in texts.columns if c != value]
    line = F.split(F.trim(F.col(value)), r"\r?\n")
    words = texts.select(*keep, F.transform(line, _words).alias("_l"))

    def at(row, k, kind="double"):
        return F.try_element_at(F.try_element_at(F.col("_l"), F.lit(row)), F.lit(k)).cast(kind)

    return words.select(
        *keep, at(1, 1, "int").alias("w"), at(1, 2, "int").alias("h"), at(1, 3, "int").alias("nb"),
        at(2, 1).alias("bias"), at(2, 2).alias("gain"), at(3, 1).alias("k"), at(3, 2).alias("background"),
    )


def read_pix_header(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per header file."""
    return parse_pix_header(
        spark.read.text(paths, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    )


def parse_params(lines: DataFrame, value: str = "value") -> DataFrame:
    """(run_id, params map) from `key: value` lines tagged with their run_id; a
    run has a few hundred of them at most. The start time is in the run id."""
    pair = F.split(F.col(value), ": ", 2)
    entries = lines.where(F.col(value).contains(": ")).select(
        "run_id", F.struct(F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value")).alias("_e")
    )
    return (
        entries.groupBy("run_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list("_e"))).alias("params"))
        .withColumn("started", F.try_to_timestamp("run_id", F.lit("yyyyMMdd-HHmmss")))
    )


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run registry of <root>/<run_id>/params_read.txt. Pickles are not read."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "params_read.txt").text(root)
    return parse_params(lines.withColumn("run_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)))
