"""Watching chains as their samples land. Both functions take a stream or a
batch DataFrame; on a batch the watermark has no effect."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from starloom.operators.chains import chain_state
from starloom.session import shared_folder


def monitor(
    samples: DataFrame, moves: Sequence[str], window: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Per run and window of arrival time: acceptance over all moves and per
    move type, out-of-bounds rate, mean chi-squared, latest source count and
    total time.

    `samples` has run_id, ts, move, accepted, out_of_bounds, chi2, nsrc, ms.
    Rows later than `delay` are dropped by the watermark; state is one built-in
    aggregate per open window.
    """
    per_move = [
        F.avg(F.when(F.col("move") == m, F.col("accepted"))).alias(f"acceptance_{m}") for m in moves
    ]
    return (
        samples.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy("run_id", F.window("ts", window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("steps"), F.avg("accepted").alias("acceptance"), *per_move,
            F.avg("out_of_bounds").alias("out_of_bounds"), F.avg("chi2").alias("chi2"),
            F.max(F.struct("ts", "nsrc")).alias("_last"), F.sum("ms").alias("total_ms"),
        )
        .select(
            "run_id", F.col("w.start").alias("window_start"), "steps", "acceptance",
            *[f"acceptance_{m}" for m in moves], "out_of_bounds", "chi2", F.col("_last.nsrc").alias("nsrc"), "total_ms",
        )
    )


def watch_samples(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 64) -> DataFrame:
    """Stream of samples appended to a Parquet folder; all new files at once if no number is given."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def start_monitor(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append each closed window to a Parquet folder; the checkpoint folder
    makes the sink exactly-once over restarts. With `available_now` the query
    ends when it has read what is there."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer).option("checkpointLocation", checkpoint).start()


def arrivals(samples: DataFrame, folder: str, parts: int) -> Iterator[int]:
    """Append samples to a Parquet folder in `parts` steps of equal time, as a run would write them."""
    ts = F.col("ts").cast("timestamp")
    # As numbers: a driver in another time zone must not shift them.
    low, high = samples.agg(F.unix_micros(F.min(ts)), F.unix_micros(F.max(ts))).first()
    for k in range(parts):
        at = F.unix_micros(ts)
        part = samples
        if low is not None:
            begin, end = (low + (high - low) * n // parts for n in (k, k + 1))
            part = samples.where((at >= begin) & ((at < end) | F.lit(k + 1 == parts)))
        part.write.mode("append").parquet(folder)
        yield k


def replayed(
    samples: DataFrame, start: Callable[[DataFrame, str, str], StreamingQuery], parts: int = 3, closing: DataFrame | None = None
) -> str:
    """Run a streaming query over samples that arrive in steps, and last over `closing`; it
    stops after each step and goes on from its checkpoint.

    Returns the folder it was told to write to. All folders lie in the shared one.
    """
    spark = samples.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def steps() -> Iterator[int]:
        yield from arrivals(samples, f"{folder}/in", parts)
        if closing is not None:
            closing.write.mode("append").parquet(f"{folder}/in")
            yield parts

    for _ in steps():
        query = start(watch_samples(spark, f"{folder}/in", samples.schema, None), f"{folder}/out", f"{folder}/checkpoint")
        query.awaitTermination()
    return f"{folder}/out"


def monitored(samples: DataFrame, moves: Sequence[str], window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """The monitor's windows from a stream of the given samples, read back from its sink.

    A last sample long after all others moves the watermark past their windows;
    its own window never closes.
    """
    end = F.max("ts") + F.expr("INTERVAL 1000 DAYS")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else end.cast(f.dataType).alias("ts") for f in samples.schema.fields]
    last = samples.agg(*nulls).where("ts is not null")
    start = lambda stream, path, checkpoint: start_monitor(monitor(stream, moves, window, delay), path, checkpoint, available_now=True)
    out = replayed(samples, start, closing=last)
    return samples.sparkSession.read.schema(monitor(samples, moves, window, delay).schema).parquet(out)


def running_states(stream: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """running_state of a stream of the given rows (with a time `ts`), as it stands at the end.

    The state has a row per chain, which a table in memory holds; its checkpoint
    carries it over the restarts.
    """
    spark, name = stream.sparkSession, f"state_{uuid.uuid4().hex}"

    def start(rows: DataFrame, _: str, checkpoint: str) -> StreamingQuery:
        writer = running_state(rows.select(*values), by).writeStream.outputMode("complete").format("memory").queryName(name)
        return writer.trigger(availableNow=True).option("checkpointLocation", checkpoint).start()

    replayed(stream, start)
    return spark.table(name)


def running_state(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean and variance per chain, for update mode: R-hat can be read
    from its latest rows at any time."""
    return chain_state(stream, by)
