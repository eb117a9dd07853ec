"""Starting streams and writing what they emit."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.staging import new_path


def file_stream(
    spark: SparkSession, folder: str, pattern: str, bytes_per_trigger: int = 256 * 1024 * 1024
) -> DataFrame:
    """Parquet files of a folder as a stream; a trigger reads about ``bytes_per_trigger``,
    but always one file at least."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxBytesPerTrigger", bytes_per_trigger)
        .parquet(folder)
    )


def drain(
    stream: DataFrame, label: str, mode: str = "append", then: Callable[[], None] | None = None
) -> DataFrame:
    """Process all available input and return the emitted rows with their batch.

    Every batch has its own folder and overwrites it when it is run again, so a
    restart from the checkpoint leaves each row once. ``then`` may add input after that;
    the query goes on from its checkpoint.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    for more in (None, then) if then else (None,):
        if more:
            more()
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(out)


def replay(
    rows: DataFrame, label: str, build: Callable[[DataFrame, str], DataFrame],
    bytes_per_trigger: int = 256 * 1024 * 1024,
) -> DataFrame:
    """A table with ``at`` (seconds) as a stream, in whatever order its files come.

    ``build`` gets the stream and a delay in which all of the table fits, so no row is late.
    When all files are read, a row without a key, later than all others by more than that,
    tells that time has passed, and what still waits is released.
    """
    spark, folder = rows.sparkSession, new_path(rows.sparkSession, label)
    rows.write.parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)
    first, last = written.agg(F.min("at"), F.max("at")).first()
    if first is None:
        return build(written, "1 second")
    span = math.ceil(last - first) + 2

    def time_passes() -> None:
        beat = spark.range(1).select(*[
            F.lit(float(last + 2 * span)).cast(f.dataType).alias(f.name) if f.name == "at"
            else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
        beat.write.mode("append").parquet(folder)

    stream = file_stream(spark, folder, "*.parquet", bytes_per_trigger)
    return drain(build(stream, f"{span} seconds"), label, then=time_passes)
