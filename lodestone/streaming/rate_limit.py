"""Sliding-window limits per client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C


def sliding_counts(
    requests: DataFrame, client: str, at_us: str, window_seconds: int = 3600,
    limit: int = C.CLIENT_LIMIT_PER_HOUR,
) -> DataFrame:
    """Requests of the client within the window before and at each request.

    A request is counted in the window-long bucket it falls in and helps in the next
    one, so the range window runs per client and bucket. A client with a third of
    all requests is as many groups as there are buckets. Requests of one client in
    the same microsecond count each other.
    """
    width = window_seconds * 1_000_000
    bucket = F.floor(F.col(at_us) / width)
    placed = requests.withColumn(
        "_b",
        F.explode(F.array(
            F.struct(bucket.alias("bucket"), F.lit(True).alias("own")),
            F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own")),
        )),
    ).select(*requests.columns, "_b.bucket", "_b.own")
    recent = (
        Window.partitionBy(client, "bucket").orderBy(at_us).rangeBetween(-(width - 1), Window.currentRow)
    )
    counted = placed.withColumn("in_window", F.count(F.lit(1)).over(recent)).filter("own")
    return counted.drop("bucket", "own").withColumn("allowed", F.col("in_window") <= limit)


def windowed_counts(
    stream: DataFrame, client: Column, at: str, window: str = "1 hour", slide: str = "10 minutes",
    late: str | None = "30 minutes",
) -> DataFrame:
    """Streaming form: counts per client and sliding window.

    A live stream drops rows more than ``late`` behind. The files of an archive come in any
    order, so for one ``late`` is None: no row is dropped and the windows stay in the state.
    """
    rows = stream if late is None else stream.withWatermark(at, late)
    return (
        rows.groupBy(F.window(at, window, slide).alias("w"), client.alias("client"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("client", F.col("w.start").alias("window_start"), "n")
    )


def latest_counts(emitted: DataFrame) -> DataFrame:
    """Last state of every window out of the updates a stream emitted."""
    return emitted.groupBy("client", "window_start").agg(F.max_by("n", "batch_id").alias("n"))
