"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. Its times carry no zone and are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in frame.schema if isinstance(f.dataType, TimestampNTZType)]
    return frame.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), "text"
    )
