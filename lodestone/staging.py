"""Written intermediate tables.

An intermediate result that several later steps read is written as parquet in
the shared folder named by ``spark.checkpoint.dir``. That cuts lineage (a lost
executor re-reads a file instead of recomputing the corpus), and it gives
Catalyst the real size of the table, so ``spark.sql.autoBroadcastJoinThreshold``
decides on broadcasting from a measured size and not from a guess.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach; set here only for local sessions."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than the session has cores.

    A small file arrives as one split and would keep one core busy. A large
    scan already has many more splits than cores and is left alone, so no text
    is shuffled at scale.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * wanted:
        return df
    return df.repartition(wanted, *keys)
