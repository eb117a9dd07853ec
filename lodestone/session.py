"""Session construction.

Only settings that the operators rely on are pinned here. Cluster sizing
(executors, memory, shuffle partitions, the shared checkpoint folder) belongs to
the deployment; every operator reads what it needs from the session it is given.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app_name: str = "lodestone", cpus: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cpus is not None or "SPARK_MASTER" not in os.environ:
        n = cpus or os.cpu_count() or 8
        builder = (
            builder.master(f"local[{n}]")
            .config("spark.sql.shuffle.partitions", str(n))
            .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
        )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
