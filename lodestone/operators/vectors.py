"""Stored vectors by model. Models coexist and are never compared with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by_model(vectors: DataFrame) -> DataFrame:
    """(model, n) of ``vectors(id, model, vec)``."""
    return vectors.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def dimensions(vectors: DataFrame) -> DataFrame:
    """The distinct (model, dim); a sound store has one for each model."""
    return vectors.select("model", F.size("vec").alias("dim")).distinct()


def without_vector(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """``chunks(id)`` that have no vector of ``model``, whatever other models have."""
    return chunks.join(vectors.filter(F.col("model") == model).select("id"), "id", "left_anti")
