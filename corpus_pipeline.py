"""A training-corpus pipeline: five text operators, each over all that the one before kept.

Stages tell rows apart by a row number, so rows that share an id, or have none, are judged
one by one. Extra columns, whatever their names, pass through. Null and empty texts are
scored like others, equal ones are one text, and they have no near copies by words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact, pieces, quality, simhash
from lodestone.llm.common import boxed, unboxed
from lodestone.llm.components import components
from lodestone.llm.near_copies import similar_pairs
from lodestone.staging import stage

KEEP_FROM = 0.7  # documents with a lower quality go
MODEL = "piece_bpe_32k.model"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least KEEP_FROM, from a network fitted on ``labels``."""
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.with_score(boxed(docs), network)
    return unboxed(scored.where(F.col("score") >= KEEP_FROM), docs.columns)


def keep_one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact.exact_dedup(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id (null last).

    Linked are fingerprints within two bits, and texts whose five-word shingles have a
    similarity of 0.8 or more.
    """
    rows = stage(boxed(docs), "numbered")
    prints = simhash.near_duplicates(rows, "rid").where("doc_id <> component_id").select(
        F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    roots = stage(components(prints.union(similar_pairs(rows))), "near-copies")
    ids = rows.select("rid", F.col("row").getField("doc_id").cast("long").alias("id"))
    best = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "rid")).alias("best")
    linked = ids.join(roots, F.col("rid") == F.col("node"))
    stay = linked.groupBy("root").agg(best).select("best.rid")
    go = linked.select("rid").join(stay, "rid", "left_anti")
    return unboxed(rows.join(go, "rid", "left_anti"), docs.columns)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither as it is nor with other values."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = stage(boxed(docs), "numbered")
    found = decontaminate.contaminated(rows, items, "rid").select(F.col("doc_id").alias("rid")).distinct()
    return unboxed(rows.join(found, "rid", "left_anti"), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return pieces.encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality", keep_good),
    ("exact-dedup", keep_one_of_equals),
    ("near-dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_texts),
    ("encoding", encode),
]

#: The network, the fingerprints and the encoding have no SQL form; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name)
    return docs
