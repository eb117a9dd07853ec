"""Second-stage scoring of retrieved pairs."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.text import tokenize
from lodestone.operators.ordered import top_k
from lodestone.staging import stage


class Scorer(Protocol):
    """Gives one number per (question, passage) pair."""

    def score(self, question: Column, passage: Column) -> Column: ...


class OverlapScorer:
    """Stand-in for a trained cross-encoder, whose weights are not available.

    The share of the passage's and question's distinct tokens that both have.
    """

    def score(self, question: Column, passage: Column) -> Column:
        a, b = F.array_distinct(tokenize(question)), F.array_distinct(tokenize(passage))
        shared = F.size(F.array_intersect(a, b))
        either = F.size(a) + F.size(b) - shared
        return F.when(either > 0, shared / either).otherwise(0.0)


def rerank(
    hits: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Scorer, k: int | None = None
) -> DataFrame:
    """Hits of each query in order of the second score; ties keep the first order."""
    hits = stage(hits.select("query_id", "doc_id", F.col("rank").alias("first_rank")), "hits")
    asked = stage(
        hits.join(queries.select("query_id", F.col("text").alias("question")), "query_id"), "pairs"
    )
    scored = asked.join(docs.select("doc_id", "text"), "doc_id").withColumn(
        "score", F.round(scorer.score(F.col("question"), F.col("text")), 6)
    )
    checked = scored.withColumn(
        "score",
        F.when(F.isnan("score") | F.col("score").isNull(), F.raise_error(F.lit("score is not a number")))
        .otherwise(F.col("score")),
    )
    scored = checked.select("query_id", "doc_id", "first_rank", "score")
    order = [F.desc("score"), F.asc("first_rank")]
    if k is None:
        ranked = scored.withColumn(
            "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        )
    else:
        ranked = top_k(scored, ["query_id"], order, k)
    return ranked.select("query_id", "rank", "doc_id", "first_rank", "score")


def hard_negatives(
    hits: DataFrame, gold: DataFrame, seed: int = C.SEED
) -> DataFrame:
    """Training pairs: the best ranked gold hits and a seeded choice of other hits.

    ``hits(query_id, rank, doc_id)`` are the first candidates of every question,
    ``gold(query_id, gold_id)`` the document that answers it.
    """
    judged = hits.join(gold, "query_id").withColumn("is_gold", F.col("doc_id") == F.col("gold_id"))
    positive = top_k(
        judged.filter("is_gold").withColumnRenamed("rank", "first_rank"),
        ["query_id"], [F.asc("first_rank"), F.asc("doc_id")], C.POSITIVES_PER_QUESTION,
    ).select("query_id", "doc_id", F.lit(1.0).alias("label"))
    missing = gold.join(positive, "query_id", "left_anti").select(
        "query_id", F.col("gold_id").alias("doc_id"), F.lit(1.0).alias("label")
    )
    shuffled = judged.filter(~F.col("is_gold")).drop("rank").withColumn(
        "order", F.md5(F.concat_ws("|", F.lit(seed), F.col("query_id"), F.col("doc_id")).cast("binary"))
    )
    negative = top_k(
        shuffled, ["query_id"], [F.asc("order")], C.NEGATIVES_PER_QUESTION
    ).select("query_id", "doc_id", F.lit(0.0).alias("label"))
    return positive.unionByName(missing).unionByName(negative)
