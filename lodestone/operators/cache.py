"""Prompt cache in two tiers: equal prompts, then similar ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.dense import HashingEmbedder, exact_neighbours
from lodestone.staging import stage

TIERS = ("fast", "large")


def lookup(
    requests: DataFrame, entries: DataFrame, embedder: HashingEmbedder, threshold: float | None = None
) -> DataFrame:
    """``(request_id, hit, entry_id, similarity)`` with hit exact, semantic or miss.

    ``requests(request_id, prompt_hash, model_tier, key_text)``;
    ``entries(entry_id, prompt_hash, embedding_model, model_tier, key_text)``, unique
    on hash, model and tier. Entries of another embedding model are never compared.
    Requests that share a prompt are looked up once. Only ids are grouped; the texts of prompts
    without an equal entry are joined to them, so no task sorts the texts it scans.
    """
    threshold = embedder.similarity_threshold if threshold is None else threshold
    own = entries.filter(F.col("embedding_model") == embedder.model)
    prompts = requests.groupBy("prompt_hash", "model_tier").agg(F.min("request_id").alias("query_id"))
    texts = requests.select(
        "prompt_hash", "model_tier", F.col("request_id").alias("query_id"), F.col("key_text").alias("text")
    )
    exact = prompts.join(
        own.select("prompt_hash", "model_tier", "entry_id"), ["prompt_hash", "model_tier"], "left"
    )
    exact = stage(exact, "exact-lookups")
    found = None
    for tier in TIERS:
        open_prompts = exact.filter(F.col("entry_id").isNull() & (F.col("model_tier") == tier))
        candidates = own.filter(F.col("model_tier") == tier).select(
            "entry_id", F.col("key_text").alias("text")
        )
        # Written first: embedding and scanning in one stage would take two Python workers a core.
        vectors = stage(
            embedder.embed(candidates, "entry_id").select(F.col("entry_id").alias("id"), "vec"), "entry-vectors"
        )
        asked = open_prompts.select("prompt_hash", "model_tier", "query_id").join(
            texts, ["prompt_hash", "model_tier", "query_id"]
        )
        asked = embedder.embed(stage(asked.select("query_id", "text"), "open-prompts"), "query_id")
        near = exact_neighbours(vectors, asked.select("query_id", "vec"), 1, exact_scores=True)
        found = near if found is None else found.unionByName(near)
    # The threshold meets the score itself; only what is reported is rounded.
    similar = found.filter(F.col("score") >= threshold).select(
        "query_id", F.col("id").alias("near_id"), F.round("score", 6).alias("near_score")
    )
    answered = exact.join(similar, "query_id", "left").select(
        "prompt_hash", "model_tier",
        F.when(F.col("entry_id").isNotNull(), "exact")
        .when(F.col("near_id").isNotNull(), "semantic")
        .otherwise("miss")
        .alias("hit"),
        F.coalesce("entry_id", "near_id").alias("entry_id"),
        F.when(F.col("entry_id").isNotNull(), 1.0).otherwise(F.col("near_score")).alias("similarity"),
    )
    return requests.select("request_id", "prompt_hash", "model_tier").join(
        answered, ["prompt_hash", "model_tier"]
    ).select("request_id", "hit", "entry_id", "similarity")


def statistics(lookups: DataFrame, entries: DataFrame) -> DataFrame:
    """Lookups by outcome, hit rate (0 without lookups) and tokens not spent."""
    spared = entries.select("entry_id", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens"))
    joined = lookups.join(spared, "entry_id", "left")
    counted = joined.agg(
        F.count(F.lit(1)).alias("lookups"),
        F.count_if(F.col("hit") == "exact").alias("exact_hits"),
        F.count_if(F.col("hit") == "semantic").alias("semantic_hits"),
        F.count_if(F.col("hit") == "miss").alias("misses"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_avoided"),
    )
    rate = F.try_divide(F.col("exact_hits") + F.col("semantic_hits"), F.col("lookups"))
    return counted.withColumn("hit_rate", F.coalesce(rate, F.lit(0.0)))


def hit_counts(lookups: DataFrame) -> DataFrame:
    return lookups.filter("hit <> 'miss'").groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("hits")
    )


def store(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after storing new responses; a stored key takes the new response."""
    from lodestone.sources.sinks import upsert

    return upsert(entries, new, ["prompt_hash", "embedding_model", "model_tier"])
