"""Hashed embeddings, cosine and exact nearest neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.text import tokenize
from lodestone.operators.ordered import top_k
from lodestone.operators.topk_blocks import (
    NEIGHBOURS,
    Leaders,
    hand_back,
    matrix,
    scan_with_blocks,
    slices,
    small_batches,
)
from lodestone.staging import spread


def token_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many, which, digest): the features of distinct words, as ``embedding_features`` makes them.

    A word is a feature, and so are its padded character grams, or itself once more if it is
    no longer than a gram. All grams are cut and numbered at once; a distinct one is hashed once.
    """
    padded = [w if len(w) <= C.NGRAM else f"^{w}$" for w in words]
    sizes = np.fromiter(map(len, padded), dtype=np.int64, count=len(words))
    ends, text = np.cumsum(sizes), "".join(padded)
    letters, code = np.unique(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), return_inverse=True)
    code = np.append(code.astype(np.uint64) + np.uint64(1), np.zeros(C.NGRAM, dtype=np.uint64))
    grams = np.maximum(sizes - C.NGRAM + 1, 1)
    at = np.repeat(ends - sizes - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
    left = np.repeat(ends, grams) - at
    packed = np.zeros(len(at), dtype=np.uint64)
    for j in range(C.NGRAM):
        packed = packed * np.uint64(len(letters) + 1) + np.where(j < left, code[at + j], np.uint64(0))
    distinct, first, gram = np.unique(packed, return_index=True, return_inverse=True)
    cuts = zip(at[first].tolist(), (at[first] + np.minimum(left[first], C.NGRAM)).tolist(), strict=True)
    digest = [zlib.crc32(text[i:j].encode()) for i, j in cuts] + [zlib.crc32(w.encode()) for w in words]
    lengths = grams + 1
    own = np.cumsum(lengths) - lengths  # the place of the word itself
    which = np.empty(lengths.sum(), dtype=np.int64)
    rest = np.ones(len(which), dtype=bool)
    rest[own] = False
    which[rest] = gram
    short = sizes <= C.NGRAM  # such a word may be a gram of others
    which[own] = np.where(short, gram[np.cumsum(grams) - grams], len(distinct) + np.arange(len(words)))
    return lengths, which, np.array(digest, dtype=np.int64)


def sparse_vectors(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, weight) of the unit vectors of all token lists.

    A distinct token is cut and hashed once per batch; counts are sums over pairs of
    numbers, so a vector depends on its own row only and nothing is shuffled.
    """
    sizes = pa.compute.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False)
    encoded = tokens.flatten().dictionary_encode()
    words = encoded.dictionary.to_pylist()
    if not words:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing, np.zeros(0)
    pair, times = np.unique(
        np.repeat(np.arange(len(tokens)), sizes) * len(words)
        + encoded.indices.to_numpy(zero_copy_only=False), return_counts=True,
    )
    row, word = np.divmod(pair, len(words))
    lengths, which, digests = token_features(words)
    starts = np.cumsum(lengths) - lengths
    reach = lengths[word]
    at = np.repeat(starts[word] - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
    feature = which[at]
    key, back = np.unique(np.repeat(row, reach) * len(digests) + feature, return_inverse=True)
    count = np.bincount(back, weights=np.repeat(times, reach))
    row, feature = np.divmod(key, len(digests))
    digest = digests[feature]
    weight = np.where(digest >> 16 & 1, 1.0, -1.0) * (1.0 + np.log(count))
    cell, back = np.unique(row * C.DIM + digest % C.DIM, return_inverse=True)
    weight = np.bincount(back, weights=weight)
    row, index = np.divmod(cell, C.DIM)
    norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(tokens)))[row]
    return row, index, np.divide(weight, norm, out=np.zeros_like(weight), where=norm > 0)


def _map_tokens(docs: DataFrame, key: str, make, schema: str) -> DataFrame:
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield make(part)
        hand_back()

    small_batches(docs.sparkSession)
    tokens = spread(docs, key).select(key, tokenize(F.col("text")).alias("tokens"))
    return tokens.mapInArrow(run, f"{key} {key_type}, {schema}")


def hashed_weights(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sparse unit vectors ``(key, idx, w)`` of ``docs(key, text)``."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        row, index, weight = sparse_vectors(part.column("tokens"))
        return pa.RecordBatch.from_arrays(
            [part.column(key).take(pa.array(row)), pa.array(index.astype(np.int32)), pa.array(weight)],
            names=[key, "idx", "w"],
        )

    return _map_tokens(docs, key, make, "idx int, w double")


def hashed_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, tokens, vec)``; a text without tokens keeps the zero vector."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        row, index, weight = sparse_vectors(part.column("tokens"))
        dense = np.zeros((part.num_rows, C.DIM))
        dense[row, index] = weight
        offsets = np.arange(0, dense.size + 1, C.DIM, dtype=np.int32)
        vec = pa.ListArray.from_arrays(pa.array(offsets), pa.array(dense.ravel()))
        return pa.RecordBatch.from_arrays(
            [part.column(key), part.column("tokens"), vec], names=[key, "tokens", "vec"]
        )

    return _map_tokens(docs, key, make, "tokens array<string>, vec array<double>")


class HashingEmbedder:
    """Offline embedder: a text frame in, a vector frame out, under one model name."""

    model = C.HASHING_MODEL
    dim = C.DIM
    similarity_threshold = C.SIMILARITY_THRESHOLD

    def index(self, texts: DataFrame, key: str = "doc_id") -> DataFrame:
        """``(key, tokens, vec, model)``."""
        return hashed_index(texts, key).withColumn("model", F.lit(self.model))

    def embed(self, texts: DataFrame, key: str = "doc_id") -> DataFrame:
        """``(key, vec, model)``."""
        return self.index(texts, key).drop("tokens")


def dot(a: Column, b: Column) -> Column:
    """Cosine of unit vectors; unequal lengths are an error, not a number."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)
    same = F.size(a) == F.size(b)
    return F.when(same, total).otherwise(F.raise_error(F.lit("dimension mismatch")))


def exact_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False,
    exact_scores: bool = False,
) -> DataFrame:
    """``(query_id, rank, id, score)`` over all ``vectors(id, vec)``.

    Scores are rounded to six decimals before ranking unless ``exact_scores``; ties go to
    the smaller id.
    """

    class Task:
        asked = leaders = None

        def load(self, block: pa.Table) -> None:
            self.query_ids = block.column("query_id").to_numpy()
            self.asked = matrix(block.column("vec"))
            self.leaders = self.leaders or Leaders(len(self.query_ids), k)

        def add(self, part: pa.RecordBatch) -> None:
            ids = part.column("id").to_numpy()
            scores = self.asked @ matrix(part.column("vec")).T
            if not exact_scores:
                scores = np.round(scores, 6)
            if exclude_self:
                scores[self.query_ids[:, None] == ids[None, :]] = -np.inf
            self.leaders.add(scores, ids)

        def rows(self) -> pa.RecordBatch:
            return neighbour_rows(self.leaders, self.query_ids)

    found = scan_with_blocks(vectors.select("id", "vec"), queries, Task, NEIGHBOURS)
    ranked = top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], k)
    return ranked.select("query_id", "rank", "id", "score")


def neighbour_rows(leaders: Leaders, query_ids: np.ndarray) -> pa.RecordBatch:
    owner, ids, scores, _ = leaders.rows(query_ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(owner, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())],
        names=["query_id", "id", "score"],
    )


def recall_and_distance(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: share of the true neighbours found, and mean ratio of best distances."""
    pairs = truth.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"])
    n_true = truth.select("query_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    nearest_found = found.filter("rank = 1").select("query_id", F.col("score").alias("got"))
    nearest_true = truth.filter("rank = 1").select("query_id", F.col("score").alias("want"))
    ratios = nearest_found.join(nearest_true, "query_id").filter("1 - want > 0").agg(
        F.coalesce(F.avg((1 - F.col("got")) / (1 - F.col("want"))), F.lit(1.0)).alias("ratio")
    )
    return pairs.agg(F.count(F.lit(1)).alias("hits")).select(
        (F.col("hits") / (n_true.scalar() * k)).alias("recall"),
        ratios.scalar().alias("distance_ratio"),
    )


def clustered_vectors(
    owners: DataFrame, key: str, dim: int = C.DIM, clusters: int = 400, sigma: float = 0.12,
    seed: int = C.SEED,
) -> DataFrame:
    """A seeded unit vector around one of ``clusters`` centroids for every key.

    Each row is generated from its own key, so the result does not depend on how
    the rows are partitioned.
    """
    centres = np.random.default_rng(seed).normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            rows = []
            for k in keys:
                rng = np.random.default_rng([seed, int(k)])
                row = centres[rng.integers(clusters)] + rng.normal(scale=sigma, size=dim)
                rows.append(row / np.linalg.norm(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "vec"]
            )

    return owners.select(F.col(key).cast("long").alias("id")).mapInArrow(
        generate, "id long, vec array<double>"
    )
