"""Lexical and dense scores, fused per query."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.operators.dense import HashingEmbedder
from lodestone.operators.lexical import LexicalBlock, weighted_queries
from lodestone.operators.ordered import top_k
from lodestone.operators.topk_blocks import Leaders, matrix, scan_with_blocks
from lodestone.staging import new_path, stage

HITS = "query_id long, doc_id long, score double, lexical_score double, dense_score double"


def build_index(docs: DataFrame, embedder: HashingEmbedder) -> DataFrame:
    """``(doc_id, tokens, vec, n_tokens, model)``: one written row per document and model.

    Tokens and vector lie side by side, so a search reads them in one scan and joins
    nothing. The model is the partition folder: a search under one model reads only
    its files. There is one model per build, so the rows go straight to its folder.
    """
    path = new_path(docs.sparkSession, "index")
    rows = embedder.index(docs).drop("model").withColumn("n_tokens", F.size("tokens"))
    rows.write.parquet(f"{path}/model={embedder.model}")
    return docs.sparkSession.read.schema(rows.schema.add("model", "string")).parquet(path)


class _Block:
    """One block of queries: their words, and their vectors unless degraded."""

    def __init__(self, block: pa.Table, avg_length: float, dense: bool) -> None:
        self.query_ids = block.column("query_id").to_numpy()
        self.lexical = LexicalBlock(block, avg_length)
        self.vectors = matrix(block.column("vec")) if dense else None

    def scores(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        raw = self.lexical.scores(part.column("tokens"))
        if self.vectors is None:
            return raw, np.zeros_like(raw)
        return raw, self.vectors @ matrix(part.column("vec")).T


def _peaks(index: DataFrame, asked: DataFrame, avg_length: float, dense: bool) -> DataFrame:
    """Highest raw score of every query on either side; one row per task and query."""

    class Task:
        asked = top = None

        def load(self, rows: pa.Table) -> None:
            self.asked = _Block(rows, avg_length, dense)
            self.query_ids = self.asked.query_ids
            if self.top is None:
                self.top = np.zeros((2, len(self.query_ids)))

        def add(self, part: pa.RecordBatch) -> None:
            for side, scores in enumerate(self.asked.scores(part)):
                self.top[side] = np.maximum(self.top[side], scores.max(axis=1))

        def rows(self) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(self.query_ids), pa.array(self.top[0]), pa.array(self.top[1])],
                names=["query_id", "lexical_peak", "dense_peak"],
            )

    per_task = scan_with_blocks(
        index, asked, Task, "query_id long, lexical_peak double, dense_peak double"
    )
    return per_task.groupBy("query_id").agg(
        F.max("lexical_peak").alias("lexical_peak"), F.max("dense_peak").alias("dense_peak")
    )


def max_normalised(scores: np.ndarray, peak: np.ndarray) -> np.ndarray:
    """Scores divided by the best of their query; a best of zero or less gives 0."""
    wide = np.broadcast_to(peak[:, None], scores.shape)
    return np.divide(scores, wide, out=np.zeros_like(scores), where=wide > 0)


def fused_top_k(
    index: DataFrame, asked: DataFrame, avg_length: float, k: int, dense: bool
) -> DataFrame:
    """``(query_id, rank, doc_id, score, lexical_score, dense_score)``.

    Two scans of the index: the first finds what each query is normalised by, the
    second fuses both sides for every document and keeps the best ``k`` per query and
    task. Only positive cosines take part. Without a dense side the weight of the
    lexical one is 1.
    """
    peaks = _peaks(index, asked, avg_length, dense)
    weights = (C.LEXICAL_WEIGHT, C.DENSE_WEIGHT) if dense else (1.0, 0.0)

    class Task:
        asked = leaders = None

        def load(self, rows: pa.Table) -> None:
            self.asked = _Block(rows, avg_length, dense)
            self.query_ids = self.asked.query_ids
            self.tops = [rows.column(c).to_numpy() for c in ("lexical_peak", "dense_peak")]
            self.leaders = self.leaders or Leaders(len(self.query_ids), k, carried=2)

        def add(self, part: pa.RecordBatch) -> None:
            raw, cosine = self.asked.scores(part)
            fused = weights[0] * max_normalised(raw, self.tops[0])
            if dense:
                fused += weights[1] * max_normalised(np.maximum(cosine, 0.0), self.tops[1])
            fused = np.round(fused, 6, out=fused)
            fused[fused <= 0] = -np.inf
            self.leaders.add(fused, part.column("doc_id").to_numpy(), (raw, cosine))

        def rows(self) -> pa.RecordBatch:
            owner, ids, scores, extra = self.leaders.rows(self.query_ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(owner, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores),
                    *[pa.array(np.round(side, 6)) for side in extra],
                ],
                names=["query_id", "doc_id", "score", "lexical_score", "dense_score"],
            )

    found = scan_with_blocks(index, asked.join(peaks, "query_id"), Task, HITS)
    ranked = top_k(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    return ranked.select("query_id", "rank", "doc_id", "score", "lexical_score", "dense_score")


def search(
    index: DataFrame, queries: DataFrame, embedder: HashingEmbedder | None = None,
    k: int = C.HIT_LIMIT,
) -> DataFrame:
    """Hybrid retrieval for a query frame ``(query_id, text)``.

    ``index`` may hold several models; only rows of the embedder's own model are read.
    Without an embedder, or without a row under its model, the result is lexical only
    and says so.
    """
    own = None
    if embedder is not None and "vec" in index.columns:
        own = index.filter(F.col("model") == embedder.model)
        if own.isEmpty():
            own = None
    if own is not None:
        asked, avg_length = weighted_queries(own, queries)
        # A vector is taken for one number where sizes are guessed, so neither side may be sent whole.
        vectors = embedder.embed(queries, "query_id").select("query_id", "vec")
        asked = asked.join(vectors.hint("merge"), "query_id")
        hits = fused_top_k(own.select("doc_id", "tokens", "vec"), stage(asked, "asked"), avg_length, k, True)
        return hits.withColumn("degraded", F.lit(False))
    words = index
    if "model" in index.columns:  # each model repeats the tokens; one of them is enough
        any_model = index.agg(F.min("model").alias("m")).first()["m"]
        words = index.filter(F.col("model") == F.lit(any_model))
    asked, avg_length = weighted_queries(words, queries)
    hits = fused_top_k(words.select("doc_id", "tokens"), stage(asked, "asked"), avg_length, k, False)
    return hits.withColumn("degraded", F.lit(True))
