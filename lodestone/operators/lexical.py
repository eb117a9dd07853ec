"""BM25 over a token index ``(doc_id, tokens, n_tokens)``.

The corpus is tokenized once into the index. Document frequencies of the query
words come from one aggregation over it. Scoring then runs where the documents
are: each task holds a bounded block of queries and keeps the best ``k`` per
query, so pairs of queries and documents never become rows, however many
documents share a word.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.text import tokenize
from lodestone.operators.ordered import top_k
from lodestone.operators.topk_blocks import Leaders, scan_with_blocks
from lodestone.staging import spread, stage

#: Words that at least COMMON_QUERIES queries of a block ask for, at most COMMON_WORDS of them,
#: are scored as a matrix product.
COMMON_WORDS, COMMON_QUERIES = 256, 16
#: Sums of rarer words made at once.
CELLS = 1 << 20


def token_index(docs: DataFrame) -> DataFrame:
    """``(doc_id, tokens, n_tokens)`` of a text frame, written once."""
    tokens = spread(docs.select("doc_id", "text")).select(
        "doc_id", tokenize(F.col("text")).alias("tokens")
    )
    return stage(tokens.withColumn("n_tokens", F.size("tokens")), "tokens")


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, qtf)``; a repeated query word counts each time."""
    tokens = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return tokens.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def inverse_frequency(n_docs: Column, df: Column) -> Column:
    return F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def document_frequency(index: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(term, df)``. A document counts once per term before anything is shuffled, so
    a term of every document arrives as one row per task."""
    terms = index.select(F.explode(F.array_distinct("tokens")).alias("term"))
    if vocabulary is not None:
        terms = terms.join(vocabulary.select("term").distinct(), "term", "left_semi")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_statistics(index: DataFrame) -> DataFrame:
    """``(term, df, idf)`` of the whole corpus."""
    n_docs = index.agg(F.count(F.lit(1)).alias("n")).scalar()
    return document_frequency(index).withColumn("idf", inverse_frequency(n_docs, F.col("df")))


def weighted_queries(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, float]:
    """``(query_id, terms, weights)`` with weights ``qtf * idf``, and the average
    document length. Documents without tokens count in both statistics."""
    size = index.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("length")
    ).first()
    terms = stage(query_terms(queries), "query-terms")
    frequency = document_frequency(index, terms)
    idf = inverse_frequency(F.lit(size["n"]), F.col("df"))
    # Words take many times their file in memory, and lists of them are guessed to be short, so
    # they are merged and never sent whole.
    weighted = terms.hint("merge").join(frequency, "term").groupBy("query_id").agg(
        F.collect_list("term").alias("terms"), F.collect_list(F.col("qtf") * idf).alias("weights")
    )
    kept = queries.select("query_id").join(weighted.hint("merge"), "query_id", "left")
    return (
        kept.select(
            "query_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"),
            F.coalesce("weights", F.array().cast("array<double>")).alias("weights"),
        ),
        float(size["length"]),
    )


class LexicalBlock:
    """Query words of a block, arranged to be met by the words of documents."""

    def __init__(self, block: pa.Table, avg_length: float) -> None:
        terms = block.column("terms").combine_chunks()
        counts = pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False)
        encoded = terms.flatten().dictionary_encode()
        self.vocabulary = encoded.dictionary
        at = encoded.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(block.num_rows), counts)
        weight = block.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.starts = np.searchsorted(at[order], np.arange(len(self.vocabulary) + 1))
        self.asking = np.diff(self.starts)
        self.n_queries = block.num_rows
        self.avg_length = avg_length
        # Words of many queries are a matrix; the place of each word in it, or -1.
        common = np.argsort(-self.asking, kind="stable")[:COMMON_WORDS]
        common = common[self.asking[common] >= COMMON_QUERIES]
        self.common_at = np.full(len(self.vocabulary), -1, dtype=np.int64)
        self.common_at[common] = np.arange(len(common))
        self.common = np.zeros((self.n_queries, len(common)))
        place = np.repeat(self.common_at, self.asking)
        held = place >= 0
        self.common[self.owner[held], place[held]] = self.weight[held]

    def scores(self, tokens: pa.ListArray) -> np.ndarray:
        """Raw scores, queries by documents."""
        lengths = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False)
        out = np.zeros((self.n_queries, len(tokens)))
        if len(self.vocabulary) == 0:
            return out
        term = pc.index_in(tokens.flatten(), value_set=self.vocabulary)
        term = term.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(tokens)), lengths)
        known = term >= 0
        pair, tf = np.unique(term[known] * len(tokens) + doc[known], return_counts=True)
        term, doc = np.divmod(pair, len(tokens))
        relative = lengths[doc] / self.avg_length if self.avg_length else np.ones(len(doc))
        weight = tf * (C.K1 + 1) / (tf + C.K1 * (1 - C.B + C.B * relative))
        place = self.common_at[term]
        shared = place >= 0
        if shared.any():
            held = np.zeros((self.common.shape[1], len(tokens)))
            held[place[shared], doc[shared]] = weight[shared]
            np.matmul(self.common, held, out=out)
        self._add_rare(out, term[~shared], doc[~shared], weight[~shared])
        return out

    def _add_rare(self, out: np.ndarray, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        """Adds the words of few queries: every (word, document) meets the queries that ask for
        the word, some CELLS sums at a time."""
        asking = self.asking[term]
        ends = np.cumsum(asking)
        first = 0
        while first < len(term):
            before = ends[first] - asking[first]
            last = max(first + 1, int(np.searchsorted(ends, before + CELLS, side="right")))
            n = asking[first:last]
            starts = self.starts[term[first:last]] - (ends[first:last] - n - before)
            at = np.arange(ends[last - 1] - before) + np.repeat(starts, n)
            cell = self.owner[at] * out.shape[1] + np.repeat(doc[first:last], n)
            sums = np.bincount(cell, self.weight[at] * np.repeat(weight[first:last], n), out.size)
            out += sums.reshape(out.shape)
            first = last


def bm25_top_k(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, doc_id, score)``. Scores are rounded before ranking so
    equal documents stay tied, and ties go to the smaller id."""
    weighted, avg_length = weighted_queries(index, queries)

    class Task:
        asked = leaders = None

        def load(self, block: pa.Table) -> None:
            self.query_ids = block.column("query_id").to_numpy()
            self.asked = LexicalBlock(block, avg_length)
            self.leaders = self.leaders or Leaders(len(self.query_ids), k)

        def add(self, part: pa.RecordBatch) -> None:
            scores = np.round(self.asked.scores(part.column("tokens")), 6)
            self.leaders.add(np.where(scores > 0, scores, -np.inf), part.column("doc_id").to_numpy())

        def rows(self) -> pa.RecordBatch:
            owner, ids, scores, _ = self.leaders.rows(self.query_ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(owner, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores)],
                names=["query_id", "doc_id", "score"],
            )

    found = scan_with_blocks(
        index.select("doc_id", "tokens"), weighted, Task,
        "query_id long, doc_id long, score double",
    )
    ranked = top_k(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    return ranked.select("query_id", "rank", "doc_id", "score")
