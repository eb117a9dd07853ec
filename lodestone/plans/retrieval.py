"""Dense, hybrid, gate and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.operators import dense, evidence, hybrid, lexical, rerank
from lodestone.operators.two_level import TwoLevelLists
from lodestone.plans import sql
from lodestone.plans.tables import benchmark_queries, corpus, table
from lodestone.staging import stage


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )


def _vector_queries(spark, folder):
    asked = benchmark_queries(spark, folder).select("query_id")
    return asked.join(_vectors(spark, folder), F.col("query_id") == F.col("id")).select(
        "query_id", "vec"
    )


def cosine_topk(spark, folder):
    return dense.exact_neighbours(
        _vectors(spark, folder), _vector_queries(spark, folder), 10
    ).withColumnRenamed("id", "vec_id")


def neighbour_label_metrics(spark, folder):
    """hit@1, hit@3 and mean reciprocal rank, a neighbour of the same label being gold."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    found = dense.exact_neighbours(
        _vectors(spark, folder), _vector_queries(spark, folder), 10, exclude_self=True
    )
    judged = (
        found.join(labels.withColumnRenamed("vec_id", "id"), "id")
        .join(
            labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")),
            "query_id",
        )
        .withColumn("is_gold", F.col("label") == F.col("wanted"))
    )
    from lodestone.operators.curves import rank_metrics

    return rank_metrics(judged)


#: The synthetic vectors are few, so the lists are short and a fifth of them is visited.
ROWS_PER_LIST, OPENED, PROBES = 10, 4, 10


def _listed_neighbours(spark, folder):
    lists = TwoLevelLists(_vectors(spark, folder), ROWS_PER_LIST, fitted=False)
    return lists.search(_vector_queries(spark, folder), 10, PROBES, OPENED)


def two_level_neighbours(spark, folder):
    """Neighbours from the nearest lists, around centres that come first by digest."""
    return _listed_neighbours(spark, folder).withColumnRenamed("id", "vec_id")


def inverted_list_recall(spark, folder):
    truth = stage(dense.exact_neighbours(_vectors(spark, folder), _vector_queries(spark, folder), 10), "truth")
    found = stage(_listed_neighbours(spark, folder), "found")
    row = dense.recall_and_distance(found, truth, 10)
    return row.select(F.round("recall", 6).alias("recall"), F.round("distance_ratio", 5).alias("distance_ratio"))


def hash_embedding(spark, folder):
    weights = dense.hashed_weights(corpus(spark, folder))
    return weights.select("doc_id", "idx", (F.round("w", 6) + 0.0).alias("w"))


def _hits(spark, folder, k=C.HIT_LIMIT):
    embedder = dense.HashingEmbedder()
    index = hybrid.build_index(corpus(spark, folder), embedder)
    return hybrid.search(index, benchmark_queries(spark, folder), embedder, k)


def hybrid_search(spark, folder):
    return _hits(spark, folder)


def hybrid_degraded(spark, folder):
    """The store holds vectors of another model only, which is a miss."""
    other = lexical.token_index(corpus(spark, folder)).withColumns(
        {"vec": F.array(F.lit(1.0)), "model": F.lit("other-model")}
    )
    return hybrid.search(other, benchmark_queries(spark, folder), dense.HashingEmbedder())


def evidence_verdict(spark, folder):
    rows = evidence.assess(
        benchmark_queries(spark, folder), _hits(spark, folder), corpus(spark, folder)
    )
    return _rounded(rows)


def evidence_verdict_degraded(spark, folder):
    rows = evidence.assess(
        benchmark_queries(spark, folder), hybrid_degraded(spark, folder), corpus(spark, folder)
    )
    return _rounded(rows)


#: Digits kept of computed columns. Scores come in with six; means of two or three
#: of them need one more, or half a unit would be left to the rounding rule.
DIGITS = {
    "combined_score": 5, "combined": 5, "term_coverage": 5, "score_entropy": 5,
    "mean_dense_top3": 7, "mean_lexical_top3": 7, "lexical_margin": 6, "dense_margin": 6,
}


def _rounded(rows):
    return rows.select(
        *[F.round(c, DIGITS[c]).alias(c) if c in DIGITS else F.col(c) for c in rows.columns]
    )


def retrieval_features(spark, folder):
    rows = evidence.features(
        benchmark_queries(spark, folder), _hits(spark, folder), corpus(spark, folder)
    )
    return _rounded(rows)


def logistic_evidence(spark, folder):
    rows = evidence.features(
        benchmark_queries(spark, folder), _hits(spark, folder), corpus(spark, folder)
    )
    scored = rows.select("query_id", F.round(evidence.logistic_probability(), 5).alias("probability"))
    return scored.withColumn("sufficient", F.col("probability") >= C.LOGISTIC_THRESHOLD)


def rerank_overlap(spark, folder):
    hits = _hits(spark, folder)
    return rerank.rerank(
        hits, benchmark_queries(spark, folder), corpus(spark, folder), rerank.OverlapScorer()
    )


def hard_negative_pairs(spark, folder):
    """Gold is the document that leads by the lexical score alone."""
    hits = stage(_hits(spark, folder, C.HARD_CANDIDATES), "candidates")
    gold = hits.groupBy("query_id").agg(
        F.max_by("doc_id", F.struct("lexical_score", (-F.col("doc_id")).alias("d"))).alias("gold_id")
    )
    return rerank.hard_negatives(hits, gold)


QUERIES = {
    "cosine_topk": cosine_topk,
    "neighbour_label_metrics": neighbour_label_metrics,
    "inverted_list_recall": inverted_list_recall, "two_level_neighbours": two_level_neighbours,
    "hash_embedding": hash_embedding,
    "hybrid_search": hybrid_search,
    "hybrid_degraded": hybrid_degraded,
    "evidence_verdict": evidence_verdict,
    "evidence_verdict_degraded": evidence_verdict_degraded,
    "retrieval_features": retrieval_features,
    "logistic_evidence": logistic_evidence,
    "rerank_overlap": rerank_overlap,
    "hard_negative_pairs": hard_negative_pairs,
}


def _neighbours(k: int, exclude_self: bool) -> str:
    skip = "AND v.vec_id <> q.vec_id" if exclude_self else ""
    return f"""
        scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, v.label AS found_label, q.label AS wanted,
                round(list_inner_product(CAST(q.embedding AS DOUBLE[]),
                    CAST(v.embedding AS DOUBLE[])), 6) AS score
            FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v
            WHERE true {skip}),
        ranked AS (
            SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored),
        near AS (SELECT * FROM ranked WHERE rank <= {k})"""


_PROBABILITY = " + ".join(
    [str(C.LOGISTIC_INTERCEPT)]
    + [
        f"({w}) * (CAST({n} AS DOUBLE) - ({m})) / {s}"
        for n, m, s, w in zip(
            C.LOGISTIC_FEATURES, C.LOGISTIC_MEAN, C.LOGISTIC_SCALE, C.LOGISTIC_COEFFICIENTS,
            strict=True,
        )
    ]
).replace("CAST(demands_value AS DOUBLE)", "CAST(CAST(demands_value AS INTEGER) AS DOUBLE)").replace(
    "CAST(value_present AS DOUBLE)", "CAST(CAST(value_present AS INTEGER) AS DOUBLE)"
)

_ASSESSED = f"""
        SELECT query_id, {sql.VERDICT} AS verdict, round(combined, 5) AS combined_score,
            CAST(top_dense AS DOUBLE) AS dense_score, CAST(top_lexical AS DOUBLE) AS lexical_score,
            round(term_coverage, 5) AS term_coverage,
            ({sql.VERDICT}) = 'sufficient' AS permits_answering,
            ({sql.VERDICT}) = 'ambiguous' AS requires_adjudication
        FROM signals"""

ORACLE = {
    "cosine_topk": f"""
        WITH {_neighbours(10, False)}
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM near""",
    "neighbour_label_metrics": f"""
        WITH {_neighbours(10, True)},
        firsts AS (
            SELECT query_id, min(CASE WHEN found_label = wanted THEN rank END) AS first_gold
            FROM near GROUP BY query_id)
        SELECT round(avg(CASE WHEN first_gold = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1,
            round(avg(CASE WHEN first_gold <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_3,
            round(avg(CASE WHEN first_gold IS NULL THEN 0.0 ELSE 1.0 / first_gold END), 6) AS mrr,
            count(*) AS n
        FROM firsts""",
    "hash_embedding": f"""
        WITH {sql.DOC_TOKENS}, {sql.hashed('vec', 'doc_tokens', 'doc_id')}
        SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(w, 6) + 0.0 AS w FROM vec""",
    "hybrid_search": f"""
        WITH {sql.hybrid()}
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score, lexical_score,
            dense_score, degraded FROM hits""",
    "hybrid_degraded": f"""
        WITH {sql.hybrid(degraded=True)}
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score, lexical_score,
            dense_score, degraded FROM hits""",
    "evidence_verdict": f"WITH {sql.hybrid()}, {sql.signals()} {_ASSESSED}",
    "evidence_verdict_degraded": f"WITH {sql.hybrid(degraded=True)}, {sql.signals()} {_ASSESSED}",
    "retrieval_features": f"""
        WITH {sql.hybrid()}, {sql.signals()}
        SELECT query_id, {", ".join(
            f"CAST(CAST({n} AS INTEGER) AS DOUBLE) AS {n}"
            if n in ("demands_value", "value_present", "degraded")
            else f"round(CAST({n} AS DOUBLE), {DIGITS.get(n, 6)}) AS {n}" for n in C.FEATURES)}
        FROM signals""",
    "logistic_evidence": f"""
        WITH {sql.hybrid()}, {sql.signals()},
        p AS (SELECT query_id, round(1 / (1 + exp(-({_PROBABILITY}))), 5) AS probability
            FROM signals)
        SELECT query_id, probability, probability >= {C.LOGISTIC_THRESHOLD} AS sufficient FROM p""",
    "rerank_overlap": f"""
        WITH {sql.hybrid()},
        pairs AS (
            SELECT h.query_id, h.doc_id, h.rank AS first_rank,
                list_distinct(q.toks) AS a, list_distinct(d.toks) AS b
            FROM hits h JOIN query_tokens q USING (query_id) JOIN doc_tokens d USING (doc_id)),
        scored AS (
            SELECT *, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))
                / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS score FROM pairs)
        SELECT query_id, CAST(row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, first_rank) AS INTEGER) AS rank,
            doc_id, CAST(first_rank AS INTEGER) AS first_rank, score
        FROM scored""",
    "hard_negative_pairs": f"""
        WITH {sql.hybrid(C.HARD_CANDIDATES)},
        gold AS (
            SELECT query_id, arg_max(doc_id, (lexical_score, -doc_id)) AS gold_id
            FROM hits GROUP BY query_id),
        neg AS (
            SELECT h.query_id, h.doc_id, row_number() OVER (PARTITION BY h.query_id
                ORDER BY md5('{C.SEED}|' || h.query_id || '|' || h.doc_id)) AS n
            FROM hits h JOIN gold g USING (query_id) WHERE h.doc_id <> g.gold_id)
        SELECT query_id, gold_id AS doc_id, CAST(1 AS DOUBLE) AS label FROM gold
        UNION ALL SELECT query_id, doc_id, CAST(0 AS DOUBLE) FROM neg WHERE n <= 4""",
}

_LISTED = f"""
    v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
    lists AS (SELECT greatest(1, count(*) // {ROWS_PER_LIST}) AS lists, count(*) AS n FROM v),
    coarse AS (SELECT row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS coarse, vec AS centre FROM v
               QUALIFY coarse < (SELECT ceil(sqrt(lists)) FROM lists)),
    far AS (SELECT id, vec, coarse, round(list_inner_product(centre, centre) - 2 * list_inner_product(vec, centre), 9)
                AS d FROM v, coarse),
    placed AS (SELECT id, any_value(vec) AS vec, arg_min(coarse, (d, coarse)) AS coarse FROM far GROUP BY id),
    shares AS (SELECT coarse, CAST(ceil(count(*) * (SELECT lists FROM lists) / (SELECT n FROM lists)) AS BIGINT) AS most
               FROM placed GROUP BY coarse),
    fine AS (SELECT coarse, row_number() OVER (PARTITION BY coarse ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS fine,
                 vec AS centre FROM placed JOIN shares USING (coarse) QUALIFY fine < most),
    members AS (
        SELECT id, any_value(vec) AS vec, any_value(coarse) AS coarse, arg_min(fine, (d, fine)) AS fine FROM (
            SELECT id, vec, coarse, fine,
                round(list_inner_product(centre, centre) - 2 * list_inner_product(vec, centre), 9) AS d
            FROM placed JOIN fine USING (coarse)) GROUP BY id),
    asked AS (SELECT item_id AS query_id, vec FROM benchmark JOIN v ON id = item_id),
    opened AS (SELECT query_id, vec, coarse FROM (
        SELECT query_id, a.vec, coarse,
            round(list_inner_product(centre, centre) - 2 * list_inner_product(a.vec, centre), 9) AS d FROM asked a, coarse)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, coarse) <= {OPENED}),
    visits AS (SELECT query_id, vec, coarse, fine FROM (
        SELECT query_id, o.vec, coarse, fine,
            round(list_inner_product(centre, centre) - 2 * list_inner_product(o.vec, centre), 9) AS d
        FROM opened o JOIN fine USING (coarse))
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, coarse, fine) <= {PROBES}),
    scored AS (SELECT query_id, id, round(list_inner_product(x.vec, m.vec), 6) AS score
               FROM visits x JOIN members m USING (coarse, fine)),
    found AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score
              FROM scored QUALIFY rank <= 10)"""
ORACLE |= {
    "two_level_neighbours": f"""
        WITH {_LISTED}
        SELECT query_id, CAST(rank AS INTEGER) AS rank, id AS vec_id, score FROM found""",
    "inverted_list_recall": f"""
        WITH {_LISTED},
        truth AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
            FROM (SELECT query_id, v.id, round(list_inner_product(a.vec, v.vec), 6) AS score FROM asked a, v)
            QUALIFY rank <= 10),
        hits AS (SELECT count(*) AS hits FROM truth JOIN found USING (query_id, id)),
        near AS (SELECT avg((1 - f.score) / (1 - t.score)) AS ratio FROM found f JOIN truth t USING (query_id)
            WHERE f.rank = 1 AND t.rank = 1 AND 1 - t.score > 0)
        SELECT round(hits / (10.0 * (SELECT count(DISTINCT query_id) FROM truth)), 6) AS recall,
            round(coalesce(ratio, 1), 5) AS distance_ratio FROM hits, near""",
}
