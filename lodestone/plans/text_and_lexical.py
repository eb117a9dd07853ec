"""Text preparation and lexical retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import text as T
from lodestone.operators import lexical
from lodestone.plans import sql
from lodestone.plans.tables import benchmark_queries, corpus, table
from lodestone.staging import spread


def bm25_topk(spark, folder):
    index = lexical.token_index(corpus(spark, folder))
    return lexical.bm25_top_k(index, benchmark_queries(spark, folder), 5)


def term_statistics(spark, folder):
    stats = lexical.term_statistics(lexical.token_index(corpus(spark, folder)))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def tokenize_counts(spark, folder):
    docs = spread(corpus(spark, folder)).withColumn("tokens", T.tokenize(F.col("text")))
    return docs.select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).alias("n_terms"),
        F.md5(F.array_join("tokens", " ").cast("binary")).alias("token_digest"),
    )


def token_estimates(spark, folder):
    docs = spread(corpus(spark, folder))
    return docs.select("doc_id", T.token_estimate(F.col("text")).alias("token_count"))


def character_ngrams(spark, folder):
    docs = spread(corpus(spark, folder))
    tokens = docs.select(F.explode(T.tokenize(F.col("text"))).alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    grams = counted.select(F.explode(T.char_ngrams(F.col("token"))).alias("gram"), "n")
    return grams.groupBy("gram").agg(F.sum("n").alias("occurrences"))


def normalised_prompts(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.select(
        "conv_id", "turn",
        T.normalise_prompt(F.col("text")).alias("prompt"),
        T.truncated(F.col("text"), C.CLAIM_CHARS).alias("claim_text"),
    )


def retrieval_query_text(spark, folder):
    turns = table(spark, folder, "conversations")
    context = F.create_map(
        F.lit("service"), F.concat(F.lit("svc-"), F.col("role")),
        F.lit("signature"), F.when(F.col("turn") % 2 == 0, "").otherwise("latency.rise"),
        F.lit("metrics"), F.lit(""),
        F.lit("change_kind"), F.when(F.col("turn") % 3 == 0, "deploy").otherwise(""),
    )
    workload = F.when(F.col("conv_id") % 2 == 0, "incident_triage").otherwise("change_review")
    return turns.select(
        "conv_id", "turn", T.retrieval_query(workload, F.col("text"), context).alias("query")
    )


def name_slugs(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_brand", "p_type")).alias("slug")
    )


QUERIES = {
    "bm25_topk": bm25_topk,
    "term_statistics": term_statistics,
    "tokenize_counts": tokenize_counts,
    "token_estimates": token_estimates,
    "character_ngrams": character_ngrams,
    "normalised_prompts": normalised_prompts,
    "retrieval_query_text": retrieval_query_text,
    "name_slugs": name_slugs,
}

ORACLE = {
    "bm25_topk": f"""
        WITH {sql.DOC_TOKENS}, {sql.QUERY_TOKENS}, {sql.bm25()},
        ranked AS (
            SELECT query_id, doc_id, round(score, 6) AS score,
                row_number() OVER (
                    PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
            FROM lexical)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM ranked WHERE rank <= 5""",
    "term_statistics": f"""
        WITH {sql.DOC_TOKENS},
        df AS (
            SELECT term, count(*) AS df
            FROM (SELECT unnest(list_distinct(toks)) AS term FROM doc_tokens) GROUP BY term),
        n AS (SELECT count(*) AS n_docs FROM documents)
        SELECT term, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf
        FROM df, n""",
    "tokenize_counts": f"""
        WITH {sql.DOC_TOKENS}
        SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens,
            CAST(len(list_distinct(toks)) AS INTEGER) AS n_terms,
            md5(array_to_string(toks, ' ')) AS token_digest
        FROM doc_tokens""",
    "token_estimates": """
        SELECT doc_id, CAST(greatest(1, floor(len(list_filter(
            string_split_regex(text, '\\s+'), lambda w: w <> '')) * CAST(1.3 AS DOUBLE)))
            AS INTEGER) AS token_count
        FROM documents""",
    "character_ngrams": f"""
        WITH {sql.DOC_TOKENS},
        t AS (SELECT unnest(toks) AS token FROM doc_tokens),
        c AS (SELECT token, count(*) AS n FROM t GROUP BY token),
        g AS (
            SELECT n, CASE WHEN length(token) <= 4 THEN token
                ELSE unnest(list_transform(range(1, length(token)),
                    lambda i: substr('^' || token || '$', i, 4))) END AS gram
            FROM (SELECT token, n FROM c WHERE length(token) > 4)
            UNION ALL SELECT n, token FROM c WHERE length(token) <= 4)
        SELECT gram, CAST(sum(n) AS BIGINT) AS occurrences FROM g GROUP BY gram""",
    "normalised_prompts": """
        SELECT conv_id, turn,
            regexp_replace(trim(lower(text), E' \\t\\n\\r'), '\\s+', ' ', 'g') AS prompt,
            left(text, 1000) AS claim_text
        FROM conversations""",
    "retrieval_query_text": """
        SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0
            THEN concat_ws(' ', nullif(text, ''),
                CASE WHEN turn % 2 = 0 THEN NULL ELSE 'latency.rise' END, 'svc-' || role)
            ELSE concat_ws(' ', nullif(text, ''), 'svc-' || role,
                CASE WHEN turn % 3 = 0 THEN 'deploy' END, 'change risk classification')
            END AS query
        FROM conversations""",
    "name_slugs": """
        SELECT p_partkey, regexp_replace(regexp_replace(
            lower(concat_ws(' / ', p_name, p_brand, p_type)), '[^a-z0-9]+', '-', 'g'),
            '^-|-$', '', 'g') AS slug
        FROM part""",
}
