"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from lodestone import constants as C

STOP_LIST = "[" + ", ".join(f"'{w}'" for w in C.STOPWORDS) + "]"


def tokens_of(text: str) -> str:
    """A list expression with the tokens of a text column."""
    lowered = f"lower({text})"
    found = f"regexp_extract_all({lowered}, '{C.IDENTIFIER}')"
    parts = (
        f"coalesce(flatten(list_transform({found}, "
        f"lambda i: list_concat([i], string_split_regex(i, '{C.IDENTIFIER_PARTS}')))), [])"
    )
    rest = f"regexp_extract_all(regexp_replace({lowered}, '{C.IDENTIFIER}', ' ', 'g'), '{C.WORD}')"
    return (
        f"list_filter(list_concat({parts}, {rest}), "
        f"lambda t: length(t) >= {C.MIN_TOKEN_CHARS} AND NOT list_contains({STOP_LIST}, t))"
    )


BENCHMARK = "SELECT item_id AS query_id, text FROM benchmark"
DOCUMENTS = "SELECT doc_id, text FROM documents"


def sources(asked: str = BENCHMARK, docs: str = DOCUMENTS) -> str:
    """CTEs ``docs``, ``asked`` and their tokens."""
    return f"""docs AS ({docs}), asked AS ({asked}),
        doc_tokens AS (SELECT doc_id, {tokens_of('text')} AS toks FROM docs),
        query_tokens AS (SELECT query_id, {tokens_of('text')} AS toks FROM asked)"""


DOC_TOKENS = f"doc_tokens AS (SELECT doc_id, {tokens_of('text')} AS toks FROM documents)"
QUERY_TOKENS = (
    f"query_tokens AS (SELECT item_id AS query_id, {tokens_of('text')} AS toks FROM benchmark)"
)


def bm25(doc_tokens: str = "doc_tokens", query_tokens: str = "query_tokens") -> str:
    """CTEs ending in ``lexical(query_id, doc_id, score)``, unrounded."""
    return f"""
    doc_len AS (SELECT doc_id, len(toks) AS length FROM {doc_tokens}),
    stats AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM doc_len),
    post AS (
        SELECT doc_id, term, count(*) AS tf
        FROM (SELECT doc_id, unnest(toks) AS term FROM {doc_tokens}) GROUP BY ALL
    ),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    q_terms AS (
        SELECT query_id, term, count(*) AS qtf
        FROM (SELECT query_id, unnest(toks) AS term FROM {query_tokens}) GROUP BY ALL
    ),
    lexical AS (
        SELECT query_id, post.doc_id,
            sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * ({C.K1} + 1)
                / (tf + {C.K1} * (1 - {C.B} + {C.B} * length / avg_length))) AS score
        FROM q_terms JOIN post USING (term) JOIN df USING (term)
        JOIN doc_len ON doc_len.doc_id = post.doc_id, stats
        GROUP BY query_id, post.doc_id
    )"""


def hashed(name: str, source: str, key: str) -> str:
    """CTEs ending in ``{name}(key, idx, w)``: hashed unit vectors of a token CTE.

    DuckDB has no CRC-32, so its 256-entry table is computed here by the eight
    shift steps and folded over the bytes of each distinct feature.
    """
    return f"""
    {name}_tok AS (SELECT {key}, unnest(toks) AS token FROM {source}),
    {name}_feat AS (
        SELECT {key}, token AS feature FROM {name}_tok
        UNION ALL SELECT {key}, token FROM {name}_tok WHERE length(token) <= 4
        UNION ALL SELECT {key}, unnest(list_transform(range(1, length(token)),
            lambda i: substr('^' || token || '$', i, 4)))
        FROM {name}_tok WHERE length(token) > 4
    ),
    {name}_count AS (SELECT {key}, feature, count(*) AS n FROM {name}_feat GROUP BY ALL),
    {name}_table AS (
        SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda acc, x: CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384)
                ELSE acc // 2 END) ORDER BY i) AS t
        FROM range(256) r(i)
    ),
    {name}_crc AS (
        SELECT feature, xor(list_reduce(
            list_prepend(4294967295, list_transform(range(1, length(feature) + 1),
                lambda i: CAST(ascii(substr(feature, i, 1)) AS BIGINT))),
            lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS digest
        FROM (SELECT DISTINCT feature FROM {name}_count), {name}_table
    ),
    {name}_sum AS (
        SELECT {key}, digest % 768 AS idx,
            sum((CASE WHEN (digest // 65536) % 2 = 1 THEN 1 ELSE -1 END) * (1 + ln(n))) AS w
        FROM {name}_count JOIN {name}_crc USING (feature) GROUP BY ALL
    ),
    {name} AS (
        SELECT {key}, idx, CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS w
        FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY {key})) AS norm FROM {name}_sum)
    )"""


def hybrid(
    limit: int = C.HIT_LIMIT, degraded: bool = False, asked: str = BENCHMARK,
    docs: str = DOCUMENTS,
) -> str:
    """CTEs ending in ``hits`` for all asked texts over all documents."""
    if degraded:
        return f"""{sources(asked, docs)}, {bm25()},
        fused AS (
            SELECT query_id, doc_id,
                round(score / max(score) OVER (PARTITION BY query_id), 6) AS score,
                round(score, 6) AS lexical_score, CAST(0 AS DOUBLE) AS dense_score
            FROM lexical),
        hits AS (
            SELECT *, true AS degraded FROM (
                SELECT *, row_number() OVER (
                    PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
                FROM fused WHERE score > 0)
            WHERE rank <= {limit})"""
    return f"""{sources(asked, docs)}, {bm25()},
        {hashed('doc_vec', 'doc_tokens', 'doc_id')},
        {hashed('query_vec', 'query_tokens', 'query_id')},
        dense AS (
            SELECT query_id, doc_id, sum(d.w * q.w) AS score
            FROM query_vec q JOIN doc_vec d USING (idx) GROUP BY ALL),
        dense_up AS (
            SELECT *, score / max(score) OVER (PARTITION BY query_id) AS n
            FROM dense WHERE score > 0),
        lexical_up AS (
            SELECT *, score / max(score) OVER (PARTITION BY query_id) AS n FROM lexical),
        fused AS (
            SELECT query_id, doc_id,
                round({C.LEXICAL_WEIGHT} * coalesce(l.n, 0) + {C.DENSE_WEIGHT} * coalesce(u.n, 0), 6)
                    AS score,
                coalesce(l.score, 0) AS lexical_raw
            FROM lexical_up l FULL JOIN dense_up u USING (query_id, doc_id)),
        ranked AS (
            SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
            FROM fused WHERE score > 0),
        hits AS (
            SELECT r.query_id, r.rank, r.doc_id, r.score,
                round(r.lexical_raw, 6) AS lexical_score,
                round(coalesce(d.score, 0), 6) AS dense_score, false AS degraded
            FROM ranked r LEFT JOIN dense d USING (query_id, doc_id)
            WHERE rank <= {limit})"""


# RE2 has ASCII word boundaries; the rules ask for Unicode ones, spelled out here.
EDGE_LEFT = r"(?:^|[^\p{L}\p{N}_])"
EDGE_RIGHT = r"(?:$|[^\p{L}\p{N}_])"
SQL_DEMANDS = "(?i)" + EDGE_LEFT + C.DEMANDS_A_VALUE[2:-2] + EDGE_RIGHT
_UNIT = C.CONTAINS_A_VALUE.split("|\\b\\d{2,}\\b")[0][2:-2].replace("\\d", "\\p{Nd}")
SQL_VALUE = "(?i)" + EDGE_LEFT + "(?:" + _UNIT + "|\\p{Nd}{2,})" + EDGE_RIGHT


def signals() -> str:
    """CTE ``signals`` on top of ``hits`` and ``query_tokens``."""
    return f"""
    top AS (
        SELECT query_id, rank, lower(text) AS body, text
        FROM hits JOIN docs USING (doc_id) WHERE rank <= 3),
    q_distinct AS (
        SELECT query_id, unnest(list_distinct(toks)) AS term FROM query_tokens),
    found AS (
        SELECT query_id, count(DISTINCT term) AS n_found
        FROM q_distinct JOIN top USING (query_id) WHERE contains(body, term) GROUP BY query_id),
    value AS (
        SELECT query_id, bool_or(rank <= 2 AND regexp_matches(text, '{SQL_VALUE}')) AS value_present
        FROM top GROUP BY query_id),
    agg AS (
        SELECT query_id, count(*) AS hit_count, max(dense_score) AS top_dense,
            max(CASE WHEN rank = 1 THEN lexical_score END) AS l1,
            max(CASE WHEN rank = 2 THEN lexical_score END) AS l2,
            max(CASE WHEN rank = 1 THEN dense_score END) AS d1,
            max(CASE WHEN rank = 2 THEN dense_score END) AS d2,
            avg(CASE WHEN rank <= 3 THEN dense_score END) AS mean_dense_top3,
            avg(CASE WHEN rank <= 3 THEN lexical_score END) AS mean_lexical_top3,
            sum(CASE WHEN lexical_score > 0 THEN lexical_score END) AS mass,
            count(CASE WHEN lexical_score > 0 THEN 1 END) AS n_positive,
            bool_or(degraded) AS degraded
        FROM hits GROUP BY query_id),
    ent AS (
        SELECT query_id, CASE WHEN any_value(n_positive) < 2 THEN 0 ELSE
            -sum(lexical_score / mass * ln(lexical_score / mass)) END AS score_entropy
        FROM hits JOIN agg USING (query_id) WHERE lexical_score > 0 GROUP BY query_id),
    signals AS (
        SELECT b.query_id,
            coalesce(hit_count, 0) AS hit_count, coalesce(top_dense, 0) AS top_dense,
            coalesce(l1, 0) AS top_lexical, coalesce(top_dense * l1, 0) AS combined,
            coalesce(mean_dense_top3, 0) AS mean_dense_top3,
            coalesce(mean_lexical_top3, 0) AS mean_lexical_top3,
            coalesce(l1 - coalesce(l2, 0), 0) AS lexical_margin,
            coalesce(CASE WHEN hit_count > 1 THEN d1 - d2 ELSE top_dense END, 0) AS dense_margin,
            coalesce(score_entropy, 0) AS score_entropy,
            CASE WHEN len(toks) = 0 THEN 0
                ELSE coalesce(n_found, 0) / len(list_distinct(toks)) END AS term_coverage,
            regexp_matches(b.text, '{SQL_DEMANDS}') AS demands_value,
            coalesce(value_present, false) AS value_present,
            len(toks) AS query_terms, coalesce(degraded, false) AS degraded
        FROM asked b JOIN query_tokens t ON t.query_id = b.query_id
        LEFT JOIN agg ON agg.query_id = b.query_id LEFT JOIN ent ON ent.query_id = b.query_id
        LEFT JOIN found ON found.query_id = b.query_id
        LEFT JOIN value ON value.query_id = b.query_id
    )"""


VERDICT = f"""CASE WHEN hit_count = 0 OR term_coverage < {C.MIN_TERM_COVERAGE} THEN 'insufficient'
    WHEN degraded THEN 'ambiguous'
    WHEN combined < {C.INSUFFICIENT_BELOW} THEN 'insufficient'
    WHEN combined >= {C.SUFFICIENT_ABOVE} AND NOT (demands_value AND NOT value_present)
        THEN 'sufficient'
    ELSE 'ambiguous' END"""
