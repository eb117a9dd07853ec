"""Cache, router, budget, citation, risk and run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import rules as R
from lodestone.functions.text import has_marker, is_claim, sentences, words
from lodestone.operators import budget, cache, citations, evidence, hybrid, router, runs
from lodestone.operators.dense import HashingEmbedder
from lodestone.operators.ordered import top_k
from lodestone.plans import sql
from lodestone.plans.tables import corpus, table
from lodestone.staging import stage
from lodestone.streaming import router_state


# --- prompts and cache -----------------------------------------------------
def _prompts(spark, folder):
    turns = table(spark, folder, "conversations")
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit("Use ONLY  the evidence.").alias("content")),
        F.struct("role", F.col("text").alias("content")),
    )
    tier = F.when(F.col("turn") % 4 < 2, "fast").otherwise("large")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "conv_id", "role",
        R.prompt_key(messages, tier, F.lit(0.0)).alias("prompt_hash"),
        tier.alias("model_tier"),
        R.key_text(messages).alias("key_text"),
        F.size(words(F.col("text"))).cast("long").alias("tokens_in"),
        F.length("text").cast("long").alias("tokens_out"),
    )


def prompt_keys(spark, folder):
    return _prompts(spark, folder).select(
        "request_id", "prompt_hash",
        R.salted_digest("salt", F.col("conv_id").cast("string")).alias("client_digest"),
    )


def _entries(prompts):
    """Answers to every third conversation are in the store, first writer first.

    Only ids are grouped, and the rows of the first writers joined to them.
    """
    stored = prompts.filter("conv_id % 3 = 0")
    first = stored.groupBy("prompt_hash", "model_tier").agg(F.min("request_id").alias("request_id"))
    kept = stored.join(first, ["prompt_hash", "model_tier", "request_id"])
    return kept.dropDuplicates(["prompt_hash", "model_tier"]).select(
        F.col("request_id").alias("entry_id"), "prompt_hash",
        F.lit(C.HASHING_MODEL).alias("embedding_model"), "model_tier", "key_text",
        "tokens_in", "tokens_out",
    )


def _lookups(spark, folder):
    """What every prompt finds in the store, and the store."""
    prompts = stage(_prompts(spark, folder), "prompts")
    entries = stage(_entries(prompts), "entries")
    return cache.lookup(prompts, entries, HashingEmbedder()), entries


def cache_lookup(spark, folder):
    return _lookups(spark, folder)[0]


def cache_statistics(spark, folder):
    lookups, entries = _lookups(spark, folder)
    found = cache.statistics(stage(lookups, "lookups"), entries)
    return found.withColumn("hit_rate", F.round("hit_rate", 6))


# --- router ----------------------------------------------------------------
def _calls(spark, folder):
    """Events as provider calls: errors are rate limits, purchases successes."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.col("user_id") % 10).alias("provider"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "rate_limited")
        .when(F.col("event_type") == "purchase", "success")
        .otherwise("transport_error")
        .alias("outcome"),
        F.unix_micros("ts").alias("at_us"),
    )


def consecutive_errors(spark, folder):
    return router.consecutive_rate_limits(_calls(spark, folder).drop("at_us"))


def call_pacing(spark, folder):
    calls = _calls(spark, folder).select(
        "provider", "seq", (F.col("at_us") / 1e6).alias("at")
    )
    gap = F.when(F.col("provider") == "p0", 600.0).otherwise(60.0)
    return router.pacing(calls, gap).select("provider", "seq", F.round("wait", 4).alias("wait"))


def http_outcomes(spark, folder):
    status = F.element_at(
        F.array(*[F.lit(s) for s in (429, 500, 503, 401, 402, 403, 404, 429)]),
        (F.col("event_id") % 8 + 1).cast("int"),
    )
    body = F.concat_ws(
        " ", F.when(F.col("event_id") % 5 == 0, "You EXCEEDED your current plan"),
        F.when(F.col("user_id") % 7 == 0, "check your billing page"), "props",
    )
    return table(spark, folder, "events").select(
        "event_id", status.alias("status"), R.http_outcome(status, body).alias("outcome")
    )


def provider_status(spark, folder):
    """Health at the end of the calls, from the state that the breaker ends in."""
    calls = stage(_calls(spark, folder).select(
        "provider", "seq", "outcome", (F.col("at_us") / 1e6).alias("at"),
        F.when(F.col("seq") % 2 == 0, 0.0).otherwise(40_000.0).alias("retry_after")), "calls")
    off = router_state.disablements(router_state.circuit_breaker(calls), calls)
    providers = calls.groupBy("provider").agg(F.min("seq").alias("position")).withColumn(
        "in_environment", F.col("provider") != "p9"
    )
    now = calls.agg(F.max("at").alias("m")).select("m").scalar()
    return router.provider_status(providers, off, now).withColumn(
        "disabled_until", F.round("disabled_until", 4)
    )


# --- budget ----------------------------------------------------------------
_PROVIDERS = [*C.PRICES, "stranger"]


def _spend(spark, folder):
    provider = F.element_at(
        F.array(*[F.lit(p) for p in _PROVIDERS]), (F.col("event_id") % len(_PROVIDERS) + 1).cast("int")
    )
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), provider.alias("provider"),
        F.floor(F.col("value") * 10).cast("long").alias("tokens_in"),
        F.floor(F.col("value") * 20).cast("long").alias("tokens_out"),
        (F.col("event_type") == "view").alias("cache_hit"),
    )


def budget_reservations(spark, folder):
    calls = _spend(spark, folder).withColumn(
        "units", R.price_units(F.col("provider"), F.col("tokens_in") + 100, F.col("tokens_out") + 100)
    )
    return budget.reserve(calls, 5_000_000)


def ledger_totals(spark, folder):
    entries = budget.ledger(_spend(spark, folder)).withColumn(
        "estimated_units",
        F.when(F.col("cache_hit"), F.lit(0).cast("long")).otherwise(
            R.price_units(F.col("provider"), F.col("tokens_in") + 100, F.col("tokens_out") + 100)
        ),
    )
    totals = budget.ledger_totals(entries)
    return totals.withColumn("overestimate_ratio", F.round("overestimate_ratio", 6))


def worst_case_provider(spark, folder):
    calls = _spend(spark, folder).groupBy("run_id", "provider").agg(
        F.min("seq").alias("position"), F.max(~F.col("cache_hit")).alias("used")
    )
    return budget.worst_case(
        calls.select("run_id", "provider", "position",
                     (F.col("used") & (F.col("position") % 3 > 0)).alias("available"))
    )


# --- citations and risk ----------------------------------------------------
def sentence_claims(spark, folder):
    turns = table(spark, folder, "conversations")
    found = turns.select(
        "conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("ordinal", "sentence")
    )
    return found.withColumns(
        {"is_claim": is_claim(F.col("sentence")), "has_marker": has_marker(F.col("sentence"))}
    )


def _answers(spark, folder):
    """Assistant turns with a marker put before each sentence end; some point nowhere."""
    turns = table(spark, folder, "conversations").filter("role = 'assistant'")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("run_id"),
        F.when(F.col("conv_id") % 2 == 0, F.expr(
            "regexp_replace(text, '([.!?])(\\\\s|$)', concat(' [', CAST((conv_id + turn) % 9 AS STRING), ']$1$2'))"
        )).otherwise(F.col("text")).alias("text"),
    )


def _answer_hits(spark, folder):
    """Six passages of evidence per answer: the longest other turns of its conversation.

    The ranking is the conversation's own, so it is cut to six before the answers are
    joined and a long conversation gives six rows per answer, not all pairs.
    """
    turns = table(spark, folder, "conversations")
    passages = turns.filter("role <> 'assistant'").select(
        "conv_id", "turn", F.length("text").alias("n")
    )
    six = top_k(passages, ["conv_id"], [F.desc("n"), F.asc("turn")], C.HIT_LIMIT)
    answers = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("run_id")
    )
    return answers.join(six, "conv_id").select(
        "run_id", "rank", F.format_string("c%d#%02d", "conv_id", "turn").alias("chunk_id"),
        (1.0 / F.col("rank")).alias("score"),
    )


def citation_extraction(spark, folder):
    found = citations.extract(_answers(spark, folder), _answer_hits(spark, folder), ["run_id"])
    return found.select(
        "run_id", "ordinal", "claim_text", "marker", "chunk_id",
        F.round("score", 6).alias("score"), "resolved",
    )


def citation_defects(spark, folder):
    """Per answer: uncited claims, fabricated markers, citations that may be stored."""
    answers = stage(_answers(spark, folder), "answers")
    found = stage(
        citations.extract(answers, _answer_hits(spark, folder), ["run_id"]), "citations"
    )
    uncited = citations.uncited_claims(answers, ["run_id"]).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("uncited")
    )
    marked = found.groupBy("run_id").agg(
        F.count_if(~F.col("resolved")).alias("fabricated"),
        F.count_if(F.col("resolved") & F.col("chunk_id").isNotNull()).alias("stored"),
    )
    joined = answers.select("run_id").join(uncited, "run_id", "left").join(marked, "run_id", "left")
    return joined.na.fill(0)


_VERBS = ["restart", "delete from", "advise on", "roll back", "purge", "observe"]


def _proposal(key):
    verb = F.element_at(F.array(*[F.lit(v) for v in _VERBS]), (key % len(_VERBS) + 1).cast("int"))
    target = F.when(key % 4 == 0, " the Tier 0 service").otherwise(" the batch service")
    return F.concat(F.lit("Please "), verb, target)


def _context(key):
    return F.create_map(
        F.lit("tier"), (key % 3).cast("string"),
        F.lit("recently_rolled_back"), F.when(key % 5 == 0, "true").otherwise("false"),
        F.lit("service"), F.lit("svc"), F.lit("signature"), F.lit(""), F.lit("metrics"), F.lit(""),
        F.lit("change_kind"), F.lit("deploy"),
    )


def _workload(key):
    return F.when(key % 2 == 0, "incident_triage").otherwise("change_review")


def risk_scoring(spark, folder):
    key = F.col("o_orderkey")
    scored = table(spark, folder, "orders").select(
        "o_orderkey", R.risk(_workload(key), _proposal(key), _context(key)).alias("r")
    )
    return scored.select(
        "o_orderkey", F.col("r.level").alias("risk"), F.col("r.reason").alias("reason"),
        R.requires_approval(F.col("r.level")).alias("needs_approval"),
    )


# --- runs ------------------------------------------------------------------
def _asked(spark, folder):
    turns = table(spark, folder, "conversations").filter("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "text")


def _orchestrated(spark, folder):
    """Every user turn is a run; the recorded texts come from the turn after it."""
    asked = stage(_asked(spark, folder), "asked")
    docs = corpus(spark, folder)
    index = hybrid.build_index(docs, HashingEmbedder())
    hits = stage(hybrid.search(index, asked, HashingEmbedder()), "hits")
    verdicts = evidence.assess(asked, hits, docs).select(
        F.col("query_id").alias("run_id"), "verdict"
    )
    key = F.col("query_id")
    requests = asked.select(
        key.alias("run_id"), _workload(key).alias("workload"), _context(key).alias("context")
    )
    answers = asked.select(
        key.alias("run_id"),
        F.when(key % 3 == 0, " yes, it does").when(key % 3 == 1, "No").alias("answer"),
    )
    replies = table(spark, folder, "conversations").filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("run_id"), "text"
    )
    cited = F.regexp_replace("text", r"([.!?])(\s|$)", " [2]$1$2")
    attempts = (
        replies.join(asked.select(key.alias("run_id")), "run_id", "left_semi")
        .select("run_id", F.explode(F.array(
            F.struct(F.lit(1).alias("attempt"), F.col("text").alias("text")),
            F.struct(F.lit(2).alias("attempt"),
                     F.when(F.col("run_id") % 7 < 5, cited).otherwise(F.col("text")).alias("text")),
        )).alias("a"))
        .select("run_id", "a.attempt", "a.text")
    )
    proposals = asked.select(key.alias("run_id"), _proposal(key).alias("proposal"))
    state = stage(
        runs.run_stages(requests, stage(verdicts, "verdicts"), answers, attempts, proposals), "runs"
    )
    evidence_hits = hits.select(
        F.col("query_id").alias("run_id"), "rank", F.col("doc_id").cast("string").alias("chunk_id"),
        "score",
    )
    return asked, state, evidence_hits


def orchestrated_runs(spark, folder):
    _, state, _ = _orchestrated(spark, folder)
    return state.select(
        "run_id", "workload", "adjudicated", "verdict", "attempts", "uncited", "risk", "status",
        F.md5(F.col("hypothesis").cast("binary")).alias("hypothesis_digest"),
    )


def stage_visits(spark, folder):
    _, state, _ = _orchestrated(spark, folder)
    steps = stage(runs.visited(state), "steps")
    counted = steps.groupBy("node").agg(F.count(F.lit(1)).alias("visits"))
    wrong = runs.terminal_edge_audit(steps).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("illegal_moves", wrong.scalar())


def stage_payloads(spark, folder):
    _, state, _ = _orchestrated(spark, folder)
    events = runs.stage_events(state, runs.visited(state))
    return events.groupBy("node").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.length("payload")).alias("payload_chars")
    )


def saved_runs(spark, folder):
    """Rows of the four run tables after saving all runs over half of them stored."""
    asked, state, hits = _orchestrated(spark, folder)
    full = state.join(
        asked.select(F.col("query_id").alias("run_id"), F.col("conv_id").cast("string").alias("session_id")),
        "run_id",
    ).select(
        F.col("run_id").cast("string").alias("run_id"), "session_id", "workload", "status", "hypothesis",
        "proposal", "risk", F.col("workload").alias("subject"), F.lit(0.00125).alias("cost_usd"),
    )
    at = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    stored = full.filter("CAST(run_id AS BIGINT) % 2 = 0").select(
        "run_id", "session_id", F.lit(None).cast("string").alias("parent_run_id"),
        F.lit("running").alias("status"), F.lit("stored").alias("verdict"),
        F.lit(0).cast("decimal(12,6)").alias("cost_usd"), F.lit(None).cast("timestamp").alias("ended_at"),
    )
    approvals = full.filter("status = 'awaiting_approval' AND CAST(run_id AS BIGINT) % 3 = 0").select(
        "run_id", F.lit("stored").alias("action"), F.lit("high").alias("risk_level"),
        F.lit("approved").alias("decision"), F.lit("ann").alias("decided_by"), at.alias("decided_at"),
    )
    no_citations = full.sparkSession.createDataFrame(
        [], "run_id string, claim_text string, chunk_id string, score double, ordinal int"
    )
    no_memory = full.sparkSession.createDataFrame(
        [], "session_id string, kind string, content string, created_at timestamp"
    )
    hits = hits.withColumn("run_id", F.col("run_id").cast("string"))
    return runs.save_runs(stored, no_citations, approvals, no_memory, full, hits, at)


def saved_run_rows(spark, folder):
    tables = saved_runs(spark, folder)
    return tables["run"].select("run_id", "session_id", "status", F.length("verdict").alias("verdict_chars"),
                                F.col("cost_usd").cast("double").alias("cost_usd"))


def saved_citations(spark, folder):
    return saved_runs(spark, folder)["citation"].select(
        "run_id", "ordinal", "chunk_id", "score", F.md5(F.col("claim_text").cast("binary")).alias("claim_digest")
    )


def recalled_memory(spark, folder):
    memory = saved_runs(spark, folder)["memory_item"]
    return runs.recall(memory).select("session_id", "rank", "content")


def recorded_decisions(spark, folder):
    """Approve or reject every second gated run, and list what follows."""
    tables = saved_runs(spark, folder)
    approvals = stage(tables["approval"], "approvals")
    stored_runs = stage(tables["run"], "stored-runs")
    number = F.col("run_id").cast("long")
    decisions = approvals.filter(number % 2 == 0).select(
        "run_id", F.when(number % 3 == 1, "rejected").otherwise("approved").alias("decision"),
        F.lit("sofia").alias("decided_by"),
    )
    out = runs.record_decisions(
        stored_runs, approvals, decisions, F.to_timestamp(F.lit("2024-02-02 00:00:00"))
    )
    decided = out["approval"].select(
        "run_id", F.coalesce("decision", F.lit("open")).alias("outcome"),
        F.coalesce("decided_by", F.lit("")).alias("detail"),
    )
    children = out["run"].filter(F.col("parent_run_id").isNotNull()).select(
        F.col("parent_run_id").alias("run_id"), F.concat(F.lit("child "), F.col("status")).alias("outcome"),
        F.col("verdict").alias("detail"),
    )
    refused = out["rejected"].select(
        "run_id", F.lit("not open").alias("outcome"), F.col("decision").alias("detail")
    )
    pending = runs.pending_approvals(out["run"], out["approval"]).select(
        "run_id", F.lit("pending").alias("outcome"), F.col("risk_level").alias("detail")
    )
    return decided.unionByName(children).unionByName(refused).unionByName(pending)


QUERIES = {
    f.__name__: f for f in (
        prompt_keys, cache_lookup, cache_statistics, consecutive_errors, call_pacing, http_outcomes,
        provider_status, budget_reservations, ledger_totals, worst_case_provider, sentence_claims,
        citation_extraction, citation_defects, risk_scoring, orchestrated_runs, stage_visits,
        stage_payloads, saved_run_rows, saved_citations, recalled_memory, recorded_decisions,
    )
}

# --- checking SQL ----------------------------------------------------------
_NORM = "regexp_replace(trim(lower({0}), E' \\t\\n\\r'), '\\s+', ' ', 'g')"
_PROMPTS = f"""
    prompts AS (
        SELECT conv_id * 1000 + turn AS request_id, conv_id,
            CASE WHEN turn % 4 < 2 THEN 'fast' ELSE 'large' END AS model_tier,
            sha256('system:use only the evidence. ' || role || ':' || {_NORM.format('text')}
                || ' tier=' || CASE WHEN turn % 4 < 2 THEN 'fast' ELSE 'large' END
                || ' temperature=0.00') AS prompt_hash,
            'use only the evidence.' || chr(10) || {_NORM.format('text')} AS key_text,
            len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS tokens_in,
            length(text) AS tokens_out
        FROM conversations)"""
_LOOKUP = f"""{_PROMPTS},
    entries AS (
        SELECT prompt_hash, model_tier, min(request_id) AS entry_id,
            arg_min(key_text, request_id) AS key_text,
            arg_min(tokens_in + tokens_out, request_id) AS tokens
        FROM prompts WHERE conv_id % 3 = 0 GROUP BY ALL),
    asked AS (
        SELECT prompt_hash, model_tier, min(request_id) AS query_id,
            arg_min(key_text, request_id) AS key_text FROM prompts
        WHERE (prompt_hash, model_tier) NOT IN (SELECT (prompt_hash, model_tier) FROM entries)
        GROUP BY ALL),
    e_tok AS (SELECT entry_id, {sql.tokens_of('key_text')} AS toks FROM entries),
    a_tok AS (SELECT query_id, {sql.tokens_of('key_text')} AS toks FROM asked),
    {sql.hashed('e_vec', 'e_tok', 'entry_id')}, {sql.hashed('a_vec', 'a_tok', 'query_id')},
    near AS (
        SELECT query_id, entry_id, round(sum(a.w * e.w), 6) AS score
        FROM a_vec a JOIN e_vec e USING (idx) JOIN asked USING (query_id)
        JOIN entries USING (entry_id) WHERE asked.model_tier = entries.model_tier GROUP BY ALL),
    best AS (
        SELECT query_id, entry_id, score FROM near
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) = 1),
    lookups AS (
        SELECT request_id,
            CASE WHEN entries.entry_id IS NOT NULL THEN 'exact' WHEN score >= 0.6 THEN 'semantic'
                ELSE 'miss' END AS hit,
            coalesce(entries.entry_id, CASE WHEN score >= 0.6 THEN best.entry_id END) AS entry_id,
            CASE WHEN entries.entry_id IS NOT NULL THEN CAST(1 AS DOUBLE)
                WHEN score >= 0.6 THEN score END AS similarity
        FROM prompts LEFT JOIN entries USING (prompt_hash, model_tier)
        LEFT JOIN asked USING (prompt_hash, model_tier) LEFT JOIN best USING (query_id))"""

_CALLS = """calls AS (
        SELECT 'p' || user_id % 10 AS provider, event_id AS seq,
            CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'purchase' THEN 'success'
                ELSE 'transport_error' END AS outcome, epoch_us(ts) / 1e6 AS at_s FROM events)"""


def _rate_sql(side: int) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {round(r[side] * 100)}" for n, r in C.PRICES.items())
    return f"(CASE provider {cases} ELSE {round(C.UNKNOWN_PRICE[side] * 100)} END)"


_SPEND = f"""spend AS (
        SELECT user_id AS run_id, event_id AS seq,
            ({_PROVIDERS})[event_id % {len(_PROVIDERS)} + 1] AS provider,
            CAST(floor(value * 10) AS BIGINT) AS tokens_in,
            CAST(floor(value * 20) AS BIGINT) AS tokens_out, event_type = 'view' AS cache_hit
        FROM events),
    priced AS (
        SELECT *, CAST((tokens_in + 100) * {_rate_sql(0)} + (tokens_out + 100) * {_rate_sql(1)} AS BIGINT)
            AS units, CAST(tokens_in * {_rate_sql(0)} + tokens_out * {_rate_sql(1)} AS BIGINT) AS actual
        FROM spend)"""

_SENTENCES = (
    "list_filter(list_transform(string_split(regexp_replace(trim({0}, E' \\t\\n\\r'), "
    "'([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, E' \\t\\n\\r')), "
    "lambda s: s <> '')"
)
_IS_CLAIM = (
    "(NOT regexp_matches({0}, '(?i)" + C.NON_CLAIM.replace("'", "''") + "') AND "
    "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')) >= 5)"
)
_ANSWERS = """answers AS (
        SELECT conv_id * 1000 + turn AS run_id, CASE WHEN conv_id % 2 = 0 THEN
            regexp_replace(text, '([.!?])(\\s|$)', ' [' || (conv_id + turn) % 9 || ']\\1\\2', 'g')
            ELSE text END AS text
        FROM conversations WHERE role = 'assistant'),
    ev AS (
        SELECT a.conv_id * 1000 + a.turn AS run_id, row_number() OVER (
                PARTITION BY a.conv_id, a.turn ORDER BY length(p.text) DESC, p.turn) AS rank,
            printf('c%d#%02d', p.conv_id, p.turn) AS chunk_id
        FROM conversations a JOIN conversations p ON a.conv_id = p.conv_id
        WHERE a.role = 'assistant' AND p.role <> 'assistant'
        QUALIFY rank <= 6)"""
_CITED = f"""{_ANSWERS},
    sent AS (
        SELECT run_id, unnest(range(len(s))) AS ordinal, unnest(s) AS sentence
        FROM (SELECT run_id, {_SENTENCES.format('text')} AS s FROM answers)),
    marks AS (
        SELECT run_id, ordinal, sentence,
            CAST(unnest(regexp_extract_all(sentence, '\\[(\\d+)\\]', 1)) AS BIGINT) AS marker FROM sent),
    cited AS (
        SELECT m.run_id, m.ordinal, m.sentence AS claim_text, m.marker, ev.chunk_id,
            CASE WHEN ev.rank IS NULL THEN 0 ELSE round(1.0 / ev.rank, 6) END AS score,
            ev.rank IS NOT NULL AS resolved
        FROM marks m LEFT JOIN ev ON ev.run_id = m.run_id AND ev.rank = m.marker)"""


def _risk_sql(key: str) -> str:
    return f"""
        SELECT *, CASE WHEN workload = 'change_review' AND {key} % 5 = 0
                THEN (['low', 'medium', 'high', 'critical'])[least(4, list_position(
                    ['low', 'medium', 'high', 'critical'], base) + 1)] ELSE base END AS risk
        FROM (SELECT *, CASE WHEN verb IN ('delete from', 'purge') THEN 'critical'
                WHEN verb IN ('restart', 'roll back') THEN CASE WHEN zero THEN 'high' ELSE 'medium' END
                WHEN zero THEN 'medium' ELSE 'low' END AS base
            FROM (SELECT *, ({_VERBS})[{key} % 6 + 1] AS verb,
                {key} % 3 = 0 OR {key} % 4 = 0 AS zero,
                CASE WHEN {key} % 2 = 0 THEN 'incident_triage' ELSE 'change_review' END AS workload
                FROM src))"""


_REASON = """CASE
            WHEN base = 'critical' THEN 'the proposal is not reversible by redeploying'
            WHEN base = 'high' THEN 'a state-changing action on a Tier 0 service'
            WHEN verb IN ('restart', 'roll back') THEN 'a state-changing action outside the Tier 0 path'
            WHEN zero THEN 'advice concerning a Tier 0 service'
            ELSE 'no state-changing action proposed' END
            || CASE WHEN workload = 'change_review' AND {key} % 5 = 0
                THEN '; escalated because this service was rolled back recently' ELSE '' END"""


_ASKED = "SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'"
_UNCITED = (
    f"len(list_filter({_SENTENCES.format('{0}')}, lambda s: {_IS_CLAIM.format('s')} "
    "AND NOT regexp_matches(s, '\\[\\d+\\]')))"
)
_STATE = f"""{sql.hybrid(asked=_ASKED)}, {sql.signals()},
    src AS (SELECT query_id AS run_id, {sql.VERDICT} AS first_verdict FROM signals),
    risky AS ({_risk_sql('run_id')}),
    reply AS (
        SELECT conv_id * 1000 + turn - 1 AS run_id, text,
            regexp_replace(text, '([.!?])(\\s|$)', ' [2]\\1\\2', 'g') AS cited
        FROM conversations WHERE role = 'assistant'),
    tried AS (
        SELECT run_id, text, CASE WHEN run_id % 7 < 5 THEN cited ELSE text END AS second,
            {_UNCITED.replace('{0}', 'text')} AS u1,
            {_UNCITED.replace('{0}', 'CASE WHEN run_id % 7 < 5 THEN cited ELSE text END')} AS u2
        FROM reply),
    final AS (
        SELECT r.*, t.* EXCLUDE (run_id), first_verdict = 'ambiguous' AS adjudicated,
            CASE WHEN first_verdict = 'ambiguous' THEN
                CASE WHEN r.run_id % 3 = 0 THEN 'sufficient' ELSE 'insufficient' END
                ELSE first_verdict END AS verdict
        FROM risky r LEFT JOIN tried t USING (run_id)),
    state AS (
        SELECT run_id, workload, adjudicated, verdict,
            CASE WHEN verdict <> 'sufficient' THEN 'refused'
                WHEN u1 IS NULL OR (u1 > 0 AND u2 > 0) THEN 'escalated'
                WHEN risk IN ('high', 'critical') THEN 'awaiting_approval' ELSE 'completed' END AS status,
            CASE WHEN verdict <> 'sufficient' THEN 0 WHEN u1 = 0 THEN 1 WHEN u2 = 0 THEN 2 ELSE 3 END
                AS attempts,
            CASE WHEN verdict <> 'sufficient' THEN '' WHEN u1 = 0 THEN text ELSE second END AS hypothesis,
            CASE WHEN verdict = 'sufficient' AND u1 > 0 AND u2 > 0 THEN u2
                WHEN verdict = 'sufficient' AND u1 IS NULL THEN NULL ELSE 0 END AS uncited,
            CASE WHEN verdict = 'sufficient' AND (u1 = 0 OR u2 = 0) THEN risk END AS risk
        FROM final)"""

ORACLE = {
    "prompt_keys": f"""
        WITH {_PROMPTS} SELECT request_id, prompt_hash,
            sha256('salt:' || conv_id) AS client_digest FROM prompts""",
    "cache_lookup": f"WITH {_LOOKUP} SELECT * FROM lookups",
    "cache_statistics": f"""
        WITH {_LOOKUP}
        SELECT count(*) AS lookups, count(*) FILTER (hit = 'exact') AS exact_hits,
            count(*) FILTER (hit = 'semantic') AS semantic_hits,
            count(*) FILTER (hit = 'miss') AS misses,
            CAST(sum(tokens) AS BIGINT) AS tokens_avoided,
            round(count(*) FILTER (hit <> 'miss') / count(*), 6) AS hit_rate
        FROM lookups LEFT JOIN entries USING (entry_id)""",
    "consecutive_errors": f"""
        WITH {_CALLS},
        i AS (SELECT *, count(*) FILTER (outcome = 'success') OVER (
            PARTITION BY provider ORDER BY seq) AS island FROM calls)
        SELECT provider, seq, outcome, count(*) FILTER (outcome = 'rate_limited') OVER (
            PARTITION BY provider, island ORDER BY seq) AS consecutive FROM i""",
    "call_pacing": f"""
        WITH {_CALLS}
        SELECT provider, seq, round(coalesce(greatest(0,
            CASE WHEN provider = 'p0' THEN 600 ELSE 60 END
            - (at_s - lag(at_s) OVER (PARTITION BY provider ORDER BY seq))), 0), 4) AS wait FROM calls""",
    "http_outcomes": """
        WITH s AS (SELECT event_id, CAST(([429, 500, 503, 401, 402, 403, 404, 429])[event_id % 8 + 1]
            AS INTEGER) AS status, event_id % 5 = 0 OR user_id % 7 = 0 AS spent FROM events)
        SELECT event_id, status, CASE WHEN status = 429 AND spent THEN 'quota_exhausted'
            WHEN status = 429 THEN 'rate_limited' WHEN status IN (401, 402, 403) THEN 'quota_exhausted'
            WHEN status >= 500 THEN 'transport_error' WHEN spent THEN 'quota_exhausted'
            ELSE 'transport_error' END AS outcome FROM s""",
    "provider_status": f"""
        WITH RECURSIVE {_CALLS},
        n AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 600 ELSE 40000 END AS ttl,
            row_number() OVER (PARTITION BY provider ORDER BY at_s, seq) AS i FROM calls),
        walk AS (
            SELECT DISTINCT provider, CAST(0 AS BIGINT) AS i, 0 AS c, CAST('-Infinity' AS DOUBLE) AS until,
                '' AS reason FROM n
            UNION ALL
            SELECT provider, i, CASE WHEN off THEN c WHEN outcome = 'success' THEN 0
                    WHEN outcome = 'rate_limited' THEN c + 1 ELSE c END,
                CASE WHEN off THEN until WHEN outcome = 'success' THEN CAST('-Infinity' AS DOUBLE)
                    WHEN outcome = 'transport_error' THEN at_s + 60
                    WHEN c + 1 < 8 THEN CAST('-Infinity' AS DOUBLE) ELSE at_s + ttl END,
                CASE WHEN off OR outcome = 'success' OR (outcome = 'rate_limited' AND c + 1 < 8) THEN reason
                    ELSE outcome END
            FROM (SELECT n.*, w.until, w.reason, n.at_s < w.until AS off,
                      CASE WHEN w.until > '-Infinity' AND n.at_s >= w.until THEN 0 ELSE w.c END AS c
                  FROM walk w JOIN n ON n.provider = w.provider AND n.i = w.i + 1)),
        ends AS (SELECT provider, arg_max(until, i) AS until, arg_max(reason, i) AS reason FROM walk GROUP BY provider),
        s AS (SELECT provider, min(seq) AS position, any_value(until) AS until, any_value(reason) AS reason,
                (SELECT max(at_s) FROM calls) < any_value(until) AS off, provider <> 'p9' AS here
            FROM calls JOIN ends USING (provider) GROUP BY provider)
        SELECT position, provider, here AND NOT off AS available,
            CASE WHEN NOT here THEN 'unavailable_in_environment' WHEN off THEN reason END AS disabled_reason,
            CASE WHEN here AND off THEN round(until, 4) END AS disabled_until FROM s""",
    "budget_reservations": f"""
        WITH RECURSIVE {_SPEND},
        n AS (SELECT run_id, seq, units, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i
            FROM priced),
        walk AS (
            SELECT run_id, seq, i, units, units <= 5000000 AS accepted, CAST(0 AS BIGINT) AS before,
                CASE WHEN units <= 5000000 THEN units ELSE 0 END AS held FROM n WHERE i = 1
            UNION ALL
            SELECT n.run_id, n.seq, n.i, n.units, w.held + n.units <= 5000000, w.held,
                CASE WHEN w.held + n.units <= 5000000 THEN w.held + n.units ELSE w.held END
            FROM walk w JOIN n ON n.run_id = w.run_id AND n.i = w.i + 1)
        SELECT run_id, seq, units, accepted, CASE WHEN accepted THEN before END AS reserved_before
        FROM walk""",
    "ledger_totals": f"""
        WITH {_SPEND},
        t AS (SELECT run_id, count(*) AS entries,
                sum(CASE WHEN cache_hit THEN 0 ELSE units END) AS r,
                sum(CASE WHEN cache_hit THEN 0 ELSE actual END) AS s,
                coalesce(sum(tokens_in + tokens_out) FILTER (cache_hit), 0) AS tok
            FROM priced GROUP BY run_id)
        SELECT run_id, entries, CAST(r AS DOUBLE) / 1e8 AS reserved_usd,
            CAST(s AS DOUBLE) / 1e8 AS actual_usd, CAST(tok AS BIGINT) AS tokens_avoided,
            CASE WHEN s > 0 THEN round(CAST(r AS DOUBLE) / CAST(s AS DOUBLE), 6) ELSE 0 END
                AS overestimate_ratio FROM t""",
    "worst_case_provider": f"""
        WITH {_SPEND},
        c AS (SELECT run_id, provider, min(seq) AS position, bool_or(NOT cache_hit) AS used
            FROM spend GROUP BY ALL),
        a AS (SELECT *, {_rate_sql(0)} + {_rate_sql(1)} AS price FROM c WHERE used AND position % 3 > 0)
        SELECT run_id, coalesce(arg_max(a.provider, (a.price, -a.position)), 'unknown') AS provider
        FROM (SELECT DISTINCT run_id FROM c) r LEFT JOIN a USING (run_id) GROUP BY run_id""",
    "sentence_claims": f"""
        WITH s AS (SELECT conv_id, turn, {_SENTENCES.format('text')} AS s FROM conversations),
        x AS (SELECT conv_id, turn, CAST(unnest(range(len(s))) AS INTEGER) AS ordinal,
            unnest(s) AS sentence FROM s)
        SELECT *, {_IS_CLAIM.format('sentence')} AS is_claim,
            regexp_matches(sentence, '\\[\\d+\\]') AS has_marker FROM x""",
    "citation_extraction": f"""
        WITH {_CITED} SELECT run_id, CAST(ordinal AS INTEGER) AS ordinal, claim_text, marker,
            chunk_id, CAST(score AS DOUBLE) AS score, resolved FROM cited""",
    "citation_defects": f"""
        WITH {_CITED},
        u AS (SELECT run_id, count(*) AS uncited FROM sent WHERE {_IS_CLAIM.format('sentence')}
            AND NOT regexp_matches(sentence, '\\[\\d+\\]') GROUP BY run_id),
        m AS (SELECT run_id, count(*) FILTER (NOT resolved) AS fabricated,
            count(*) FILTER (resolved) AS stored FROM cited GROUP BY run_id)
        SELECT run_id, coalesce(uncited, 0) AS uncited, coalesce(fabricated, 0) AS fabricated,
            coalesce(stored, 0) AS stored
        FROM answers LEFT JOIN u USING (run_id) LEFT JOIN m USING (run_id)""",
    "risk_scoring": f"""
        WITH src AS (SELECT o_orderkey FROM orders), r AS ({_risk_sql('o_orderkey')})
        SELECT o_orderkey, risk, {_REASON.format(key='o_orderkey')} AS reason,
            risk IN ('high', 'critical') AS needs_approval FROM r""",
    "orchestrated_runs": f"""
        WITH {_STATE}
        SELECT run_id, workload, adjudicated, verdict, CAST(attempts AS INTEGER) AS attempts,
            CAST(uncited AS INTEGER) AS uncited, risk, status, md5(hypothesis) AS hypothesis_digest
        FROM state""",
    "stage_visits": f"""
        WITH {_STATE},
        v AS (
            SELECT unnest(['classify', 'retrieve', 'assess_evidence']) AS node FROM state
            UNION ALL SELECT 'adjudicate' FROM state WHERE adjudicated
            UNION ALL SELECT unnest(['hypothesise', 'verify']) FROM state, range(3) t(i) WHERE i < attempts
            UNION ALL SELECT unnest(CASE status WHEN 'refused' THEN ['refuse'] WHEN 'escalated'
                THEN ['escalate'] WHEN 'awaiting_approval' THEN ['propose_action', 'risk_gate', 'await_approval']
                ELSE ['propose_action', 'risk_gate', 'emit'] END) FROM state)
        SELECT node, count(*) AS visits, CAST(0 AS BIGINT) AS illegal_moves FROM v GROUP BY node""",
    "stage_payloads": f"""
        WITH {_STATE},
        p AS (SELECT *, 'Please ' || ({_VERBS})[run_id % 6 + 1] || CASE WHEN run_id % 4 = 0
            THEN ' the Tier 0 service' ELSE ' the batch service' END AS proposal,
            {_REASON.format(key='run_id')} AS reason
            FROM state JOIN (SELECT run_id, verb, zero, base FROM risky) USING (run_id)),
        e AS (
            SELECT unnest(['classify', 'retrieve']) AS node, 2 AS n FROM p
            UNION ALL SELECT 'assess_evidence', length(to_json({{'verdict': verdict}})) FROM p
            UNION ALL SELECT 'adjudicate', length(to_json({{'verdict': verdict}})) FROM p WHERE adjudicated
            UNION ALL SELECT 'hypothesise', CASE WHEN hypothesis IS NULL THEN length(to_json({{'attempts': attempts}}))
                ELSE length(to_json({{'attempts': attempts, 'text': hypothesis}})) END
                FROM p, range(3) t(i) WHERE i < attempts
            UNION ALL SELECT 'verify', CASE WHEN uncited IS NULL THEN 2
                ELSE length(to_json({{'uncited': uncited}})) END FROM p, range(3) t(i) WHERE i < attempts
            UNION ALL SELECT 'propose_action', length(to_json({{'proposal': proposal}})) FROM p WHERE risk IS NOT NULL
            UNION ALL SELECT 'risk_gate', length(to_json({{'risk': risk, 'reason': reason}})) FROM p WHERE risk IS NOT NULL
            UNION ALL SELECT CASE status WHEN 'refused' THEN 'refuse' WHEN 'escalated' THEN 'escalate'
                WHEN 'completed' THEN 'emit' ELSE 'await_approval' END, length(to_json({{'status': status}})) FROM p)
        SELECT node, count(*) AS events, CAST(sum(n) AS BIGINT) AS payload_chars FROM e GROUP BY node""",
    "saved_run_rows": f"""
        WITH {_STATE}
        SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(run_id // 1000 AS VARCHAR) AS session_id, status,
            CAST(CASE WHEN run_id % 2 = 0 THEN 6
                WHEN hypothesis IS NULL OR hypothesis = '' THEN NULL ELSE least(2000, length(hypothesis)) END AS INTEGER) AS verdict_chars,
            CASE WHEN run_id % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(0.00125 AS DOUBLE) END AS cost_usd
        FROM state""",
    "saved_citations": f"""
        WITH {_STATE},
        sent AS (
            SELECT run_id, unnest(range(len(s))) AS ordinal, unnest(s) AS sentence
            FROM (SELECT run_id, {_SENTENCES.format('hypothesis')} AS s FROM state)),
        marks AS (
            SELECT run_id, ordinal, sentence,
                CAST(unnest(regexp_extract_all(sentence, '\\[(\\d+)\\]', 1)) AS BIGINT) AS marker FROM sent)
        SELECT CAST(m.run_id AS VARCHAR) AS run_id, CAST(ordinal AS INTEGER) AS ordinal,
            CAST(h.doc_id AS VARCHAR) AS chunk_id, h.score, md5(left(sentence, 1000)) AS claim_digest
        FROM marks m JOIN hits h ON h.query_id = m.run_id AND h.rank = m.marker""",
    "recalled_memory": f"""
        WITH {_STATE},
        m AS (
            SELECT CAST(run_id // 1000 AS VARCHAR) AS session_id,
                '{{"run_id":"' || run_id || '","workload":"' || workload || '","subject":"' || workload
                || '","status":"' || status || '"' || coalesce(',"risk":"' || risk || '"', '') || '}}' AS content
            FROM state)
        SELECT session_id, CAST(row_number() OVER (
            PARTITION BY session_id ORDER BY content) AS INTEGER) AS rank, content FROM m
        QUALIFY rank <= 5""",
    "recorded_decisions": f"""
        WITH {_STATE},
        a AS (SELECT run_id, risk, CASE WHEN run_id % 3 = 0 THEN 'approved' END AS old,
                CASE WHEN run_id % 2 = 0 THEN CASE WHEN run_id % 3 = 1 THEN 'rejected' ELSE 'approved' END END AS new
            FROM state WHERE status = 'awaiting_approval')
        SELECT CAST(run_id AS VARCHAR) AS run_id, coalesce(old, new, 'open') AS outcome,
            CASE WHEN old IS NOT NULL THEN 'ann' WHEN new IS NOT NULL THEN 'sofia' ELSE '' END AS detail FROM a
        UNION ALL SELECT CAST(run_id AS VARCHAR),
            'child ' || CASE new WHEN 'approved' THEN 'completed' ELSE 'refused' END,
            'continuation of ' || run_id || ' after it was ' || new FROM a WHERE old IS NULL AND new IS NOT NULL
        UNION ALL SELECT CAST(run_id AS VARCHAR), 'not open', new FROM a WHERE old IS NOT NULL AND new IS NOT NULL
        UNION ALL SELECT CAST(run_id AS VARCHAR), 'pending', risk FROM a WHERE old IS NULL AND new IS NULL""",
}
