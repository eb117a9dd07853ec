"""Streaming queries, and small batch operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.operators import runs
from lodestone.operators.ordered import quantile_rows
from lodestone.plans.tables import table
from lodestone.streaming import rate_limit, router_state
from lodestone.streaming.jobs import drain, file_stream, replay


def _stream(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = file_stream(spark, folder, "events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _outcome():
    return (
        F.when(F.col("event_type") == "purchase", "success")
        .when((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0), "transport_error")
        .when((F.col("event_type") == "signup") & (F.col("event_id") % 97 == 0), "quota_exhausted")
        .otherwise("rate_limited")
    )


def _events(spark, folder):
    return table(spark, folder, "events")


def _calls(spark, folder):
    """Every user as a provider; errors, views and clicks are rate limits."""
    return _events(spark, folder).select(
        F.concat(F.lit("p"), F.col("user_id")).alias("provider"), F.col("event_id").alias("seq"),
        (F.unix_micros("ts") / 1e6).alias("at"), _outcome().alias("outcome"),
        F.when(F.col("event_id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(7200.0)).alias("retry_after"),
    )


def _breaker_rows(done):
    return done.select(
        "provider", "seq", "action", "consecutive",
        F.when(F.col("disabled_until") < float("inf"), F.round("disabled_until", 4))
        .otherwise(F.col("disabled_until")).alias("disabled_until"),
    )


def circuit_breaker(spark, folder):
    """The archived calls, walked in order."""
    return _breaker_rows(router_state.circuit_breaker(_calls(spark, folder)))


def circuit_breaker_stream(spark, folder):
    """The same calls as a stream with keyed state, in any order of files."""
    calls = _calls(spark, folder).repartition(4, F.xxhash64("seq"))
    return _breaker_rows(replay(calls, "calls", router_state.circuit_breaker))


_PROVIDERS = [
    router_state.Provider("groq", 2.0), router_state.Provider("local", 0.0, False),
    router_state.Provider("cerebras", 0.0), router_state.Provider("mistral", 1.5),
]


def provider_failover(spark, folder):
    kinds = F.array(*[F.lit(k) for k in (
        "rate_limited", "success", "transport_error", "rate_limited", "success", "rate_limited",
        "rate_limited",
    )])
    outcomes = F.array(*[
        F.element_at(kinds, ((F.col("event_id") * (i + 2)) % 7 + 1).cast("int"))
        for i in range(len(_PROVIDERS))
    ])
    hints = F.array(*[F.when(F.col("event_id") % (i + 3) == 0, 5.0).otherwise(0.0) for i in range(len(_PROVIDERS))])
    # The synthetic sessions ask rarely, so their clock runs slower here.
    requests = _events(spark, folder).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"),
        (F.unix_micros("ts") / 2e10).alias("at"), outcomes.alias("outcomes"), hints.alias("retry_after"),
    )
    found = router_state.failover(requests, _PROVIDERS)
    return found.withColumn("waited", F.round("waited", 4))


def windowed_client_counts(spark, folder):
    counted = rate_limit.windowed_counts(_stream(spark, folder), F.col("user_id"), "ts", late=None)
    latest = rate_limit.latest_counts(drain(counted, "client-counts", "update"))
    return latest.select(
        "client", F.unix_micros("window_start").alias("window_start_us"), "n",
        (F.col("n") <= C.CLIENT_LIMIT_PER_HOUR).alias("allowed"),
    )


def sliding_rate_limit(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "user_id", F.unix_micros("ts").alias("at_us")
    )
    # The synthetic clients ask rarely, so the limit is looked at over a day.
    return rate_limit.sliding_counts(events, "user_id", "at_us", 86_400, 3)


def stage_spans(spark, folder):
    """Each user's events as stages of a run; purchases are its model calls."""
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"),
        F.unix_micros("ts").alias("at_us"),
        (F.col("event_type") == "purchase").cast("long").alias("new_calls"),
        (F.col("event_type") == "view").cast("long").alias("new_hits"),
    )
    return runs.spans(events)


def value_percentiles(spark, folder):
    """Mean, median and the value at index ``int(0.95 * (n - 1))`` per event type."""
    events = table(spark, folder, "events").select("event_type", "event_id", "value")
    found = quantile_rows(events, "value", "event_id", ["event_type"])
    return found.select(
        "event_type", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "p95", "n"
    )


def declared_and_traced(spark, folder):
    """Customers with a positive balance against customers with an order, both ways."""
    declared = table(spark, folder, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("id")
    )
    traced = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"))
    return declared.subtract(traced).select("id", F.lit("not traced").alias("problem")).unionByName(
        traced.subtract(declared).select("id", F.lit("not declared").alias("problem"))
    )


QUERIES = {
    f.__name__: f for f in (
        circuit_breaker, circuit_breaker_stream, provider_failover, windowed_client_counts, sliding_rate_limit, stage_spans,
        value_percentiles, declared_and_traced,
    )
}

_NEVER = "CAST('-Infinity' AS DOUBLE)"


def _failover_sql() -> str:
    """One recursion step per request; the providers are nested one inside the next."""
    n = len(_PROVIDERS)
    fields = ", ".join(f"c{i}, u{i}, l{i}" for i in range(n))
    step = """SELECT r.session_id, r.i, r.seq, greatest(r.now_s, w.clock) AS clock, false AS served,
        '' AS attempts, '' AS provider, CAST(0 AS DOUBLE) AS waited, '' AS events, """
    step += ", ".join(f"w.c{i}, w.u{i}, w.l{i}, r.o{i}, r.h{i}" for i in range(n))
    step += " FROM walk w JOIN req r ON r.session_id = w.session_id AND r.i = w.i + 1"
    for i, (name, gap, here) in enumerate(_PROVIDERS):
        rest = ", ".join(f"c{j}, u{j}, l{j}, o{j}, h{j}" for j in range(n) if j != i)
        step = f"""SELECT *, NOT served AND {'true' if here else 'false'} AND clock >= u{i} AS tried,
            CASE WHEN u{i} > {_NEVER} THEN 0 ELSE c{i} END AS base,
            CASE WHEN l{i} > {_NEVER} THEN greatest(0.0, {gap} - (clock - l{i})) ELSE 0.0 END AS gap FROM ({step})"""
        step = f"""SELECT *, CASE WHEN tried THEN clock + gap ELSE clock END AS clock_after,
            tried AND o{i} = 'rate_limited' AND base + 1 >= 8 AS off FROM ({step})"""
        step = f"""SELECT session_id, i, seq, clock_after AS clock, served OR (tried AND o{i} = 'success') AS served,
            attempts || CASE WHEN NOT tried THEN '' WHEN attempts = '' THEN '{name}' ELSE ',{name}' END AS attempts,
            CASE WHEN tried AND o{i} = 'success' THEN '{name}' ELSE provider END AS provider,
            CASE WHEN tried THEN waited + gap ELSE waited END AS waited,
            events || CASE WHEN NOT tried THEN '' ELSE CASE WHEN events = '' THEN '' ELSE '; ' END || CASE o{i}
                WHEN 'success' THEN '{name} success'
                WHEN 'rate_limited' THEN '{name} rate_limit consecutive=' || (base + 1) || CASE WHEN off
                    THEN '; {name} disabled for ' || CASE WHEN h{i} > 0 THEN '5' ELSE '600' END || 's' ELSE '' END
                WHEN 'quota_exhausted' THEN '{name} disabled quota exhausted'
                ELSE '{name} error ' || o{i} END END AS events,
            CASE WHEN NOT tried THEN c{i} WHEN o{i} = 'success' THEN 0 WHEN o{i} = 'rate_limited' THEN base + 1
                ELSE base END AS c{i},
            CASE WHEN NOT tried THEN u{i} WHEN o{i} = 'success' THEN {_NEVER}
                WHEN o{i} = 'rate_limited' THEN CASE WHEN NOT off THEN {_NEVER}
                    ELSE clock_after + CASE WHEN h{i} > 0 THEN h{i} ELSE 600 END END
                WHEN o{i} = 'transport_error' THEN clock_after + 60 ELSE CAST('Infinity' AS DOUBLE) END AS u{i},
            CASE WHEN tried AND o{i} IN ('success', 'rate_limited') THEN clock_after ELSE l{i} END AS l{i},
            o{i}, h{i}, {rest} FROM ({step})"""
    kinds = """(['rate_limited', 'success', 'transport_error', 'rate_limited', 'success',
        'rate_limited', 'rate_limited'])"""
    asked = ", ".join(
        f"{kinds}[event_id * {i + 2} % 7 + 1] AS o{i}, CASE WHEN event_id % {i + 3} = 0 THEN 5.0::DOUBLE ELSE 0 END AS h{i}"
        for i in range(n))
    start = ", ".join(f"0 AS c{i}, {_NEVER} AS u{i}, {_NEVER} AS l{i}" for i in range(n))
    return f"""
        WITH RECURSIVE req AS (
            SELECT user_id AS session_id, event_id AS seq, epoch_us(ts) / 2e10 AS now_s,
                row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, {asked} FROM events),
        walk AS (
            SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS seq, {_NEVER} AS clock,
                '' AS attempts, '' AS provider, CAST(0 AS DOUBLE) AS waited, '' AS events, {start} FROM req
            UNION ALL SELECT session_id, i, seq, clock, attempts, provider, waited, events, {fields} FROM ({step}))
        SELECT session_id, seq, attempts, nullif(provider, '') AS provider, round(waited, 4) AS waited, events
        FROM walk WHERE i > 0"""


ORACLE = {
    "provider_failover": _failover_sql(),
    "circuit_breaker": """
        WITH RECURSIVE calls AS (
            SELECT 'p' || user_id AS provider, event_id AS seq, epoch_us(ts) / 1e6 AS now_s,
                CASE WHEN event_type = 'purchase' THEN 'success'
                    WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'transport_error'
                    WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'quota_exhausted'
                    ELSE 'rate_limited' END AS outcome,
                CASE WHEN event_id % 2 = 0 THEN 600 ELSE 7200 END AS ttl,
                row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        walk AS (
            SELECT DISTINCT provider, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS seq, '' AS action,
                0 AS consecutive, CAST('-Infinity' AS DOUBLE) AS until FROM calls
            UNION ALL
            SELECT provider, i, seq, CASE WHEN off THEN 'skipped' WHEN outcome = 'success' THEN 'served'
                    WHEN outcome = 'rate_limited' AND c + 1 < 8 THEN 'failed' ELSE 'disabled' END,
                CASE WHEN off THEN c WHEN outcome = 'success' THEN 0
                    WHEN outcome = 'rate_limited' THEN c + 1 ELSE c END,
                CASE WHEN off THEN until WHEN outcome = 'success' THEN CAST('-Infinity' AS DOUBLE)
                    WHEN outcome = 'rate_limited' THEN CASE WHEN c + 1 < 8
                        THEN CAST('-Infinity' AS DOUBLE) ELSE now_s + ttl END
                    WHEN outcome = 'transport_error' THEN now_s + 60
                    ELSE CAST('Infinity' AS DOUBLE) END
            FROM (
                SELECT n.provider, n.i, n.seq, n.outcome, n.now_s, n.ttl, w.until, n.now_s < w.until AS off,
                    CASE WHEN w.until > '-Infinity' AND n.now_s >= w.until THEN 0 ELSE w.consecutive END AS c
                FROM walk w JOIN calls n ON n.provider = w.provider AND n.i = w.i + 1))
        SELECT provider, seq, action, CAST(consecutive AS INTEGER) AS consecutive,
            CASE WHEN until = '-Infinity' THEN NULL WHEN until = 'Infinity' THEN until
                ELSE round(until, 4) END AS disabled_until
        FROM walk WHERE i > 0""",
    "windowed_client_counts": """
        WITH w AS (
            SELECT user_id AS client, epoch_us(ts) // 600000000 * 600000000 - k * 600000000 AS s
            FROM events, range(6) r(k))
        SELECT client, s AS window_start_us, count(*) AS n, count(*) <= 20 AS allowed
        FROM w GROUP BY ALL""",
    "sliding_rate_limit": """
        WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS at_us FROM events),
        c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY at_us
            RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM e)
        SELECT *, in_window <= 3 AS allowed FROM c""",
    "stage_spans": """
        WITH e AS (
            SELECT user_id AS run_id, event_id AS step, epoch_us(ts) AS us,
                CAST(event_type = 'purchase' AS BIGINT) AS calls, CAST(event_type = 'view' AS BIGINT) AS cache_hits
            FROM events),
        s AS (SELECT *, coalesce(lag(us) OVER (PARTITION BY run_id ORDER BY step), us) AS prev,
            first(us) OVER (PARTITION BY run_id ORDER BY step) AS start,
            sum(calls) OVER (PARTITION BY run_id ORDER BY step) AS ledger_size FROM e)
        SELECT run_id, step, ((prev - start + 5) // 10) / 100 AS start_ms,
            ((us - prev + 5) // 10) / 100 AS duration_ms, calls, cache_hits,
            CAST(ledger_size AS BIGINT) AS ledger_size FROM s""",
    "value_percentiles": """
        SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
            list(value ORDER BY value)[CAST(floor(CAST(0.95 AS DOUBLE) * (count(*) - 1)) AS BIGINT) + 1] AS p95,
            count(*) AS n
        FROM events GROUP BY event_type""",
    "declared_and_traced": """
        SELECT c_custkey AS id, 'not traced' AS problem FROM customer WHERE c_acctbal > 0
            AND c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT DISTINCT o_custkey, 'not declared' FROM orders
            WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
}
ORACLE["circuit_breaker_stream"] = ORACLE["circuit_breaker"]
