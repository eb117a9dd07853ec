import random

import pytest
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import rules as R
from lodestone.operators import budget, cache, citations, router, runs
from lodestone.operators.dense import HashingEmbedder
from lodestone.staging import stage
from lodestone.streaming import jobs, rate_limit, router_state


def test_reservations_equal_the_sequential_rule_even_for_a_hot_run(spark):
    rng = random.Random(5)
    calls = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i, rng.randint(1, 60)) for i in range(200)]
    df = spark.createDataFrame(calls, "run_id string, seq long, units long")
    got = {r.seq: (r.accepted, r.reserved_before) for r in budget.reserve(df, 500, rows_per_range=30).collect()}
    held = {}
    for run, seq, units in calls:
        before = held.get(run, 0)
        fits = before + units <= 500
        assert got[seq] == (fits, before if fits else None)
        held[run] = before + units if fits else before


def test_budget_edges(spark):
    df = spark.createDataFrame([("r", 1, 11)], "run_id string, seq long, units long")
    assert not budget.reserve(df, 10).first().accepted
    assert budget.reserve(df, 11).first().accepted
    with pytest.raises(ValueError, match="positive"):
        budget.reserve(df, 0)


def test_prices(spark):
    df = spark.createDataFrame([("groq",), ("nobody",)], "p string")
    got = [r[0] for r in df.select(R.dollars(R.price_units(F.col("p"), F.lit(10**6), F.lit(10**6)))).collect()]
    assert got == [pytest.approx(0.13), pytest.approx(18.0)]


def test_rate_limit_runs(spark):
    outcomes = "LLSLLLSXL"
    names = {"L": "rate_limited", "S": "success", "X": "transport_error"}
    df = spark.createDataFrame([("p", i, names[o]) for i, o in enumerate(outcomes)], "provider string, seq long, outcome string")
    got = router.consecutive_rate_limits(df, rows_per_range=3).orderBy("seq").collect()
    assert [r.consecutive for r in got] == [1, 2, 0, 1, 2, 3, 0, 0, 1]


def test_http_classes(spark):
    cases = [(429, "slow down", "rate_limited"), (429, "quota exceeded", "quota_exhausted"), (401, "", "quota_exhausted"),
             (402, "", "quota_exhausted"), (503, "billing", "transport_error"), (400, "no more credits", "quota_exhausted"),
             (404, "", "transport_error")]
    df = spark.createDataFrame(cases, "s int, b string, want string")
    assert all(r.want == r.got for r in df.select("want", R.http_outcome(F.col("s"), F.col("b")).alias("got")).collect())


def test_cache_tiers_and_models(spark):
    texts = ["restart the connection pool on orders-db", "what severity is a tier 0 outage"]
    entries = spark.createDataFrame(
        [(1, "h1", C.HASHING_MODEL, "fast", texts[0], 3, 4), (2, "h2", "other", "fast", texts[1], 1, 1)],
        "entry_id long, prompt_hash string, embedding_model string, model_tier string, key_text string, tokens_in long, tokens_out long",
    )
    requests = spark.createDataFrame(
        [(1, "h1", "fast", texts[0]), (2, "h9", "fast", "restart the connection pool on the orders-db"),
         (3, "h2", "fast", texts[1]), (4, "h9", "large", texts[0]), (5, "h9", "fast", "restart the connection pool on the orders-db")],
        "request_id long, prompt_hash string, model_tier string, key_text string",
    )
    found = cache.lookup(requests, entries, HashingEmbedder())
    got = {r.request_id: (r.hit, r.entry_id) for r in found.collect()}
    assert got == {1: ("exact", 1), 2: ("semantic", 1), 3: ("miss", None), 4: ("miss", None), 5: ("semantic", 1)}
    stats = cache.statistics(found, entries).first()
    assert (stats.lookups, stats.tokens_avoided, stats.hit_rate) == (5, 21, pytest.approx(0.6))
    empty = cache.statistics(found.limit(0), entries).first()
    assert empty.hit_rate == 0.0 and empty.tokens_avoided == 0


def test_prompt_keys_separate_temperature_and_tier(spark):
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit(" Hello  There ").alias("content")))
    same = F.array(F.struct(F.lit("user").alias("role"), F.lit("hello there").alias("content")))
    row = spark.range(1).select(
        R.prompt_key(messages, F.lit("fast"), F.lit(0.0)), R.prompt_key(same, F.lit("fast"), F.lit(0.0)),
        R.prompt_key(same, F.lit("fast"), F.lit(0.7)), R.prompt_key(same, F.lit("large"), F.lit(0.0)),
    ).first()
    assert row[0] == row[1] and len({row[1], row[2], row[3]}) == 3


def test_citations_stay_when_unresolved(spark):
    answers = spark.createDataFrame([("r", "The pool was full today [1]. It was [0] and [9][1] so. No marker is in this one.")], "run_id string, text string")
    hits = spark.createDataFrame([("r", 1, "c#00", 0.5)], "run_id string, rank int, chunk_id string, score double")
    got = citations.extract(answers, hits, ["run_id"]).orderBy("ordinal", "at").collect()
    assert [(r.ordinal, r.marker, r.chunk_id, r.resolved) for r in got] == [
        (0, 1, "c#00", True), (1, 0, None, False), (1, 9, None, False), (1, 1, "c#00", True)
    ]
    assert citations.fabricated(citations.extract(answers, hits, ["run_id"])).count() == 2
    assert [r.sentence for r in citations.uncited_claims(answers, ["run_id"]).collect()] == ["No marker is in this one."]


@pytest.mark.parametrize("workload, text, context, level", [
    ("incident_triage", "DROP  TABLE users", {}, "critical"),
    ("incident_triage", "restart it", {"tier": "0"}, "high"),
    ("incident_triage", "restart the Tier 0 node", {}, "high"),
    ("incident_triage", "restart it", {}, "medium"),
    ("incident_triage", "look at tier 0", {"recently_rolled_back": "true"}, "medium"),
    ("change_review", "look at tier 0", {"recently_rolled_back": "true"}, "high"),
    ("change_review", "purge it", {"recently_rolled_back": "true"}, "critical"),
    ("change_review", "observe", {}, "low"),
])
def test_risk(spark, workload, text, context, level):
    df = spark.createDataFrame([(workload, text, context)], "w string, p string, c map<string,string>")
    assert df.select(R.risk(F.col("w"), F.col("p"), F.col("c"))["level"]).first()[0] == level


def test_runs_end_where_the_graph_says(spark):
    context = "map('tier', '0')"
    requests = spark.sql(f"SELECT explode(array('s','a','b','e','x')) AS run_id, 'incident_triage' AS workload, {context} AS context")
    verdicts = spark.createDataFrame([("s", "sufficient"), ("a", "ambiguous"), ("b", "ambiguous"), ("e", "sufficient"), ("x", "insufficient")], "run_id string, verdict string")
    answers = spark.createDataFrame([("a", "yes, clearly"), ("b", "NO")], "run_id string, answer string")
    cited, bare = "The pool was full all day [1].", "The pool was full all day."
    attempts = spark.createDataFrame([("s", 1, bare), ("s", 2, cited), ("a", 1, cited), ("e", 1, bare), ("e", 2, bare), ("e", 3, bare)], "run_id string, attempt int, text string")
    proposals = spark.createDataFrame([("s", "restart it"), ("a", "observe")], "run_id string, proposal string")
    state = runs.run_stages(requests, verdicts, answers, attempts, proposals)
    got = {r.run_id: (r.status, r.attempts) for r in state.collect()}
    assert got == {"s": ("awaiting_approval", 2), "a": ("completed", 1), "b": ("refused", 0), "e": ("escalated", 3), "x": ("refused", 0)}
    assert runs.terminal_edge_audit(runs.visited(state)).isEmpty()
    path = [r.node for r in runs.visited(state).filter("run_id = 'e'").orderBy("step").collect()]
    assert path[-1] == "escalate" and path.count("verify") == 3
    wrong = spark.createDataFrame([("r", 0, "await_approval"), ("r", 1, "emit")], "run_id string, step int, node string")
    assert runs.terminal_edge_audit(wrong).first().after_terminal


def test_a_decision_counts_once(spark):
    run = spark.createDataFrame([("r1", "s", None, "awaiting_approval", "v", None, None)], "run_id string, session_id string, parent_run_id string, status string, verdict string, cost_usd decimal(12,6), ended_at timestamp")
    approvals = spark.createDataFrame([("r1", "do", "high", None, None, None)], "run_id string, action string, risk_level string, decision string, decided_by string, decided_at timestamp")
    decide = spark.createDataFrame([("r1", "approved", "ann")], "run_id string, decision string, decided_by string")
    now = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    one = runs.record_decisions(run, approvals, decide, now)
    child = one["run"].filter("parent_run_id = 'r1'").first()
    assert child.status == "completed" and child.session_id == "s" and one["rejected"].isEmpty()
    two = runs.record_decisions(one["run"], one["approval"], decide, now)
    assert two["run"].count() == 2 and two["rejected"].count() == 1
    assert runs.pending_approvals(one["run"], one["approval"]).isEmpty()
    with pytest.raises(Exception, match="approved or rejected"):
        runs.record_decisions(run, approvals, decide.withColumn("decision", F.lit("maybe")), now)


CALLS = "provider string, seq long, at double, outcome string, retry_after double"


def test_breaker_state_lives_across_batches(spark):
    rows = [("p", i, float(i), "rate_limited", 0.0) for i in range(8)]
    rows += [("p", 8, 500.0, "success", 0.0), ("p", 9, 606.9, "success", 0.0), ("p", 10, 607.0, "success", 0.0)]
    rows += [("q", 0, 0.0, "transport_error", 0.0), ("q", 1, 59.0, "success", 0.0), ("q", 2, 60.0, "success", 0.0)]
    rows += [("z", 0, 0.0, "quota_exhausted", 0.0), ("z", 1, 1e5, "success", 0.0)]
    rows += [("r", i, float(i), "rate_limited", 30.0) for i in range(8)] + [("r", 8, 37.5, "success", 0.0)]
    rows += [("o", i, float(i), "success" if i == 4 else "rate_limited", 0.0) for i in range(12)]
    want = {
        "p": ["failed"] * 7 + ["disabled", "skipped", "skipped", "served"], "q": ["disabled", "skipped", "served"],
        "z": ["disabled", "skipped"], "r": ["failed"] * 7 + ["disabled", "served"],
        "o": ["failed"] * 4 + ["served"] + ["failed"] * 7}
    rows = [(p, i, 1000.0 + at, outcome, hint) for p, i, at, outcome, hint in rows]
    for seed in (1, 2):
        mixed = spark.createDataFrame(rows, CALLS).repartition(5, F.xxhash64(F.lit(seed), "provider", "seq"))
        done = jobs.replay(mixed, "breaker-test", router_state.circuit_breaker, bytes_per_trigger=1)
        got = {(r.provider, r.seq): r.action for r in done.collect()}
        assert len(got) == len(rows)
        assert {k: [got[k, i] for i in range(len(v))] for k, v in want.items()} == want


def state_rows(spark, folder, columns):
    return [r for r in spark.read.format("statestore").option("stateVarName", columns).load(folder).collect()]


def test_idle_state_is_cleared_and_disabled_for_good_stays(spark, tmp_path):
    rows = [("p", 0, 0.0, "rate_limited", 0.0), ("z", 0, 0.0, "quota_exhausted", 0.0), ("late", 0, 5000.0, "success", 0.0)]
    rows += [("p", 1, 4000.0, "rate_limited", 0.0), (None, None, 20_000.0, None, None)]
    rows = [(p, i, 1000.0 + at, outcome, hint) for p, i, at, outcome, hint in rows]
    folder, state = str(tmp_path / "calls"), str(tmp_path / "state")
    emitted = []
    for row in rows:  # one trigger each
        spark.createDataFrame([row], CALLS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(CALLS).parquet(folder)
        walked = router_state.circuit_breaker(stream, late="10 seconds", idle_seconds=1000.0)
        query = walked.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(
            lambda batch, _: emitted.extend(tuple(r) for r in batch.collect())).start()
        query.awaitTermination()
    # The last row of each key says how it ended; p was forgotten between its calls.
    got = {(r[0], r[1]): (r[2], r[3]) for r in emitted}
    assert got["p", 0] == ("failed", 1) and got["z", 0] == ("disabled", 0) and got["late", 0] == ("served", 0)
    kept = {r["key"]["provider"] for r in state_rows(spark, state, "walk")}
    assert kept == {"z"}
    assert ("p", 1) not in got or got["p", 1] == ("failed", 1)


REQUESTS = "session_id long, seq long, at double, outcomes array<string>, retry_after array<double>"


def asked(spark, rows):
    return spark.createDataFrame([(s, i, at, o, [h] * len(o)) for s, i, at, o, h in rows], REQUESTS)


def test_failover_order_and_failing_closed(spark):
    rows = [(1, 0, 0.0, ["transport_error", "success"], 0.0), (1, 1, 30.0, ["success", "success"], 0.0),
            (1, 2, 61.0, ["success", "success"], 0.0), (1, 3, 62.0, ["transport_error", "transport_error"], 0.0),
            (1, 4, 63.0, ["success", "success"], 0.0), (2, 0, 1.0, ["success", "success"], 0.0)]
    providers = [router_state.Provider("a"), router_state.Provider("b")]
    mixed = asked(spark, [(s, i, 1000.0 + at, o, h) for s, i, at, o, h in rows]).repartition(3, F.xxhash64("seq"))
    done = jobs.replay(mixed, "failover-test", lambda s, late: router_state.failover(s, providers, late), 1)
    got = [(r.attempts, r.provider) for r in done.where("session_id = 1").orderBy("seq").collect()]
    assert got == [("a,b", "b"), ("b", "b"), ("a", "a"), ("a,b", None), ("", None)]
    assert sorted(map(tuple, done.drop("batch_id").collect())) == sorted(
        map(tuple, router_state.failover(mixed, providers).collect()))


def test_failover_environment_pacing_hints_and_events(spark):
    """Scripted calls as a router with a manual clock answers them."""
    providers = [router_state.Provider("off", available=False), router_state.Provider("slow", gap=2.0),
                 router_state.Provider("next")]
    rows = [(1, i, 0.1 * i, ["success", "rate_limited", "success"], 30.0) for i in range(8)]
    rows += [(1, 8, 20.0, ["success", "success", "quota_exhausted"], 0.0),
             (1, 9, 43.9, ["success", "success", "success"], 0.0), (1, 10, 44.1, ["success", "success", "success"], 0.0)]
    done = {r.seq: r for r in router_state.failover(asked(spark, rows), providers).collect()}
    assert done[0].attempts == "slow,next" and done[0].waited == 0.0
    assert done[0].events == "slow rate_limit consecutive=1; next success"
    assert done[1].waited == pytest.approx(1.9)  # asked 0.1 s after the last call, the gap is 2 s
    assert done[7].events == "slow rate_limit consecutive=8; slow disabled for 30s; next success"
    assert done[7].waited == pytest.approx(2.0)  # the eighth call was made at 14 s
    assert done[8].attempts == "next" and done[8].provider is None
    assert done[8].events == "next disabled quota exhausted"
    assert (done[9].attempts, done[9].provider) == ("", None)  # still disabled
    assert (done[10].attempts, done[10].provider) == ("slow", "slow")


def test_status_comes_from_the_state_and_not_from_a_single_bad_call(spark):
    rows = [("one", 0, 0.0, "rate_limited", 0.0), ("many", 20, 50.0, "rate_limited", 0.0),
            ("back", 0, 0.0, "transport_error", 0.0), ("back", 1, 61.0, "success", 0.0),
            ("gone", 0, 0.0, "quota_exhausted", 0.0), ("gone", 1, 5.0, "success", 0.0)]
    rows += [("many", i, float(i), "rate_limited", 0.0) for i in range(8)]
    calls = spark.createDataFrame(rows, CALLS)
    off = router_state.disablements(router_state.circuit_breaker(calls), calls)
    assert sorted(map(tuple, off.collect())) == [("gone", "quota_exhausted", None), ("many", "rate_limited", 607.0)]


def test_sliding_counts_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.7 else "b", rng.randint(0, 20_000_000)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, c string, us long")
    got = {r.i: r.in_window for r in rate_limit.sliding_counts(df, "c", "us", 2, 20).collect()}
    for i, c, us in rows:
        assert got[i] == sum(1 for _, c2, u2 in rows if c2 == c and us - 2_000_000 < u2 <= us)


def test_files_out_of_order_over_triggers_change_nothing(spark, tmp_path):
    """Events cut into four files by time, written in another order, one file per trigger."""
    from lodestone.plans.tables import table

    folder = "/root/testdata/sf0.001"
    events = table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.col("user_id") % 5).alias("provider"), F.col("event_id").alias("seq"),
        (F.unix_micros("ts") / 1e6).alias("at"), "ts", "user_id",
        F.when(F.col("event_id") % 5 == 0, "success").otherwise("rate_limited").alias("outcome"),
        F.lit(0.0).alias("retry_after"),
    )
    for part in (2, 0, 3, 1):
        events.where(F.floor(F.dayofmonth("ts") / 8) == part).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "cut"))
    cut = spark.read.parquet(str(tmp_path / "cut"))
    want = sorted(map(tuple, router_state.circuit_breaker(events.drop("ts", "user_id")).collect()))
    assert len(want) == events.count()
    assert sorted(map(tuple, router_state.circuit_breaker(cut.drop("ts", "user_id")).collect())) == want
    got = jobs.replay(
        cut.drop("ts", "user_id"), "cut-calls", router_state.circuit_breaker, bytes_per_trigger=1).drop("batch_id")
    assert sorted(map(tuple, got.collect())) == want

    stream = jobs.file_stream(spark, str(tmp_path / "cut"), "*.parquet", bytes_per_trigger=1)
    counted = rate_limit.windowed_counts(stream, F.col("user_id"), "ts", late=None)
    latest = rate_limit.latest_counts(jobs.drain(counted, "cut-counts", "update"))
    whole = events.groupBy(F.window("ts", "1 hour", "10 minutes"), "user_id").count()
    assert latest.agg(F.sum("n")).first()[0] == whole.agg(F.sum("count")).first()[0]
    assert latest.count() == whole.count()


def test_cache_entries_are_embedded_before_the_scan_and_not_in_its_tasks(spark, monkeypatch):
    plans, real = [], cache.exact_neighbours

    def watched(vectors, *a, **k):
        plans.append(vectors._jdf.queryExecution().executedPlan().toString())
        return real(vectors, *a, **k)

    monkeypatch.setattr(cache, "exact_neighbours", watched)
    row = "prompt_hash string, model_tier string, key_text string"
    entries = spark.createDataFrame([(1, "a", "fast", "pool wait", HashingEmbedder.model)], f"entry_id long, {row}, embedding_model string")
    asked = spark.createDataFrame([(7, "b", "fast", "pool wait"), (8, "c", "large", "lag")], f"request_id long, {row}")
    got = {r.request_id: (r.hit, r.entry_id) for r in cache.lookup(asked, entries, HashingEmbedder()).collect()}
    assert got == {7: ("semantic", 1), 8: ("miss", None)}
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)


def test_cached_prompts_are_looked_up_without_sorting_texts(spark):
    rows = [(i, f"h{i % 7}", "fast" if i % 7 % 2 else "large", f"restart node {i % 7} now") for i in range(40)]
    requests = spark.createDataFrame(rows, "request_id long, prompt_hash string, model_tier string, key_text string")
    entries = requests.where("request_id in (0, 1, 2)").withColumnRenamed("request_id", "entry_id").withColumn(
        "embedding_model", F.lit(HashingEmbedder().model))
    read, real = [], cache.stage

    def watch(frame, label, *rest):
        read.append((label, frame._jdf.queryExecution().executedPlan().toString()))
        return real(frame, label, *rest)

    cache.stage = watch
    try:
        got = cache.lookup(requests, entries, HashingEmbedder())
    finally:
        cache.stage = real
    plans = dict(read)
    assert "SortAggregate" not in plans["exact-lookups"] and "open-prompts" in plans
    assert got.count() == 40 and got.where("hit = 'exact'").count() == sum(i % 7 < 3 for i in range(40))


def test_steps_and_evidence_of_runs_are_merged_and_not_sent_whole(spark):
    steps = spark.createDataFrame([(1, 0, "classify"), (1, 1, "retrieve"), (1, 2, "emit")],
                                  "run_id long, step int, node string").transform(stage, "steps")
    state = spark.createDataFrame([(1, "completed", "t", "sufficient", 1, 0, "p", "low", "r")],
                                  "run_id long, status string, hypothesis string, verdict string, attempts int, "
                                  "uncited int, proposal string, risk string, risk_reason string").transform(stage, "state")
    texts = spark.createDataFrame([(1, "It is so [1]. It is not [9].")], "run_id long, text string").transform(stage, "texts")
    hits = spark.createDataFrame([(1, 1, "7", 0.5)], "run_id long, rank int, chunk_id string, score double").transform(
        stage, "hits")
    made = [runs.stage_events(state, steps), runs.terminal_edge_audit(steps),
            citations.extract(texts, hits, ["run_id"])]
    for frame in made:
        assert "SortMergeJoin [run_id" in frame._jdf.queryExecution().executedPlan().toString()
    assert made[0].count() == 3 and [r["target"] for r in made[1].collect()] == ["emit"]
    assert sorted((r["marker"], r["resolved"]) for r in made[2].collect()) == [(1, True), (9, False)]


def test_calls_that_wait_are_kept_in_few_entries_and_all_are_walked(spark, tmp_path):
    n, emitted = 2500, []
    rows = [("p", i, 1000.0 + (i * 7) % n, "success" if i % 3 else "rate_limited", float(i % 2)) for i in range(n)]
    folder, state = str(tmp_path / "calls"), str(tmp_path / "state")

    def trigger(part):
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(folder)
        walked = router_state.circuit_breaker(spark.readStream.schema(CALLS).parquet(folder), late="1 hour")
        query = walked.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(
            lambda batch, _: emitted.extend(tuple(r) for r in batch.collect())).start()
        query.awaitTermination()

    trigger(rows)
    assert not emitted and 1 <= len(state_rows(spark, state, "waiting")) <= 3
    trigger([(None, None, 1000.0 + 3600 + n / 2, None, None)])  # half of the calls are due
    due = len(emitted)
    trigger([(None, None, 50_000.0, None, None)])
    want = sorted(map(tuple, router_state.circuit_breaker(spark.createDataFrame(rows, CALLS)).collect()))
    assert 0 < due < n and sorted(emitted) == want
