import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from lodestone.operators import absence, dataset, models, suites
from lodestone.plans.catalogue import all_queries

SMALL = "/root/testdata/sf0.001"


def questions(spark, rows):
    return spark.createDataFrame(rows, "id string, mechanism string, group string, text string")


def brute_cap(rows, share):
    """The published rule, pass by pass over the rows themselves."""
    while True:
        cap, kept = max(1, int(len(rows) * share)), []
        for m in sorted({r[1] for r in rows}):
            members = sorted(r for r in rows if r[1] == m)
            if len(members) > cap:
                buckets = {g: [r for r in members if r[2] == g] for g in sorted({r[2] for r in members})}
                turn, chosen = 0, []
                while len(chosen) < cap:
                    chosen += [b[turn] for b in buckets.values() if turn < len(b)][: cap - len(chosen)]
                    turn += 1
                members = chosen
            kept += members
        if len(kept) == len(rows):
            return {r[0] for r in kept}
        rows = kept


@pytest.mark.parametrize("rows_per_range", [25, 10_000])
def test_cap_equals_repeated_passes(spark, rows_per_range):
    rng = random.Random(4)
    rows = [(f"q{i:04d}", "m1" if i % 10 < 6 else f"m{2 + i % 4}", "hot" if rng.random() < 0.5 else f"g{rng.randint(0, 9)}", "t")
            for i in range(300)]
    got = {r.id for r in dataset.cap_mechanisms(questions(spark, rows), 0.30, rows_per_range=rows_per_range).collect()}
    assert got == brute_cap(rows, 0.30)


def test_copies_keep_the_smallest_id(spark):
    rows = [("b", "m", "g", "What is THE pool"), ("a", "m", "g", "what pool"), ("c", "m", "g", "pool what")]
    assert {r.id for r in dataset.first_per_token_tuple(questions(spark, rows)).collect()} == {"a", "c"}


def test_groups_never_straddle_the_split(spark):
    rows = spark.range(400).select("id", (F.col("id") % 37).alias("g"))
    split = dataset.split_by_group(rows, "g", rows_per_range=10)
    sides = split.groupBy("g").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0]
    n_test = split.filter("split = 'test'").select("g").distinct().count()
    assert sides == 1 and n_test == round(37 * 0.25)
    again = dataset.split_by_group(rows.repartition(3), "g")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))


@pytest.mark.parametrize("block", [1, 500])
def test_absence_is_verified_by_substring(spark, block):
    topics = spark.createDataFrame([(1, ["disk", "full"]), (2, ["dns"]), (3, ["oper"])], "topic int, terms array<string>")
    chunks = spark.createDataFrame([("The DISK is there",), ("it is full",), ("DNS operates",)], "body string")
    assert {r.topic for r in dataset.stated(topics, chunks, block).collect()} == {2, 3}


def test_stated_topics_equal_brute_force(spark):
    draw = random.Random(4)
    bodies = ["".join(draw.choices("ab C", k=draw.randint(0, 30))) for _ in range(40)] + [None, ""]
    topics = [(i, ["".join(draw.choices("abc ", k=draw.randint(0, 4))) for _ in range(draw.randint(0, 4))])
              for i in range(80)] + [(90, ["a", None]), (91, []), (92, [""]), (93, ["nowhere", "a"])]
    chunks = spark.createDataFrame([(b,) for b in bodies], "body string").repartition(3)
    frame = spark.createDataFrame(topics, "topic int, terms array<string>")
    want = {t for t, terms in topics if None not in terms and any(
        all(x in b.lower() for x in terms) for b in bodies if b is not None)}
    for shard in (1, 7, 500):
        assert {r.topic for r in absence.stated(frame, chunks, shard).collect()} == want
    nothing = spark.createDataFrame([], "body string")
    assert absence.stated(frame, nothing).count() == 0


def test_terms_stated_together_equal_brute_force(spark):
    draw = random.Random(5)
    bodies = ["".join(draw.choices("abcd ", k=20)) for _ in range(30)]
    left = ["ab", "cd", "dd", "zz", "a"]
    right = ["bc", "a", "ddd", "da"]
    got = absence.stated_together(*[spark.createDataFrame([(x,) for x in t], "term string") for t in (left, right)],
                                  spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert set(map(tuple, got.collect())) == {
        (a, b) for a in left for b in right if any(a in x and b in x for x in bodies)}


def test_property_questions_keep_a_plan_of_constant_size(spark, monkeypatch):
    properties = spark.createDataFrame(
        [(0, "pool ceiling", "orders-db", ["ceiling"]), (1, "lag limit", "bus", ["not there"])],
        "position int, prop string, documented_for string, proof_terms array<string>")
    entities = spark.createDataFrame([(i, f"svc-{i}x") for i in range(50)] + [(50, "orders-db"), (51, "cache")],
                                     "position int, entity string")
    chunks = spark.createDataFrame([("the ceiling of svc-3x pool",), ("a cache",)], "body string")
    sizes = []
    for block in (7, 10_000):
        monkeypatch.setattr(dataset, "ENTITY_BLOCK", block)
        made = dataset.property_transfer_questions(properties, entities, chunks)
        rows = made.collect()
        assert len(rows) == 3 * (52 - 2)  # not for orders-db, nor for svc-3x, which a passage names with it
        assert not any("orders-db" in r.text or "svc-3x" in r.text for r in rows)
        sizes.append(made._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert sizes[0] == sizes[1]


def test_heading_questions(spark):
    titles = spark.createDataFrame([("d", "Pool Trouble")], "id string, title string")
    chunks = spark.createDataFrame(
        [("d#0", "d", "Root causes"), ("d#1", "d", "Why now"), ("d#2", "d", "Process"), ("d#3", "d", None)],
        "chunk_id string, document_id string, heading string",
    )
    got = {r.id: r.text for r in dataset.heading_questions(titles, chunks).collect()}
    assert got == {
        "q-head-d#0-0": "what are the root causes", "q-head-d#0-1": "explain the root causes for pool trouble",
        "q-head-d#1-0": "why now", "q-head-d#1-1": "why now, for pool trouble",
        "q-head-d#2-0": "what is the process", "q-head-d#2-1": "explain the process for pool trouble",
    }


def test_suites_fail_on_bad_input(spark):
    good = [(i, "answerable" if i % 2 else "unanswerable", "ambiguous", False, float(i)) for i in range(220)]
    schema = "query_id long, label string, verdict string, permits_answering boolean, combined_score double"
    reached = spark.createDataFrame([(1, True)], "query_id long, found boolean")
    passed = {r.name: r.passed for r in suites.core(spark.createDataFrame(good, schema), reached).collect()}
    assert all(passed.values()) and len(passed) == 5
    bad = [(q, la, v, True, s) for q, la, v, _, s in good[:40]]
    missed = spark.createDataFrame([(1, False)], "query_id long, found boolean")
    failed = {r.name: r.passed for r in suites.core(spark.createDataFrame(bad, schema), missed).collect()}
    assert not any(failed[n] for n in (
        "sample_is_large_enough", "false_answer_rate_within_budget", "ambiguous_never_permits_answering",
        "every_fault_reaches_its_runbook"))
    gold = spark.createDataFrame([(1, True), (2, False)], "query_id long, is_first boolean")
    hard = spark.createDataFrame([(8.85,)], "combined_score double")
    probe = suites.probe(spark.createDataFrame(good, schema), gold, hard)
    row = suites.report(probe).first()
    assert row.passed and row.warned


def test_features_by_name(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 2.0, 1.0)], "a double, b double, c double")
    assert list(models.as_vector(rows, ["c", "a"]).first().features) == [3.0, 1.0]
    with pytest.raises(ValueError, match="does not|do not have"):
        models.as_vector(rows, ["z"])
    assert models.varying_columns(rows, ["a", "b", "c"]) == ["a", "c"]
    other = rows.withColumn("c", F.col("c") + 0.5)
    assert models.parity(rows, other, "a", "c").first().max_difference == 0.5


def test_registry_is_consistent():
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 95
    own = all_queries()  # the library's own part names none of the text-preparation queries
    assert set(own) <= set(queries) and not [n for n in own if "pipeline" in n or re.match(r"op\d", n)]


FAST = ["tokenize_counts", "roc_points", "upsert_orders", "page_chunks", "closure_hops", "citation_extraction",
        "risk_scoring", "hybrid_search", "constraint_violations", "round_robin_cap", "sliding_rate_limit"]


@pytest.mark.parametrize("name", FAST)
def test_registered_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = entry_points.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    quoted = [f'"{c}"' for c in columns]
    want = con.execute(f"SELECT {', '.join(quoted)} FROM ({entry_points.oracle_sql()[name]})").fetchall()
    key = lambda row: tuple(str(v) for v in row)
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want))


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() == 200


def test_boosting_reads_bins_with_weights_and_not_all_rows(spark):
    rows = spark.range(20_000).select(
        F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"),
        (F.col("id") > 9_000).cast("int").alias("label"), (F.col("id") % 10).cast("string").alias("group"),
        (F.col("id") % 5).cast("int").alias("fold"),
    )
    edges = models.bin_edges(rows, ["a", "b"], [0, 1, 2, 3, 4])
    assert len(edges[0]["a"]) == models.BINS - 1 and edges[0]["b"] == [0.0, 1.0]
    assert edges[2]["a"][15] in range(9_998, 10_002)  # half of the rows of the other folds
    seen = models.folded_rows(models.binned(rows.where("fold <> 2"), edges[2]), ["a", "b"])
    assert seen.count() <= 2 * models.BINS * 3 and seen.rdd.getNumPartitions() == 1
    assert seen.agg(F.sum(models.WEIGHT)).first()[0] == 16_000
    few = [(0.0, 0, "a"), (1.0, 1, "a"), (0.0, 0, "b"), (1.0, 1, "b"), (9.0, 1, "b")]
    rows = spark.createDataFrame(few, "a double, label int, group string")
    make = lambda names: models.boosted(names, trees=3)
    scored = models.out_of_fold(rows, ["a"], make, k=2, in_bins=True).collect()
    assert len(scored) == 5 and all((r.score > 0.5) == (r.label == 1) for r in scored)


def test_hits_leave_a_task_in_bounded_batches(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(absence, "HITS_AT_ONCE", 3)
    real, folder = absence._hits, str(tmp_path)

    def counted(text_no, no):
        open(f"{folder}/{len(no)}", "w").close()
        return real(text_no, no)

    monkeypatch.setattr(absence, "_hits", counted)
    terms = spark.createDataFrame([("pool",), ("node",)], "term string")
    texts = spark.range(20).select(F.lit("the pool of a node").alias("body")).coalesce(1)
    numbered, hits = absence.term_hits(terms, texts)
    assert hits.count() == 40 and hits.distinct().count() == 40
    assert max(int(f.name) for f in tmp_path.iterdir()) <= 4
