import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, telemetry, vectors
from lodestone.sources import estate
from lodestone.staging import stage


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "upstream_id string, downstream_id string")


def test_blast_radius_of_the_estate(spark):
    roots = spark.createDataFrame([("svc-config",), ("svc-reporting-batch",)], "root string")
    nodes = estate.services(spark).select(F.col("id").alias("node"))
    got = graph.affected(estate.dependencies(spark), roots, nodes).collect()
    hops = {(r.root, r.node): r.hops for r in got}
    assert hops == {
        ("svc-config", "svc-config"): 0, ("svc-config", "svc-edge-gateway"): 1, ("svc-config", "svc-pricing"): 1,
        ("svc-config", "svc-checkout-api"): 2, ("svc-config", "svc-catalog-api"): 2,
        ("svc-reporting-batch", "svc-reporting-batch"): 0,
    }
    with pytest.raises(KeyError):
        graph.affected(estate.dependencies(spark), spark.createDataFrame([("nobody",)], "root string"), nodes)


def test_estate_is_sound(spark):
    services, edges = estate.services(spark), estate.dependencies(spark)
    assert services.count() == 19 and edges.count() == 27
    assert graph.graph_problems(services, edges).isEmpty()
    assert graph.cyclic_core(edges).isEmpty() and graph.cycle_path(graph.cyclic_core(edges)) is None


def test_cycles_are_found_with_a_path(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "y")])
    core = graph.cyclic_core(edges)
    assert {tuple(r) for r in core.collect()} == {("b", "c"), ("c", "b")}
    assert graph.cycle_path(core) == ["b", "c", "b"]


def test_all_cycles_come_with_their_nodes_in_order(spark):
    draw = random.Random(7)
    pairs = {(draw.randrange(60), draw.randrange(60)) for _ in range(90)} | {(100 + i, 100 + (i + 1) % 37) for i in range(37)}
    core = graph.cyclic_core(edges_of(spark, [(f"n{a:03d}", f"n{b:03d}") for a, b in pairs]))
    following = {}
    for u, d in core.collect():
        following[u] = min(d, following.get(u, d))
    want = set()
    for node in following:
        for _ in following:
            node = following[node]
        path = [node]
        while following[path[-1]] != node:
            path.append(following[path[-1]])
        turn = path.index(min(path))
        want.add(tuple(path[turn:] + path[:turn]))
    got = {}
    for r in graph.cycles(core).collect():
        got.setdefault(r["cycle"], {})[r["position"]] = r["node"]
    assert {tuple(v[i] for i in range(len(v))) for v in got.values()} == want
    assert graph.cycles(graph.cyclic_core(edges_of(spark, [("a", "b")]))).count() == 0


def test_vectors_of_models_are_kept_apart(spark):
    rows = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (1, "b", [1.0])], "id long, model string, vec array<double>")
    assert {tuple(r) for r in vectors.count_by_model(rows).collect()} == {("a", 2), ("b", 1)}
    assert {tuple(r) for r in vectors.dimensions(rows).collect()} == {("a", 2), ("b", 1)}
    chunks = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert sorted(r["id"] for r in vectors.without_vector(chunks, rows, "b").collect()) == [2, 3]


def test_closure_ends_on_a_cycle(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "a")])
    got = graph.blast_radius(edges, spark.createDataFrame([("a",)], "root string")).collect()
    assert [r.node for r in got] == ["b"]


def test_problems_are_counted(spark):
    nodes = spark.createDataFrame([("a", "n"), ("a", "m"), ("b", "n")], "id string, name string")
    edges = edges_of(spark, [("a", "a"), ("a", "z"), ("a", "b"), ("a", "b")])
    got = {r.problem: r.n for r in graph.graph_problems(nodes, edges).collect()}
    assert got == {
        "duplicate id": 1, "duplicate name": 1, "unknown downstream": 1, "self edge": 1, "duplicate edge": 1
    }


@pytest.fixture(scope="module")
def points(spark):
    services, patterns = estate.services(spark), estate.patterns(spark)
    seeds = spark.sql("SELECT id AS seed, timestamp'2026-01-01 12:00:00' AS opened_at FROM range(40)")
    rows = telemetry.incidents(seeds, telemetry.candidates(services, patterns), services, patterns)
    return rows, telemetry.telemetry(telemetry.development(
        rows, estate.signals(spark), services, estate.dependencies(spark)
    ))


def pair_list():
    able = [
        (s[0], p[0]) for s in estate.rows(estate.SERVICES) for p in estate.rows(estate.PATTERNS)
        if s[4] in p[3].split()
    ]
    return sorted(able)


def test_incidents_follow_from_their_seed(points):
    for r in points[0].collect():
        assert (r.service_id, r.pattern_id) == random.Random(r.seed).choice(pair_list())
        assert r.incident_id == f"inc-{r.seed:08x}"


def test_values_follow_from_seed_service_metric_and_step(points):
    rows, sampled = points
    by_id = {r.incident_id: r for r in rows.collect()}
    levels = {
        (c[0], c[2]): (float(c[5]), float(c[6])) for c in estate.rows(estate.SIGNALS) if c[1] == "primary"
    }
    seen = 0
    for p in sampled.filter("is_primary").collect():
        incident = by_id[p.incident_id]
        step = int((p.observed_at - incident.opened_at).total_seconds() // 60) + 45
        baseline, peak = levels[p.pattern_id, p.name]
        progress = (step - 45) * 60 / 1800
        if progress <= 0:
            shape = 0.0
        elif p.pattern_id == "fault-cert-expiry":
            shape = 1.0
        elif p.pattern_id == "fault-memory-leak":
            shape = min(1.0, progress)
        else:
            shape = min(1.0, progress**0.6)
        seed = incident.seed ^ zlib.crc32(f"{p.service_id}|{p.name}|{step}".encode())
        noise = random.Random(seed).gauss(0.0, abs(peak - baseline) * 0.02 + abs(baseline) * 0.01)
        assert p.value == pytest.approx(baseline + (peak - baseline) * shape + noise, abs=1.01e-4)
        seen += 1
    assert seen > 1000


def test_window_has_76_steps_and_far_services_move_later(points):
    rows, sampled = points
    counts = sampled.groupBy("incident_id", "service_id", "name").count().select("count").distinct().collect()
    assert [r[0] for r in counts] == [76]
    contrast = telemetry.contrast(
        sampled.filter("is_primary AND name = 'http.client.p99_ms'"), ["name"], F.col("observed_at"),
        F.col("opened_at"), F.col("value"),
    ).first()
    assert contrast is None or contrast.fault_max > 10 * contrast.baseline_mean
    assert sampled.filter("hops > 0").count() > 0


def test_direct_neighbours(spark):
    edges = estate.dependencies(spark)
    assert {r.node for r in graph.upstream_of(edges, "svc-config").collect()} == {"svc-edge-gateway", "svc-pricing"}
    assert {r.node for r in graph.downstream_of(edges, "svc-pricing").collect()} == {"svc-config"}
    assert graph.lookup_one(estate.services(spark), "id", "svc-config").tier == 2
    with pytest.raises(KeyError):
        graph.lookup_one(estate.services(spark), "id", "nobody")


def test_incidents_of_a_table_of_one_split_keep_all_cores_busy(spark):
    services = stage(spark.createDataFrame(
        [("s1", "one", "jvm"), ("s2", "two", "jvm")], "id string, name string, runtime string"), "services")
    patterns = stage(spark.createDataFrame(
        [("P1", "stall", "sig", "high", ["jvm"])],
        "id string, name string, signature string, severity string, runtimes array<string>"), "patterns")
    seeds = spark.range(100).coalesce(1).select(
        F.col("id").alias("seed"), F.timestamp_micros(F.col("id")).alias("opened_at"))
    rows = telemetry.incidents(seeds, telemetry.candidates(services, patterns), services, patterns)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    picks = {r.seed: r.service_id for r in rows.collect()}
    assert picks == {s: f"s{random.Random(s).choice(range(2)) + 1}" for s in range(100)}


def test_a_seeded_value_is_that_of_a_new_generator(spark):
    got = spark.range(50).select("id", telemetry._noisy(
        F.col("id") * 2**33, F.lit(5.0), F.lit(2.0)).alias("v")).collect()
    assert all(r.v == round(5.0 + random.Random(r.id * 2**33).gauss(0.0, 2.0), 4) for r in got)


def test_seeds_of_a_batch_are_taken_together_and_give_what_each_generator_gives(spark, monkeypatch):
    draw = random.Random(3)
    seeds = [draw.randrange(-2**62, 2**62) for _ in range(300)] + [draw.randrange(2**32) for _ in range(300)]
    seeds += [0, 1, -1, 2**32 - 1, 2**32, 2**33, -(2**63), 2**63 - 1]
    want = [(g.random(), g.random()) for g in map(random.Random, seeds)]
    first, second = telemetry.first_randoms(np.array(seeds, dtype=np.int64))
    assert list(zip(first.tolist(), second.tolist(), strict=True)) == want
    want = [round(7.5 + random.Random(s).gauss(0.0, 2.5), 4) for s in seeds]

    def none(*_):
        raise AssertionError("a generator was made for a single point")

    level = [pd.Series([v] * len(seeds)) for v in (7.5, 2.5)]
    monkeypatch.setattr(telemetry.random, "Random", none)
    assert telemetry._noisy.func(pd.Series(seeds), *level).tolist() == want
    assert telemetry._noisy.func(pd.Series([], dtype="int64"), *[x[:0] for x in level]).empty
