import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.text import char_ngrams, tokenize
from lodestone.operators import dense, evidence, hybrid, lexical, rerank, topk_blocks, two_level
from lodestone.staging import stage

DOCS = [
    (0, "The connection pool db.pool.wait_ms climbs when callers hold connections too long. Wait 40 ms."),
    (1, "Consumer lag grows while throughput falls; the stream falls behind its producers."),
    (2, "Cache eviction empties the working set and every request misses the cache at once."),
    (3, "Consumer lag grows while throughput falls; the stream falls behind its producers."),
    (4, ""),
    (5, "pool pool pool pool"),
]
QUERIES = [(10, "pool wait pool"), (11, "why does consumer lag grow"), (12, "zzz unknown"), (13, "cache")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string")


@pytest.fixture(scope="module")
def index(docs):
    return hybrid.build_index(docs, dense.HashingEmbedder())


def words(spark, rows):
    df = spark.createDataFrame(rows, "i long, text string")
    return {r[0]: r[1] for r in df.select("i", tokenize(F.col("text"))).collect()}


def brute_bm25(spark):
    tokens, asked = words(spark, DOCS), words(spark, QUERIES)
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    out = {}
    for q, qt in asked.items():
        for d, ts in tokens.items():
            tf, total = Counter(ts), 0.0
            for t in qt:
                if tf[t]:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    total += idf * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg))
            if total > 0:
                out[q, d] = total
    return out


def brute_vector(tokens):
    counts = Counter()
    for t in tokens:
        counts[t] += 1
        grams = [t] if len(t) <= 4 else [f"^{t}$"[i : i + 4] for i in range(len(t) - 1)]
        counts.update(grams)
    v = np.zeros(C.DIM)
    for f, n in counts.items():
        h = zlib.crc32(f.encode())
        v[h % C.DIM] += (1 if h >> 16 & 1 else -1) * (1 + math.log(n))
    norm = np.linalg.norm(v)
    return v / norm if norm else v


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_bm25_equals_brute_force_for_any_query_block(spark, docs, queries, block, monkeypatch):
    monkeypatch.setattr(lexical, "scan_with_blocks", lambda *a: topk_blocks.scan_with_blocks(*a, block))
    got = lexical.bm25_top_k(lexical.token_index(docs), queries, 10).collect()
    want = brute_bm25(spark)
    assert {(r.query_id, r.doc_id): r.score for r in got} == {k: round(v, 6) for k, v in want.items()}
    ranks = [(r.doc_id, r["rank"]) for r in got if r.query_id == 11]
    assert ranks == [(1, 1), (3, 2)] or sorted(ranks, key=lambda x: x[1]) == [(1, 1), (3, 2)]


def test_bm25_cuts_to_k_and_slices_do_not_matter(docs, queries, monkeypatch):
    monkeypatch.setattr(topk_blocks, "SLICE", 2)
    got = lexical.bm25_top_k(lexical.token_index(docs), queries, 1).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {(10, 5), (11, 1), (13, 2)}


def test_vectors_equal_brute_force(spark, docs):
    got = {r.doc_id: np.array(r.vec) for r in dense.HashingEmbedder().embed(docs).collect()}
    for d, tokens in words(spark, DOCS).items():
        assert np.allclose(got[d], brute_vector(tokens), atol=1e-12)
    assert not got[4].any()


def test_neighbours_equal_numpy_with_ties_and_without_self(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8))
    vectors[40:] = vectors[7]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = frame.filter("id < 9").withColumnRenamed("id", "query_id")
    got = dense.exact_neighbours(frame, asked, 5, exclude_self=True).collect()
    scores = np.round(vectors @ vectors.T, 6)
    for q in range(9):
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-scores[q, i], i))[:5]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == order


def test_two_level_lists_visiting_all_are_exact_even_when_split(spark, monkeypatch):
    monkeypatch.setattr(two_level, "ROWS_PER_CELL", 7)
    monkeypatch.setattr(two_level, "QUERIES_PER_CELL", 2)
    rng = np.random.default_rng(2)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(250, 6)))]
    frame = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = frame.filter("id % 25 = 0").withColumnRenamed("id", "query_id")
    truth = dense.exact_neighbours(frame, asked, 4)
    for fitted in (True, False):
        lists = two_level.TwoLevelLists(frame, 10, fitted)
        assert lists.members.count() == 250 and lists.lists > 10
        found = lists.search(asked, 4, probes=1000)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, truth.collect()))
    row = dense.recall_and_distance(found, truth, 4).first()
    assert row["recall"] == 1.0 and row["distance_ratio"] == pytest.approx(1.0)


def test_calibrated_lists_reach_the_recall_and_skip_most_lists(spark):
    owners = spark.range(20_000)
    frame = stage(dense.clustered_vectors(owners, "id", dim=32, clusters=400, sigma=0.06), "clustered")
    lists = two_level.TwoLevelLists(frame, 50)
    assert lists.calibrate(dense.exact_neighbours, 10, target=0.95) >= 0.95
    assert lists.probes <= 0.2 * lists.lists
    asked = frame.filter("id % 50 = 7").withColumnRenamed("id", "query_id")
    truth = stage(dense.exact_neighbours(frame, asked, 10), "truth")
    row = dense.recall_and_distance(lists.search(asked, 10), truth, 10).first()
    assert row["recall"] >= 0.9
    compared, pairs = lists.rows_visited(asked).first()
    assert compared <= 0.2 * pairs
    visited = lists.list_order(asked.limit(3), two_level.OPENED, lists.probes)
    plan = lists.members.where(F.col("coarse").isin([r[0] for r in visited.select("coarse").distinct().collect()]))
    assert "PartitionFilters: [isnotnull(coarse" in plan._jdf.queryExecution().toString() or \
        "PartitionFilters: [coarse" in plan._jdf.queryExecution().toString()


def test_unequal_dimensions_are_an_error(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="dimension mismatch"):
        frame.select(dense.dot(F.col("a"), F.col("b"))).collect()


def test_generated_vectors_do_not_depend_on_partitions(spark):
    owners = spark.range(20)
    one = dense.clustered_vectors(owners.repartition(1), "id", dim=6, clusters=3)
    many = dense.clustered_vectors(owners.repartition(5), "id", dim=6, clusters=3)
    assert sorted(map(tuple, [(r.id, tuple(r.vec)) for r in one.collect()])) == sorted(
        (r.id, tuple(r.vec)) for r in many.collect()
    )


def test_fusion_equals_brute_force(spark, index, queries):
    got = hybrid.search(index, queries, dense.HashingEmbedder(), k=6).collect()
    lex, asked, tokens = brute_bm25(spark), words(spark, QUERIES), words(spark, DOCS)
    for q, qt in asked.items():
        cos = {d: float(brute_vector(qt) @ brute_vector(t)) for d, t in tokens.items()}
        raw = {d: lex.get((q, d), 0.0) for d in tokens}
        top_l, top_c = max(raw.values()), max(max(cos.values()), 0.0)
        fused = {
            d: round(0.6 * (raw[d] / top_l if top_l else 0) + 0.4 * (max(cos[d], 0) / top_c if top_c else 0), 6)
            for d in tokens
        }
        order = sorted((d for d in fused if fused[d] > 0), key=lambda d: (-fused[d], d))[:6]
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.doc_id for r in rows] == order
        assert all(r.score == pytest.approx(fused[r.doc_id], abs=2e-6) and not r.degraded for r in rows)


def test_another_model_is_a_miss_not_a_comparison(index, queries):
    class Other(dense.HashingEmbedder):
        model = "other"

    hits = hybrid.search(index, queries, Other()).collect()
    assert hits and all(r.degraded and r.dense_score == 0.0 for r in hits)
    assert {r.score for r in hits if r["rank"] == 1} == {1.0}


def test_verdict_order_and_edges(spark):
    rows = [
        # hits, coverage, degraded, combined, demands, present
        (0, 1.0, False, 99.0, False, False, "insufficient"),
        (3, 0.29, False, 99.0, False, False, "insufficient"),
        (3, 0.30, True, 0.0, False, False, "ambiguous"),
        (3, 0.30, False, 0.7399, False, False, "insufficient"),
        (3, 0.30, False, 0.74, False, False, "ambiguous"),
        (3, 0.30, False, 10.38, False, False, "sufficient"),
        (3, 0.30, False, 10.38, True, False, "ambiguous"),
        (3, 0.30, False, 10.38, True, True, "sufficient"),
    ]
    df = spark.createDataFrame(
        rows, "hit_count int, term_coverage double, degraded boolean, combined double, "
        "demands_value boolean, value_present boolean, want string",
    )
    assert all(r.v == r.want for r in df.select("want", evidence.verdict().alias("v")).collect())


def test_top_dense_is_the_maximum_and_top_lexical_the_first(spark, docs):
    hits = spark.createDataFrame(
        [(1, 1, 0, 1.0, 9.0, 0.1, False), (1, 2, 1, 0.9, 4.0, 0.8, False)],
        "query_id long, rank int, doc_id long, score double, lexical_score double, dense_score double, degraded boolean",
    )
    asked = spark.createDataFrame([(1, "pool rate"), (2, "nothing here")], "query_id long, text string")
    rows = {r.query_id: r for r in evidence.features(asked, hits, docs).collect()}
    assert rows[1].combined == pytest.approx(0.8 * 9.0)
    assert rows[1].dense_margin == pytest.approx(-0.7)
    assert rows[1].lexical_margin == 5.0 and rows[1].value_present == 1.0
    assert rows[1].score_entropy == pytest.approx(-(9 / 13 * math.log(9 / 13) + 4 / 13 * math.log(4 / 13)))
    assert rows[2].hit_count == 0 and rows[2].score_entropy == 0.0
    verdicts = {r.query_id: r.verdict for r in evidence.assess(asked, hits, docs).collect()}
    assert verdicts[2] == "insufficient"


def test_rerank_keeps_first_order_on_ties(spark, docs, queries):
    hits = spark.createDataFrame([(11, 1, 3), (11, 2, 1), (11, 3, 2)], "query_id long, rank int, doc_id long")
    got = rerank.rerank(hits, queries, docs, rerank.OverlapScorer(), 2).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [3, 1]


def test_short_tokens_count_twice(spark):
    df = spark.createDataFrame([("rate",)], "t string")
    assert df.select(char_ngrams(F.col("t"))).first()[0] == ["rate"]
    assert brute_vector(["rate"]).any()


def test_embedding_needs_no_shuffle(spark):
    """Of a scan with many splits; one with fewer than cores is spread first."""
    docs = spark.range(0, 50, 1, 16).selectExpr("id as doc_id", "concat('payments-api latency p', id) as text")
    plan = dense.hashed_weights(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_many_query_blocks_give_one_answer(spark, monkeypatch):

    vectors = dense.clustered_vectors(spark.range(200), "id", dim=16, clusters=5)
    asked = vectors.withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, dense.exact_neighbours(vectors, asked, 3).collect()))
    monkeypatch.setattr(topk_blocks, "CARRIED", 1)
    monkeypatch.setattr(topk_blocks, "PIECE", 32)
    monkeypatch.setattr(topk_blocks, "SLICE", 8)
    monkeypatch.setattr(topk_blocks.scan_with_blocks, "__defaults__", (30,))
    found = dense.exact_neighbours(vectors, asked, 3)
    assert sorted(map(tuple, found.collect())) == want


def test_centres_that_come_first_by_digest_are_picked_from_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(two_level, "SAMPLE", 20)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, vec array<double>")
    lists = two_level.TwoLevelLists(frame, 10, fitted=False)
    first = sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())[: math.ceil(math.sqrt(20))]
    assert np.array_equal(lists.coarse, np.array([vec for _, vec in first]))


def test_a_text_that_many_queries_hit_is_lowered_and_searched_once(spark, docs, queries, index):
    hits = stage(hybrid.search(index, queries, dense.HashingEmbedder()), "hits")
    plan = evidence.signals(queries, hits, docs)._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.splitlines() if "found#" in line and "filter(terms" in line]
    assert read and not any("lower(text" in line or "RLIKE" in line.upper() for line in read)


def test_a_task_holds_one_block_of_queries_at_a_time(spark):
    class Held:
        now = most = 0

        def __init__(self):
            Held.now += 1
            Held.most = max(Held.most, Held.now)

        def __del__(self):
            Held.now -= 1

    class Task:
        asked = None

        def load(self, block):
            self.asked = Held()

        def add(self, part):
            pass

        def rows(self):
            return pa.RecordBatch.from_arrays([pa.array([Held.most])], names=["most"])

    asked = spark.range(35).withColumnRenamed("id", "query_id")
    found = topk_blocks.scan_with_blocks(spark.range(0, 9, 1, 1), asked, Task, "most long", 10)
    assert {r.most for r in found.collect()} == {1}


def test_blocks_of_queries_are_whole_bounded_and_cut_without_sorting_vectors(spark):
    rows = [(i // 2, [float(i)]) for i in range(100)]  # ids may repeat
    asked = spark.createDataFrame(rows, "query_id long, vec array<double>")
    folder, names = topk_blocks.written_blocks(asked, 7)
    blocks = [topk_blocks.read_block(folder, name) for name in names]
    assert max(b.num_rows for b in blocks) <= 7 and len(blocks) > 14
    assert sorted(v[0] for b in blocks for v in b["vec"].to_pylist()) == [float(i) for i in range(100)]
    assert topk_blocks.written_blocks(asked.limit(0), 7)[1] == []


def test_words_of_many_queries_and_of_few_are_scored_alike(monkeypatch):
    rng = np.random.default_rng(3)
    asked = [sorted({f"w{w}" for w in rng.zipf(1.3, 12) if w < 400}) for _ in range(90)]
    texts = [[f"w{w}" for w in rng.zipf(1.3, n) if w < 400] for n in (0, 5, 80, 300)]
    block = pa.table({"terms": pa.array(asked, pa.list_(pa.string())),
                      "weights": pa.array([[1.0 + len(t) for t in q] for q in asked], pa.list_(pa.float64()))})
    monkeypatch.setattr(lexical, "CELLS", 50)
    got = lexical.LexicalBlock(block, 20.0)
    assert 0 < got.common.shape[1] < len(got.vocabulary)
    want = np.zeros((90, 4))
    for q, d in np.ndindex(90, 4):
        counts = Counter(texts[d])
        want[q, d] = sum(
            (1.0 + len(t)) * counts[t] * 2.5 / (counts[t] + 1.5 * (0.25 + 0.75 * len(texts[d]) / 20.0))
            for t in asked[q] if counts[t])
    assert np.allclose(got.scores(pa.array(texts, pa.list_(pa.string()))), want, atol=1e-9)


def test_features_cut_at_once_are_those_of_each_word():
    words = ["a", "ab", "abc", "abcd", "xabcdx", "abcde", "bcde", "^abc", "abc$", "ünïcödé", "日本語日本語"]
    lengths, which, digests = dense.token_features(words)
    parts = np.split(which, np.cumsum(lengths)[:-1])
    numbers = {}
    for word, part in zip(words, parts, strict=True):
        padded = f"^{word}$"
        want = [word, word] if len(word) <= C.NGRAM else [word] + [
            padded[i : i + C.NGRAM] for i in range(len(padded) - C.NGRAM + 1)]
        assert [int(d) for d in digests[part]] == [zlib.crc32(f.encode()) for f in want]
        for number, feature in zip(part.tolist(), want, strict=True):
            assert numbers.setdefault(number, feature) == feature
    assert len(set(numbers.values())) == len(numbers)  # equal features have one number


def test_a_task_holds_pieces_of_bounded_bytes_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(topk_blocks, "SLICE", 8)
    monkeypatch.setattr(topk_blocks, "PIECE_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(100), pa.int64()), "t": ["x" * 50] * 100})
    held = list(topk_blocks.pieces(iter([batch])))
    assert sum(p.num_rows for piece in held for p in piece) == 100
    assert max(sum(p.nbytes for p in piece) for piece in held) < 2000
    key, before = topk_blocks.BATCH_KEY, spark.conf.get(topk_blocks.BATCH_KEY)
    try:
        for given, kept in (("10000", str(topk_blocks.BATCH_ROWS)), ("0", str(topk_blocks.BATCH_ROWS)), ("100", "100")):
            spark.conf.set(key, given)
            topk_blocks.small_batches(spark)
            assert spark.conf.get(key) == kept
    finally:
        spark.conf.set(key, before)


def test_vectors_and_word_lists_of_queries_are_never_sent_whole_to_all_tasks(spark, docs, queries, index, monkeypatch):
    plans = {}

    def kept(frame, label, *rest):
        plans[label] = frame._jdf.queryExecution().executedPlan().toString()
        return stage(frame, label, *rest)

    monkeypatch.setattr(hybrid, "stage", kept)
    monkeypatch.setattr(evidence, "stage", kept)
    hits = hybrid.search(index, queries, dense.HashingEmbedder())
    judged = evidence.signals(queries, hits, docs)
    words = "array_distinct"  # the plan of the top hits makes them
    assert "MapInArrow" in plans["asked"] and "BroadcastHashJoin [query_id" not in plans["asked"].split("MapInArrow")[0]
    assert words in plans["top-hits"] and "Broadcast" not in plans["top-hits"]
    read = judged._jdf.queryExecution().executedPlan().toString()
    assert not any("Broadcast" in line and "terms" in line for line in read.splitlines())
    assert sorted(r["query_id"] for r in judged.collect()) == [q[0] for q in QUERIES]
