"""The stages of the pipeline against brute force, each on its own input."""

import random

import public_tokenizers
import sentencepiece
from test_dedup_operators import slow_components, slow_fingerprint

import corpus_pipeline as pipeline
from lodestone.llm import near_copies
from lodestone.llm.decontaminate import contaminated
from lodestone.llm.near_copies import similar_pairs
from lodestone.staging import stage

FOLDER = "/root/testdata/sf0.001"


def slow_set(text, words=5):
    parts = (text or "").encode().split()
    n = min(words, len(parts))
    return {tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)} if parts else set()


def slow_similar(texts):
    """All pairs with a five-word similarity of 0.8 or more."""
    sets = [(i, slow_set(t)) for i, t in sorted(texts.items())]
    return [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
            if x and y and len(x & y) >= 0.8 * len(x | y)]


def smallest_of_groups(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    columns, inputs = docs.columns, {}
    for name, work in pipeline.STAGES:
        inputs[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(work(spark, docs, FOLDER), name)
        if name != "encoding":
            assert docs.columns == columns
    names = [n for n, _ in pipeline.STAGES]
    kept = {a: set(inputs[b]) for a, b in zip(names, names[1:], strict=False)}

    judged = [i for i in inputs["quality"] if i in labels]
    assert sum((i in kept["quality"]) == bool(labels[i]) for i in judged) >= 0.9 * len(judged)

    texts = inputs["exact-dedup"]
    last = {t: i for i, t in sorted(texts.items())}
    assert kept["exact-dedup"] == set(last.values())

    texts = inputs["near-dedup"]
    ids = sorted(texts)
    roots = slow_components(ids, [slow_fingerprint(texts[i]) for i in ids], 2)
    assert kept["near-dedup"] == smallest_of_groups(
        ids, [(i, r) for i, r in zip(ids, roots, strict=True)] + slow_similar(texts))

    texts = inputs["decontamination"]
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = {i for i, t in texts.items() for r in items.collect()
             if r["text"] in t and len(r["text"].split()) >= 8}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"] for r in contaminated(table, items).collect()}
    assert whole <= found and kept["decontamination"] == set(texts) - found

    reference = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pipeline.MODEL))
    for row in docs.collect():
        assert list(row["ids"]) == reference.encode(inputs["encoding"][row["doc_id"]])
    assert docs.count() == len(inputs["encoding"])


def edited(draw, words, n):
    words = list(words)
    for at in draw.sample(range(len(words)), n):
        words[at] = f"new{draw.randrange(10**6)}"
    return words


def test_verified_pairs_hold_nearly_all_similar_texts_and_no_others(spark):
    draw, texts = random.Random(5), {}
    for g in range(60):
        base = [f"w{draw.randrange(10**5)}" for _ in range(draw.randint(30, 250))]
        for n in range(draw.randint(1, 6)):
            texts[len(texts)] = " ".join(edited(draw, base, min(n, len(base) // 40)))
    common = [f"c{k}" for k in range(100)]  # a large group of near copies
    for _ in range(200):
        texts[len(texts)] = " ".join(edited(draw, common, 1))
    texts |= {len(texts): "", len(texts) + 1: None, len(texts) + 2: "a b", len(texts) + 3: "a b"}
    rows = spark.createDataFrame(list(texts.items()), "rid long, text string").repartition(4)
    want = {tuple(sorted(p)) for p in slow_similar(texts)}
    got = {tuple(r) for r in similar_pairs(rows).collect()}
    assert got <= want
    ids = sorted(texts)
    left, best = smallest_of_groups(ids, got), smallest_of_groups(ids, want)
    assert best <= left and len(ids) - len(left) >= 0.98 * (len(ids) - len(best))


def test_texts_that_stay_apart_in_large_buckets_multiply_no_entries(spark, monkeypatch):
    draw, entries, proposed = random.Random(6), [], []
    base = [f"c{k}" for k in range(100)]
    texts = {n: " ".join(edited(draw, base, 1 if n % 2 else 2)) for n in range(400)}
    texts |= {400 + n: " ".join(edited(draw, base, 3)) for n in range(100)}

    def counted(frame, label, *rest):
        made = stage(frame, label, *rest)
        if label == "bucket-members":
            entries.append(made.count())
        if label == "choices":
            proposed.append(made.count())
        return made

    monkeypatch.setattr(near_copies, "stage", counted)
    rows = spark.createDataFrame(list(texts.items()), "rid long, text string").repartition(4)
    got = {tuple(r) for r in similar_pairs(rows).collect()}
    want = {tuple(sorted(p)) for p in slow_similar(texts)}
    ids = sorted(texts)
    left, best = smallest_of_groups(ids, got), smallest_of_groups(ids, want)
    assert got <= want and best <= left and len(ids) - len(left) >= 0.98 * (len(ids) - len(best))
    assert len(left) > 50  # texts that stay apart in buckets of hundreds
    assert max(entries) == entries[0]
    assert max(proposed) <= near_copies.CHOSEN * near_copies.ORDERS * entries[0]


CLASHES = ("doc_id long, text string, rid string, row string, __score double, __dropped long, item_id long, "
           "score string, `a.b` int")


def test_rows_with_repeated_ids_none_or_clashing_columns_are_judged_one_by_one(spark, tmp_path):
    draw = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    item = "What is the sum of 12 apples and 30 pears that Anna Lee bought on market day in town"
    texts = [(3, " ".join(base)), (5, " ".join(edited(draw, base, 1))), (5, "other words stand here alone now"),
             (None, "no id " + " ".join(f"q{k}" for k in range(40))), (None, f"so {item} then"), (7, ""), (8, None),
             (9, " ".join(base)), (9, " ".join(base))]
    rows = [(i, t, "r", "w", 0.5, 1, 2, "s", 4) for i, t in texts]
    docs = spark.createDataFrame(rows, CLASHES).repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1), (7, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = stage(docs, "docs")
    scored = pipeline.keep_good(spark, docs, str(tmp_path))
    assert scored.columns == docs.columns and scored.count() <= docs.count()
    docs = stage(pipeline.keep_one_of_equals(spark, docs, str(tmp_path)), "a")
    assert sorted([(r["doc_id"], r["text"]) for r in docs.collect()], key=str) == sorted(
        [texts[1], texts[2], texts[3], texts[4], texts[6], texts[8]], key=str)
    columns = docs.columns
    docs = stage(pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path)), "b")
    docs = stage(pipeline.drop_benchmark_texts(spark, docs, str(tmp_path)), "c")
    assert docs.columns == columns
    assert sorted([(r["doc_id"], r["text"]) for r in docs.collect()], key=str) == sorted(
        [texts[1], texts[2], texts[3], texts[6]], key=str)
    assert pipeline.encode(spark, docs, str(tmp_path)).count() == 4


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = stage(spark.createDataFrame([], "doc_id long, text string"), "none")
    for name, work in pipeline.STAGES:
        docs = stage(work(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0


def test_texts_of_a_bucket_are_all_compared_whatever_pieces_and_blocks_it_is_cut_in(spark, monkeypatch):
    draw = random.Random(9)
    base = [f"c{k}" for k in range(100)]
    texts = {n: " ".join(edited(draw, base, 1 + n % 4)) for n in range(160)}
    other = [f"o{k}" for k in range(100)]
    texts |= {200 + n: " ".join(edited(draw, other, 2)) for n in range(40)}
    ids = sorted(texts)
    sets = [near_copies.shingle_set(texts[i].encode(), 5) for i in ids]
    bands = near_copies.minima(sets).astype("uint32").reshape(len(ids), near_copies.BANDS, near_copies.ROWS)
    place = {i: n for n, i in enumerate(ids)}
    alike = {tuple(sorted(p)) for p in slow_similar(texts)}
    want = {(a, b) for a, b in alike if (bands[place[a]] == bands[place[b]]).all(axis=1).any()}
    rows = spark.createDataFrame(list(texts.items()), "rid long, text string").repartition(4)
    for piece, size in ((4, 1 << 20), (4, 4000), (256, 4000)):
        monkeypatch.setattr(near_copies, "PIECE", piece)
        monkeypatch.setattr(near_copies, "BLOCK_BYTES", size, raising=False)
        got = {tuple(r) for r in similar_pairs(rows).collect()}
        assert got <= want
        assert smallest_of_groups(ids, got) == smallest_of_groups(ids, want)
    assert 40 < len(smallest_of_groups(ids, want)) < 160
