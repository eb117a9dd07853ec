"""Personal data, licences, decontamination and quality against brute force."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from lodestone.llm import decontaminate, licences, personal_data, quality

CLASH = "doc_id long, text string, rid string, base string, words string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], CLASH).repartition(3)


def slow_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0,
                "card": 16 <= len(digits) <= 19 and personal_data.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    draw = random.Random(4)
    parts = ["a", "@", ".", "-", " ", "+", "1", "22", "255", "4111 1111 1111 1111", "é", "x@y.z", "(", ")",
             "\n", "4111111111111111", "+1 (555) 123-4567", "10.0.0.1", "%", "_"]
    for _ in range(4000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 14)))
        assert personal_data.base_spans(text) == slow_spans(text), repr(text)
    assert personal_data.base_spans("1" * 100_000 + "@" * 1000) == slow_spans("1" * 19) * 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please write to me at user{i}@mail.example.com for news") for i in range(12)]
    rows += [(100, "please write to me at bob(at)mail.example.com for news")]
    rows += [(200, "the number 12345678 of nothing"), (201, None), (202, ""), (None, "x"), (100, "z")]
    found = personal_data.find(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    added = [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["added"]]) for r in found]
    assert [x for x in added if x[1]] == [(100, [("email", 22, 45)])]
    rows[12] = (100, "please write to me at bob@mail for news")
    added = [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["added"]])
             for r in personal_data.find(frame(spark, rows)).collect()]
    assert [x for x in added if x[1]] == [(100, [("email", 22, 30)])]


@pytest.mark.parametrize("written", [
    "bob(at)mail.example.com", "bob7(at)mail.example.com", "bob [at] mail.example.com", "bob @ mail", "bob@mail",
    "b" * 300 + "@mail", "bob (at)mail"])
def test_identifiers_are_found_however_they_are_written(spark, written):
    rows = [(i, f"please write to me at user{i}@mail.example.com for news") for i in range(12)]
    found = personal_data.find(frame(spark, rows + [(100, f"please write to me at {written} for news")]))
    spans = {r["doc_id"]: r["added"] for r in found.collect()}[100]
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("email", 22, 22 + len(written))]


def test_a_number_beside_an_identifier_hides_none(spark):
    rows = [(i, f"my id 7 user{i}@mail.example.com for news") for i in range(12)]
    rows += [(100, "my id 7 bob@mail for news")]
    spans = {r["doc_id"]: r["added"] for r in personal_data.find(frame(spark, rows)).collect()}[100]
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("email", 8, 16)]


def test_long_runs_of_digits_take_linear_time():
    started = time.time()
    for text in ("1" * 1_000_000, "1 " * 200_000, "1." * 200_000, "a@" * 100_000, "(at) " * 50_000):
        personal_data.mentions(text, personal_data.base_spans(text))
    assert time.time() - started < 60


def slow_graph(edges, rounds, support, confidence):
    """The scores over edges (pattern, value, fits, known, n), round by round."""
    pairs = [(p, v, k, known, n) for p, v, fits, known, n in edges for k in fits]
    total = Counter()
    for p, _, _, _, n in edges:
        total[p] += n
    score = {}
    for _, v, k, known, _ in pairs:
        score[v, k] = max(score.get((v, k), 0.0), float(known == k))
    for _ in range(rounds):
        hit, many = Counter(), Counter()
        for p, v, k, _, n in pairs:
            hit[p, k] += n * score[v, k]
            many[p, k] += score[v, k] >= confidence
        c = {x: hit[x] / total[x[0]] if many[x] >= support else 0.0 for x in hit}
        score = {}
        for p, v, k, known, _ in pairs:
            own = c[p, k] if c[p, k] >= confidence else 0.0
            score[v, k] = max(score.get((v, k), 0.0), float(known == k), own)
    return {x for x, v in c.items() if v >= confidence}


def test_pattern_scores_equal_brute_force(spark):
    draw = random.Random(11)
    for _ in range(4):
        edges = {(f"p{draw.randrange(6)}", f"v{draw.randrange(25)}"): None for _ in range(60)}
        rows = []
        for p, v in edges:
            known = draw.choice([None, "email", "phone"]) if draw.random() < 0.8 else None
            rows.append((p, v, ["email", "phone"] if known is None else personal_data.KINDS, known, draw.randint(1, 5)))
        schema = "pattern string, value string, fits array<string>, known string, n long"
        for confidence in (0.3, 0.6):
            got = personal_data.accepted_patterns(spark.createDataFrame(rows, schema), 3, 2, confidence)
            assert {tuple(r) for r in got.collect()} == slow_graph(rows, 3, 2, confidence)


def test_mixed_contexts_add_nothing(spark):
    values = ["a1@b.c", "10.1.2.3", "4111111111111111", "+1 (555) 123-4567", "55501234"]
    rows = [(i, f"seen on the {values[i % 5]} then") for i in range(50)]
    found = personal_data.find(frame(spark, rows)).collect()
    assert all(not r["added"] for r in found)


def slow_licences(text, frequencies):
    words_of = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = words_of.findall(lower)
    starts, base = [], set()
    for label, phrase in licences.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    labels, best = set(base), 0.0
    half = max(32, max(len(t.split()) for _, t in licences.TEMPLATES))
    for at in range(0, max(1, len(words) - half), half):
        block = set(words[at : at + 2 * half])
        for label, template in licences.TEMPLATES:
            t = set(template.split())
            share = len(block & t) / len(t)
            if len(block & t) >= math.ceil(0.85 * len(t) - 1e-9):
                labels.add(label)
                best = max(best, share)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else best)


def test_licences_match_brute_force(spark):
    draw = random.Random(6)
    pool = [w for _, t in licences.TEMPLATES for w in t.split()] + ["é", "x1", "Under", "MIT", "\n", "License,"]
    rows = []
    for i in range(150):
        body = [draw.choice(pool) for _ in range(draw.randint(0, 200))]
        for _ in range(draw.randint(0, 2)):
            notice = draw.choice(licences.TEMPLATES)[1].split()
            if draw.random() < 0.5:
                notice[draw.randrange(len(notice))] = "changed"
            at = draw.randint(0, len(body))
            body[at:at] = notice
        rows.append((i, " ".join(body)))
    rows += [(900, None), (901, ""), (None, "Under the MIT License. Under the MIT license"), (0, "cc by-nc"),
             (902, "word " * 5000 + "licensed under cc by nc")]
    got = licences.scan(frame(spark, rows)).collect()
    want = sorted(str((i, *slow_licences(t, None))) for i, t in rows)
    assert sorted(str(tuple(r)) for r in got) == want


def test_wrapped_and_long_notices_are_found_whole(spark):
    long = " ".join(f"clause{i}" for i in range(90))
    own = [("mit", licences.TEMPLATES[1][1]), ("long", long)]
    rows = []
    for k, (_, notice) in enumerate(own):
        for at in (0, 31, 57):
            words = ["filler"] * at + notice.split() + ["more"] * 40
            for width in (1, 7, 1000):
                lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
                rows.append((1000 * k + 10 * at + len(str(width)), "\n".join(lines)))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(frame(spark, rows), templates=own).collect()}
    assert got == {i: ("mit" if i < 1000 else "long", 1.0) for i, _ in rows}


def item(n, name, unit="km"):
    return (f"{name} drives {n} {unit} from the old harbour to the quiet village and {name} waits {n} "
            "minutes before the long way home begins again near the river")


def test_contaminated_documents(spark):
    bench = spark.createDataFrame(
        [(1, item(5, "Alice")), (2, "six short words make an item"), (3, None), (4, "too short")],
        "item_id long, text string")
    noise = " ".join(f"filler{i % 7} word{i}" for i in range(60))
    rows = [
        (10, noise + " " + item(5, "Alice") + " " + noise),
        (11, noise + "\n" + item(17, "Bruno") + " " + noise),  # other number, other name
        (12, item(17, "Bruno").replace("Bruno waits", "Carla waits")),  # one slot, two values
        (13, item(5, "Alice").upper()), (14, "x. Six short, words make an item!"), (15, noise),
        (16, None), (17, ""), (None, item(5, "Alice")), (10, noise + " " + item(5, "Alice") + " " + noise),
        (18, " ".join(item(5, "Alice").split()[:9])),
    ]
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    found = {(r["doc_id"], r["item_id"]): r for r in got}
    assert set(found) == {(10, 1), (11, 1), (13, 1), (14, 2), (None, 1)}
    assert len(got) == 5
    assert found[10, 1]["changed"] == 0 and found[11, 1]["changed"] == 4
    assert found[10, 1]["matched"] == found[10, 1]["windows"]


def test_contamination_by_shuffle_equals_broadcast(spark, monkeypatch):
    bench = spark.createDataFrame([(1, item(5, "Alice"))], "item_id long, text string")
    docs = frame(spark, [(10, item(6, "Bob")), (11, "nothing here at all to be found by anyone")])
    want = decontaminate.contaminated(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert decontaminate.contaminated(docs, bench).collect() == want != []


def test_no_python_in_decontamination(spark):
    bench = spark.createDataFrame([(1, item(5, "Alice"))], "item_id long, text string")
    plan = decontaminate.contaminated(frame(spark, [(1, "a")]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def slotted(name, number, words=30):
    text = [f"plain{i}" for i in range(words)]
    text[words // 2] = number
    return f"{name} " + " ".join(text)


def test_values_with_another_number_of_words(spark):
    bench = spark.createDataFrame(
        [(1, slotted("the", "5")), (2, slotted("a", "5", 45).replace("plain", "other")),
         (3, slotted("the", "Paris").replace("plain", "some")),
         (4, " ".join(["Ann"] + [f"long{i}" for i in range(30)] + ["Ann"] + ["near"]))],
        "item_id long, text string")
    noise = " ".join(f"filler{i % 7} word{i}" for i in range(40))
    rows = [
        (10, f"{noise} {slotted('the', '1,250')} {noise}"),
        (11, slotted("a", "3.5", 45).replace("plain", "other")),
        (12, f"{noise} {slotted('the', 'New York')}".replace("plain", "some")),
        (13, f"{noise} {slotted('the', 'a port of call')} {noise}".replace("plain", "some")),
        (14, " ".join(["Bob"] + [f"long{i}" for i in range(30)] + ["Carl"] + ["near"])),
        (15, noise), (16, " ".join(slotted("the", "1,250").split()[:9])),
    ]
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(10, 1), (11, 2), (12, 3), (13, 3), (14, 4)}
    assert len(got) == 5
    found = {r["doc_id"]: r for r in got}
    assert [found[i]["changed"] for i in (10, 11, 12, 14)] == [1, 1, 1, 0]
    assert all(found[i]["matched"] == found[i]["windows"] for i in (10, 11, 12))


def test_items_that_templates_do_not_hold(spark):
    bench = spark.createDataFrame(
        [(1, "What is 12 + 15 x 3 - 4 / 2"), (2, "Name three primes"), (3, "日本の首都はどこですか"),
         (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (5, "..."), (6, "巴黎")],
        "item_id long, text string")
    noise = " ".join(f"filler{i % 7} word{i}" for i in range(40))
    rows = [
        (10, f"{noise} what is 12 + 15 x 3 - 4 / 2? {noise}"), (11, f"{noise} What is 13 + 15 x 3 - 4 / 2"),
        (12, "Please name three primes."), (13, "Please name three large primes"),
        (14, "問題:日本の首都はどこですか。東京"), (15, "日本の首都"), (16, f"1 2 3 4 5 6 7 8 9 10 11 12 {noise}"),
        (17, "2 3 4 5 6 7 8 9 10 11 12 1 9"), (18, "7 6 5 4 3 2 1 7 6 5 4 3 2 1"), (19, "我爱巴黎"), (20, None),
    ]
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    want = {(10, 1), (12, 2), (14, 3), (16, 4), (17, 4), (19, 6)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert all(r["changed"] == 0 for r in got)


def quality_rows():
    draw = random.Random(9)
    syllables = ["the", "re", "on", "ti", "an", "ou", "ly", "en"]
    rows, labels = [], []
    for i in range(240):
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(draw.randint(5, 300))]
        good = i % 3 != 0
        rows.append((i, " ".join(words) if good else " ".join(w + "###" for w in words)))
        labels.append((i, int(good)))
    return rows, labels


def test_classifier_tells_held_out_texts(spark):
    rows, labels = quality_rows()
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = frame(spark, rows + [(900, None), (901, ""), (None, "y"), (0, "again")])
    taught = {r["__id"] for r in quality.training_rows(docs, marks, 1000, 1 << 15).collect()}
    assert taught and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in taught)
    network = quality.train(docs, marks)
    got = {r["doc_id"]: r["score"] for r in quality.with_score(docs, network).collect()}
    held = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == q for i, q in held]) >= 0.95
    assert all(0 <= s <= 1 for s in got.values())
    assert quality.with_score(docs, network).columns[-1] == "score"


def test_every_byte_reaches_the_score():
    network = quality.ByteNetwork()
    text = bytes(range(97, 122)) * 200
    for at in (0, 600, 2500, len(text) - 1):
        values, _ = quality.chunks([text])
        changed, _ = quality.chunks([text[:at] + b"~" + text[at + 1 :]])
        assert (values != changed).any()
    assert network.probabilities([b"", b"a", text]).shape == (3,)


def test_gradients_match_differences():
    network = quality.ByteNetwork()
    for k in network.w:
        network.w[k] = network.w[k].astype(np.float64)
    texts, labels = [b"some bytes " * 70, b"other", b"###"], np.array([1, 1, 0])
    _, g = network._gradients(texts, labels)
    for name, weights in network.w.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), weights.shape)
        old, step = weights[at], 1e-5
        weights[at] = old + step
        above, _ = network._gradients(texts, labels)
        weights[at] = old - step
        below, _ = network._gradients(texts, labels)
        weights[at] = old
        assert (above - below) / (2 * step) == pytest.approx(g[name][at], rel=2e-2, abs=1e-5), name


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert personal_data.find(nothing).count() == 0
    assert licences.scan(nothing).count() == 0
    assert decontaminate.contaminated(nothing, bench).count() == 0
    some = spark.createDataFrame([(1, "text of one document")], "doc_id long, text string")
    assert decontaminate.contaminated(some, bench).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.with_score(nothing, quality.train(nothing, labels)).count() == 0


def test_a_text_is_lowered_once_for_its_probes_and_odd_words_meet_their_windows(spark):
    item = "Ünit 5 KG of ٣ stones at İzmir cost ² more than ΣΑΣ paid 12 kg 7 m there today"
    texts = spark.createDataFrame([(1, f"so {item} then"), (2, "5"), (3, ""), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    wanted = decontaminate.benchmark_windows(items, 8, 5, 4)
    sizes = [tuple(r) for r in wanted.select("form", "length").distinct().collect()]
    probes = decontaminate._probes(texts.withColumn("words", F.expr(decontaminate.WORDS)), sizes)
    assert {r["probe"] for r in wanted.collect()} <= {r["probe"] for r in probes.where("doc_id = 1").collect()}
    plan = probes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "ascii(" not in plan
