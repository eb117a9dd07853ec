"""Periodic runs against brute force."""

import hashlib
import random
import time
import zlib

from lodestone.llm import periodic
from lodestone.llm.queries import QUERIES


def slow_runs(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            s = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 3 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(draw):
    kinds = draw.choice([1, 2, 3, 50])
    words = [str(draw.randrange(kinds)).encode() for _ in range(draw.randint(0, 150))]
    for _ in range(draw.randint(0, 3)):
        unit = [str(draw.randrange(draw.choice([1, 2, 9]))).encode() for _ in range(draw.randint(1, 20))]
        at = draw.randint(0, len(words))
        words[at:at] = (unit * draw.randint(2, 9))[: draw.randint(0, 180)]
    return words


def test_runs_equal_brute_force():
    draw = random.Random(3)
    for least in (24, 6, 3):
        for _ in range(60):
            documents = [some_words(draw) for _ in range(8)]
            assert periodic.runs(documents, least) == [slow_runs(d, least) for d in documents]


def test_many_positions_of_one_node_take_no_square_of_time():
    line = [str(i).encode() for i in range(20)]
    apart = [w for i in range(6000) for w in [*line, b"x%d" % i]]
    started = time.time()
    assert periodic.runs([[b"a"] * 100_000]) == [[(0, 100_000, 1)]]
    assert periodic.runs([apart]) == [[]]
    assert periodic.runs([line * 5000]) == [[(0, 100_000, 20)]]
    assert time.time() - started < 60


def slow_row(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(found), *best, None if not found else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
            len(words) - len(gone))


def test_query_on_awkward_rows_equals_brute_force(spark, tmp_path):
    draw = random.Random(9)
    rows = [(i, " ".join(str(draw.randrange(300)) for _ in range(draw.randint(0, 300)))) for i in range(120)]
    rows += [(7, rows[7][1]), (None, "a " * 40), (None, None), (500, ""), (501, "\x1c \xa0 \t\n\x0b a"),
             (502, "x" * 100_000), (503, "é a\n" * 400), (504, "b " * 5000)]
    spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, start string, n_runs long") \
        .repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([slow_row(*r) for r in rows], key=str)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(empty).count() == 0
