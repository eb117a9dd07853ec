"""Exact, near and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import xxhash

from lodestone.llm import exact, simhash, substrings
from lodestone.llm.components import components

SCHEMA = "doc_id long, text string, keep_id string, row string, rid string, fp string, `group` string"


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame(
        [(i, t, "a", "b", "c", "d", "e") for i, t in rows], SCHEMA).repartition(parts)


def awkward_rows():
    draw = random.Random(3)
    rows = [(i, "a" * draw.randint(0, 900)) for i in range(30)]
    rows += [(100 + i, "same text " * 200) for i in range(40)]
    rows += [(200 + i, "same text " * 200 + "x") for i in range(3)]
    return rows + [(300, None), (301, ""), (None, "a"), (None, "only here"), (302, ""), (302, "")]


def test_exact_dedup_groups(spark):
    rows = awkward_rows()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for bound in (1 << 24, 50):  # the small bound splits over many rounds
        got = exact.mark_duplicates(frame(spark, rows), group_bytes=bound, with_text=True).collect()
        assert len(got) == len(rows)
        for r in got:
            ids = groups[r["text"] or ""]
            best = max((i for i in ids if i is not None), default=None)
            assert (r["keep_id"], r["group_size"]) == (best, len(ids))
            assert not r["kept"] or r["row"]["doc_id"] == best
        assert sum(r["kept"] for r in got) == len(groups)
    kept = exact.exact_dedup(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "row", "rid", "fp", "group"]
    assert kept.count() == len(groups)


def test_radix_groups_compare_whole_texts():
    texts = [b"x" * n for n in (0, 7, 8, 9, 7, 0, 5000, 5000)] + [b"x" * 4999 + b"y"]
    found = sorted(sorted(g) for g in exact.radix_groups(texts))
    assert found == [[0, 5], [1, 4], [2], [3], [6, 7], [8]]


def slow_fingerprint(text, words=3):
    parts = (text or "").encode().lower().split()
    grams = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, radius):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[root(a)] = root(b)
    members = {}
    for i, x in enumerate(ids):
        members.setdefault(root(i), []).append(x)
    return [min((x for x in members[root(i)] if x is not None), default=None) for i in range(len(ids))]


def test_masks_cover_every_pair_of_bits():
    tables = simhash.masks(2)
    assert len(tables) == 7
    for a in range(64):
        for b in range(a, 64):
            flipped = 1 << a | 1 << b
            assert any(not m & flipped for m in tables)


def test_near_duplicates_match_brute_force(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [draw.choice(words) for _ in range(draw.choice((1, 2, 3, 60, 400)))]
        for copy in range(draw.randint(1, 3)):
            text = list(base)
            if copy and len(text) > 50:
                text[draw.randrange(len(text))] = "CHANGED"
            rows.append((1000 - 10 * i - copy, " ".join(text)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), rows[1]]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    want = slow_components([i for i, _ in rows], prints, 2)
    expected = sorted(
        (str(i), p - (1 << 64) if p >> 63 else p, str(c))
        for (i, _), p, c in zip(rows, prints, want, strict=True))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == expected


def test_links_of_crowded_fingerprints(spark):
    draw = random.Random(8)
    prints = {0}
    for _ in range(150):
        x = draw.choice(sorted(prints))
        for _ in range(draw.randint(1, 3)):
            x ^= 1 << draw.randrange(64)
        prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    for radius in (1, 2):
        edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius)
        assert all((a ^ b).bit_count() <= radius or ((a ^ b) & (2**64 - 1)).bit_count() <= radius
                   for a, b in edges.collect())
        found = {r["node"]: r["root"] for r in components(edges).collect()}
        want = slow_components(signed, [p & (2**64 - 1) for p in signed], radius)
        assert [found.get(p, p) for p in signed] == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def slow_repeats(rows, window):
    documents = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in documents:
        for s in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in documents:
        gone = set()
        for s in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((str(i), len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def repeat_rows():
    draw = random.Random(11)
    words = [f"é{i}" for i in range(500)]

    def some(n):
        return [draw.choice(words) for _ in range(n)]

    passage, short = some(70), some(30)
    rows = []
    for i in range(40):
        body = some(draw.randint(0, 120))
        for _ in range(draw.randint(0, 2)):
            at, cut = draw.randint(0, len(body)), draw.randint(0, 20)
            body[at:at] = passage[cut:] if draw.random() < 0.7 else short
        rows.append((draw.randint(0, 10**6), " ".join(body)))
    rows += [(10**7 + i, "Und " * 80) for i in range(3)] + [(10**7 + 9, "x " * 60 + "Und " * 70)]
    rows += [rows[5], (10**8, rows[6][1] + "\n"), (10**8, rows[7][1]), (None, rows[8][1])]
    return rows + [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "one")]


def test_repeated_passages_match_brute_force(spark):
    rows = repeat_rows()
    for window, bound in ((50, 4096), (20, 3), (11, 1)):  # small bounds lengthen prefixes
        got = substrings.remove_repeats(frame(spark, rows), window=window, group_rows=bound).collect()
        assert sorted((str(a), b, c, d) for a, b, c, d in got) == slow_repeats(rows, window)


def test_equal_windows_pick_equal_anchors():
    draw = random.Random(2)
    shared = [str(draw.randrange(50)).encode() for _ in range(50)]
    for _ in range(20):
        a = [str(draw.randrange(9)).encode() for _ in range(draw.randint(0, 99))]
        b = [str(draw.randrange(9)).encode() for _ in range(draw.randint(0, 99))]
        (ha, pa), (hb, pb) = substrings.anchors([a + shared + a, b + shared + b], 50)
        in_a = {(int(h), int(p) - len(a)) for h, p in zip(ha, pa, strict=True)}
        in_b = {(int(h), int(p) - len(b)) for h, p in zip(hb, pb, strict=True)}
        assert any(0 <= p <= 40 for _, p in in_a & in_b)


def test_node_ranks_number_equal_prefixes():
    rows = [[b"a", b"b", b"c", b"a", b"b", b"c"], [b"b", b"c", b"a"], [b"c"]]
    row, start, node = substrings.node_ranks(rows, 3)
    found = {}
    for r, s, n in zip(row, start, node, strict=True):
        found.setdefault(int(n), set()).add(tuple(rows[r][s : s + 3]))
    assert all(len(v) == 1 for v in found.values())
    assert len(found) == len({tuple(r[s : s + 3]) for r in rows for s in range(len(r) - 2)})
    assert len(row) == 5 and isinstance(node, np.ndarray)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert exact.mark_duplicates(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert substrings.remove_repeats(nothing).count() == 0
