"""Repeated passages by prefix-partitioned suffix trees over sampled suffixes.

A window is ``window`` consecutive words. Of each window the ``PREFIX`` consecutive words
with the least hash, its anchor, are picked; equal windows pick equal anchors at equal
places, so every repeat has suffixes that start at a shared anchor, and only suffixes at
anchors are kept (about one word in twenty). Anchors that stand in one document only hold
no repeat and leave at once.

The other suffixes, each with the words before it that a window can reach, are divided by
their prefix. Groups of a prefix fill tasks up to a bound of rows; a prefix with more rows
than the bound is lengthened to a whole window, where its group is a single deep node. In
each group all suffixes are ranked by doubling the length of the prefix they are compared
by; equal ranks at depth ``window`` are the deep internal nodes of the group's tree, and
the smallest document below such a node tells which windows repeat an earlier document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema, column, map_text, raw_bytes
from lodestone.staging import stage

PREFIX = 10  # words of an anchor, the shortest prefix that divides suffixes
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
GROUP_ROWS = 4096


def _gram_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; one less row per missing word."""
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    total = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for j in range(size):
        total = total * _FACTOR + each[j : j + len(total)]
    return total


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(documents: list[list[bytes]], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of the anchors of each document, given as its words."""
    words = [w for d in documents for w in d]
    ends = np.cumsum([len(d) for d in documents])
    span = window - PREFIX + 1
    grams = _gram_hashes(words, PREFIX)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int32))
    if len(words) < window:
        return [nothing] * len(documents)
    bits = np.uint64(len(words).bit_length())
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least(packed, span)  # one per window, those across documents too
    out, start = [], 0
    for end in ends.tolist():
        if end - start < window:
            out.append(nothing)
        else:
            at = np.unique(least[start : end - window + 1] & ((np.uint64(1) << bits) - np.uint64(1)))
            at = at.astype(np.int64)
            out.append((grams[at].view(np.int64), (at - start).astype(np.int32)))
        start = end
    return out


def node_ranks(rows: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, node) of every suffix of the rows that has ``depth`` words.

    Equal nodes are equal first ``depth`` words. Words are numbered, then ranks of prefixes
    of twice the length come from pairs of ranks, so words are compared and not hashes.
    """
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for r in rows for w in r], dtype=np.int64)
    sizes = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    start = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[row] - start  # words from here to the end of the row
    rank, length = ids, 1
    while length < depth:
        step = min(length, depth - length)
        on = np.flatnonzero(left >= length + step)
        pair = rank[on] * (rank.max(initial=0) + 1) + rank[on + step]
        rank = np.full(len(ids), -1, dtype=np.int64)
        rank[on] = np.unique(pair, return_inverse=True)[1]
        length += step
    on = np.flatnonzero(left >= depth)
    return row[on], start[on], rank[on]


def _ranges(starts: np.ndarray, window: int) -> list[list[int]]:
    """Windows at ascending ``starts``, as ranges of words without overlaps."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    return [[int(s[0]), int(s[-1]) + window] for s in np.split(starts, cut)]


def _scan(source: DataFrame, window: int) -> DataFrame:
    """Words, a digest of them, and the distinct anchors of every document."""
    def work(part: pa.RecordBatch) -> dict:
        documents = [t.split() for t in raw_bytes(part["text"])]
        named = part["doc_id"].is_valid().to_pylist()
        found = anchors([d if ok else [] for d, ok in zip(documents, named, strict=True)], window)
        digests = [hashlib.sha256(b" ".join(d)) for d in documents]
        return {
            "doc_id": part["doc_id"], "tk": part["tk"], "n_words": [len(d) for d in documents],
            "sha": [d.hexdigest() for d in digests],
            "ck": [int.from_bytes(d.digest()[:8], "big", signed=True) for d in digests],
            "hs": [np.unique(h) for h, _ in found],
        }

    return map_text(
        source, work, "doc_id long, tk long, n_words long, sha string, ck long, hs array<long>")


def _members(partial: DataFrame, window: int) -> DataFrame:
    """A row per shared anchor: where its context stands, and a 128-bit digest of the context.

    The context is the anchor's words with as many around them as a window can reach.
    """
    before = window - PREFIX
    names = ("doc_id", "tk", "h", "start", "n", "c1", "c2")

    def work(part: pa.RecordBatch) -> dict:
        made: dict = {k: [] for k in names}
        documents = [t.split() for t in raw_bytes(part["text"])]
        keys = zip(part["doc_id"].to_pylist(), part["tk"].to_pylist(), part["hs"].to_pylist(), strict=True)
        for (doc, tk, shared), words, (hashes, spots) in zip(
            keys, documents, anchors(documents, window), strict=True
        ):
            shared = set(shared)
            for h, spot in zip(hashes.tolist(), spots.tolist(), strict=True):
                if h in shared:
                    start = max(0, spot - before)
                    near = words[start : spot + window]
                    c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(near)), "<i8").tolist()
                    for k, v in zip(names, (doc, tk, h, start, len(near), c1, c2), strict=True):
                        made[k].append(v)
        return made

    return map_text(partial, work, "doc_id long, tk long, h long, start long, n long, c1 long, c2 long")


def _contexts(partial: DataFrame) -> DataFrame:
    """(h, c1, c2, first, context): the words of the contexts that ``wanted`` names."""
    def work(part: pa.RecordBatch) -> dict:
        made: dict = {k: [] for k in ("h", "c1", "c2", "first", "context")}
        for doc, text, wanted in zip(
            part["doc_id"].to_pylist(), raw_bytes(part["text"]), part["wanted"].to_pylist(), strict=True
        ):
            words = text.split()
            for w in wanted:
                made["first"].append(doc)
                made["context"].append(b" ".join(words[w["start"] : w["start"] + w["n"]]).decode())
                for k in ("h", "c1", "c2"):
                    made[k].append(w[k])
        return made

    return map_text(partial, work, "h long, c1 long, c2 long, first long, context string")


def _tree_ranges(classes: DataFrame, window: int, group_rows: int) -> DataFrame:
    """(c1, c2, spans) for contexts with windows that an earlier document has as well.

    Whole groups of a prefix are worked on together until ``group_rows`` is reached, so a
    task holds two bounds of rows at most.
    """
    schema = "c1 long, c2 long, spans array<array<long>>"
    arrow = arrow_schema(schema)

    def judge(held: list[dict]) -> pa.RecordBatch:
        rows = [r["context"].encode().split() for r in held]
        first = np.array([r["first"] for r in held], dtype=np.int64)
        row, start, node = node_ranks(rows, window)
        least = np.full(node.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, first[row])
        hit = least[node] < first[row]
        rows_hit, starts_hit = row[hit], start[hit]  # by row, then start
        parts = np.split(starts_hit, np.flatnonzero(np.diff(rows_hit)) + 1) if len(rows_hit) else []
        spans = {
            i: _ranges(part, window)
            for i, part in zip(np.unique(rows_hit).tolist(), parts, strict=True)
        }
        return pa.RecordBatch.from_arrays([
            pa.array([held[i]["c1"] for i in spans], pa.int64()),
            pa.array([held[i]["c2"] for i in spans], pa.int64()),
            pa.array(list(spans.values()), arrow.field("spans").type)], schema=arrow)

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= group_rows and r["h"] != held[-1]["h"]:
                    yield judge(held)
                    held = []
                held.append(r)
        if held:
            yield judge(held)

    grouped = classes.repartition("h").sortWithinPartitions("h")
    return grouped.select("h", "context", "first", "c1", "c2").mapInArrow(run, schema)


def _deep_ranges(classes: DataFrame, window: int) -> DataFrame:
    """As ``_tree_ranges``, for prefixes with too many suffixes for one task: the prefix is the
    whole window, and equal windows are counted together before they are shuffled."""
    windows = classes.select(
        "c1", "c2", "first", F.split("context", " ").alias("w")
    ).select("c1", "c2", "first", F.posexplode(F.expr(
        f"transform(sequence(0, size(w) - {window}), i -> array_join(slice(w, i + 1, {window}), ' '))"
    )).alias("at", "words"))
    # Written out, so that the join below reads two exchanges and a hot window can be split.
    least = stage(
        windows.groupBy("words").agg(F.min("first").alias("least"), F.max("first").alias("most"))
        .where("least < most").select("words", "least"), "deep-nodes")
    found = windows.join(least, "words").where("least < first")
    return found.groupBy("c1", "c2").agg(F.collect_list(
        F.array(F.col("at").cast("long"), (F.col("at") + window).cast("long"))).alias("spans"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``.

    Words are runs of characters other than ASCII white space. A word goes if a window over
    it also starts in a document with a smaller id; all windows are judged on the input.
    Documents whose words are all those of a smaller id are told by a digest and lose
    everything if they have a window. Null and empty texts have no words; a document
    without an id keeps its words and marks no others; repeated rows are judged alike.
    ``kept_sha256`` is that of the kept words joined by single spaces. Other columns are
    not read.
    """
    if window < PREFIX + 1:
        raise ValueError(f"window over {PREFIX} words")
    source = docs.select(
        column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text")
    ).withColumn("tk", F.xxhash64("text"))
    scanned = stage(_scan(source, window), "anchors")
    twins = stage(
        scanned.where(f"n_words >= {window} and doc_id is not null").groupBy("sha").agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last").select("sha", "first"), "twins")
    copies = stage(
        scanned.select("doc_id", "tk", "sha").join(twins, "sha").where("first < doc_id")
        .select("doc_id", "tk").distinct(), "twin-copies")
    spots = scanned.select("doc_id", "tk", "ck", F.explode("hs").alias("h"))
    shared = stage(
        spots.groupBy("h").agg(F.min("ck").alias("a"), F.max("ck").alias("b")).where("a < b").select("h"),
        "shared-anchors")
    places = spots.select("doc_id", "tk", "h").join(shared, "h").groupBy("doc_id", "tk").agg(
        F.collect_set("h").alias("hs")  # no more than the document's words
    ).join(copies, ["doc_id", "tk"], "left_anti")
    partial = stage(source.join(places, ["doc_id", "tk"]), "partial-repeats")

    members = stage(_members(partial, window).where(f"n >= {window}"), "anchor-members")
    classes = stage(
        members.groupBy("h", "c1", "c2", "n").agg(
            F.min(F.struct("doc_id", "tk", "start")).alias("first")), "contexts")
    sizes = classes.groupBy("h").count().where("count > 1")  # one context alone repeats itself only
    wanted = classes.join(sizes, "h").groupBy("first.doc_id", "first.tk").agg(
        F.collect_list(F.struct("h", "c1", "c2", "n", F.col("first.start").alias("start"))).alias("wanted"))
    contexts = _contexts(partial.select("doc_id", "tk", "text").dropDuplicates(["doc_id", "tk"]).join(
        wanted, ["doc_id", "tk"]))
    hot = stage(sizes.where(f"count > {group_rows}").select("h"), "hot-prefixes")
    if hot.isEmpty():
        spans = _tree_ranges(contexts, window, group_rows)
    else:
        contexts = stage(contexts, "context-words")
        spans = _tree_ranges(contexts.join(hot, "h", "left_anti"), window, group_rows).unionByName(
            _deep_ranges(contexts.join(hot, "h"), window))
    known = classes.groupBy("c1", "c2").agg(F.min("first.doc_id").alias("first"))
    judged = known.join(spans.groupBy("c1", "c2").agg(
        F.flatten(F.collect_list("spans")).alias("spans")), ["c1", "c2"], "left")
    gone = members.join(stage(judged, "judged-contexts"), ["c1", "c2"]).select(
        "doc_id", "tk", F.explode(F.expr(
            "if(doc_id > first, array(array(start, start + n)), "
            "transform(spans, x -> transform(x, y -> y + start)))")).alias("x"))
    cuts = gone.groupBy("doc_id", "tk").agg(F.collect_set("x").alias("cuts"))
    cut = stage(_cut(partial.select("doc_id", "tk", "text").join(cuts, ["doc_id", "tk"])).distinct(), "cut")

    empty = hashlib.sha256(b"").hexdigest()
    whole = copies.join(
        scanned.select("doc_id", "tk", "n_words").distinct(), ["doc_id", "tk"]
    ).select("doc_id", "tk", F.col("n_words").alias("removed"), F.lit(empty).alias("kept_sha"))
    changed = cut.unionByName(whole)
    return scanned.select("doc_id", "tk", "n_words", "sha").join(changed, ["doc_id", "tk"], "left").select(
        "doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def _cut(texts: DataFrame) -> DataFrame:
    def work(part: pa.RecordBatch) -> dict:
        removed, shas = [], []
        for text, cuts in zip(raw_bytes(part["text"]), part["cuts"].to_pylist(), strict=True):
            words = text.split()
            gone = np.zeros(len(words), dtype=bool)
            for start, end in cuts:
                gone[start:end] = True
            removed.append(int(gone.sum()))
            kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return {"doc_id": part["doc_id"], "tk": part["tk"], "removed": removed, "kept_sha": shas}

    return map_text(texts, work, "doc_id long, tk long, removed long, kept_sha string")
