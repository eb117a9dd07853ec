"""Pairs of texts whose five-word shingles are similar, for the near-copy stage of a pipeline.

Fingerprints within two bits hold few of the pairs whose shingle sets have a similarity of
0.8, so the stage also looks for these: minima of the shingle hashes under many orders are
cut into bands, texts that agree in a band share a bucket, and all texts of a bucket that are not
linked yet are compared by the exact similarity of their sets. With 16 bands of 6 minima a pair of
similarity 0.8 shares none with a chance under 0.01.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hand_back, map_text, raw_bytes
from lodestone.llm.components import components
from lodestone.llm.substrings import _gram_hashes
from lodestone.operators.ordered import row_numbers, running_totals
from lodestone.staging import stage

BANDS, ROWS = 16, 6
_DRAW = np.random.default_rng(20_240_501)
_FACTORS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
AT_ONCE = 1 << 18  # shingles hashed at a time
PIECE = 256  # texts compared all with all by their minima
ORDERS, LONGER = 2, 16  # a larger bucket is cut in so many orders, each by so many minima
RANGE_ROWS = 16 * PIECE  # entries of large buckets that one task numbers
CHOSEN = 2  # partners that a text of a large bucket proposes
BLOCK_BYTES = 2 << 20  # sets of a block; a larger bucket is compared block with block


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Hashes of the distinct shingles; a text with fewer words is one shingle, an empty one none."""
    parts = text.split()
    if not parts:
        return np.zeros(0, np.uint64)
    return np.unique(_gram_hashes(parts, min(words, len(parts))))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least hash of each set under each order; sets may not be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), BANDS * ROWS), dtype=np.uint64)
    for k, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
        mixed = flat * factor + shift
        least[:, k] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)
    return least


def _marked(rows: DataFrame, words: int) -> DataFrame:
    def work(part: pa.RecordBatch) -> dict:
        rids, marks, held, names, size = [], [], [], [], 0

        def flush():
            if held:
                rids.extend(names)
                marks.extend(minima(held).astype(np.uint32).view(np.int32).tolist())
                held.clear()
                names.clear()

        for rid, text in zip(part["rid"].to_pylist(), raw_bytes(part["text"]), strict=True):
            found = shingle_set(text, words)
            if len(found):
                held.append(found)
                names.append(rid)
                size += len(found)
                if size >= AT_ONCE:
                    flush()
                    size = 0
        flush()
        return {"rid": rids, "marks": marks}

    return map_text(rows.select("rid", "text"), work, "rid long, marks array<int>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    def work(part: pa.RecordBatch) -> dict:
        found = [shingle_set(t, words).view(np.int64) for t in raw_bytes(part["text"])]
        return {"rid": part["rid"], "shingles": found, "bytes": [x.nbytes for x in found]}

    return map_text(rows.select("rid", "text"), work, "rid long, shingles array<long>, bytes long")


def _shared(spots: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, rid, root, n): entries of buckets whose texts are not all linked; n texts each.
    Of buckets with the same texts one is kept."""
    if roots is None:
        spots = spots.withColumn("root", F.col("rid"))
    else:
        spots = spots.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select(
            "key", "rid", F.coalesce("root", "rid").alias("root"))
    texts = [F.bit_xor(F.xxhash64(F.lit(i), "rid")).alias(f"texts_{i}") for i in range(2)]
    sizes = spots.groupBy("key").agg(
        F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *texts)
    kept = sizes.where("low < high").groupBy("n", "texts_0", "texts_1").agg(F.min("key").alias("key"))
    return stage(spots.join(kept.select("key", "n"), "key"), "bucket-members")


def _pieces(large: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, piece, rid, marks): a bucket in as many pieces as it needs in each of ORDERS orders by
    further minima."""
    draws = [np.random.default_rng([0, d]).permutation(BANDS * ROWS)[:LONGER].tolist() for d in range(ORDERS)]
    orders = F.array(*[F.array(*[F.col("marks")[i] for i in draw]) for draw in draws])
    dealt = large.join(marks, "rid").select("key", "rid", F.posexplode(orders).alias("turned", "place"))
    placed = row_numbers(dealt, [F.col(c) for c in ("key", "turned", "place", "rid")], "no", rows_per_range=RANGE_ROWS)
    return placed.select("key", F.floor((F.col("no") - 1) / PIECE).alias("piece"), "rid").join(marks, "rid")


def partners(marks: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts each text proposes: the CHOSEN that agree with it in most minima, ``agree`` at least."""
    alike = np.count_nonzero(marks[:, None, :] == marks[None, :, :], axis=2)
    np.fill_diagonal(alike, -1)
    alike[alike < agree] = -1
    best = np.argsort(-alike, axis=1, kind="stable")[:, :CHOSEN]
    row, place = np.nonzero(np.take_along_axis(alike, best, axis=1) >= 0)
    return row, best[row, place]


def _pairs(rids: np.ndarray, row: np.ndarray, other: np.ndarray) -> pa.Table:
    sides = np.minimum(rids[row], rids[other]), np.maximum(rids[row], rids[other])
    return pa.table({"a": pa.array(sides[0], pa.int64()), "b": pa.array(sides[1], pa.int64())})


def _choices(pieces: DataFrame, agree: int) -> DataFrame:
    """(a, b): what the texts of each piece propose."""

    def proposed(part: pa.Table) -> pa.Table:
        part = part.sort_by("rid")
        minima_of = part["marks"].combine_chunks().flatten().to_numpy()
        return _pairs(part["rid"].to_numpy(), *partners(minima_of.reshape(part.num_rows, -1), agree))

    return pieces.groupBy("key", "piece").applyInArrow(proposed, "a long, b long").where("a < b").distinct()


def unlinked_similar(
    flat: np.ndarray, sizes: np.ndarray, roots: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all texts with a similarity of ``least``, ``roots`` telling which are linked already.

    ``flat`` has the shingles of all texts in turn. A text is compared with all others at once,
    until every pair of texts either was compared or is linked: texts of the largest linked group
    meet those outside it when these are compared.
    """
    numbers, code = np.unique(flat, return_inverse=True)
    shared = np.bincount(code)[code] > 1  # a shingle of one text is in no other
    owner, code = np.repeat(np.arange(len(sizes)), sizes)[shared], code[shared]
    cuts = np.searchsorted(owner, np.arange(len(sizes) + 1))
    group = np.unique(roots, return_inverse=True)[1]
    compared, held = np.zeros(len(sizes), dtype=bool), np.zeros(len(numbers), dtype=bool)
    row, other = [], []
    while True:
        outside = np.flatnonzero(~compared & (group != np.bincount(group).argmax()))
        if not outside.size:
            return np.array(row, dtype=np.int64), np.array(other, dtype=np.int64)
        i = outside[0]
        own = code[cuts[i] : cuts[i + 1]]
        held[own] = True
        both = np.bincount(owner[held[code]], minlength=len(sizes))
        held[own] = False
        compared[i] = True
        near = np.flatnonzero((both >= least * (sizes[i] + sizes - both)) & (group != group[i]))
        met, first = np.unique(group[near], return_index=True)
        row += [i] * len(met)
        other += near[first].tolist()
        group[np.isin(group, met)] = group[i]


def _blocks(entries: DataFrame) -> DataFrame:
    """(key, piece, rid, root): what is compared together, so that all texts of a bucket which are not
    linked meet in a piece of some BLOCK_BYTES.

    A bucket of two blocks at most is one piece. In a larger one the texts of its largest linked group
    need not meet each other: each block of the others meets each of theirs and every block of others.
    """
    whole = entries.groupBy("key").agg(F.sum("bytes").alias("all_bytes"))
    entries = stage(entries.join(whole, "key"), "bucket-sizes")
    fits = F.col("all_bytes") <= 2 * BLOCK_BYTES
    small = entries.where(fits).select("key", F.lit("").alias("piece"), "rid", "root")
    large = entries.where(~fits)
    if large.isEmpty():
        return small
    counts = large.groupBy("key", "root").agg(F.count("*").alias("n"))
    first = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("first"))
    sided = large.join(first, "key").select("key", "rid", "root", "bytes", (F.col("root") == F.col("first")).alias("own"))
    placed = running_totals(sided, [F.col("rid")], {"upto": F.col("bytes")}, ["key", "own"], RANGE_ROWS)
    placed = stage(placed.select("key", "rid", "root", "own", F.floor(
        (F.col("upto") - F.col("bytes")) / BLOCK_BYTES).cast("int").alias("block")), "blocks")
    ends = placed.groupBy("key").agg(
        F.max(F.when(F.col("own"), F.col("block"))).alias("own_end"),
        F.max(F.when(~F.col("own"), F.col("block"))).alias("end"))

    def name(kind: str, i: Column, j: Column) -> Column:
        return F.concat_ws("-", F.lit(kind), i.cast("string"), j.cast("string"))

    block = F.col("block")
    every, own = F.sequence(F.lit(0), F.col("end")), F.sequence(F.lit(0), F.col("own_end"))
    met = F.filter(every, lambda i: i != block)
    names = F.when(F.col("own"), F.transform(every, lambda i: name("own", i, block))).otherwise(F.concat(
        F.transform(own, lambda j: name("own", block, j)),
        F.transform(met, lambda i: name("rest", F.least(i, block), F.greatest(i, block)))))
    return small.union(placed.join(ends, "key").select("key", F.explode(names).alias("piece"), "rid", "root"))


def _marks(sets: DataFrame) -> DataFrame:
    """(rid, marks): the minima of sets that were made before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                part = batch.slice(start, PIECE)
                found = [np.asarray(x.values).view(np.uint64) for x in part["shingles"]]
                marks = minima(found).astype(np.uint32).view(np.int32).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part["rid"], pa.array(marks, pa.list_(pa.int32()))], names=["rid", "marks"])
        hand_back()

    return sets.select("rid", "shingles").mapInArrow(run, "rid long, marks array<int>")


def _unlinked_pairs(met: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between texts of buckets that were not linked yet."""

    def compared(part: pa.Table) -> pa.Table:
        part = part.sort_by("rid")
        found = part["shingles"].combine_chunks()
        row, other = unlinked_similar(
            found.flatten().to_numpy(), pa.compute.list_value_length(found).to_numpy(), part["root"].to_numpy(), least)
        made = _pairs(part["rid"].to_numpy(), row, other)
        if part.nbytes > BLOCK_BYTES // 2:
            hand_back()
        return made

    entries = met.select("key", "rid", "root").join(sets.select("rid", "bytes"), "rid")
    dealt = _blocks(entries).join(sets.select("rid", "shingles"), "rid")
    return dealt.groupBy("key", "piece").applyInArrow(compared, "a long, b long").distinct()


def similar_pairs(rows: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(a, b): verified links between rows (rid, text), written out; rid must be unique.

    Texts are linked as they are by all pairs of a bucket with a similarity of ``least``. In
    buckets of over PIECE texts each first proposes the CHOSEN texts of its piece that agree with it in
    most minima; these pairs are verified by their sets. Then all texts of all buckets that are
    not linked meet each other's sets inside tasks, so pairs never become rows: a task gives fewer
    links than it has texts. A bucket of unlinked texts takes time with the square of its size,
    but is cut in blocks of bounded bytes. Null and empty texts have no shingles and no links.
    """
    n = BANDS * ROWS
    agree = math.floor(n * least - 4 * math.sqrt(n * least * (1 - least)))
    bands = F.array(*[F.xxhash64(F.lit(k), *[F.col("marks")[k * ROWS + i] for i in range(ROWS)])
                      for k in range(BANDS)])
    banded = stage(_marked(rows, words).select("rid", bands.alias("keys")), "bands")
    met = _shared(banded.select("rid", F.explode("keys").alias("key")), None)
    texts = rows.select("rid", "text").join(met.select("rid").distinct(), "rid", "left_semi")
    sets = stage(_sets(texts, words), "shingle-sets")
    large = met.where(F.col("n") > PIECE)
    if large.isEmpty():
        return stage(_unlinked_pairs(met, sets, least), "similar-pairs")
    both = F.size(F.array_intersect("x", "y"))
    marks = stage(_marks(sets.join(large.select("rid").distinct(), "rid", "left_semi")), "minima")
    chosen = stage(_choices(_pieces(large, marks), agree), "choices")
    links = stage(chosen.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y")), "b"
    ).where(both >= least * (F.size("x") + F.size("y") - both)).select("a", "b"), "likely-pairs")
    left = _shared(met.select("key", "rid"), stage(components(links), "roots"))
    return links.union(stage(_unlinked_pairs(left, sets, least), "similar-pairs")).distinct()
