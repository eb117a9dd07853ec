"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

Bit i of the fingerprint carries a vector m(i) of radius+1 bits, never zero. Mask v keeps
the bits whose vector has odd parity with v. Any ``radius`` positions leave a v that is
orthogonal to all of their vectors, so some mask hides every differing bit: two
fingerprints within the radius always meet in one of the 2^(radius+1) - 1 tables.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_and_text, map_text, raw_bytes
from lodestone.llm.components import components
from lodestone.staging import stage

SEED = 42
_ROWS = 1 << 15


def fingerprint(text: bytes, words: int) -> int:
    """Signed 64-bit SimHash of the word shingles; zero without words."""
    parts = text.lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(len(p) + 1 for p in parts))
        starts = [0, *ends[: len(parts) - words]]
        hashes = [
            xxhash.xxh64_intdigest(joined[s : e - 1], SEED)
            for s, e in zip(starts, ends[words - 1 :], strict=True)
        ]
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), _ROWS):
        block = values[at : at + _ROWS].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def masks(radius: int, width: int = 64) -> list[int]:
    """The covering masks, as signed 64-bit numbers."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(width)]
    made = [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        for v in range(1, size + 1)
    ]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    def work(part: pa.RecordBatch) -> dict:
        return {
            "doc_id": part["doc_id"],
            "fp": [fingerprint(t, words) for t in raw_bytes(part["text"])],
        }

    return map_text(id_and_text(docs, id_col, text_col), work, "doc_id long, fp long")


def links(classes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within the radius.

    Fingerprints that share a bucket of some table move on, alone, to every value one flip
    of a hidden bit away. At most 65 distinct fingerprints meet at such a value, and any
    two of them differ in two bits at most, so a bucket of any size yields no pairs.
    """
    if radius not in (1, 2):
        raise ValueError("radius 1 or 2")
    tables = F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(m).alias("mask")) for t, m in enumerate(masks(radius))
    ])).alias("x")
    spread = classes.select("fp", tables).select(
        "fp", "x.t", "x.mask", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key")
    )
    shared = spread.groupBy("t", "key").count().where("count > 1").select("t", "key")
    met = spread.join(shared, ["t", "key"])
    bits = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    flips = F.concat(
        F.array(F.lit(0).cast("long")), F.filter(bits, lambda b: b.bitwiseAND(F.col("mask")) == 0)
    )
    centres = met.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")
    )
    groups = centres.groupBy("centre").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    if radius == 1:
        groups = groups.where(F.array_contains("fps", F.col("centre")))
        first = F.col("centre")
    else:
        first = F.array_min("fps")
    return groups.select(first.alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2
) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links of ``radius`` bits.

    Equal fingerprints are one class, counted before anything is shuffled, so thousands of
    copies are one row in the tables. Null and empty texts have fingerprint zero and link
    like others. A repeated id gives a row each; a null id keeps its row, and its component
    is the smallest other id, or null if there is none. Other columns are not read.
    """
    prints = stage(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp-classes")
    roots = components(links(classes, radius))
    joined = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classed = joined.join(smallest, "root").select("fp", "component_id")
    return prints.join(classed, "fp").select("doc_id", "fp", "component_id")
