"""Which terms stand in which texts, by a multi-pattern automaton.

All distinct terms are written in shards of bounded size. A task reads the shards one after
the other, builds an automaton of each and runs its texts through it once, so a text is read
once per shard and not once per term, and the plan is the same for any number of terms. What
leaves a task are (text, term) numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import row_numbers
from lodestone.operators.topk_blocks import hand_back, small_batches
from lodestone.staging import new_path, stage

SHARD = 50_000  # terms of one automaton
HELD_BYTES = 16 << 20  # text held while the shards pass by; a longer text is held alone
HITS_AT_ONCE = 100_000  # numbers that leave a task together


def _automaton(folder: str, number: int):
    import ahocorasick

    filesystem, path = fs.FileSystem.from_uri(f"{folder}/shard={number}")
    table = pq.read_table(path, filesystem=filesystem, partitioning=None)
    built = ahocorasick.Automaton()
    for term, no in zip(table["term"].to_pylist(), table["no"].to_pylist(), strict=True):
        built.add_word(term, no)
    built.make_automaton()
    return built


def term_hits(terms: DataFrame, texts: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``(numbered(no, term), hits(text_no, no))`` of ``terms(term)`` that ``texts(body)`` hold.

    A term occurs as a substring, as it is written. Empty and null terms are left out. The
    number of a text means nothing beyond these hits.
    """
    spark = terms.sparkSession
    distinct = terms.select("term").where("term <> ''").distinct()
    numbered = stage(row_numbers(distinct, [F.col("term")], "no"), "terms")
    n = numbered.count()
    folder = new_path(spark, "term-shards")
    numbered.select("term", "no", F.floor((F.col("no") - 1) / shard).alias("shard")).repartition(
        "shard").write.partitionBy("shard").parquet(folder)
    shards = -(-n // shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _automaton(folder, 0) if shards == 1 else None
        for piece in _pieces(batches):
            for number in range(shards):
                automaton = only or _automaton(folder, number)
                text_no, no = [], []
                for at, body in piece:
                    found = {value for _, value in automaton.iter(body)}
                    text_no += [at] * len(found)
                    no += found
                    if len(no) >= HITS_AT_ONCE:
                        yield _hits(text_no, no)
                        text_no, no = [], []
                yield _hits(text_no, no)
        del only
        hand_back()

    small_batches(spark)
    bodies = texts.select(F.monotonically_increasing_id().alias("text_no"), F.col("body"))
    hits = bodies.where("body is not null").mapInArrow(run, "text_no long, no long")
    return numbered, stage(hits, "term-hits")


def _hits(text_no: list[int], no: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(text_no, pa.int64()), pa.array(no, pa.int64())], names=["text_no", "no"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for batch in batches:
        for at, body in zip(batch["text_no"].to_pylist(), batch["body"].to_pylist(), strict=True):
            held.append((at, body))
            size += len(body)
            if size >= HELD_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def stated(topics: DataFrame, chunks: DataFrame, shard: int = SHARD) -> DataFrame:
    """``topic`` of those ``topics(topic, terms)`` whose terms all occur in some one chunk body.

    Bodies are lowered, terms are taken as they are. The texts that hold a topic's rarest term
    are looked at for its other terms, by counting. A topic without terms is stated if there
    is any chunk; one with a null term is not.
    """
    topics = stage(topics.select("topic", "terms").distinct().withColumn(
        "topic_no", F.monotonically_increasing_id()), "topics")
    wanted = topics.where("not exists(terms, t -> t is null)").select(
        "topic_no", F.expr("filter(array_distinct(terms), t -> t <> '')").alias("terms"))
    each = wanted.select("topic_no", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    numbered, hits = term_hits(each, chunks.select(F.lower("body").alias("body")), shard)
    spread = stage(hits.groupBy("no").agg(F.count("*").alias("spread")), "term-spread")
    known = each.join(numbered, "term").join(spread, "no").select("topic_no", "n", "no", "spread")
    rarest = known.groupBy("topic_no").agg(
        F.min_by("no", F.struct("spread", "no")).alias("no"), F.count("*").alias("met"),
        F.first("n").alias("n")).where("met = n")  # a term that no text holds ends it here
    rarest = stage(rarest, "rarest-terms")
    others = known.join(rarest.select("topic_no", F.col("no").alias("rare")), "topic_no").where("no <> rare")
    first = rarest.join(hits, "no").select("topic_no", "n", "text_no")
    rest = first.join(others.select("topic_no", "no"), "topic_no").join(hits, ["text_no", "no"])
    whole = rest.groupBy("topic_no", "text_no", "n").agg(F.count("*").alias("met")).where("met = n - 1")
    bare = chunks.limit(1).select(F.lit(True).alias("some")).join(
        wanted.where("size(terms) = 0").select("topic_no"), how="cross")  # one row at most on the left
    found = whole.select("topic_no").union(rarest.where("n = 1").select("topic_no")).union(
        bare.select("topic_no")).distinct()
    return topics.join(found, "topic_no").select("topic")


def stated_together(left: DataFrame, right: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(a, b)`` of the terms ``left(term)`` and ``right(term)`` that some chunk body holds both of.

    Pairs come from texts, so those that never meet are never made.
    """
    both = left.select("term", F.lit(0).alias("side")).union(right.select("term", F.lit(1).alias("side")))
    numbered, hits = term_hits(both, chunks.select(F.lower("body").alias("body")))
    sides = stage(both.distinct().join(numbered, "term"), "term-sides")
    named = hits.join(sides, "no")
    a = named.where("side = 0").select("text_no", F.col("term").alias("a")).distinct()
    b = named.where("side = 1").select("text_no", F.col("term").alias("b")).distinct()
    return a.join(b, "text_no").select("a", "b").distinct()
