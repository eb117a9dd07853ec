"""Prefix trie of conversations by truncation peeling.

Conversations are told apart by running digests of their turns: the digest of the first d
turns names a node of depth d. Equal conversations are one class from the start, so
thousands of copies are one row. Then the trie is peeled from its greatest depth: the
conversations that end there join the nodes that survived the level below, all are grouped
by their digest, the groups are nodes, and each loses its last turn and moves up.

Deep down a class is alone. There every level would be one row on its own, so the levels
below the last turn that a class shares with another are written from running sums, and
peeling begins where classes meet. Each level is one grouping with map-side sums: a node
with a third of all conversations below it costs a row per task. A level's nodes are
written before the next one reads them, so a lost executor re-reads a file.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema
from lodestone.operators.ordered import running_totals
from lodestone.staging import new_path, stage

NOTHING = hashlib.sha256(b"").hexdigest()
LISTED = 1 << 16  # characters of member ids that travel as one row
KEY = ["k1", "k2"]


def _prefixes(rows: DataFrame) -> DataFrame:
    """Rows with their depth, the digest of the turns up to them (k1, k2) and before them
    (p1, p2), and the bytes up to them.

    A digest is a sum of 64-bit hashes of (place, turn), twice, so running sums that ranges
    of rows add up give it for conversations of any length.
    """
    salted = rows.select(
        "conv_id", "at", "bytes",
        F.xxhash64(F.lit(3), "at", "t1", "t2").cast("decimal(28,0)").alias("a1"),
        F.xxhash64(F.lit("fourth"), "t2", "at", "t1").cast("decimal(28,0)").alias("a2"))
    summed = running_totals(
        salted, [F.col("at")],
        {"s1": F.col("a1"), "s2": F.col("a2"), "upto": F.col("bytes")}, ["conv_id"])
    limit = F.lit(str(1 << 63)).cast("decimal(38,0)")

    def key(value):
        return F.pmod(value.cast("decimal(38,0)"), limit).cast("long")

    return summed.select(
        "conv_id", (F.col("at") + 1).alias("depth"), "bytes", "upto",
        key(F.col("s1")).alias("k1"), key(F.col("s2")).alias("k2"),
        key(F.col("s1") - F.col("a1")).alias("p1"), key(F.col("s2") - F.col("a2")).alias("p2"))


def _listed(members: DataFrame) -> DataFrame:
    """(k1, k2, n_turns, ends): SHA-256 of the ascending ids of each class, comma-joined.

    Ids are sorted in ranges over all classes and joined there; a class is then hashed over
    the joined pieces in turn, with one piece in memory.
    """
    keys = [*KEY, "n_turns"]
    pieces_schema = "k1 long, k2 long, n_turns long, first long, ids string"
    pieces_arrow = arrow_schema(pieces_schema)
    ends_schema = "k1 long, k2 long, n_turns long, ends string"
    ends_arrow = arrow_schema(ends_schema)

    def join(batches):
        key, first, held, size, out = None, None, [], 0, []

        def close():
            if held:
                out.append((*key, first, ",".join(held)))

        for batch in batches:
            columns = [batch[c].to_pylist() for c in (*keys, "conv_id")]
            for *now, conv in zip(*columns, strict=True):
                if now != key or size > LISTED:
                    close()
                    key, first, held, size = now, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(pieces_arrow.names, r, strict=True)) for r in out], pieces_arrow)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(pieces_arrow.names, r, strict=True)) for r in out], pieces_arrow)

    def digest(batches):
        key, state = None, None
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in (*keys, "ids")]
            for *now, ids in zip(*columns, strict=True):
                if now == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist(
                [dict(zip(ends_arrow.names, r, strict=True)) for r in out], ends_arrow)
        if key is not None:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(ends_arrow.names, (*key, state.hexdigest()), strict=True))], ends_arrow)

    ordered = members.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id")
    pieces = stage(ordered.sortWithinPartitions(*keys, "conv_id").mapInArrow(join, pieces_schema), "member-ids")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").select(
        *keys, "ids").mapInArrow(digest, ends_schema)


def prefix_trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: each distinct sequence of the first d turns, from the root (d = 0).

    ``rows`` is (conv_id, at, t1, t2, bytes), places from 0 without gaps; ``members`` is
    (conv_id, n_turns) of every conversation, turnless ones too, each id once. Returns
    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves (childless nodes below, itself included), saved_tokens (over the
    node and all below it, one less than its conversations times the bytes of its last
    text) and ends_sha256 (of the ids of the members that end there; none: of nothing).
    Without conversations there is no node. Turns are compared by a 128-bit digest.
    """
    spark = rows.sparkSession
    prefixes = stage(_prefixes(rows), "prefixes")
    last = prefixes.groupBy("conv_id").agg(
        F.max_by(F.struct(*KEY), "depth").alias("k"), F.max("upto").alias("total"))
    ended = stage(members.join(last, "conv_id", "left").select(
        "conv_id", "n_turns", *[F.coalesce(f"k.{k}", F.lit(0)).alias(k) for k in KEY],
        F.coalesce("total", F.lit(0)).alias("total")), "ended")
    classes = ended.groupBy("n_turns", *KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("total").alias("total"))
    many = stage(classes, "classes")
    several = many.where("n_convs > 1").select("n_turns", *KEY)
    ends = _listed(stage(ended.join(several, ["n_turns", *KEY]), "members-of-many"))
    classes = stage(many.join(ends, ["n_turns", *KEY], "left").withColumn(
        "ends", F.coalesce("ends", F.sha2(F.col("conv_id").cast("string"), 256))), "class-ends")

    # Nodes that several classes reach, and the depth at which each class is alone.
    own = stage(prefixes.join(classes.drop(*KEY), "conv_id"), "class-prefixes")
    shared = stage(own.groupBy("depth", *KEY).agg(
        F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("p1", "p2", "bytes")]
    ).where("n > 1").drop("n"), "shared-prefixes")
    met = own.select("conv_id", "depth", *KEY).join(shared.select("depth", *KEY), ["depth", *KEY], "left_semi")
    alone = stage(classes.select("conv_id").join(
        met.groupBy("conv_id").agg(F.max("depth").alias("met")), "conv_id", "left"
    ).select("conv_id", (F.coalesce("met", F.lit(0)) + 1).alias("alone_from")), "alone-from")
    below = own.join(alone, "conv_id").where("depth >= alone_from").select(
        "conv_id", "depth", "alone_from", *KEY, "p1", "p2", "n_convs",
        F.expr("cast(depth < n_turns as long)").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.expr("(n_convs - 1) * (total - upto + bytes)").alias("saved_tokens"),
        F.when(F.expr("depth = n_turns"), F.col("ends")).alias("ends"))
    below = stage(below, "below")
    tops = below.where("depth = alone_from")
    inside = stage(classes.join(alone, "conv_id").where("n_turns < alone_from"), "ended-inside")

    deepest = alone.agg(F.max("alone_from")).first()[0]
    if deepest is None:
        return _result(below.withColumn("parent_conv_id", F.col("conv_id")))
    folder, level = new_path(spark, "levels"), None
    for depth in range(deepest - 1, -1, -1):
        arrived = inside.where(F.col("n_turns") == depth).select(
            *KEY, "conv_id", "n_convs", F.lit(0).cast("long").alias("n_children"),
            F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "ends")
        lower = tops.where(F.col("depth") == depth + 1)
        for part in [lower] if level is None else [lower, level]:
            arrived = arrived.unionByName(part.select(
                F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id", "n_convs",
                F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                F.lit(None).cast("string").alias("ends")))
        groups = arrived.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends").alias("ends"))
        if depth:
            groups = groups.join(shared.where(F.col("depth") == depth).drop("depth"), KEY)
        else:
            groups = groups.select("*", *[F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "bytes")])
        nodes = groups.select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), *KEY, "p1", "p2", "n_convs", "n_children",
            F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
            F.expr("saved_tokens + (n_convs - 1) * bytes").alias("saved_tokens"), "ends")
        nodes.write.parquet(f"{folder}/{depth:09d}")
        level = spark.read.schema(nodes.schema).parquet(f"{folder}/{depth:09d}")
    core = spark.read.schema(level.schema).parquet(*[f"{folder}/{d:09d}" for d in range(deepest)])
    parents = core.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"))
    hang = core.unionByName(tops.drop("alone_from")).join(parents, ["depth", "p1", "p2"], "left")
    deep = below.where("depth > alone_from").drop("alone_from").withColumn("parent_conv_id", F.col("conv_id"))
    return _result(hang.unionByName(deep))


def _result(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
