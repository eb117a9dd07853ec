"""Exact duplicates by distributed MSD radix partitioning.

Texts are split by their leading bytes. A group that is still larger than a task should
hold is split again by its next bytes, with digits that widen from round to round, until
it is small or its texts have ended; ended texts of one group are equal. Small groups are
shuffled once, packed into bins, and split further in memory until every group is a
single text or has ended. Bytes are compared themselves; no digest stands for a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.common import arrow_schema, column
from lodestone.staging import stage

FIRST_DIGIT, WIDEN = 8, 8  # bytes the first round reads, and how much wider each next digit is
GROUP_BYTES = 16 << 20  # most text a task has to hold together


def radix_groups(texts: list[bytes]) -> list[list[int]]:
    """Positions of equal texts, one list per distinct text, by MSD radix recursion.

    A worklist of (members, depth) takes the place of the call stack. Each step reads the
    next digit of every member; digits widen with the depth, so long equal texts take few.
    """
    groups, work = [], [(list(range(len(texts))), 0, 8)]
    while work:
        members, depth, width = work.pop()
        if len(members) == 1:
            groups.append(members)
            continue
        split: dict[bytes, list[int]] = {}
        for i in members:
            split.setdefault(texts[i][depth : depth + width], []).append(i)
        for digit, part in split.items():
            if len(digit) < width:  # these texts ended inside the digit and are equal
                groups.append(part)
            else:
                work.append((part, depth + width, min(width * 4, 1 << 16)))
    return groups


def mark_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    group_bytes: int = GROUP_BYTES, with_text: bool = False,
) -> DataFrame:
    """Every row of ``docs`` as (row, keep_id, group_size, kept), and its text if asked.

    Of equal texts the row with the largest id stays; among repeated rows of that id one
    stays. Null counts as an empty text, ids that are null rank below all others (and
    ``keep_id`` is null where no row of the group has one). ``row`` is a struct of the
    other input columns under their own names, whatever these are.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*[column(c) for c in docs.columns if c != text_col]).alias("row"),
        column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("rid"), F.lit(0).cast("long").alias("group"),
    )
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    limit = max(1, min(group_bytes, total // (4 * shuffles)))
    bins = 4 * shuffles * max(1, -(-total // (4 * shuffles * group_bytes)))

    small, ended, level, start, width = [], [], 0, 0, FIRST_DIGIT
    while True:
        whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        rows = rows.withColumn("digit", F.substring(whole, start + 1, width))
        # At most total / limit groups of a round are over the limit.
        large = stage(
            rows.groupBy("group", "digit").agg(F.sum(size).alias("bytes"))
            .where(F.col("bytes") > limit)
            .select(F.col("group").alias("g"), F.col("digit").alias("d"),
                    F.monotonically_increasing_id().alias("next")),
            f"radix-{level}",
        )
        target = F.pmod(F.xxhash64(F.lit(level), "group", "digit"), F.lit(bins)).cast("int")
        if large.isEmpty():
            small.append(rows.withColumn("bin", target))
            break
        met = rows.join(large, F.expr("group = g and digit = d"), "left")
        small.append(met.where("next is null").withColumn("bin", target))
        over = stage(
            met.where("next is not null").select(
                "row", "id", "text", "rid", F.col("next").alias("group"),
                (F.length("digit") < width).alias("done")),
            f"radix-rows-{level}",
        )
        ended.append(over.where("done").withColumn("level", F.lit(level)))
        rows = over.where("not done").drop("done")
        level, start, width = level + 1, start + width, width * WIDEN

    kept_columns = ["row", "keep_id", "group_size", "kept"] + ["text"] * with_text
    packed = None
    for part in small:
        part = part.select("row", "id", "text", "rid", "bin")
        packed = part if packed is None else packed.unionByName(part)
    found = _split_bins(packed, kept_columns)
    for part in ended:
        best = part.groupBy("level", "group").agg(
            F.max(F.struct(F.coalesce("id", F.lit(-(1 << 63))), "rid", "id")).alias("best"),
            F.count("*").alias("group_size"),
        )
        found = found.unionByName(part.join(best, ["level", "group"]).select(
            "row", F.col("best.id").alias("keep_id"), "group_size",
            (F.col("rid") == F.col("best.rid")).alias("kept"), "text").select(*kept_columns))
    return found


def _split_bins(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Equal texts within each bin. A bin mixes small groups, so each task call holds a
    bounded number of bytes however the texts are spread."""
    schema = StructType([rows.schema["row"]]).add("keep_id", "long").add(
        "group_size", "long").add("kept", "boolean")
    if "text" in columns:
        schema = schema.add(rows.schema["text"])
    arrow = arrow_schema(schema)

    def split(table: pa.Table) -> pa.Table:
        texts = [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()]
        ids, rids = table["id"].to_pylist(), table["rid"].to_pylist()
        keep, size = [None] * len(texts), np.zeros(len(texts), dtype=np.int64)
        kept = np.zeros(len(texts), dtype=bool)
        for members in radix_groups(texts):
            best = max(members, key=lambda i: (ids[i] is not None, ids[i] or 0, rids[i]))
            kept[best] = True
            for i in members:
                keep[i], size[i] = ids[best], len(members)
        made = [table["row"].cast(arrow.field("row").type), pa.array(keep, pa.int64()),
                pa.array(size), pa.array(kept)]
        return pa.table(made + [table["text"]] * ("text" in columns), schema=arrow)

    return rows.groupBy("bin").applyInArrow(split, schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    kept = mark_duplicates(docs, id_col, text_col, with_text=True).where("kept")
    return kept.select(*[
        F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
        for c in docs.columns
    ])
