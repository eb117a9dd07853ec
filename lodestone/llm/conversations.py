"""Turns of conversations in order, and conversations rebuilt from the turns of others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column
from lodestone.operators.ordered import row_numbers
from lodestone.staging import stage


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text); null roles and texts are empty, other columns stay out."""
    return conversations.select(
        column("conv_id").cast("long").alias("conv_id"), column("turn").cast("long").alias("turn"),
        *[F.coalesce(column(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, t1, t2, bytes): place of each turn, a 128-bit digest of its role and text,
    and the UTF-8 bytes of its text.

    Turns are ordered by ``turn``, null first, equal ones by their role and digest. Rows
    without a conv_id belong to no conversation. The places of a conversation are counted
    over ranges of rows, so one of any length is no single task's work.
    """
    rows = turns(conversations).where("conv_id is not null").select(
        "conv_id", "turn", "role",
        F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit("second"), "text", "role").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2")]
    placed = row_numbers(rows, order, "at", ["conv_id"])
    return placed.select("conv_id", (F.col("at") - 1).alias("at"), "t1", "t2", "bytes")


def rebuilt(conversations: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(rows, members): each conversation c with the first h turns of conversation c - c % every
    in place of its own first h, where h is the unsigned crc32 of its id modulo ``most``.

    Rows are as in ``digested``; members (conv_id, n_turns) has turnless conversations too.
    """
    rows = stage(digested(conversations), "turns")
    own = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = own.select(
        "conv_id", "n", (F.col("conv_id") - F.pmod("conv_id", F.lit(every))).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    first = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = stage(plan.join(first, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("head"), "n"
    ).withColumn("n_turns", F.expr("head + greatest(n - h, 0)")), "rebuilding")
    heads = rows.where(F.col("at") < most).withColumnRenamed("conv_id", "base").join(
        plan.select("conv_id", "base", "head"), "base").where("at < head")
    tails = rows.join(plan.select("conv_id", "h", "head"), "conv_id").where("at >= h")
    wanted = ["conv_id", "at", "t1", "t2", "bytes"]
    return heads.select(*wanted).union(
        tails.withColumn("at", F.expr("at - h + head")).select(*wanted)
    ), plan.select("conv_id", "n_turns")
