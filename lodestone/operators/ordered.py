"""Running totals and ranks that no single task has to compute alone.

A window without a partition key, or with a key that holds a third of the
table, sorts all those rows in one task. Here the rows are range-partitioned by
(key, order), each range is summarised to one row, the summaries give every
range its starting offset, and the window then runs inside each range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.staging import stage

RANGE = "_range"
ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 20_000


def ranged(
    df: DataFrame,
    order: Sequence[Column],
    rows_per_range: int = ROWS_PER_RANGE,
    materialise: bool = True,
) -> DataFrame:
    """Add the number of the contiguous range each row falls in.

    The range numbers come from a sampled partitioner, so the result is written
    before anyone reads it: two readers must see the same numbers. ``df`` has to
    be cheap to count (a scan or a staged table); ``materialise`` stages it first.
    """
    if materialise:
        df = stage(df, "ordered")
    n_ranges = min(MAX_RANGES, max(1, math.ceil(df.count() / rows_per_range)))
    if n_ranges == 1:
        return df.withColumn(RANGE, F.lit(0))
    split = df.repartitionByRange(n_ranges, *order).withColumn(RANGE, F.spark_partition_id())
    return stage(split, "ranges")


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    totals: dict[str, Column],
    keys: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
    materialise: bool = True,
) -> DataFrame:
    """Inclusive running sums of ``totals`` in ``order``, restarting per key."""
    by_key = [F.col(k) for k in keys]
    rows = ranged(df, [*by_key, *order], rows_per_range, materialise)
    per_range = rows.groupBy(*keys, RANGE).agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_range.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col(RANGE).alias("_key_range"),
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_off_{name}")
            for name in totals
        ],
    )
    matched = F.col(RANGE) == F.col("_key_range")
    for key in keys:
        matched = matched & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    inside = (
        Window.partitionBy(*keys, RANGE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = rows.join(offsets, matched)
    for name, value in totals.items():
        out = out.withColumn(name, F.col(f"_off_{name}") + F.sum(value).over(inside))
    helpers = [f"_off_{n}" for n in totals] + [f"_key_{k}" for k in keys] + ["_key_range", RANGE]
    return out.drop(*helpers)


def row_numbers(
    df: DataFrame,
    order: Sequence[Column],
    name: str = "row_number",
    keys: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
    materialise: bool = True,
) -> DataFrame:
    """Dense 1..n positions per key, in an order that must be unique."""
    return running_totals(
        df, order, {name: F.lit(1).cast("long")}, keys, rows_per_range, materialise
    )


def previous_values(
    df: DataFrame,
    order: Sequence[Column],
    columns: dict[str, str],
    keys: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
    materialise: bool = True,
) -> DataFrame:
    """For ``{new: old}`` add the value of ``old`` in the row before, per key.

    The first row of a key in a range takes the last row of the key in an
    earlier range.
    """
    by_key = [F.col(k) for k in keys]
    packed = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    rows = ranged(df, [*by_key, *order], rows_per_range, materialise)
    position = F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy(*order))
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order)
    marked = rows.withColumn("_before", F.lag(packed).over(inside)).withColumn("_at", position)
    lasts = (
        rows.withColumn("_row", packed)
        .groupBy(*keys, RANGE)
        .agg(F.max_by("_row", F.struct(*order)).alias("_last"))
    )
    earlier = Window.partitionBy(*keys).orderBy(RANGE)
    carried = lasts.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col(RANGE).alias("_key_range"), F.lag("_last").over(earlier).alias("_carried"),
    )
    matched = F.col(RANGE) == F.col("_key_range")
    for key in keys:
        matched = matched & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    joined = marked.join(carried, matched)
    source = F.when(F.col("_at") == 1, F.col("_carried")).otherwise(F.col("_before"))
    out = joined.withColumn("_source", source)
    for new in columns:
        out = out.withColumn(new, F.col(f"_source.{new}"))
    return out.drop(
        "_before", "_at", "_carried", "_source", "_key_range", RANGE, *[f"_key_{k}" for k in keys]
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key with their rank.

    The rank filter lets Spark cut every partition to ``k`` rows per key before
    the shuffle, so a key with very many rows costs k rows per partition.
    """
    ranked = df.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.filter(F.col("rank") <= k)


def quantile_rows(
    df: DataFrame, value: str, tie: str, keys: Sequence[str], share: float = 0.95,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Mean, median and the value at index ``int(share * (n - 1))`` per key.

    The position comes from range-split ranks, so no key is sorted by one task and
    no list of its values is built.
    """
    placed = stage(
        row_numbers(df, [F.col(value), F.col(tie)], "_at", keys, rows_per_range), "placed"
    )
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    # Keys are few next to rows; the counts are joined by their measured size.
    judged = placed.join(stage(sizes, "sizes"), list(keys))
    high = F.floor(F.lit(share) * (F.col("n") - 1)) + 1
    lower_middle, upper_middle = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return judged.groupBy(*keys).agg(
        F.first("mean").alias("mean"),
        (
            F.max(F.when(F.col("_at") == lower_middle, F.col(value)))
            + F.max(F.when(F.col("_at") == upper_middle, F.col(value)))
        ).alias("_middle"),
        F.max(F.when(F.col("_at") == high, F.col(value))).alias("p95"),
        F.first("n").alias("n"),
    ).withColumn("median", F.col("_middle") / 2).drop("_middle")
