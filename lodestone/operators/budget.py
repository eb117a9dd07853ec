"""Spend control over recorded calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.rules import dollars, price_units
from lodestone.operators.ordered import ROWS_PER_RANGE, running_totals
from lodestone.staging import stage


def reserve(
    calls: DataFrame, ceiling_units: int, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """``calls(run_id, seq, units)`` with ``accepted`` and ``reserved_before``.

    A call is refused if it would take its run past the ceiling, and a refused
    call holds nothing, so one running sum is right only up to the first refusal.
    Each round therefore refuses every open call dearer than what its run has
    left, sums the rest and accepts the calls whose sum still fits: sums only grow,
    so these are the ones before the first refusal. What is left of a run falls with
    every round, so the open calls fall quickly; sums run over ranges, so a run with
    very many calls is shared out. Prices are whole units and sums exact.
    """
    if ceiling_units <= 0:
        raise ValueError("a budget ceiling must be positive")
    calls = stage(calls.select("run_id", "seq", "units"), "calls")
    open_calls = calls.withColumn("held", F.lit(0).cast("long"))
    accepted: DataFrame | None = None
    while True:
        fitting = open_calls.filter(F.col("held") + F.col("units") <= ceiling_units)
        summed = stage(
            running_totals(
                fitting, [F.col("seq")], {"total": F.col("units")}, ["run_id"], rows_per_range
            ),
            "summed-calls",
        )
        if summed.isEmpty():
            break
        reached = F.col("held") + F.col("total")
        taken = summed.filter(reached <= ceiling_units)
        part = taken.select("run_id", "seq", (reached - F.col("units")).alias("reserved_before"))
        accepted = part if accepted is None else accepted.unionByName(part)
        held = taken.groupBy("run_id").agg(F.max(reached).alias("held"))
        open_calls = summed.filter(reached > ceiling_units).select("run_id", "seq", "units").join(
            held, "run_id"
        )
    if accepted is None:
        return calls.select(
            "run_id", "seq", "units", F.lit(False).alias("accepted"),
            F.lit(None).cast("long").alias("reserved_before"),
        )
    marked = accepted.select("run_id", "seq", "reserved_before", F.lit(True).alias("_taken"))
    return calls.join(marked, ["run_id", "seq"], "left").select(
        "run_id", "seq", "units", F.coalesce("_taken", F.lit(False)).alias("accepted"),
        "reserved_before",
    )


def worst_case(candidates: DataFrame) -> DataFrame:
    """Dearest available provider per run; ``unknown`` where none is available."""
    each = F.when(F.col("available"), price_units(F.col("provider"), F.lit(10**6), F.lit(10**6)))
    best = candidates.groupBy("run_id").agg(
        F.max_by(
            F.when(F.col("available"), F.col("provider")),
            F.struct(each.alias("price"), (-F.col("position")).alias("first")),
        ).alias("provider")
    )
    return best.select("run_id", F.coalesce("provider", F.lit("unknown")).alias("provider"))


def ledger(calls: DataFrame) -> DataFrame:
    """Actual cost per call; a cache hit costs nothing and is still entered."""
    actual = F.when(F.col("cache_hit"), F.lit(0).cast("long")).otherwise(
        price_units(F.col("provider"), F.col("tokens_in"), F.col("tokens_out"))
    )
    return calls.withColumn("actual_units", actual)


def ledger_totals(entries: DataFrame) -> DataFrame:
    """Per run: reserved, spent, tokens avoided and how pessimistic the reservation was."""
    spared = F.when(F.col("cache_hit"), F.col("tokens_in") + F.col("tokens_out"))
    totals = entries.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("estimated_units").alias("reserved"),
        F.sum("actual_units").alias("spent"),
        F.coalesce(F.sum(spared), F.lit(0)).alias("tokens_avoided"),
    )
    return totals.select(
        "run_id", "entries", dollars(F.col("reserved")).alias("reserved_usd"),
        dollars(F.col("spent")).alias("actual_usd"), "tokens_avoided",
        F.when(F.col("spent") > 0, F.col("reserved") / F.col("spent")).otherwise(0.0)
        .alias("overestimate_ratio"),
    )
