"""Provider health over recorded calls, as batch frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.operators.ordered import ROWS_PER_RANGE, previous_values, running_totals
from lodestone.staging import stage


def consecutive_rate_limits(calls: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``calls(provider, seq, outcome)`` with the length of the current run of
    rate limits, which only a success ends.

    The run is a difference of two running totals, so a provider with most of the
    calls is worked on by as many tasks as it has ranges.
    """
    limited = (F.col("outcome") == "rate_limited").cast("long")
    served = (F.col("outcome") == "success").cast("long")
    counted = running_totals(
        calls, [F.col("seq")], {"n_limited": limited, "n_served": served}, ["provider"],
        rows_per_range,
    )
    counted = stage(counted, "call-runs")
    starts = counted.groupBy("provider", "n_served").agg(
        F.min(F.col("n_limited") - limited).alias("before")
    )
    return counted.join(starts, ["provider", "n_served"]).select(
        "provider", "seq", "outcome", (F.col("n_limited") - F.col("before")).alias("consecutive")
    )


def pacing(calls: DataFrame, gap_seconds: Column, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Seconds each call ``(provider, seq, at)`` has to wait for its provider's gap."""
    after = previous_values(
        calls, [F.col("seq")], {"last_at": "at"}, ["provider"], rows_per_range
    )
    remaining = gap_seconds - (F.col("at") - F.col("last_at"))
    return after.select(
        "provider", "seq", F.coalesce(F.greatest(F.lit(0.0), remaining), F.lit(0.0)).alias("wait")
    )


def provider_status(providers: DataFrame, disablements: DataFrame, now: Column) -> DataFrame:
    """Health in routing order from ``providers(position, provider, in_environment)`` and
    the latest ``disablements(provider, reason, expires_at)``; no expiry is for good."""
    joined = providers.join(disablements, "provider", "left")
    active = F.col("reason").isNotNull() & (
        F.col("expires_at").isNull() | (now < F.col("expires_at"))
    )
    return joined.select(
        "position", "provider",
        (F.col("in_environment") & ~active).alias("available"),
        F.when(~F.col("in_environment"), "unavailable_in_environment")
        .when(active, F.col("reason"))
        .alias("disabled_reason"),
        F.when(F.col("in_environment") & active, F.col("expires_at")).alias("disabled_until"),
    )


def disable_seconds(outcome: Column, retry_after: Column) -> Column:
    """How long an outcome takes a provider out; null is for good. A retry hint of
    zero counts as none."""
    hinted = F.coalesce(F.nullif(retry_after, F.lit(0.0)), F.lit(C.RATE_LIMIT_TTL_SECONDS))
    return F.when(outcome == "rate_limited", hinted).when(
        outcome == "transport_error", F.lit(C.TRANSPORT_TTL_SECONDS)
    )
