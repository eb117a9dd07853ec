"""Provider health as keyed state: failure counts, timed disablement, failover."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.streaming.ordered_state import ordered_walk

#: No disablement; infinity means for good.
NEVER = -math.inf


def after_call(
    consecutive: int, outcome: str, now: float, retry_after: float
) -> tuple[int, float]:
    """Count and disablement after one attempt."""
    if outcome == "success":
        return 0, NEVER
    if outcome == "rate_limited":
        consecutive += 1
        if consecutive < C.MAX_CONSECUTIVE_RATE_LIMITS:
            return consecutive, NEVER
        return consecutive, now + (retry_after or C.RATE_LIMIT_TTL_SECONDS)
    if outcome == "transport_error":
        return consecutive, now + C.TRANSPORT_TTL_SECONDS
    return consecutive, math.inf  # no quota left, or not there at all


class Provider(NamedTuple):
    """One provider of a failover order: seconds between its calls, and whether it is to be
    had in this environment."""

    name: str
    gap: float = 0.0
    available: bool = True


CALL_ROW = "seq long, at double, outcome string, retry_after double"
BREAKER = "provider string, seq long, action string, consecutive int, disabled_until double"
BREAKER_STATE = "consecutive int, until double, last double"
REQUEST_ROW = "seq long, at double, outcomes array<string>, retry_after array<double>"
FAILOVER = "session_id long, seq long, attempts string, provider string, waited double, events string"
FAILOVER_STATE = "counts array<int>, until array<double>, called array<double>, clock double"


class Breaker:
    """One provider: a disabled one is skipped while a call comes before the expiry; a later
    call finds it enabled again and its count forgotten."""

    start = (0, NEVER, NEVER)

    def step(self, key, state: tuple, call) -> tuple[tuple, tuple]:
        consecutive, until, _ = state
        if call.at < until:
            return (key, call.seq, "skipped", consecutive, until), (consecutive, until, float(call.at))
        if until != NEVER:
            consecutive, until = 0, NEVER
        consecutive, until = after_call(consecutive, call.outcome, call.at, call.retry_after)
        action = "served" if call.outcome == "success" else ("failed" if until == NEVER else "disabled")
        shown = None if until == NEVER else until
        return (key, call.seq, action, consecutive, shown), (int(consecutive), float(until), float(call.at))

    def forever(self, state: tuple) -> bool:
        return state[1] == math.inf

    def last(self, state: tuple) -> float:
        return state[2]


class Failover:
    """One session: providers in order; a request nobody serves has a null provider.

    A provider that is not there in this environment, or is disabled, is no attempt. One that
    was called less than its gap ago is waited for, and the waiting moves the clock for the
    providers after it. The clock never goes back. Transport and quota errors are no calls
    that a gap counts from.
    """

    def __init__(self, providers: list[Provider]) -> None:
        n, self.providers = len(providers), providers
        self.start = ([0] * n, [NEVER] * n, [NEVER] * n, NEVER)

    def step(self, key, state: tuple, request) -> tuple[tuple, tuple]:
        counts, until, called = list(state[0]), list(state[1]), list(state[2])
        clock = begun = max(state[3], float(request.at))
        tried, events, served = [], [], None
        for i, provider in enumerate(self.providers):
            if not provider.available or clock < until[i]:
                continue
            if until[i] != NEVER:
                counts[i], until[i] = 0, NEVER
            tried.append(provider.name)
            clock += max(0.0, provider.gap - (clock - called[i]))
            outcome, hint = request.outcomes[i], request.retry_after[i]
            counts[i], until[i] = after_call(counts[i], outcome, clock, hint)
            if outcome == "success":
                called[i], served = clock, provider.name
                events.append(f"{provider.name} success")
                break
            if outcome == "rate_limited":
                called[i] = clock
                events.append(f"{provider.name} rate_limit consecutive={counts[i]}")
                if until[i] != NEVER:
                    events.append(f"{provider.name} disabled for {hint or C.RATE_LIMIT_TTL_SECONDS:.0f}s")
            else:
                events.append(f"{provider.name} " + (
                    "disabled quota exhausted" if outcome == "quota_exhausted" else f"error {outcome}"))
        row = (key, request.seq, ",".join(tried), served, clock - begun, "; ".join(events))
        return row, (counts, until, called, clock)

    def forever(self, state: tuple) -> bool:
        return math.inf in state[1]

    def last(self, state: tuple) -> float:
        return state[3]


def _archive(rows: DataFrame, key: str, walker, schema: str) -> DataFrame:
    """The same walk over a whole table, in order whatever its files hold.

    Rows of a key are sorted by Spark and met one by one; a task holds one state and one
    batch, however many rows a key has.
    """
    columns = [part.split()[0] for part in schema.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = None, walker.start
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = getattr(row, key)
                if own != last:
                    last, now = own, walker.start
                made, now = walker.step(own, now, row)
                out.append(made)
            yield pd.DataFrame(out, columns=columns)

    return rows.repartition(key).sortWithinPartitions(key, "at", "seq").mapInPandas(walk, schema)


def circuit_breaker(
    calls: DataFrame, late: str = "10 minutes", idle_seconds: float | None = None
) -> DataFrame:
    """``calls(provider, seq, at, outcome, retry_after)``, a stream or a table, to one row per call.

    Calls of a provider count by (at, seq), whatever order they come in.
    """
    if calls.isStreaming:
        return ordered_walk(
            calls, "provider", Breaker(), CALL_ROW, BREAKER_STATE, BREAKER, late, idle_seconds)
    return _archive(calls, "provider", Breaker(), BREAKER)


def failover(
    requests: DataFrame, providers: list[Provider], late: str = "10 minutes",
    idle_seconds: float | None = None,
) -> DataFrame:
    """Try providers in order for ``requests(session_id, seq, at, outcomes, retry_after)``.

    The arrays have the recorded outcome and retry hint (0: none) of each provider. Each
    session has its own health state. A request nobody serves has a null provider: it fails
    closed. ``waited`` is the seconds spent on gaps, ``events`` what happened in turn.
    """
    walker = Failover(providers)
    if requests.isStreaming:
        return ordered_walk(
            requests, "session_id", walker, REQUEST_ROW, FAILOVER_STATE, FAILOVER, late, idle_seconds)
    return _archive(requests, "session_id", walker, FAILOVER)


def disablements(breaker_rows: DataFrame, calls: DataFrame) -> DataFrame:
    """(provider, reason, expires_at) of the providers that their last call left disabled.

    ``breaker_rows`` is what ``circuit_breaker`` made of ``calls``; a null expiry is for good.
    """
    ordered = breaker_rows.join(calls.select("provider", "seq", "at", "outcome"), ["provider", "seq"])
    when = F.struct("at", "seq")
    last = ordered.groupBy("provider").agg(
        F.max_by("disabled_until", when).alias("until"),
        F.max_by(F.when(F.col("action") == "disabled", F.col("outcome")),
                 F.when(F.col("action") == "disabled", when)).alias("reason"))
    return last.where("until is not null").select(
        "provider", "reason",
        F.when(F.col("until") < math.inf, F.col("until")).alias("expires_at"))
