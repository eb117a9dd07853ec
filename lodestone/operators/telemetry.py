"""Seeded incidents and the telemetry they leave along a service graph."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone import constants as C
from lodestone.operators.graph import affected
from lodestone.operators.ordered import row_numbers
from lodestone.staging import spread, stage

N_STEPS = (C.BASELINE_MINUTES + C.FAULT_MINUTES) * 60 // C.SAMPLE_SECONDS


def applicable(services: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(service_id, pattern_id)`` a runtime allows: an equi join on the runtime."""
    able = patterns.select(F.col("id").alias("pattern_id"), F.explode("runtimes").alias("runtime"))
    return services.select(F.col("id").alias("service_id"), "runtime").join(able, "runtime").select(
        "service_id", "pattern_id"
    )


def candidates(services: DataFrame, patterns: DataFrame) -> DataFrame:
    """Applicable pairs with their position in id order, from 0."""
    pairs = row_numbers(
        applicable(services, patterns), [F.col("service_id"), F.col("pattern_id")], "n"
    )
    return pairs.select((F.col("n") - 1).cast("int").alias("pick"), "service_id", "pattern_id")


def seeded_pick(n: int):
    """Index a seeded generator chooses out of ``n``."""

    @F.pandas_udf("int")
    def pick(seeds: pd.Series) -> pd.Series:
        return pd.Series([random.Random(int(s)).choice(range(n)) for s in seeds], dtype="int32")

    return pick


def incidents(seeds: DataFrame, pairs: DataFrame, services: DataFrame, patterns: DataFrame,
              pick: Column | None = None) -> DataFrame:
    """One incident per ``seeds(seed, opened_at)``, fully determined by its seed.

    ``pick`` may give the index of the pair; by default the seed draws it.
    """
    pairs = stage(pairs, "pairs")
    chosen = seeded_pick(pairs.count())(F.col("seed")) if pick is None else pick
    # A seed becomes many points, so a table of few splits would keep as few cores busy.
    named = spread(seeds, "seed").withColumn("pick", chosen).join(pairs, "pick")
    services = services.select(F.col("id").alias("service_id"), F.col("name").alias("service_name"))
    patterns = patterns.select(
        F.col("id").alias("pattern_id"), F.col("name").alias("pattern_name"), "signature", "severity"
    )
    return named.join(services, "service_id").join(patterns, "pattern_id").select(
        F.format_string("inc-%08x", "seed").alias("incident_id"), "service_id", "pattern_id",
        F.concat_ws(" on ", "pattern_name", "service_name").alias("title"), "signature", "severity",
        "opened_at", "seed",
    )


def metric_applies(metric: Column, is_app: Column, tier: Column, on_datastore: Column) -> Column:
    """Whether a secondary metric is plausible on a service, by the metric's prefix."""

    def prefixed(*prefixes: str) -> Column:
        found = F.lit(False)
        for p in prefixes:
            found = found | metric.startswith(p)
        return found

    return (
        F.when(prefixed("db.", "cache."), on_datastore)
        .when(prefixed("http.", "thread_pool.", "runtime.", "process.", "tls."), is_app)
        .when(prefixed("pipeline."), tier == C.BATCH_TIER)
        .when(prefixed("stream.", "search."), ~is_app)
        .otherwise(is_app)
    )


def service_traits(services: DataFrame, dependencies: DataFrame) -> DataFrame:
    stores = services.filter(F.col("runtime").isin(*C.DATASTORE_RUNTIMES)).select(
        F.col("id").alias("downstream_id")
    )
    leaning = dependencies.join(stores, "downstream_id", "left_semi").select(
        F.col("upstream_id").alias("id")
    ).distinct().withColumn("on_datastore", F.lit(True))
    return services.join(leaning, "id", "left").select(
        F.col("id").alias("service_id"), "tier",
        (~F.col("runtime").isin(*C.DATASTORE_RUNTIMES)).alias("is_app"),
        F.coalesce("on_datastore", F.lit(False)).alias("on_datastore"),
    )


def fault_shape(pattern_id: Column, progress: Column) -> Column:
    ramp = F.least(F.lit(1.0), progress)
    return (
        F.when(progress <= 0, 0.0)
        .when(pattern_id == C.STEP_PATTERN, 1.0)
        .when(pattern_id == C.LINEAR_PATTERN, ramp)
        .otherwise(F.least(F.lit(1.0), F.pow(progress, F.lit(C.ONSET_EXPONENT))))
    )


def development(
    incident_rows: DataFrame, signals: DataFrame, services: DataFrame, dependencies: DataFrame
) -> DataFrame:
    """How far each signal has developed, per incident, service, metric and minute.

    The root moves first; a service ``h`` hops upstream moves later and less.
    """
    roots = services.select(F.col("id").alias("root"))
    hops = affected(dependencies, roots).filter("hops > 0").select(
        F.col("root").alias("service_id"), F.col("node").alias("seen_on"), "hops"
    )
    traits = service_traits(services, dependencies).withColumnRenamed("service_id", "seen_on")
    level = ["pattern_id", "metric", "unit", "baseline", "peak"]
    own = incident_rows.join(
        signals.filter("role = 'primary'").select(*level), "pattern_id"
    ).withColumns({"seen_on": F.col("service_id"), "hops": F.lit(0)})
    plausible = metric_applies(
        F.col("metric"), F.col("is_app"), F.col("tier"), F.col("on_datastore")
    )
    felt = (
        incident_rows.join(stage(hops, "hops"), "service_id")
        .join(signals.filter("role = 'secondary'").select(*level), "pattern_id")
        .join(traits, "seen_on")
        .filter(plausible)
        .drop("is_app", "tier", "on_datastore")
    )
    lanes = own.unionByName(felt)
    stepped = lanes.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(N_STEPS))))
    seconds = F.col("step") * C.SAMPLE_SECONDS - C.BASELINE_MINUTES * 60
    progress = (seconds - F.col("hops") * C.LAG_SECONDS_PER_HOP) / (C.FAULT_MINUTES * 60.0)
    fade = F.when(F.col("hops") == 0, 1.0).otherwise(
        1.0 / (1.0 + C.ATTENUATION_PER_HOP * (F.col("hops") - 1))
    )
    return stepped.select(
        "incident_id", "pattern_id", "opened_at", "seed",
        F.col("seen_on").alias("service_id"), "metric", "unit", "baseline", "peak", "hops", "step",
        (F.col("hops") == 0).alias("is_primary"),
        F.timestamp_micros(F.unix_micros("opened_at") + seconds.cast("long") * 1_000_000).alias("observed_at"),
        (fault_shape(F.col("pattern_id"), progress) * fade).alias("development"),
    )


#: Words of the generator's state, the place its outputs are mixed with, and what a seed starts from.
_WORDS, _MIXED = 624, 397
_START = [19650218]
for _i in range(1, _WORDS):
    _START.append((1812433253 * (_START[-1] ^ _START[-1] >> 30) + _i) & 0xFFFFFFFF)


def first_randoms(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two ``random()`` of ``random.Random(seed)`` for every 64-bit seed.

    Each step of the generator's seeding is made for all seeds at once; of its outputs only the
    four that two doubles need are made.
    """
    size = np.abs(seeds).view(np.uint64)  # a seed counts without its sign, in words of 32 bits
    low, high = (size & np.uint64(0xFFFFFFFF)).astype(np.uint32), (size >> np.uint64(32)).astype(np.uint32)
    added = [low, np.where(high > 0, high + np.uint32(1), low)]  # its words in turn, each with its place
    state = np.empty((_WORDS, len(seeds)), dtype=np.uint32)
    held = np.empty(len(seeds), dtype=np.uint32)

    def mix(before: np.ndarray, word, factor: int, more, out: np.ndarray) -> None:
        np.right_shift(before, 30, out=held)
        np.bitwise_xor(held, before, out=held)
        np.multiply(held, np.uint32(factor), out=held)
        np.bitwise_xor(held, word, out=held)
        np.add(held, more, out=out)

    state[0] = _START[0]
    for i in range(1, _WORDS):
        mix(state[i - 1], np.uint32(_START[i]), 1664525, added[(i - 1) % 2], state[i])
    mix(state[-1], state[1], 1664525, added[(_WORDS - 1) % 2], state[1])
    for i in range(2, _WORDS):
        mix(state[i - 1], state[i], 1566083941, np.uint32(2**32 - i), state[i])
    mix(state[-1], state[1], 1566083941, np.uint32(2**32 - 1), state[1])
    state[0] = 1 << 31
    upper, lower = np.uint32(1 << 31), np.uint32((1 << 31) - 1)
    outputs = []
    for k in range(4):
        y = state[k] & upper | state[k + 1] & lower
        y = state[k + _MIXED] ^ y >> np.uint32(1) ^ np.where(y & np.uint32(1), np.uint32(0x9908B0DF), np.uint32(0))
        y ^= y >> np.uint32(11)
        y ^= y << np.uint32(7) & np.uint32(0x9D2C5680)
        y ^= y << np.uint32(15) & np.uint32(0xEFC60000)
        outputs.append(y ^ y >> np.uint32(18))
    first, second = (
        ((a >> np.uint32(5)) * 67108864.0 + (b >> np.uint32(6))) * (1.0 / 9007199254740992.0)
        for a, b in (outputs[:2], outputs[2:]))
    return first, second


@F.pandas_udf(DoubleType())
def _noisy(seed: pd.Series, mean: pd.Series, sigma: pd.Series) -> pd.Series:
    """Seeded value per point; the generator is seeded anew for every point, so the
    result does not depend on partitioning. It is ``gauss`` of a new generator, whose
    functions are those of ``math``, so that no last digit differs."""
    out = []
    if seed.dtype != "int64":  # a seed is missing
        generator = random.Random()
        for s, m, g in zip(seed.tolist(), mean.tolist(), sigma.tolist(), strict=True):
            generator.seed(s)
            out.append(round(m + generator.gauss(0.0, g), 4))
        return pd.Series(out, dtype="float64")
    cos, log, sqrt = math.cos, math.log, math.sqrt
    first, second = first_randoms(seed.to_numpy())
    turns = (first * (2.0 * math.pi)).tolist()
    for t, r, m, g in zip(turns, (1.0 - second).tolist(), mean.tolist(), sigma.tolist(), strict=True):
        out.append(round(m + cos(t) * sqrt(-2.0 * log(r)) * g, 4))
    return pd.Series(out, dtype="float64")


def telemetry(points: DataFrame) -> DataFrame:
    """Sampled values of ``development`` rows."""
    key = F.concat_ws("|", "service_id", "metric", F.col("step").cast("string"))
    seed = F.col("seed").cast("long").bitwiseXOR(F.crc32(key.cast("binary")))
    span = F.col("peak") - F.col("baseline")
    value = _noisy(
        seed, F.col("baseline") + span * F.col("development"),
        F.abs(span) * C.SPAN_NOISE + F.abs("baseline") * C.BASELINE_NOISE,
    )
    return points.select(
        "incident_id", "pattern_id", "service_id", "observed_at", "opened_at", "hops",
        F.lit("metric").alias("kind"), F.col("metric").alias("name"), value.alias("value"), "unit",
        "is_primary",
    )


def contrast(points: DataFrame, keys: list[str], at: Column, opened: Column, value: Column) -> DataFrame:
    """Mean before the opening against mean and peak after it."""
    before, after = F.when(at < opened, value), F.when(at >= opened, value)
    return points.groupBy(*keys).agg(
        F.avg(before).alias("baseline_mean"), F.avg(after).alias("fault_mean"),
        F.max(after).alias("fault_max"), F.min(after).alias("fault_min"),
    )


def onset(points: DataFrame) -> DataFrame:
    """First step, counted from the opening, at which a service's signal has moved."""
    moved = points.filter("development > 0")
    return moved.groupBy("pattern_id", "hops").agg(
        F.min(F.col("step") - C.BASELINE_MINUTES * 60 // C.SAMPLE_SECONDS).alias("first_step"),
        F.count(F.lit(1)).alias("moved_points"),
    )
