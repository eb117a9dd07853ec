"""Evaluation statistics of a scored, labelled frame ``(score double, label int)``."""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.operators.ordered import RANGE, ROWS_PER_RANGE, ranged, running_totals
from lodestone.staging import stage


def grouped_scores(scored: DataFrame) -> DataFrame:
    """One row per distinct score: ties stay together and copies collapse early.

    ``bad`` counts labels other than 0 and 1, for ``validated`` to refuse.
    """
    return scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"),
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad"),
    )


def validated(groups: DataFrame) -> DataFrame:
    """Fail on no rows, a label other than 0 or 1, a missing class or a score that is no number."""
    bad = groups.agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"),
        F.max(F.isnan("score") | F.col("score").isNull()).alias("nan"), F.sum("bad").alias("bad"),
    ).first()
    if bad["p"] is None:
        raise ValueError("no observations")
    if bad["bad"]:
        raise ValueError("labels must be 0 or 1")
    if not bad["p"] or not bad["n"]:
        raise ValueError("both classes must be present; a one-class set has no curve")
    if bad["nan"]:
        raise ValueError("scores must be numbers")
    return groups.drop("bad")


def cumulative(scored: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Distinct scores with own counts ``p, n`` and totals ``tp, fp`` down to each
    score, and the class sizes ``positives, negatives``."""
    groups = validated(stage(grouped_scores(scored), "scores"))
    totals = groups.agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    counted = running_totals(
        groups, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")},
        rows_per_range=rows_per_range, materialise=False,
    )
    return counted.withColumns(
        {"positives": totals.select("p").scalar(), "negatives": totals.select("n").scalar()}
    )


def roc_points(scored: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    points = cumulative(scored, rows_per_range).select(
        F.col("score").cast("double").alias("threshold"),
        (F.col("fp") / F.col("negatives")).alias("false_positive_rate"),
        (F.col("tp") / F.col("positives")).alias("true_positive_rate"),
    )
    start = scored.sparkSession.range(1).select(
        F.lit(math.inf).alias("threshold"), F.lit(0.0).alias("false_positive_rate"),
        F.lit(0.0).alias("true_positive_rate"),
    )
    return points.unionByName(start)


def auc_both_ways(scored: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Area by trapezoids and by rank sums, in one pass over the running totals.

    A group of tied scores adds a trapezoid whose left height is the count before
    it, so no neighbouring row has to be looked up.
    """
    c = cumulative(scored, rows_per_range)
    size = F.col("p") + F.col("n")
    below = F.col("positives") + F.col("negatives") - F.col("tp") - F.col("fp")
    mean_rank = below + (size + 1) / 2
    sums = c.agg(
        F.sum(F.col("n").cast("double") * (2 * F.col("tp") - F.col("p")) / 2).alias("area"),
        F.sum(F.col("p") * mean_rank).alias("ranks"),
        F.max("positives").cast("double").alias("pos"),
        F.max("negatives").cast("double").alias("neg"),
    )
    return sums.select(
        (F.col("area") / (F.col("pos") * F.col("neg"))).alias("auc_trapezoid"),
        (
            (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2)
            / (F.col("pos") * F.col("neg"))
        ).alias("auc_rank_sum"),
    )


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    defined = (precision > 0) | (recall > 0)
    return F.when(
        defined, (1 + b2) * precision * recall / (b2 * precision + recall)
    ).otherwise(0.0)


def pr_points(scored: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    return cumulative(scored, rows_per_range).select(
        F.col("score").cast("double").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("positives")).alias("recall"),
        (F.col("p") / F.col("positives")).alias("recall_gain"),
    )


def average_precision(points: DataFrame, beta: float = 1.0) -> DataFrame:
    """Step sum of precision, and the threshold with the best F (highest on ties)."""
    f = f_beta(F.col("precision"), F.col("recall"), beta)
    best = F.max_by(
        F.struct("threshold", f.alias("f")), F.struct(f.alias("f"), "threshold")
    ).alias("best")
    return points.agg(
        F.sum(F.col("recall_gain") * F.col("precision")).alias("average_precision"), best
    ).select("average_precision", F.col("best.threshold").alias("best_threshold"),
             F.col("best.f").alias("best_f"))


def youden_point(points: DataFrame) -> DataFrame:
    order = F.struct(
        (F.col("true_positive_rate") - F.col("false_positive_rate")).alias("j"),
        (-F.col("false_positive_rate")).alias("low_fpr"), "threshold",
    )
    return _pick(points, F.max_by, order)


def budget_point(points: DataFrame, limit: float) -> DataFrame:
    """Most sensitive point within a false-positive budget; an error if there is none."""
    eligible = points.filter(F.col("false_positive_rate") <= limit)
    order = F.struct(
        "true_positive_rate", (-F.col("false_positive_rate")).alias("low_fpr"), "threshold"
    )
    return _pick(eligible, F.max_by, order)


def refusal_point(points: DataFrame, lost: float) -> DataFrame:
    """Finite point keeping ``1 - lost`` of the positives at the least false-positive rate."""
    eligible = points.filter(
        (F.col("true_positive_rate") >= 1 - lost) & (F.col("threshold") < math.inf)
    )
    order = F.struct("false_positive_rate", (-F.col("threshold")).alias("high"))
    return _pick(eligible, F.min_by, order)


def _pick(points: DataFrame, chooser, order: Column) -> DataFrame:
    row = F.struct("threshold", "false_positive_rate", "true_positive_rate")
    found = F.coalesce(chooser(row, order), F.raise_error(F.lit("no point of the curve is within the budget")))
    return points.agg(found.alias("r")).select("r.*")


class Statistic(Protocol):
    """A number of a resample, put together from sums over ranges of scores.

    ``partial`` gets the scores of a range, best first, the drawn counts of positives and
    negatives (replicates by scores) and those of all better ranges (by replicate); it
    returns one array per name in ``sums``. ``value`` makes the number from the columns
    named in ``sums`` and from ``p`` and ``n``, summed over all ranges. A null value leaves
    the replicate out.
    """

    sums: tuple[str, ...]

    def partial(
        self, scores: np.ndarray, p: np.ndarray, n: np.ndarray, p_before: np.ndarray, n_before: np.ndarray
    ) -> tuple[np.ndarray, ...]: ...

    def value(self) -> Column: ...


class Auc:
    """Area under the ROC curve."""

    sums = ("area",)

    def partial(self, scores, p, n, p_before, n_before) -> tuple[np.ndarray, ...]:
        return ((n * (p_before[:, None] + np.cumsum(p, axis=1) - p / 2)).sum(1),)

    def value(self) -> Column:
        return F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area") / (F.col("p") * F.col("n")))


class AveragePrecision:
    """Precision at each score, weighted by the positives it adds."""

    sums = ("weighted",)

    def partial(self, scores, p, n, p_before, n_before) -> tuple[np.ndarray, ...]:
        hits = p_before[:, None] + np.cumsum(p, axis=1)
        seen = hits + n_before[:, None] + np.cumsum(n, axis=1)
        return ((p * np.divide(hits, seen, out=np.zeros_like(hits), where=seen > 0)).sum(1),)

    def value(self) -> Column:
        return F.when(F.col("p") > 0, F.col("weighted") / F.col("p"))


class Accuracy:
    """Share of rows on their side of a threshold."""

    sums = ("right",)

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def partial(self, scores, p, n, p_before, n_before) -> tuple[np.ndarray, ...]:
        above = scores >= self.threshold
        return (p[:, above].sum(1) + n[:, ~above].sum(1),)

    def value(self) -> Column:
        return F.try_divide(F.col("right"), F.col("p") + F.col("n"))


# The step and the two factors of a published 64-bit mixing function.
_STEP, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_SECOND)
    return z ^ (z >> np.uint64(31))


def _poisson(counts: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Poisson numbers of mean ``counts`` (by column) at the given places of their distribution."""
    out = np.zeros(chance.shape)
    for mean in np.unique(counts[counts > 0]):
        reach = 12 * math.sqrt(mean) + 30
        low = max(0, math.floor(mean - reach))
        values = np.arange(low, math.ceil(mean + reach) + 1)
        logs = np.concatenate([[0.0], np.log(np.arange(1, values[-1] + 1, dtype=float))]).cumsum()[values]
        below = np.cumsum(np.exp(values * math.log(mean) - mean - logs))
        at = np.flatnonzero(counts == mean)
        out[:, at] = low + np.searchsorted(below, chance[:, at], side="right")
    return out


def draws(scores: np.ndarray, p: np.ndarray, n: np.ndarray, resamples: int, seed: int):
    """Drawn counts (replicates by scores) of positives and negatives.

    A draw is a digest of the score, the side, the replicate and the seed, taken as a place
    in the Poisson distribution. It depends on nothing else, and SQL can repeat it.
    """
    with np.errstate(over="ignore"):
        own = _mixed((np.asarray(scores, dtype=float) + 0.0).view(np.uint64) + np.uint64(seed) * np.uint64(_STEP))
        at = np.arange(1, resamples + 1, dtype=np.uint64)[:, None] * np.uint64(2)
        return tuple(
            _poisson(counts, (_mixed(own[None, :] + (at + np.uint64(side)) * np.uint64(_STEP))
                              >> np.uint64(11)) * 2.0**-53)
            for side, counts in ((0, p), (1, n)))


def bootstrap(
    scored: DataFrame, statistic: Statistic, resamples: int = 2000, confidence: float = 0.95,
    seed: int = C.SEED, rows_per_range: int = 20_000,
) -> DataFrame:
    """Percentile interval ``(low, high, used)`` of any ``Statistic``.

    Every distinct score keeps its two counts, and a replicate draws a Poisson number for
    each of them: the large-sample form of resampling rows. Draws come from digests, so they
    do not depend on how rows are laid out or split in ranges, and a second pass can make
    them again. The first pass sums the counts of each range; running sums tell every range
    what better ones hold, so statistics that need the order come out exact. What is
    shuffled is replicates times ranges.
    """
    groups = validated(stage(grouped_scores(scored), "scores"))
    rows = ranged(groups, [F.desc("score")], rows_per_range, materialise=False)
    names = ["p", "n", *statistic.sums]

    def walked(pdf: pd.DataFrame, p_before: np.ndarray, n_before: np.ndarray, sums):
        pdf = pdf.sort_values("score", ascending=False)
        scores, total = pdf["score"].to_numpy(dtype=float), np.zeros((2 + len(sums), resamples))
        for start in range(0, len(pdf), 500):
            part = slice(start, start + 500)
            p, n = draws(scores[part], pdf["p"].to_numpy()[part], pdf["n"].to_numpy()[part], resamples, seed)
            made = [p.sum(1), n.sum(1)]
            if sums:
                made += statistic.partial(scores[part], p, n, p_before + total[0], n_before + total[1])
            total += np.array(made)
        return pd.DataFrame(total.T, columns=["p", "n", *sums]).assign(replicate=np.arange(resamples))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        nothing = np.zeros(resamples)
        return walked(pdf, nothing, nothing, ()).assign(part=int(pdf[RANGE].iloc[0]))

    def measure(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        before = before.sort_values("replicate")
        return walked(pdf, before["p"].to_numpy(dtype=float), before["n"].to_numpy(dtype=float), statistic.sums)

    parts = rows.groupBy(RANGE).applyInPandas(count, "p double, n double, replicate int, part int")
    earlier = Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stage(parts.select(
        F.col("part").alias(RANGE), "replicate",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(c) for c in ("p", "n")]), "counts-before")
    schema = ", ".join(f"{c} double" for c in names) + ", replicate int"
    measured = rows.groupBy(RANGE).cogroup(before.groupBy(RANGE)).applyInPandas(measure, schema)
    estimates = measured.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names]).select(
        statistic.value().alias("e")
    ).filter("e IS NOT NULL")
    tail = (1.0 - confidence) / 2
    # ``resamples`` numbers at most, whatever the table holds.
    ordered = estimates.agg(F.sort_array(F.collect_list("e")).alias("e")).withColumn("m", F.size("e"))
    low = F.greatest(F.lit(0), F.floor(tail * F.col("m"))).cast("int")
    high = F.least(F.col("m") - 1, F.ceil((1 - tail) * F.col("m")) - 1).cast("int")
    return ordered.select(F.get("e", low).alias("low"), F.get("e", high).alias("high"), F.col("m").alias("used"))


def bootstrap_auc(scored: DataFrame, **options) -> DataFrame:
    """``(point, low, high, used)`` of the AUC; options as for ``bootstrap``."""
    point = auc_both_ways(scored).select("auc_rank_sum").scalar()
    return bootstrap(scored, Auc(), **options).select(point.alias("point"), "low", "high", "used")


def rank_metrics(judged: DataFrame) -> DataFrame:
    """hit@1, hit@3, MRR and n from ``(query_id, rank, is_gold)``."""
    first = judged.groupBy("query_id").agg(
        F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("first_gold")
    )
    return first.agg(
        F.round(F.avg(F.when(F.col("first_gold") == 1, 1.0).otherwise(0.0)), 6).alias("hit_at_1"),
        F.round(F.avg(F.when(F.col("first_gold") <= 3, 1.0).otherwise(0.0)), 6).alias("hit_at_3"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_gold"), F.lit(0.0))), 6).alias("mrr"),
        F.count(F.lit(1)).alias("n"),
    )
