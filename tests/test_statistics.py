import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import stats as S
from lodestone.operators import curves


def frame(spark, scores, labels):
    return spark.createDataFrame(list(zip(map(float, scores), labels, strict=True)), "score double, label int")


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(7)
    labels = [rng.randint(0, 1) for _ in range(300)]
    return [round(rng.gauss(y, 1.0), 1) for y in labels], labels  # rounded, so ties abound


def brute_auc(scores, labels):
    p = [s for s, y in zip(scores, labels, strict=True) if y]
    n = [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))


@pytest.mark.parametrize("rows_per_range", [7, 10_000])
def test_areas_agree_with_counting_pairs(spark, sample, rows_per_range):
    row = curves.auc_both_ways(frame(spark, *sample), rows_per_range).first()
    want = brute_auc(*sample)
    assert row.auc_trapezoid == pytest.approx(want, abs=1e-12)
    assert row.auc_rank_sum == pytest.approx(want, abs=1e-12)


def test_ties_make_one_point(spark):
    df = frame(spark, [1, 1, 1, 0.5, 0.5, 0, 0, 0], [1, 0, 1, 1, 0, 0, 1, 0])
    points = curves.roc_points(df, 2).orderBy(F.desc("threshold")).collect()
    assert [p.threshold for p in points] == [math.inf, 1.0, 0.5, 0.0]
    assert [(p.false_positive_rate, p.true_positive_rate) for p in points] == [
        (0.0, 0.0), (0.25, 0.5), (0.5, 0.75), (1.0, 1.0)
    ]


def test_operating_points(spark):
    df = frame(spark, [4, 3, 2, 1], [1, 0, 1, 0])
    points = curves.roc_points(df)
    assert curves.youden_point(points).first().threshold == 4.0
    assert curves.budget_point(points, 0.0).first().true_positive_rate == 0.5
    assert curves.refusal_point(points, 0.02).first().threshold == 2.0
    ap = curves.average_precision(curves.pr_points(df)).first()
    assert ap.average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_invalid_input_is_refused(spark):
    with pytest.raises(ValueError, match="both classes"):
        curves.roc_points(frame(spark, [1, 2], [1, 1]))
    with pytest.raises(ValueError, match="numbers"):
        curves.roc_points(frame(spark, [1, float("nan")], [1, 0]))
    with pytest.raises(ValueError, match="labels"):
        curves.roc_points(frame(spark, [1.0, 2.0, 3.0], [2, 1, 0]))


def test_bootstrap_is_seeded_and_covers(spark, sample):
    df = frame(spark, *sample)
    one = curves.bootstrap_auc(df, resamples=300, rows_per_range=20).first()
    two = curves.bootstrap_auc(df.repartition(3), resamples=300, rows_per_range=1000).first()
    assert one == two  # neither the layout nor the ranges matter
    assert one.low < one.point < one.high and one.used == 300
    assert 0.02 < one.high - one.low < 0.2


def test_bootstrap_of_another_statistic(spark, sample):
    row = curves.bootstrap(frame(spark, *sample), curves.Accuracy(0.5), resamples=300).first()
    right = sum((s >= 0.5) == bool(y) for s, y in zip(*sample, strict=True)) / len(sample[0])
    assert row.low < right < row.high and row.used == 300 and row.high - row.low < 0.2


def test_average_precision_interval_equals_a_plain_walk_over_the_draws(spark, sample):
    scores, labels = sample
    one = curves.bootstrap(frame(spark, *sample), curves.AveragePrecision(), resamples=200, rows_per_range=15).first()
    kinds = sorted(set(scores), reverse=True)
    p = np.array([sum(y for s, y in zip(scores, labels, strict=True) if s == k) for k in kinds])
    n = np.array([sum(1 - y for s, y in zip(scores, labels, strict=True) if s == k) for k in kinds])
    dp, dn = curves.draws(np.array(kinds, dtype=float), p, n, 200, C.SEED)
    values = []
    for a, b in zip(dp, dn, strict=True):
        tp = fp = total = 0.0
        for x, y in zip(a, b, strict=True):
            tp, fp = tp + x, fp + y
            total += x * tp / (tp + fp) if tp + fp else 0.0
        values.append(total / a.sum())
    values.sort()
    assert (one.low, one.high) == (pytest.approx(values[5]), pytest.approx(values[194]))


def test_draws_have_the_mean_and_spread_of_their_distribution():
    for mean in (1, 3, 40, 100_000):
        p, n = curves.draws(np.arange(50) / 7, np.full(50, mean), np.full(50, mean), 2000, 1)
        assert abs(p.mean() / mean - 1) < 0.02 and abs(n.var() / mean - 1) < 0.05
        assert abs(np.corrcoef(p[:, 0], p[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(p[:, 0], n[:, 0])[0, 1]) < 0.1


def test_no_point_within_budget_is_an_error(spark):
    points = curves.roc_points(frame(spark, [2, 1], [0, 1])).where("threshold < 2")
    with pytest.raises(Exception, match="budget"):
        curves.budget_point(points, 0.5).collect()


def test_published_intervals(spark):
    df = spark.createDataFrame([(15, 319), (9, 396), (0, 50), (50, 50)], "s long, n long")
    rows = [r.w for r in df.select(S.wilson(F.col("s"), F.col("n")).alias("w")).collect()]
    assert [(round(r.low, 3), round(r.high, 3)) for r in rows[:2]] == [(0.029, 0.076), (0.012, 0.043)]
    assert rows[2].low == 0.0 and rows[3].high == pytest.approx(1.0) and rows[3].high <= 1.0
    with pytest.raises(Exception, match="successes"):
        df.select(S.wilson(F.col("n") + 1, F.col("n"))).collect()


def test_quantile(spark):
    for p, z in ((0.975, 1.959964), (0.5, 0.0), (0.001, -3.090232), (0.999, 3.090232)):
        assert S.normal_quantile(p) == pytest.approx(z, abs=1e-5)
        got = spark.range(1).select(S.normal_quantile_of(F.lit(p))).first()[0]
        assert got == pytest.approx(S.normal_quantile(p), abs=1e-12)
    with pytest.raises(ValueError):
        S.normal_quantile(1.0)


def test_exact_mcnemar(spark):
    cases = [(0, 0), (1, 0), (91, 28), (5, 5), (3, 9)]
    df = spark.createDataFrame(cases, "a long, b long")
    got = [r[0] for r in df.select(S.mcnemar_p(F.col("a"), F.col("b"))).collect()]
    for (a, b), p in zip(cases, got, strict=True):
        n = a + b
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(a, b) + 1)) / 2**n)
        assert p == pytest.approx(want, rel=1e-9)


def test_sample_size(spark):
    n = spark.range(1).select(S.sample_size(F.lit(0.5), F.lit(0.1))).first()[0]
    assert n == 388


def test_rank_metrics(spark):
    rows = [(1, 1, True), (1, 2, False), (2, 1, False), (2, 3, True), (3, 1, False)]
    r = curves.rank_metrics(spark.createDataFrame(rows, "query_id int, rank int, is_gold boolean")).first()
    assert (r.hit_at_1, r.hit_at_3, r.mrr, r.n) == (round(1 / 3, 6), round(2 / 3, 6), round((1 + 1 / 3) / 3, 6), 3)
