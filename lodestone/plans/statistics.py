"""Evaluation statistics over the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions import stats as S
from lodestone.operators import curves
from lodestone.plans.tables import table


def _labelled(spark, folder):
    docs = table(spark, folder, "documents")
    return table(spark, folder, "labels").join(docs, "doc_id")


def _scored(spark, folder):
    return _labelled(spark, folder).select(
        F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label")
    )


def roc_points(spark, folder):
    return curves.roc_points(_scored(spark, folder)).select(
        "threshold",
        F.round("false_positive_rate", 6).alias("false_positive_rate"),
        F.round("true_positive_rate", 6).alias("true_positive_rate"),
    )


def auc_both_ways(spark, folder):
    return curves.auc_both_ways(_scored(spark, folder)).select(
        F.round("auc_trapezoid", 6).alias("auc_trapezoid"),
        F.round("auc_rank_sum", 6).alias("auc_rank_sum"),
    )


def pr_points(spark, folder):
    return curves.pr_points(_scored(spark, folder)).select(
        "threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
        F.round(curves.f_beta(F.col("precision"), F.col("recall"), 2.0), 6).alias("f2"),
    )


def average_precision(spark, folder):
    found = curves.average_precision(curves.pr_points(_scored(spark, folder)))
    return found.select(
        F.round("average_precision", 6).alias("average_precision"), "best_threshold",
        F.round("best_f", 6).alias("best_f"),
    )


def operating_points(spark, folder):
    """Youden, false-answer budget and false-refusal points of one curve."""
    from lodestone.staging import stage

    points = stage(curves.roc_points(_scored(spark, folder)), "roc")
    chosen = [
        ("youden", curves.youden_point(points)),
        ("sufficient_above", curves.budget_point(points, C.FALSE_ANSWER_BUDGET)),
        ("insufficient_below", curves.refusal_point(points, C.DERIVED_REFUSAL_BUDGET)),
    ]
    out = None
    for name, point in chosen:
        row = point.select(
            F.lit(name).alias("rule"), "threshold",
            F.round("false_positive_rate", 6).alias("false_positive_rate"),
            F.round("true_positive_rate", 6).alias("true_positive_rate"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def _interval(rows):
    return rows.select(*[F.round(c, 8).alias(c) if c != "used" else F.col(c) for c in rows.columns])


def bootstrap_auc(spark, folder):
    return _interval(curves.bootstrap_auc(_scored(spark, folder)))


def bootstrap_average_precision(spark, folder):
    return _interval(curves.bootstrap(_scored(spark, folder), curves.AveragePrecision(), resamples=1000))


def wilson_by_source(spark, folder):
    counted = _labelled(spark, folder).groupBy("source").agg(
        F.count_if(F.col("toxic") == 1).alias("successes"), F.count(F.lit(1)).alias("trials")
    )
    interval = counted.withColumn("w", S.wilson(F.col("successes"), F.col("trials")))
    budget = F.lit(0.25)
    return interval.select(
        "source", "successes", "trials",
        F.round("w.point", 6).alias("point"), F.round("w.low", 6).alias("low"),
        F.round("w.high", 6).alias("high"),
        S.budget_state(F.col("w.point"), F.col("w.high"), budget).alias("state"),
        F.round(S.axis_percent(F.col("w.point"), F.col("w.high"), budget), 4).alias("axis_percent"),
    )


def mcnemar_rules(spark, folder):
    """Two rules for quality on the same documents: long text, and not toxic."""
    judged = _labelled(spark, folder).select(
        "lang",
        (F.col("n_chars") >= 1000).cast("int").eqNullSafe(F.col("quality")).alias("a"),
        (1 - F.col("toxic")).eqNullSafe(F.col("quality")).alias("b"),
    )
    counted = judged.groupBy("lang").agg(
        F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
        F.count_if(F.col("b") & ~F.col("a")).alias("only_b"),
    )
    return counted.withColumn(
        "p_value", F.round(S.mcnemar_p(F.col("only_a"), F.col("only_b")), 6)
    )


def required_sample_size(spark, folder):
    rates = _labelled(spark, folder).groupBy("lang").agg(F.avg("quality").alias("rate"))
    return rates.select(
        "lang", F.round("rate", 6).alias("rate"),
        F.explode(F.array(*[F.lit(d) for d in (0.01, 0.02, 0.05)])).alias("difference"),
    ).withColumn("n", S.sample_size(F.col("rate"), F.col("difference")))


def label_mechanism_counts(spark, folder):
    """Counts by ``label/mechanism``, the mechanism being the document's source."""
    key = F.concat_ws(
        "/", F.when(F.col("quality") == 1, "answerable").otherwise("unanswerable"), F.col("source")
    )
    return _labelled(spark, folder).groupBy(key.alias("composition")).agg(
        F.count(F.lit(1)).alias("n")
    ).orderBy("composition")


def class_floor_and_ceiling(spark, folder):
    return _scored(spark, folder).agg(
        F.min(F.when(F.col("label") == 1, F.col("score"))).alias("positive_floor"),
        F.max(F.when(F.col("label") == 0, F.col("score"))).alias("negative_ceiling"),
    ).withColumn("overlap", F.col("positive_floor") <= F.col("negative_ceiling"))


QUERIES = {
    "roc_points": roc_points,
    "auc_both_ways": auc_both_ways,
    "pr_points": pr_points,
    "average_precision": average_precision,
    "operating_points": operating_points,
    "bootstrap_auc": bootstrap_auc,
    "bootstrap_average_precision": bootstrap_average_precision,
    "wilson_by_source": wilson_by_source,
    "mcnemar_rules": mcnemar_rules,
    "required_sample_size": required_sample_size,
    "label_mechanism_counts": label_mechanism_counts,
    "class_floor_and_ceiling": class_floor_and_ceiling,
}

_SCORED = """scored AS (
        SELECT CAST(n_chars AS DOUBLE) AS score, quality AS label
        FROM labels JOIN documents USING (doc_id)),
    groups AS (
        SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
        FROM scored GROUP BY score),
    cum AS (
        SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp,
            sum(p) OVER () AS pos, sum(n) OVER () AS neg
        FROM groups WINDOW w AS (ORDER BY score DESC)),
    roc AS (
        SELECT CAST('Infinity' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr,
            CAST(0 AS DOUBLE) AS tpr
        UNION ALL SELECT score, CAST(fp / neg AS DOUBLE), CAST(tp / pos AS DOUBLE) FROM cum)"""
_POINT = """threshold, round(fpr, 6) AS false_positive_rate,
            round(tpr, 6) AS true_positive_rate"""
_LABELLED = "labels JOIN documents USING (doc_id)"
_Z = S.normal_quantile(0.975)
_ZB = S.normal_quantile(0.80)

ORACLE = {
    "roc_points": f"WITH {_SCORED} SELECT {_POINT} FROM roc",
    "auc_both_ways": f"""
        WITH {_SCORED},
        steps AS (
            SELECT tpr, fpr, lag(tpr) OVER (ORDER BY fpr, tpr) AS tpr0,
                lag(fpr) OVER (ORDER BY fpr, tpr) AS fpr0 FROM roc),
        ranks AS (
            SELECT label, rank() OVER (ORDER BY score)
                + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored),
        u AS (
            SELECT sum(r) FILTER (label = 1) AS rp, count(*) FILTER (label = 1) AS p,
                count(*) FILTER (label = 0) AS n FROM ranks)
        SELECT (SELECT round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) FROM steps) AS auc_trapezoid,
            round(CAST((rp - p * (p + 1) / 2.0) / (p * n) AS DOUBLE), 6) AS auc_rank_sum FROM u""",
    "pr_points": f"""
        WITH {_SCORED},
        pr AS (SELECT score AS threshold, tp / (tp + fp) AS p, tp / pos AS r FROM cum)
        SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall,
            round(CASE WHEN p = 0 AND r = 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END, 6) AS f2
        FROM pr""",
    "average_precision": f"""
        WITH {_SCORED},
        pr AS (
            SELECT score AS threshold, tp / (tp + fp) AS p, tp / pos AS r,
                tp / pos - coalesce(lag(tp) OVER (ORDER BY score DESC), 0) / pos AS gain FROM cum),
        f AS (
            SELECT *, CASE WHEN p = 0 AND r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM pr)
        SELECT round(sum(gain * p), 6) AS average_precision,
            arg_max(threshold, (f, threshold)) AS best_threshold, round(max(f), 6) AS best_f
        FROM f""",
    "operating_points": f"""
        WITH {_SCORED}
        (SELECT 'youden' AS rule, {_POINT} FROM roc
            ORDER BY tpr - fpr DESC, fpr, threshold DESC LIMIT 1)
        UNION ALL (SELECT 'sufficient_above', {_POINT} FROM roc
            WHERE fpr <= 0.05 ORDER BY tpr DESC, fpr, threshold DESC LIMIT 1)
        UNION ALL (SELECT 'insufficient_below', {_POINT} FROM roc
            WHERE tpr >= 0.98 AND threshold < 'Infinity' ORDER BY fpr, threshold DESC LIMIT 1)""",
    "wilson_by_source": f"""
        WITH c AS (
            SELECT source, count(*) FILTER (toxic = 1) AS successes, count(*) AS trials
            FROM {_LABELLED} GROUP BY source),
        w AS (
            SELECT *, successes / trials AS p, {_Z} AS z, CAST(trials AS DOUBLE) AS n FROM c),
        i AS (
            SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS c0,
                z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS s FROM w),
        b AS (SELECT *, greatest(0, c0 - s) AS lo, least(1, c0 + s) AS hi FROM i)
        SELECT source, successes, trials, round(p, 6) AS point, round(lo, 6) AS low,
            round(hi, 6) AS high,
            CASE WHEN p >= 0.25 THEN 'over budget' WHEN hi < 0.25 THEN 'clear of budget'
                ELSE 'within budget, interval not yet tight' END AS state,
            round(least(100, p / greatest(CAST(0.25 AS DOUBLE) / CAST(0.6 AS DOUBLE),
                hi * CAST(1.15 AS DOUBLE)) * 100), 4) AS axis_percent
        FROM b""",
    "mcnemar_rules": f"""
        WITH j AS (
            SELECT lang, CAST(n_chars >= 1000 AS INTEGER) = quality AS a,
                1 - toxic = quality AS b FROM {_LABELLED}),
        c AS (
            SELECT lang, count(*) FILTER (a AND NOT b) AS only_a,
                count(*) FILTER (b AND NOT a) AS only_b FROM j GROUP BY lang),
        t AS (
            SELECT lang, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
                - n * ln(2))) AS tail
            FROM (SELECT lang, CAST(only_a + only_b AS DOUBLE) AS n,
                    CAST(unnest(range(least(only_a, only_b) + 1)) AS DOUBLE) AS k FROM c)
            GROUP BY lang)
        SELECT lang, only_a, only_b, CASE WHEN only_a + only_b = 0 THEN 1
            ELSE round(least(1, 2 * tail), 6) END AS p_value FROM c JOIN t USING (lang)""",
    "required_sample_size": f"""
        WITH r AS (SELECT lang, avg(quality) AS raw FROM {_LABELLED} GROUP BY lang),
        d AS (SELECT lang, raw AS p1,
            unnest([CAST(0.01 AS DOUBLE), CAST(0.02 AS DOUBLE), CAST(0.05 AS DOUBLE)]) AS difference
            FROM (SELECT lang, round(raw, 6) AS raw FROM r)),
        q AS (SELECT *, least(0.999999, greatest(0.000001, p1 + difference)) AS p2 FROM d),
        m AS (SELECT *, (p1 + p2) / 2 AS pl FROM q)
        SELECT lang, p1 AS rate, difference, CAST(ceil(
            pow({_Z} * sqrt(2 * pl * (1 - pl)) + {_ZB} * sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2)
            / pow(p2 - p1, 2)) AS BIGINT) AS n FROM m""",
    "label_mechanism_counts": f"""
        SELECT CASE WHEN quality = 1 THEN 'answerable' ELSE 'unanswerable' END || '/' || source
            AS composition, count(*) AS n FROM {_LABELLED} GROUP BY 1""",
    "class_floor_and_ceiling": f"""
        WITH {_SCORED}, x AS (SELECT min(score) FILTER (label = 1) AS positive_floor,
            max(score) FILTER (label = 0) AS negative_ceiling FROM scored)
        SELECT *, positive_floor <= negative_ceiling AS overlap FROM x""",
}


def _mixed_sql(z: str) -> str:
    """The mixing function over unsigned 128-bit numbers, modulo 2^64."""
    wrap = "18446744073709551616::UHUGEINT"
    one = f"(xor({z}, {z} >> 30) * {curves._FIRST}::UHUGEINT) % {wrap}"
    return one, "(xor({0}, {0} >> 27) * " + f"{curves._SECOND}::UHUGEINT) % {wrap}", "xor({0}, {0} >> 31)"


def _resampled_sql(resamples: int) -> str:
    """CTE ``drawn(score, replicate, p, n)``: Poisson counts from digests."""
    step, wrap = f"{curves._STEP}::UHUGEINT", "18446744073709551616::UHUGEINT"

    def mixed(source: str, z: str, out: str, keep: str) -> str:
        a, b, c = _mixed_sql("z0")
        return (f"{out}_0 AS (SELECT {keep}, ({z}) % {wrap} AS z0 FROM {source}), "
                f"{out}_1 AS (SELECT {keep}, {a} AS z1 FROM {out}_0), "
                f"{out}_2 AS (SELECT {keep}, {b.format('z1')} AS z2 FROM {out}_1), "
                f"{out} AS (SELECT {keep}, {c.format('z2')} AS z FROM {out}_2)")

    bits = "CAST(CAST(CAST(score AS BIT) AS VARCHAR) AS BIT)::UBIGINT::UHUGEINT"
    return f"""{_SCORED.split('    cum AS (')[0].rstrip().rstrip(',')},
        {mixed('groups', f"{bits} + ({C.SEED}::UHUGEINT * {step}) % {wrap}", 'own', 'score, p, n')},
        cells AS (SELECT own.score, r.replicate, side, CASE side WHEN 0 THEN p ELSE n END AS mean,
            z + ((2 * (r.replicate + 1) + side)::UHUGEINT * {step}) % {wrap} AS asked
            FROM own, range({resamples}) r(replicate), range(2) s(side)),
        {mixed('cells', 'asked', 'place', 'score, replicate, side, mean')},
        means AS (SELECT DISTINCT mean FROM cells WHERE mean > 0),
        chances AS (
            SELECT mean, list(below ORDER BY j) AS below FROM (
                SELECT mean, j, sum(exp(j * ln(mean) - mean - lgamma(j + 1))) OVER (
                    PARTITION BY mean ORDER BY j) AS below
                FROM means, LATERAL (SELECT unnest(range(0, CAST(ceil(mean + 12 * sqrt(mean) + 30) AS BIGINT) + 1)) AS j))
            GROUP BY mean),
        counts AS (
            SELECT score, replicate, side, CASE WHEN mean = 0 THEN 0 ELSE len(list_filter(
                below, lambda b: b <= CAST(CAST(z AS UBIGINT) >> 11 AS DOUBLE) * pow(2, -53))) END AS k
            FROM place LEFT JOIN chances USING (mean)),
        drawn AS (SELECT score, replicate, CAST(sum(k) FILTER (side = 0) AS DOUBLE) AS p,
            CAST(sum(k) FILTER (side = 1) AS DOUBLE) AS n FROM counts GROUP BY score, replicate)"""


_BOUNDS = """ordered AS (SELECT list(e ORDER BY e) AS e, count(*) AS m FROM estimates WHERE e IS NOT NULL),
        bounds AS (SELECT e[CAST(greatest(0, floor((1.0::DOUBLE - 0.95) / 2 * m)) AS BIGINT) + 1] AS low,
            e[CAST(least(m - 1, ceil((1 - (1.0::DOUBLE - 0.95) / 2) * m) - 1) AS BIGINT) + 1] AS high,
            CAST(m AS INTEGER) AS used FROM ordered)"""
ORACLE |= {
    "bootstrap_auc": f"""
        WITH {_resampled_sql(2000)},
        better AS (SELECT *, sum(p) OVER (PARTITION BY replicate ORDER BY score DESC) - p / 2 AS before FROM drawn),
        estimates AS (SELECT CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(n * before) / (sum(p) * sum(n)) END AS e
            FROM better GROUP BY replicate),
        {_BOUNDS},
        point AS (SELECT sum(n * before) / (sum(p) * sum(n)) AS point FROM (
            SELECT p, n, sum(p) OVER (ORDER BY score DESC) - p / 2 AS before FROM groups))
        SELECT round(point, 8) AS point, round(low, 8) AS low, round(high, 8) AS high, used FROM bounds, point""",
    "bootstrap_average_precision": f"""
        WITH {_resampled_sql(1000)},
        seen AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM drawn
            WINDOW w AS (PARTITION BY replicate ORDER BY score DESC)),
        estimates AS (SELECT CASE WHEN sum(p) > 0 THEN
            sum(CASE WHEN tp + fp > 0 THEN p * tp / (tp + fp) ELSE 0 END) / sum(p) END AS e FROM seen GROUP BY replicate),
        {_BOUNDS}
        SELECT round(low, 8) AS low, round(high, 8) AS high, used FROM bounds""",
}
