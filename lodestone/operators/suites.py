"""Evaluation suites: named checks over an assessed question set.

``assessed`` is ``(query_id, label, verdict, permits_answering, combined_score)``.
Every question is scored once; all checks read the same staged frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.stats import wilson

CHECK = "suite string, name string, passed boolean, value double"


def _rows(counted: DataFrame, suite: str, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    named = F.array(*[
        F.struct(
            F.lit(suite).alias("suite"), F.lit(name).alias("name"),
            passed.cast("boolean").alias("passed"), value.cast("double").alias("value"),
        )
        for name, (passed, value) in checks.items()
    ])
    return counted.select(F.explode(named).alias("c")).select("c.*")


def core(assessed: DataFrame, reached: DataFrame) -> DataFrame:
    """Blocking checks. ``reached(query_id, found)`` tells for each fault whether its
    document came back. The false-answer bound is twice the budget, as published."""
    yes, no = F.col("label") == "answerable", F.col("label") == "unanswerable"
    counted = assessed.agg(
        F.count_if(yes).alias("n_yes"), F.count_if(no).alias("n_no"),
        F.count_if(no & F.col("permits_answering")).alias("answered"),
        F.count_if(yes & (F.col("verdict") == "insufficient")).alias("refused"),
        F.count_if((F.col("verdict") == "ambiguous") & F.col("permits_answering")).alias("leaked"),
    ).withColumn(
        "unreachable", reached.agg(F.count_if(~F.col("found")).alias("n")).scalar()
    )
    false_answers = wilson(F.col("answered"), F.col("n_no"))
    refusals = wilson(F.col("refused"), F.col("n_yes"))
    return _rows(counted, "core", {
        "sample_is_large_enough": (
            (F.col("n_yes") >= C.MIN_CLASS_SIZE) & (F.col("n_no") >= C.MIN_CLASS_SIZE),
            F.least("n_yes", "n_no"),
        ),
        "false_answer_rate_within_budget": (
            false_answers["high"] <= C.FALSE_ANSWER_BUDGET * 2, false_answers["point"]
        ),
        "false_refusal_rate_within_budget": (
            refusals["point"] <= C.FALSE_REFUSAL_BUDGET, refusals["point"]
        ),
        "ambiguous_never_permits_answering": (F.col("leaked") == 0, F.col("leaked")),
        "every_fault_reaches_its_runbook": (F.col("unreachable") == 0, F.col("unreachable")),
    })


def probe(
    assessed: DataFrame, gold_ranks: DataFrame, value_absent: DataFrame
) -> DataFrame:
    """Known limits, reported and never blocking.

    ``gold_ranks(query_id, is_first)`` for questions with a known passage;
    ``value_absent(combined_score)`` of questions whose value is not stated.
    """
    score = F.col("combined_score")
    floor = F.min(F.when(F.col("label") == "answerable", score)).alias("floor")
    ceiling = F.max(F.when(F.col("label") == "unanswerable", score)).alias("ceiling")
    share = gold_ranks.agg(F.coalesce(F.avg(F.col("is_first").cast("double")), F.lit(0.0)).alias("s"))
    hard = value_absent.agg(F.max("combined_score").alias("s"))
    counted = assessed.agg(floor, ceiling).withColumns(
        {"share": share.scalar(), "hard": hard.scalar()}
    )
    return _rows(counted, "probe", {
        "signals_still_overlap": (F.col("floor") > F.col("ceiling"), F.col("floor") - F.col("ceiling")),
        "value_absent_questions_still_score_high": (
            F.col("hard") < C.PROBE_VALUE_CEILING, F.col("hard")
        ),
        "chunk_selection_is_weak": (F.col("share") >= C.PROBE_GOLD_SHARE, F.col("share")),
    })


def report(checks: DataFrame) -> DataFrame:
    """One row per suite; the probe always passes and warns instead."""
    is_probe = F.col("suite") == "probe"
    return checks.groupBy("suite").agg(
        F.bool_and(is_probe | F.col("passed")).alias("passed"),
        F.bool_or(is_probe & ~F.col("passed")).alias("warned"),
        F.sort_array(F.collect_list(F.struct("name", "passed", "value"))).alias("checks"),
    )
