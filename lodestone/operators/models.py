"""Fitted evidence models and their checks."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.operators.dataset import grouped_folds
from lodestone.operators.ordered import running_totals
from lodestone.staging import stage

#: Bins of a column in boosting, as many as the trees divide it in.
BINS = 32
WEIGHT = "_rows"
#: Folded training rows of one task.
FOLDED_ROWS = 50_000


def varying_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns that are not constant, from one pass of minima and maxima."""
    ends = rows.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    ).first()
    return [c for c in columns if ends[f"lo_{c}"] != ends[f"hi_{c}"]]


def column_hygiene(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, constant)``."""
    ends = rows.agg(*[(F.min(c) == F.max(c)).alias(c) for c in columns])
    return ends.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns])
    )).alias("feature", "constant"))


def as_vector(rows: DataFrame, names: list[str], output: str = "features") -> DataFrame:
    """Features in the model's own order, by name; a missing one is an error."""
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"model expects features these rows do not have: {missing}")
    return VectorAssembler(inputCols=names, outputCol=output).transform(rows)


def logistic(names: list[str]) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=100),
    ])


def boosted(names: list[str], trees: int = 250, rate: float = 0.08) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="features"),
        GBTClassifier(labelCol="label", weightCol=WEIGHT, maxBins=BINS, maxIter=trees, stepSize=rate, seed=C.SEED),
    ])


def bin_edges(folded: DataFrame, names: list[str], folds: list[int]) -> dict[int, dict[str, list[float]]]:
    """For every fold, the inner edges of each column's bins, from the rows of all other folds.

    The bins hold equal shares of the rows, and a column of at most BINS values has one bin for
    each. Values are counted before they are ordered; the driver sees the edges only.
    """
    cells = folded.select("fold", F.posexplode(F.array(*[F.col(c).cast("double") for c in names])).alias("at", "value"))
    counts = cells.where("value IS NOT NULL AND NOT isnan(value)").groupBy("at", "value").agg(
        *[F.count_if(F.col("fold") != f).alias(f"n_{f}") for f in folds]
    )
    counts = stage(counts, "value-counts")
    sizes = counts.groupBy("at").agg(
        *[F.sum(f"n_{f}").alias(f"rows_{f}") for f in folds],
        *[F.count_if(F.col(f"n_{f}") > 0).alias(f"values_{f}") for f in folds],
    )
    placed = running_totals(
        counts, [F.col("value")], {f"upto_{f}": F.col(f"n_{f}") for f in folds}, ["at"], materialise=False
    ).join(sizes, "at")

    def is_edge(f: int):
        upto, n, rows = F.col(f"upto_{f}"), F.col(f"n_{f}"), F.col(f"rows_{f}")
        reaches = F.floor(upto * BINS / rows) > F.floor((upto - n) * BINS / rows)
        return (n > 0) & (upto < rows) & (reaches | (F.col(f"values_{f}") <= BINS))

    marked = placed.select("at", "value", F.array(*[is_edge(f) for f in folds]).alias("edge"))
    found = {f: {c: [] for c in names} for f in folds}
    for row in marked.where(F.array_contains("edge", True)).orderBy("at", "value").collect():
        for f, edge in zip(folds, row["edge"], strict=True):
            if edge:
                found[f][names[row["at"]]].append(row["value"])
    return found


def binned(rows: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """``rows`` with every column of ``edges`` replaced by the number of its bin; no number has none."""

    def place(c: str):
        limits = F.array(*[F.lit(e) for e in edges[c]]).cast("array<double>")
        number = F.col(c).cast("double")
        return F.when(number.isNotNull() & ~F.isnan(number), F.size(F.filter(limits, lambda e: e < number)))

    return rows.withColumns({c: place(c).cast("double") for c in edges})


def folded_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """Equal rows as one with their number as its weight, in as few parts as they need."""
    once = stage(rows.groupBy(*names, "label").agg(F.count(F.lit(1)).cast("double").alias(WEIGHT)), "folded-rows")
    return once.coalesce(max(1, math.ceil(once.count() / FOLDED_ROWS)))


def out_of_fold(
    rows: DataFrame, names: list[str], make, group: str = "group", k: int = 5, in_bins: bool = False
) -> DataFrame:
    """``(score, label)`` of each row from a model that saw no row of its group.

    The folds are fitted side by side: boosting is a long chain of small jobs, and one
    chain alone leaves a cluster idle. A model that sees only the bin of a value is fitted
    ``in_bins``: on distinct rows of bins and their weights, which grow far slower than the rows,
    so that its chain of jobs does not read all rows each time.
    """
    folded = stage(grouped_folds(rows.select("label", group, *names), group, k), "folds")
    kept = varying_columns(folded, names)
    present = sorted(r["fold"] for r in folded.select("fold").distinct().collect())
    edges = bin_edges(folded, kept, present) if in_bins else None

    def fit(fold: int) -> DataFrame:
        seen, unseen = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        if edges:
            seen, unseen = folded_rows(binned(seen, edges[fold]), kept), binned(unseen, edges[fold])
        model = make(kept).fit(seen)
        return model.transform(unseen).select(
            F.element_at(vector_to_array("probability"), 2).alias("score"), "label"
        )

    with ThreadPoolExecutor(len(present)) as pool:
        return reduce(DataFrame.unionByName, pool.map(fit, present))


def parity(expected: DataFrame, produced: DataFrame, key: str, value: str) -> DataFrame:
    """Largest absolute difference between stored and produced predictions."""
    both = expected.select(key, F.col(value).alias("want")).join(
        produced.select(key, F.col(value).alias("got")), key, "left"
    )
    return both.agg(
        F.max(F.abs(F.col("want") - F.col("got"))).alias("max_difference"),
        F.count_if(F.col("got").isNull()).alias("missing"),
    )
