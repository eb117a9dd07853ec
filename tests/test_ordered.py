import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most of the rows."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randint(1, 9)) for i in range(600)]
    rng.shuffle(rows)
    return pd.DataFrame(rows, columns=["k", "i", "v"]), spark.createDataFrame(rows, "k string, i int, v long")


@pytest.mark.parametrize("rows_per_range", [40, 10_000])
def test_running_totals_per_key(skewed, rows_per_range):
    pdf, df = skewed
    got = ordered.running_totals(df, [F.col("i")], {"t": F.col("v")}, ["k"], rows_per_range).toPandas()
    want = pdf.sort_values("i").assign(t=lambda d: d.groupby("k").v.cumsum())
    assert dict(zip(got.i, got.t, strict=True)) == dict(zip(want.i, want.t, strict=True))


def test_row_numbers_without_key(skewed):
    pdf, df = skewed
    got = ordered.row_numbers(df, [F.desc("v"), F.asc("i")], "n", rows_per_range=50).toPandas()
    want = pdf.sort_values(["v", "i"], ascending=[False, True]).reset_index(drop=True)
    assert list(got.sort_values("n").i) == list(want.i)
    assert sorted(got.n) == list(range(1, 601))


def test_previous_values_cross_ranges(skewed):
    pdf, df = skewed
    got = ordered.previous_values(df, [F.col("i")], {"p": "v"}, ["k"], 40).toPandas()
    want = pdf.sort_values("i").assign(p=lambda d: d.groupby("k").v.shift())
    a = dict(zip(got.i, got.p.fillna(-1), strict=True))
    assert a == dict(zip(want.i, want.p.fillna(-1), strict=True))


def test_quantile_rows(skewed):
    pdf, df = skewed
    got = ordered.quantile_rows(df, "v", "i", ["k"], rows_per_range=50).toPandas().set_index("k")
    for key, part in pdf.groupby("k"):
        values = sorted(part.v)
        assert got.loc[key, "p95"] == values[int(0.95 * (len(values) - 1))]
        assert got.loc[key, "median"] == part.v.median()
