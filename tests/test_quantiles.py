from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from fieldform.operators.quantiles import exact_medians
from fieldform.plans import models


def frame(spark, columns):
    rows = list(zip(*columns.values()))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_medians_equal_sorted_values_at_any_accuracy(spark, accuracy):
    draw = random.Random(accuracy)
    n = 301
    columns = {
        "smooth": [draw.gauss(0, 1) for _ in range(n)],
        "ties": [float(draw.randint(0, 3)) for _ in range(n)],
        "hot": [1.0 if draw.random() < 0.5 else 1.0 + draw.random() for _ in range(n)],
        "skew": [10.0 ** draw.uniform(-300, 300) for _ in range(n)],
        "gaps": [None if i % 3 else draw.random() for i in range(n)],
        "nans": [math.nan if i % 2 else draw.random() for i in range(n)],
        "none": [None] * n,
        "one": [None] * (n - 1) + [7.25],
        "edge": [math.inf if i % 5 == 0 else -math.inf if i % 5 == 1 else draw.random() for i in range(n)],
    }
    got = exact_medians(frame(spark, columns), list(columns), accuracy)
    for name, values in columns.items():
        known = [v for v in values if v is not None and not math.isnan(v)]
        want = statistics.median(known) if known else None
        assert got[name] == pytest.approx(want, rel=1e-12) if known else got[name] is None, name


def test_even_counts_take_the_mean_of_the_middle_values(spark):
    df = frame(spark, {"x": [4.0, 1.0, 3.0, 2.0], "big": [1.7e308, 1.7e308, 1.6e308, 1.6e308]})
    assert exact_medians(df, ["x", "big"]) == {"x": 2.5, "big": pytest.approx(1.65e308)}


def test_empty_table_and_no_columns(spark):
    df = frame(spark, {"x": [1.0]}).filter("false")
    assert exact_medians(df, ["x"]) == {"x": None}
    assert exact_medians(df, []) == {}


def test_imputation_takes_the_exact_median_of_the_training_rows(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (10.0, "a"), (20.0, "b"), (None, "b")], "x double, g string")
    fitted = models.feature_stages(train, ["x"], ["g"], min_frequency=1).fit(train)
    scored = spark.createDataFrame([(None, "a"), (float("nan"), "a"), (3.0, "c")], "x double, g string")
    got = fitted.transform(scored).select(F.col("x__i"), F.col("x__na")).collect()
    assert [tuple(r) for r in got] == [(6.0, 1.0), (6.0, 0.0), (3.0, 0.0)]
