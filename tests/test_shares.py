"""The share of forward runners: order of its sums, and the shuffles that it costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldform.operators import history
from fieldform.sources.testtables import starters


def test_means_add_the_newest_start_first(spark):
    places = [(1, 12), (1, 12), (7, 12)]
    starts = F.array(*[F.struct((F.lit(float(a)) / b).alias("early_pct")) for a, b in places])
    row = spark.range(1).select(history._recent(starts, "early_pct", 4, "avg").alias("mean")).first()
    assert row["mean"] == (7 / 12 + 1 / 12 + 1 / 12) / 3
    assert row["mean"] > 0.25 >= (1 / 12 + 1 / 12 + 7 / 12) / 3


def test_panel_rows_stay_put_once_they_are_wide(spark, sf):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = history.build_panel(starters(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    # The last join brings the states; the share and the courses have moved the rows before.
    last = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert "contest_date" in last and "venue" not in last
