"""The leakage probe rebuilds what its targets may depend on, and the market makes its facts once."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldform import scale
from fieldform.operators import history, market
from fieldform.sources.testtables import entries, starters

COLUMNS = ["career_top3", "recent3_rel_time", "trend_time", "same_course_top3", "front_share"]


def test_probe_rebuilds_linked_rows_only(spark, sf):
    rows = starters(spark, sf)
    last = rows.agg(F.max("contest_date").alias("d")).first()["d"]
    target, sizes = F.col("contest_date") == F.lit(last), []

    def leaky(given):
        sizes.append(given.count())
        # One predictor takes the outcome itself, another a mean over all rows that are given.
        mean = given.agg(F.avg("label")).scalar()
        return history.build_panel(given).withColumns({"career_top3": F.col("career_top3") + F.col("label"), "front_share": mean})

    outcomes = {"label": 1 - F.col("label"), "time_s": F.lit(1.0), "early_pct": F.lit(0.5)}
    found = {r.predictor: (r.rows, r.changed) for r in history.leakage_probe(rows, leaky, target, COLUMNS, outcomes).collect()}
    n = rows.filter(target).count()
    assert found["career_top3"] == found["front_share"] == (n, n)
    assert found["recent3_rel_time"] == found["trend_time"] == found["same_course_top3"] == (n, 0)
    assert len(sizes) == 2 and max(sizes) < rows.count()


def test_linked_rows_give_the_predictors_of_the_whole_table(spark, sf):
    rows = starters(spark, sf)
    target = F.col("contest_id") % 100 == 7
    h = F.pmod(F.xxhash64("contest_id", "subject_id"), F.lit(11))
    rows = scale.materialize(rows.withColumn("contest_id", F.when(h == 0, None).otherwise(F.col("contest_id"))))
    part = scale.materialize(history.linked_rows(rows, target))
    own = history.build_panel(part.drop("_target")).filter(target).select("contest_id", "subject_id", *COLUMNS)
    whole = history.build_panel(rows).filter(target).select("contest_id", "subject_id", *COLUMNS)
    assert whole.count() == part.filter("_target").count() > 0
    assert own.exceptAll(whole).isEmpty() and whole.exceptAll(own).isEmpty()


def test_markets_read_their_facts_back(spark, sf):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = market.rebuild_market(entries(spark, sf))[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    # Rows and strengths meet the facts by contest, then each other.
    assert plan.count("Exchange hashpartitioning") <= 6
