"""The panel by one pass over each subject, against states per day joined back; steps that keep no shuffle files."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from fieldform import scale
from fieldform.operators import history
from fieldform.sources.testtables import starters

SPOILED = ("subject_id", "contest_date", "contest_id", "surface", "distance_m", "venue", "label", "early_pct", "time_s")


def spoiled(rows):
    """Now and then one of the values that a history depends on is unknown, and some contests lie on one day."""
    h = F.pmod(F.xxhash64("contest_id", "subject_id"), F.lit(29))
    rows = rows.withColumn("contest_date", F.when(F.col("contest_id") % 3 == 0, F.trunc("contest_date", "month")).otherwise(F.col("contest_date")))
    return rows.select(*[F.when(h == i, None).otherwise(F.col(c)).alias(c) if c in SPOILED else F.col(c) for i, c in enumerate(rows.columns)])


def test_one_pass_equals_joined_states(spark, sf, monkeypatch):
    for rows in (starters(spark, sf), scale.materialize(spoiled(starters(spark, sf)))):
        once = history.build_panel(rows)
        with monkeypatch.context() as m:
            m.setattr(scale, "GROUP_ROWS", 0)
            joined = history.build_panel(rows)
        assert once.dtypes == joined.dtypes
        once, joined = scale.materialize(once), scale.materialize(joined)
        assert once.count() == rows.count()
        assert once.exceptAll(joined).isEmpty() and joined.exceptAll(once).isEmpty()


def test_panel_takes_few_shuffles(spark, sf):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = history.build_panel(starters(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    # Early places by subject, days and contests; rows and facts by contest and day; rows by subject.
    assert plan.count("Exchange hashpartitioning") == 6


def test_written_steps_keep_no_shuffle_files(spark):
    def files():
        root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for top in root for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    before = files()
    out = scale.materialize(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s")))
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000


def test_blocks_in_one_pass_equal_joined_cells(spark, sf, monkeypatch):
    for rows in (starters(spark, sf), scale.materialize(spoiled(starters(spark, sf)))):
        rows = rows.unionByName(rows.filter("contest_id % 7 = 0"))
        once = history.strict_prior_blocks(rows, tolerance=400)
        with monkeypatch.context() as m:
            m.setattr(scale, "GROUP_ROWS", 0)
            joined = history.strict_prior_blocks(rows, tolerance=400)
        assert once.dtypes == joined.dtypes
        once, joined = scale.materialize(once), scale.materialize(joined)
        assert once.count() == rows.count()
        assert once.exceptAll(joined).isEmpty() and joined.exceptAll(once).isEmpty()


def test_blocks_take_one_shuffle(spark, sf):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = history.strict_prior_blocks(scale.materialize(starters(spark, sf)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert plan.count("Exchange hashpartitioning") == 1


def test_entries_by_contest_meet_their_facts_where_they_lie(spark, sf):
    rows = starters(spark, sf)
    lying = scale.materialize(rows, "lying", by="contest_id")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = history.build_panel(lying, by_contest=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        # Facts by contest, rows by subject; rows do not move by contest.
        assert plan.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(contest_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    want = history.build_panel(rows)
    assert out.columns == want.columns
    assert sorted(out.collect(), key=str) == sorted(want.collect(), key=str)
