"""The entry table of the test folders: one shuffle of the lines, whatever the size of a contest."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldform import scale
from fieldform.sources import testtables


def folder(spark, sf, tmp_path):
    """The tables with one order in nine lost, whose lines then belong to no contest, and some lines repeated."""
    out = str(tmp_path / "tables")
    orders, lines = (testtables.table(spark, sf, name) for name in ("orders", "lineitem"))
    orders.filter("o_orderkey % 9 <> 0").write.parquet(f"{out}/orders.parquet")
    lines.unionByName(lines.filter("l_linenumber = 1")).write.parquet(f"{out}/lineitem.parquet")
    testtables.table(spark, sf, "part").write.parquet(f"{out}/part.parquet")
    return out


def test_lines_of_lost_orders_are_left_out(spark, sf, tmp_path):
    sf = folder(spark, sf, tmp_path)
    rows = testtables.build_entries(spark, sf)
    orders, lines = (testtables.table(spark, sf, name) for name in ("orders", "lineitem"))
    want = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.floor(F.col("l_orderkey") / 4).alias("contest_id"), F.col("l_partkey").alias("subject_id")
    )
    keys = ["contest_id", "subject_id"]
    assert sorted(rows.select(keys).collect()) == sorted(want.distinct().collect())


def test_large_contests_take_the_other_path(spark, sf, tmp_path, monkeypatch):
    sf = folder(spark, sf, tmp_path)
    usual = testtables.build_entries(spark, sf)
    monkeypatch.setattr(scale, "GROUP_ROWS", 3)
    assert sorted(usual.collect(), key=str) == sorted(testtables.build_entries(spark, sf).collect(), key=str)


def test_lines_are_shuffled_once(spark, sf, monkeypatch):
    monkeypatch.setattr(scale, "materialize", lambda *_: (_ for _ in ()).throw(AssertionError("written in between")))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = testtables.build_entries(spark, sf)._jdf.queryExecution().sparkPlan().toString()
        planned = testtables.build_entries(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert plan.count("lineitem.parquet") == 1
    # Lines by contest, orders by contest twice, and both sides of the join with the parts.
    assert planned.count("Exchange hashpartitioning") == 5


def test_written_entries_do_not_move_to_their_subjects(spark, sf, tmp_path, monkeypatch):
    sf, plans, usual = folder(spark, sf, tmp_path), [], scale.materialize
    monkeypatch.setattr(scale, "materialize", lambda df, name="step", **kw: plans.append(df._jdf.queryExecution().toString()) or usual(df, name, **kw))
    rows = testtables.entries(spark, sf)
    assert len(plans) == 1 and "p_brand" not in plans[0]
    want = testtables.build_entries(spark, sf)
    assert rows.columns == want.columns and rows.dtypes == want.dtypes
    assert sorted(rows.collect(), key=str) == sorted(want.collect(), key=str)
    counted = rows.groupBy("surface").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in counted


def test_lines_of_lost_and_repeated_parts(spark, sf, tmp_path):
    sf, other = folder(spark, sf, tmp_path), str(tmp_path / "other")
    for name in ("orders", "lineitem"):
        testtables.table(spark, sf, name).write.parquet(f"{other}/{name}.parquet")
    part = testtables.table(spark, sf, "part")
    part = part.filter("p_partkey % 7 <> 0")
    part.unionByName(part.filter("p_partkey % 11 = 0").withColumn("p_brand", F.lit("again"))).write.parquet(f"{other}/part.parquet")
    want = testtables.build_entries(spark, other)
    assert testtables.lean_entries(spark, other) is None
    assert sorted(testtables.entries(spark, other).collect(), key=str) == sorted(want.collect(), key=str)
    assert want.filter("subject_id % 7 = 0").isEmpty() and not want.filter("grp = 'again'").isEmpty()
