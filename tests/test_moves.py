"""Rows that a step sends through shuffles, and results that must not depend on how they travel."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from fieldform import scale
from fieldform.operators import history, metrics, selection
from fieldform.sources import parts
from fieldform.sources.testtables import entries, starters


def moved(spark):
    """Rows written to shuffles so far in this session."""
    time.sleep(1)  # the store hears of finished stages a little later
    gate = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


FAMILIES = {"a": "x", "b": "x", "c": "y", "d": "other"}


def contributions(spark, n=600):
    """Known and other features, repeats, unknown values and a feature without a name."""
    rows = spark.range(n).select(
        F.col("id").alias("contest_id"), F.lit(1).alias("subject_id"), F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("scope"),
        F.when(F.col("id") % 7 > 0, (1999 + F.col("id") % 3).cast("string")).alias("year"),
        F.explode(F.array(*[F.lit(x) for x in ("a", "a", "b", "c", "d", "e", None)])).alias("feature"),
    )
    value = (F.col("contest_id") % 5 - 2).cast("double") * F.when(F.col("feature") == "b", -2.0).otherwise(1.0)
    rows = rows.withColumn("contribution", F.when(F.col("contest_id") % 11 > 0, value))
    return rows.filter("NOT (contest_id % 13 = 0 AND feature <=> 'c')")


def test_rollup_equals_sums_by_entry_in_sql(spark):
    contributions(spark).createOrReplaceTempView("rollup_rows")
    want = spark.sql("""
    WITH g AS (SELECT contest_id, scope, year, 'feature' AS grain, feature AS name, sum(contribution) AS c FROM rollup_rows GROUP BY ALL
      UNION ALL SELECT contest_id, scope, year, 'family', CASE WHEN feature IN ('a', 'b') THEN 'x' WHEN feature = 'c' THEN 'y' ELSE 'other' END, sum(contribution)
      FROM rollup_rows GROUP BY ALL),
    s AS (SELECT scope, year, grain, name, c FROM g UNION ALL SELECT scope, 'ALL', grain, name, c FROM g)
    SELECT scope, year, grain, name, count(*), round(sum(abs(c)) / count(*), 9), round(sum(c) / count(*), 9), round(count_if(c <> 0) / count(*), 9) FROM s GROUP BY ALL""")
    got = metrics.importance_rollup(contributions(spark), FAMILIES)
    got = got.select("scope", "year", "grain", "name", "rows", *[F.round(c, 9) for c in ("mean_abs", "mean_signed", "nonzero_share")])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_rollup_sends_one_row_an_entry(spark):
    rows = scale.materialize(contributions(spark, 4000).filter("feature IN ('a', 'b', 'c')").coalesce(2))
    before = moved(spark)
    metrics.importance_rollup(rows, FAMILIES).collect()
    assert moved(spark) - before < 1.5 * 4000


def test_closure_leaves_the_entries_where_they_are(spark, sf):
    rows = starters(spark, sf)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = moved(spark)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")  # less than the entries, more than the keys
        sample = scale.materialize(history.closure_sample(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert sample.count() > 0
    assert moved(spark) - before < 0.5 * rows.count()


def test_first_version_of_parts_moves_the_entries_once(spark, sf, tmp_path):
    rows = entries(spark, sf)
    ledger = scale.materialize(rows.select("contest_id", "contest_date").distinct())
    before = moved(spark)
    manifest = parts.apply_parts(spark, rows, ledger, str(tmp_path))
    # Once as keys, which must not repeat, once as whole rows; the ledger and what is counted by month come on top.
    assert moved(spark) - before < 2.6 * rows.count()
    for name, want in (("audit", rows), ("history", rows.filter("status <> 'scratched'"))):
        got = parts.read_part_table(manifest, name, verify=True).select(rows.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def priced(spark, n):
    rows = spark.range(n, numPartitions=3).select(
        F.when(F.col("id") % 97 > 0, F.col("id") % (n // 12)).alias("contest_id"), F.col("id").alias("subject_id"),
        (F.col("id") % 5 % 2).cast("int").alias("label"), (F.rand(1) * 0.9).alias("m"), (F.rand(2) * 0.9).alias("n"),
    ).filter("contest_id IS NOT NULL")
    return scale.materialize(rows.withColumn("contest_date", F.date_add(F.lit("2000-01-01"), (F.col("contest_id") % 9).cast("int"))))


def test_blends_equal_the_gate_over_unfolded_losses(spark):
    rows = priced(spark, 600)
    long = rows.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in selection.DEFAULT_WEIGHTS])))
    long = long.withColumn("p", (1 - F.col("weight")) * F.col("m") + F.col("weight") * F.col("n"))
    long = long.withColumn("candidate", F.format_string("blend_w%.2f", "weight"))
    table, decision = selection.select_one_se(metrics.contest_losses(long), "blend_w0.00")
    got, decided = selection.blend_one_se(rows, "m", "n")

    def plain(df, columns):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(columns).collect())

    assert set(got.columns) == {*table.columns, "weight"}
    assert plain(got, table.columns) == plain(table, table.columns)
    assert plain(decided, decision.columns) == plain(decision, decision.columns)
    want = metrics.micro_scores(long, ["weight"]).select("weight", "micro_brier", "micro_log_loss", "rows")
    assert plain(selection.blend_grid(rows, "m", "n"), ["weight", "brier", "log_loss", "rows"]) == plain(want, want.columns)


def test_blends_move_the_entries_once(spark):
    rows = priced(spark, 6000)
    for run in (lambda: selection.blend_grid(rows, "m", "n"), lambda: selection.blend_one_se(rows, "m", "n")[0]):
        before = moved(spark)
        run().collect()
        assert moved(spark) - before < 1.3 * 6000
