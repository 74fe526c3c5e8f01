"""Cases in which rows could silently be lost, changed or confused."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldform.contracts import ContractError
from fieldform.operators import history, joins, market, metrics, relative, selection, standardize
from fieldform.scale import with_group
from fieldform.sources import writers
from fieldform.sources.fingerprint import row_fingerprint
from tests.helpers import by_key, day, entry, field, rotating


def test_rows_without_a_group_stay(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 7.0)], "contest_id long, x double")
    out = {(r.contest_id, r.x, r.m) for r in with_group(df, "contest_id", F.avg("x").alias("m")).collect()}
    assert out == {(1, 2.0, 3.0), (1, 4.0, 3.0), (None, 7.0, None)}


def test_every_earlier_start_of_a_day_counts_in_the_last_three(spark):
    """Subject 0 starts twice on the second day; the last three are both of these and none of the first two is lost."""
    places = {0: 1, 1: 4, 2: 2, 3: 3}
    when = {0: 0, 1: 10, 2: 10, 3: 20, 4: 30}
    rows = []
    for c, d in when.items():
        for s in range(4):
            rows.append(entry(c, d, s + 10 * (s > 0) * c, s + 1, (places.get(c, 1) + s - 1) % 4 + 1 if s else places.get(c, 1), distance_m=1000 + 100 * c))
    out = by_key(history.recent_form(field(spark, rows)), "recent3_finish_pct", "recent3_top3")
    pct = lambda *p: sum((x - 1) / 3 for x in p) / len(p)
    assert out[(2, 0)] == out[(1, 0)] == (pct(1), 1)
    assert out[(3, 0)] == (pytest.approx(pct(1, 4, 2)), 2)
    assert out[(4, 0)] == (pytest.approx(pct(4, 2, 3)), 2)
    deltas = by_key(history.prev_deltas(field(spark, rows)), "distance_change", "prev_date")
    assert deltas[(3, 0)] == (100, day(10))  # of the later contest of that day


def test_more_starts_on_one_day_than_a_summary_holds(spark):
    rows = [entry(c, 0 if c < 6 else 5, s + (s > 0) * 10 * c, s + 1, (s + c) % 4 + 1) for c in range(7) for s in range(4)]
    out = by_key(history.recent_form(field(spark, rows)), "recent3_finish_pct")
    own = {c: (0 + c) % 4 for c in range(6)}
    assert out[(6, 0)] == pytest.approx(sum(own[c] / 3 for c in (3, 4, 5)) / 3)


def test_mixed_surfaces_are_refused(spark):
    rows = field(spark, rotating(surface=["turf", "dirt"]))
    with pytest.raises(PySparkException, match="mixed surface"):
        relative.surface_base(rows, "turf").collect()
    with pytest.raises(PySparkException, match="mixed surface"):
        relative.surface_base(rows.filter("surface = 'turf'").withColumn("surface", F.when(F.col("entry_no") > 1, F.col("surface"))), "turf").count()
    assert relative.surface_base(rows.filter("surface = 'turf'"), "turf").count() == rows.filter("surface = 'turf'").count()


def test_fingerprints_tell_fields_apart(spark):
    schema = "a string, b string"
    print_ = lambda rows: row_fingerprint(spark.createDataFrame(rows, schema), ["a", "b"]).first()["fingerprint"]
    cases = [[("a|b", "c")], [("a", "b|c")], [("\\N", "x")], [(None, "x")], [("-", "x")], [("", "x")], [("1:a", "")], [("a", "1:")], [(None, None)]]
    assert len({print_(c) for c in cases}) == len(cases)
    assert print_([("a", "b"), ("c", "d")]) == print_([("c", "d"), ("a", "b")]) != print_([("a", "d"), ("c", "b")])


@pytest.mark.parametrize(("scale", "line", "rows"), [(3, (0, -1), 400), (6, (-8, 1), 2000), (1, (5, 0.1), 4000)])
def test_the_calibrator_converges_where_classes_overlap(spark, scale, line, rows):
    draw = random.Random(rows)
    data = []
    for _ in range(rows):
        x = draw.gauss(0, scale)
        y = int(draw.random() < 1 / (1 + math.exp(-(line[0] + line[1] * x))))
        data.append(("g", 1 / (1 + math.exp(-x)), y))
    df = spark.createDataFrame(data, "g string, p double, label int")
    for by in ((), ("g",)):
        row = metrics.calibration_line(df, by=by).first()
        assert row["converged"]
        x = [math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9))) for _, p, _ in data]
        gap = [y - 1 / (1 + math.exp(-(row["intercept"] + row["slope"] * a))) for a, (_, _, y) in zip(x, data, strict=True)]
        assert abs(sum(gap)) < 1e-4 and abs(sum(g * a for g, a in zip(gap, x, strict=True))) < 1e-3


def test_the_calibrator_says_when_there_is_no_line(spark):
    apart = [("apart", 0.01 * k, int(k > 50)) for k in range(1, 100)]
    level = [("level", 0.3, k % 2) for k in range(40)]
    fine = [("fine", 0.01 * k, int((k * 37) % 100 < k)) for k in range(1, 100)]
    df = spark.createDataFrame([*apart, *level, *fine], "g string, p double, label int")
    got = {r["g"]: r for r in metrics.calibration_line(df, by=["g"]).collect()}
    assert got["fine"]["converged"] and got["fine"]["slope"] > 0
    assert all(not got[g]["converged"] and got[g]["slope"] is None for g in ("apart", "level"))


@pytest.mark.parametrize("limit", [market.ARRAY_ROWS, 3])
def test_contests_with_unknown_probabilities_have_no_shift(spark, monkeypatch, limit):
    monkeypatch.setattr(market, "ARRAY_ROWS", limit)
    rows = [(1, s, 0.2 + 0.1 * s) for s in range(5)] + [(2, s, None) for s in range(5)] + [(3, s, 0.4 if s else None) for s in range(5)] + [(None, 1, 0.5)]
    out = market.logit_shift_to_sum(spark.createDataFrame(rows, "contest_id long, subject_id long, p double"), "p").collect()
    assert len(out) == len(rows)
    assert sum(r.p_adjusted for r in out if r.contest_id == 1) == pytest.approx(3.0)
    assert all(r.p_adjusted is None and r["shift"] is None for r in out if r.contest_id != 1)


def test_table_diff_reports_lone_columns_and_any_name(spark):
    left = spark.createDataFrame([(1, 5, "x", 1.5), (2, 6, None, 2.5)], "id long, a int, `n|b` string, v double")
    right = spark.createDataFrame([(1, 5, "x", 1.5), (2, 7, None, 2.5)], "id long, a int, `n|b` string, b double")
    got = {r.column_name: (r.null_mismatches, r.value_mismatches, r.verdict) for r in joins.table_diff(left, right, "id").collect()}
    assert got == {"<keys>": (0, 0, "equal"), "a": (0, 1, "different"), "n|b": (0, 0, "equal"), "v": (2, 0, "different"), "b": (2, 0, "different")}
    assert {r.verdict for r in joins.table_diff(left, right.limit(0), "id").filter("column_name = 'b'").collect()} == {"different"}
    dates = spark.createDataFrame([(1, day(0))], "id long, d date")
    row = joins.table_diff(dates, dates.withColumn("d", F.date_add("d", 3)), "id").filter("column_name = 'd'").first()
    assert (row.max_abs_error, row.value_mismatches) == (3.0, 1)


def test_two_corrections_of_one_key_are_refused(spark):
    df = spark.createDataFrame([(1, 5)], "contest_id long, x int")
    with pytest.raises(ContractError):
        standardize.apply_overrides(df, spark.createDataFrame([(1, 6), (1, 7)], "contest_id long, x int"), "contest_id", ["x"])


def review_rows(spark, dates=70, good_from=0):
    """Two contests a day; the model is perfect from ``good_from`` on and useless before."""
    rows = []
    for d in range(dates):
        for c in range(2):
            for s in range(4):
                y = int(s < 2)
                p = (0.9 if y else 0.1) if d >= good_from else 0.5
                rows.append((2 * d + c, day(2 * d), y, 0.5, *[(1 - w) * 0.5 + w * p for w in (0.1, 0.25, 0.5, 1.0)]))
    return spark.createDataFrame(rows, "contest_id long, contest_date date, label int, p_w000 double, p_w010 double, p_w025 double, p_w050 double, p_w100 double")


def test_a_review_withholds_scores_while_collecting(spark):
    row = selection.review_decision(review_rows(spark, dates=20), contests=100, dates=30, days=40).first()
    assert (row["status"], row["contests"], row["winner"], row["incumbent_retained"]) == ("collecting", 40, None, None)


def test_a_review_ends_with_its_window(spark):
    rows = review_rows(spark)
    first = selection.review_decision(rows, contests=100, dates=30, days=40).first()
    assert (first["status"], first["winner"], first["contests"], first["window_end"]) == ("review_ready", "w100", 100, day(98))
    spoiled = rows.withColumn("label", F.when(F.col("contest_date") > F.lit(day(98)), 1 - F.col("label")).otherwise(F.col("label")))
    assert selection.review_decision(spoiled, contests=100, dates=30, days=40).first() == first
    assert selection.review_decision(review_rows(spark, good_from=50), contests=100, dates=30, days=40).first()["winner"] == "w000"


def test_partitioned_files_follow_the_bytes(spark, tmp_path):
    rows = spark.range(200_000).select(
        F.col("id").alias("contest_id"), F.when(F.col("id") < 190_000, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("split"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        manifest = writers.write_partitioned(rows.repartition(6), str(tmp_path / "out"), ["split"])
        found = {r["split"]: (r["files"], r["contests"]) for r in manifest.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert {k: v[1] for k, v in found.items()} == {"hot": 190_000, "c0": 3_333, "c1": 3_334, "c2": 3_333}
    assert found["hot"][0] > 3 and all(found[c][0] <= 2 for c in ("c0", "c1", "c2"))
