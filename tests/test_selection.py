from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldform.operators import metrics, selection

LOSS = "candidate string, contest_id long, block date, rows long, brier double, log_loss double"


def losses(spark, values, per_day=2):
    """{candidate: [loss per contest]}, ``per_day`` contests on each date."""
    rows = []
    for name, xs in values.items():
        rows += [(name, i, dt.date(2000, 1, 1) + dt.timedelta(days=i // per_day), 4, x, x * 2) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, LOSS)


def preds(spark, rows):
    return spark.createDataFrame(
        [(c, k, dt.date(2000, 1, k), s, y, p) for c, k, s, y, p in rows],
        "candidate string, contest_id long, contest_date date, subject_id long, label int, p double",
    )


def test_macro_and_micro_differ_with_field_size(spark):
    rows = [("a", 1, 0, 1, 0.5), ("a", 1, 1, 0, 0.5)] + [("a", 2, s, 0, 0.0) for s in range(8)]
    row = metrics.candidate_scores(metrics.contest_losses(preds(spark, rows))).first()
    assert row["macro_brier"] == pytest.approx(0.125)
    assert row["micro_brier"] == pytest.approx(0.05)
    assert (row["contests"], row["rows"]) == (2, 10)


def test_log_loss_is_clipped_and_brier_is_not(spark):
    row = metrics.entry_losses(preds(spark, [("a", 1, 0, 0, 1.0)])).first()
    assert row["brier"] == 1.0
    assert row["log_loss"] == pytest.approx(-math.log(1e-12), rel=1e-4)


@pytest.mark.parametrize("row", [("a", 1, 0, 2, 0.5), ("a", 1, 0, 1, 1.5), ("a", 1, 0, 1, float("nan")), ("a", 1, 0, 1, None)])
def test_invalid_predictions_fail(spark, row):
    with pytest.raises(PySparkException):
        metrics.entry_losses(preds(spark, [row])).collect()


def test_moving_block_fails(spark):
    rows = preds(spark, [("a", 1, 0, 1, 0.5), ("a", 1, 1, 0, 0.5)])
    rows = rows.withColumn("contest_date", F.date_add("contest_date", F.col("subject_id").cast("int")))
    with pytest.raises(PySparkException):
        metrics.contest_losses(rows).collect()


def test_clustered_error_by_hand(spark):
    xs = [0.1, 0.3, -0.2, 0.4, 0.0]
    mean = sum(xs) / 5
    sums = [xs[0] + xs[1] - 2 * mean, xs[2] + xs[3] - 2 * mean, xs[4] - mean]
    want = math.sqrt(3 / 2 * sum(s * s for s in sums) / 25)
    row = selection.clustered_mean_se(losses(spark, {"a": xs}), "brier", "block").first()
    assert (row["mean_brier"], row["se_brier"]) == (pytest.approx(mean), pytest.approx(want))


def test_one_cluster_has_infinite_error_and_keeps_the_incumbent(spark):
    table = losses(spark, {"old": [0.3, 0.3], "new": [0.1, 0.1]})
    _, decision = selection.select_one_se(table, "old")
    row = decision.first()
    assert row["winner"] == "old" and row["point_best"] == "new" and row["incumbent_retained"]


def test_clear_gain_displaces_and_noise_does_not(spark):
    clear = losses(spark, {"old": [0.30, 0.31, 0.30, 0.31] * 4, "new": [0.20, 0.21, 0.20, 0.21] * 4})
    assert selection.select_one_se(clear, "old")[1].first()["winner"] == "new"
    noise = losses(spark, {"old": [0.30, 0.10, 0.50, 0.12] * 4, "new": [0.10, 0.50, 0.10, 0.31] * 4}, per_day=1)
    assert selection.select_one_se(noise, "old")[1].first()["winner"] == "old"
    assert selection.select_one_se(noise, "old", k=0.0)[1].first()["winner"] == "new"
    assert selection.select_one_se(noise, None)[1].first()["winner"] == "new"


def test_gate_contracts(spark):
    table = losses(spark, {"a": [0.1, 0.2, 0.3, 0.4], "b": [0.1, 0.2, 0.3, 0.4]})
    with pytest.raises(ValueError):
        selection.select_one_se(table, "a", k=-1)
    with pytest.raises(PySparkException):
        selection.select_one_se(table, "missing")[1].collect()
    partial = table.filter("NOT (candidate = 'b' AND contest_id = 3)")
    with pytest.raises(PySparkException):
        selection.select_one_se(partial, "a")[0].collect()


def test_ties_go_to_log_loss_then_name(spark):
    table = losses(spark, {"b": [0.2] * 4, "a": [0.2] * 4})
    assert selection.select_one_se(table, None)[1].first()["winner"] == "a"


def test_simplest_within_one_error(spark):
    table = losses(spark, {"deep": [0.10, 0.50, 0.10, 0.50], "flat": [0.30, 0.10, 0.50, 0.40]}, per_day=1)
    ranks = spark.createDataFrame([("deep", 2), ("flat", 1)], "candidate string, complexity_rank int")
    chosen = selection.select_simplest_one_se(table, ranks).filter("is_selected").first()["candidate"]
    assert chosen == "flat"


def test_blend_grid_prefers_the_smaller_weight_on_ties(spark):
    rows = preds(spark, [("x", k, s, int(s == 0), 0.4) for k in range(1, 5) for s in range(4)])
    rows = rows.withColumnRenamed("p", "m").withColumn("n", F.col("m"))
    out = selection.blend_grid(rows, "m", "n", [0.0, 0.5, 1.0]).filter("is_selected").first()
    assert out["weight"] == 0.0
    assert selection.blend_one_se(rows, "m", "n", [0.0, 0.5, 1.0])[1].first()["winner"] == "blend_w0.00"


@pytest.mark.parametrize("weights", [[0.5, 1.0], [0.0, 1.2], []])
def test_blend_weights_are_checked(spark, weights):
    rows = preds(spark, [("x", 1, 0, 1, 0.4)])
    with pytest.raises(ValueError):
        selection.blend_losses(rows, "p", "p", weights)


@pytest.mark.parametrize("n", [1, 2, 7, 23, 101])
def test_reliability_bins_match_quantile_cuts_of_ranks(spark, n):
    """Edges are the linear quantiles of the ranks, closed on the right."""
    q = 10
    rows = preds(spark, [("a", 1, i, i % 2, 0.3 if i < n // 3 else i / (n + 1)) for i in range(n)])
    got = {r["bin"]: r["rows"] for r in metrics.reliability_table(rows, q=q).collect()}
    bins = min(q, n)
    want: dict[int, int] = {}
    for rank in range(1, n + 1):
        edges = [1 + (n - 1) * j / bins for j in range(1, bins + 1)]
        b = next((j for j, e in enumerate(edges) if rank <= e + 1e-9), bins - 1) if n > 1 else 0
        want[b] = want.get(b, 0) + 1
    assert got == want


def test_calibration_line_recovers_a_known_line(spark):
    rows = (
        spark.range(40000)
        .select(((F.col("id") % 97) / 100 + 0.01).alias("p"), (F.pmod(F.xxhash64("id"), F.lit(1000003)) / 1000003).alias("u"))
        .withColumn("t", -0.4 + 1.5 * F.ln(F.col("p") / (1 - F.col("p"))))
        .withColumn("label", (F.col("u") < 1 / (1 + F.exp(-F.col("t")))).cast("int"))
    )
    row = metrics.calibration_line(rows).first()
    assert row["intercept"] == pytest.approx(-0.4, abs=0.05)
    assert row["slope"] == pytest.approx(1.5, abs=0.06)


def test_steep_lines_are_exact_and_try_whole_steps_first(spark, monkeypatch):
    """Two prices, so the line goes through both rates; the whole step is always taken here."""
    asked, real = [], metrics._newton_step
    monkeypatch.setattr(metrics, "_newton_step", lambda *a: asked.append(a[4]) or real(*a))
    rows = [(0.5, 1)] * 30 + [(0.5, 0)] * 70 + [(0.52, 1)] * 60 + [(0.52, 0)] * 40
    row = metrics.calibration_line(spark.createDataFrame(rows, "p double, label int")).first()
    low, high = math.log(30 / 70), math.log(60 / 40)
    assert row["intercept"] == pytest.approx(low, rel=1e-12)
    assert row["slope"] == pytest.approx((high - low) / math.log(0.52 / 0.48), rel=1e-11)
    assert set(asked) == {(1.0,)}


def test_calibration_line_needs_rows_and_two_outcomes(spark):
    few = preds(spark, [("a", 1, i, i % 2, 0.1 + 0.05 * i) for i in range(9)])
    one = preds(spark, [("a", 1, i, 1, 0.1 + 0.05 * i) for i in range(12)])
    for rows in (few, one):
        assert metrics.calibration_line(rows).first()["slope"] is None


def test_contest_review_ranks_and_mass(spark):
    rows = preds(spark, [("a", 1, s, int(s < 3), p) for s, p in enumerate([0.9, 0.2, 0.5, 0.6, 0.8])])
    rows = rows.withColumn("entry_no", F.col("subject_id"))
    row = metrics.contest_review(rows).first()
    assert row["leader_mass"] == pytest.approx(1.6)
    assert row["leader_ranks"] == "1;4;5"
