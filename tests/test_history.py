from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fieldform.contracts import ContractError
from fieldform.operators import history
from tests.helpers import by_key, entry, field, rotating

OUTCOMES = ("finish_position", "time_s", "early_position", "label", "finish_pct", "early_pct", "status")


def test_counts_and_recent_form_by_hand(spark):
    rows = [entry(c, c * 10, 1, 1, place) for c, place in enumerate([1, 4, 2, 3])]
    rows += [entry(c, c * 10, 9, 2, 5 - place) for c, place in enumerate([1, 4, 2, 3])]
    out = by_key(history.build_panel(field(spark, rows)), "career_starts", "career_top3", "recent3_finish_pct", "recent3_top3", "days_since_prev")
    assert out[(0, 1)] == (0, 0, None, None, None)
    assert out[(1, 1)] == (1, 1, 0.0, 1, 10)
    assert out[(3, 1)][:2] == (3, 2)
    assert out[(3, 1)][2] == pytest.approx((0 + 1 + 1 / 3) / 3)


def test_same_day_entries_do_not_see_each_other(spark):
    rows = [entry(0, 0, 1, 1, 1), entry(1, 5, 1, 1, 1), entry(2, 5, 1, 1, 2), entry(3, 6, 1, 1, 3)]
    out = by_key(history.prior_counts(field(spark, rows)), "career_starts", "same_distance_top3")
    assert out == {(0, 1): (0, 0), (1, 1): (1, 1), (2, 1): (1, 1), (3, 1): (3, 3)}


def test_outcomes_of_the_target_day_never_move_predictors(spark):
    rows = field(spark, rotating())
    outcomes = {"finish_position": F.lit(1), "label": F.lit(1), "time_s": F.lit(1.0), "early_pct": F.lit(0.0), "finish_pct": F.lit(0.0)}
    report = history.leakage_probe(
        rows, history.build_panel, F.col("contest_id") == 5, ["career_top3", "recent3_rel_time", "recent3_finish_pct", "front_share", "trend_top3"], outcomes
    ).collect()
    assert all(r["changed"] == 0 and r["rows"] == 5 for r in report)


def test_later_outcomes_do_move_predictors(spark):
    """The probe itself can fail: changing an earlier contest must show."""
    rows = field(spark, rotating())
    altered = rows.withColumn("label", F.when(F.col("contest_id") == 0, 1 - F.col("label")).otherwise(F.col("label")))
    a, b = (by_key(history.build_panel(x), "career_top3") for x in (rows, altered))
    assert any(a[k] != b[k] for k in a if k[0] > 0)


def test_asof_context_equals_the_panel(spark):
    rows = field(spark, rotating(surface=["turf", "dirt"], distance_m=[1200, 1400, 1800], venue=[1, 2]))
    last = F.col("contest_id") == 5
    cols = [
        "career_starts", "turf_top3", "same_distance_starts", "same_course_top3", "days_since_prev", "distance_change",
        "surface_changed", "recent3_finish_pct", "recent3_rel_time", "recent4_early_pct", "trend_finish", "front_share",
    ]
    want = by_key(history.build_panel(rows).filter(last), *cols)
    got = by_key(history.asof_context(rows.filter(~last), rows.filter(last).drop(*OUTCOMES)), *cols)
    assert got == want


def test_targets_on_several_days_are_not_history(spark):
    rows = field(spark, rotating(contests=6))
    past = rows.filter("contest_id < 3")
    out = history.asof_context(past, rows.filter("contest_id >= 3").drop(*OUTCOMES))
    assert {r["career_starts"] for r in out.collect()} == {3}


def test_blocks_match_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for c in range(60):
        kw = {
            "surface": rng.choice(["turf", "dirt", None]), "distance_m": rng.choice([1000, 1150, 1200, 1390, 1400, 1600, 2000, 2150, None]),
            "venue": rng.choice([1, 2, None]),
        }
        for s in rng.sample(range(5), 3):
            rows.append(entry(c, rng.randrange(25), s, s + 1, rng.randrange(1, 7), 6, **kw))
    # All entries of a contest share its date.
    dates = {}
    rows = [r[:1] + (dates.setdefault(r[0], r[1]),) + r[2:] for r in rows]
    got = by_key(
        history.strict_prior_blocks(field(spark, rows)),
        *[f"{b}_{x}" for b in ("same_surface", "near", "regime", "course_distance") for x in ("starts", "top3")],
    )
    index = {name.split()[0]: i for i, name in enumerate("contest_id contest_date subject_id entry_no status surface venue distance_m".split())}

    def regime(d):
        return sum(d > cut for cut in (1400, 2000, 2600))

    for a in rows:
        s, d, v = (a[index[k]] for k in ("surface", "distance_m", "venue"))
        prior = [b for b in rows if b[2] == a[2] and b[1] < a[1] and s is not None and b[index["surface"]] == s]
        known = [b for b in prior if b[index["distance_m"]] is not None]

        def pair(ok, chosen):
            return (len(chosen), sum(b[15] <= 3 for b in chosen)) if ok else (None, None)

        want = (
            pair(s is not None, prior)
            + pair(s is not None and d is not None, [b for b in known if d is not None and abs(b[index["distance_m"]] - d) <= 200])
            + pair(s is not None and d is not None, [b for b in known if d is not None and regime(b[index["distance_m"]]) == regime(d)])
            + pair(
                s is not None and d is not None and v is not None,
                [b for b in known if b[index["distance_m"]] == d and b[index["venue"]] == v],
            )
        )
        assert got[(a[0], a[2])] == want


def test_unknown_prior_outcome_makes_the_block_unknown(spark):
    rows = field(spark, [entry(c, c, 1, 1, 1) for c in range(3)])
    rows = rows.withColumn("label", F.when(F.col("contest_id") != 1, F.col("label")))
    out = by_key(history.strict_prior_blocks(rows), "near_starts", "near_top3")
    assert out == {(0, 1): (0, 0), (1, 1): (1, 1), (2, 1): (None, None)}


def test_panel_refuses_market_and_missing_columns(spark):
    rows = field(spark, rotating(2))
    with pytest.raises(ContractError):
        history.build_panel(rows.withColumn("win_odds", F.lit(2.0)))
    with pytest.raises(ContractError):
        history.build_panel(rows.drop("weight"))


def test_draw_survives_scratches(spark):
    rows = [entry(0, 0, s, s, s, 7, declared_size=8, field_size=7) for s in range(1, 8)]
    assert by_key(field(spark, rows), "draw_pct")[(0, 7)] == pytest.approx(6 / 7)


def test_stale_and_uncertified_history(spark):
    rows = field(spark, rotating(3, gap=10))
    assert history.asof_slice(rows, "2000-01-25", 7, "2000-01-24")[1].first()["verdict"] == "usable"
    assert history.asof_slice(rows, "2000-02-25", 7, "2000-02-24")[1].first()["verdict"] == "stale"
    assert history.asof_slice(rows, "2000-01-25", 7, "2000-01-22")[1].first()["verdict"] == "not_certified"
    assert history.asof_slice(rows, "1999-01-25", 7, "2000-01-22")[1].first()["verdict"] == "empty"


def test_strict_history_reports_same_day_repeats(spark):
    rows = field(spark, [entry(0, 0, 1, 1, 1), entry(1, 0, 1, 1, 1), entry(2, 1, 1, 1, 1)])
    report = {r["rule"]: r["violations"] for r in history.strict_history_check(history.build_panel(rows)).collect()}
    assert report == {"same_day": 1, "duplicate_key": 0, "not_before": 0}


def test_plans_of_the_day_states(spark):
    """Counts use no window over raw entries; starts are cut to the rank before the shuffle."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    rows = history.winner_relative(field(spark, rotating()))
    counts = plan(history.daily_starts(rows, 0))
    assert "Window" not in counts and counts.count("Exchange hashpartitioning(subject_id") == 1
    starts = plan(history.daily_starts(rows))
    assert "WindowGroupLimit" in starts and starts.index("WindowGroupLimit") < starts.rindex("WindowGroupLimit")


def test_many_starts_on_one_day(spark):
    """Hundreds of starts of one subject on one day: all are counted, the last ones by contest id are summarized."""
    rows = [entry(c, 10, 1, 1, 1 + c % 4, distance_m=1000 + c) for c in range(300)] + [entry(c, 10, 2 + k, 2 + k, 2 + (c + k) % 3) for c in range(300) for k in range(3)]
    rows += [entry(900, 20, s, s, s) for s in (1, 2, 3, 4)]
    out = history.build_panel(field(spark, rows)).filter("contest_id = 900 AND subject_id = 1").first()
    assert out["career_starts"] == 300 and out["career_top3"] == 225
    assert out["distance_change"] == 1200 - 1299
    assert out["recent3_top3"] == sum(1 + c % 4 <= 3 for c in (297, 298, 299))
    totals = {r["subject_id"]: (r["n"], len(r["starts"])) for r in history.daily_starts(history.winner_relative(field(spark, rows))).filter("n > 1").collect()}
    assert totals == {s: (300, 4) for s in (1, 2, 3, 4)}
