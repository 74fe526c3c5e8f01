"""Linked decisions over stored predictions: planted winners, resumption, and one feature fit a fold."""

from __future__ import annotations

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.search_checks import gate_sql
from fieldform.contracts import ContractError
from fieldform.operators import cohorts, history, metrics, selection
from fieldform.plans import search
from fieldform.plans.models import C_GRID, CONFIGS, Recipe
from fieldform.plans.search import Configuration, RateFolds, Scope, VectorFolds
from fieldform.plans.store import ResultStore, source_of
from fieldform.scale import materialize, new_folder
from tests.helpers import field, rotating

SCHEMA = "candidate string, contest_id long, contest_date date, subject_id long, label int, surface string, distance_m int, p double"
BANDS = ((1000, 1400), (1401, 2000))


def forecast(spark, surface, skill, distances=(1200, 1400, 1600), contests=40):
    """Eight entries a contest, two contests a day; ``skill[candidate](distance)`` moves p from the base rate towards the label."""
    rows = []
    for name, of in skill.items():
        for c in range(contests):
            distance = distances[c % len(distances)]
            for s in range(8):
                label = int((s + c) % 8 < 3)
                wobble = 0.02 * ((s * 7 + c * 3) % 5 - 2) * (1 + (c // 2) % 3)
                p = 0.375 + of(distance) * (label - 0.375) + wobble
                rows.append((name, c + (0 if surface == "turf" else 1000), dt.date(2000, 1, 1) + dt.timedelta(days=c // 2), s, label, surface, distance, min(max(p, 0.01), 0.99)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def routed(spark):
    """Turf: bands win the short band only, and the held model wins at 1200.  Dirt: G3 wins everywhere, the route at 1200."""
    turf = forecast(spark, "turf", {"G0": lambda d: 0.3, "G3": lambda d: 0.3, "R3": lambda d: 0.6 if d <= 1400 else 0.1})
    dirt = forecast(spark, "dirt", {"G0": lambda d: 0.1, "G3": lambda d: 0.5, "R3": lambda d: 0.5})
    held = forecast(spark, "turf", {"x": lambda d: 0.9}).unionByName(forecast(spark, "dirt", {"x": lambda d: 0.05})).drop("candidate")
    preds = turf.unionByName(dirt)
    return preds, held, search.route_by_gates(preds, BANDS, override=(1200, held))


def test_planted_routes(routed):
    _, _, out = routed
    routes = {(r.surface, r.lo, r.hi, r.is_override): r.model_id for r in out.routes.collect()}
    assert routes == {
        ("turf", 1000, 1400, False): "R3", ("turf", 1401, 2000, False): "G0", ("turf", 1200, 1200, True): "held_1200",
        ("dirt", 1000, 1400, False): "G3", ("dirt", 1401, 2000, False): "G3",
    }
    winners = {(r.surface, r.gate, r.lo): r.winner for r in out.decisions.collect()}
    assert winners[("turf", "global", None)] == "G0" and winners[("dirt", "global", None)] == "G3"
    assert winners[("turf", "override", 1200)] == "held" and winners[("dirt", "override", 1200)] == "route"
    assert ("dirt", "whole", None) in winners


def test_routed_rows_are_those_of_their_model(routed):
    preds, held, out = routed
    rows = {(r.contest_id, r.subject_id): (r.model_id, r.p) for r in out.predictions.collect()}
    assert len(rows) == 2 * 40 * 8 == out.predictions.count()
    given = {(r.candidate, r.contest_id, r.subject_id): r for r in preds.collect()}
    kept = {(r.contest_id, r.subject_id): r.p for r in held.collect()}
    for (c, s), (model, p) in rows.items():
        short = given["G0", c, s].distance_m
        want = "held_1200" if c < 1000 and short == 1200 else "G3" if c >= 1000 else "R3" if short <= 1400 else "G0"
        assert model == want and p == (kept[c, s] if model == "held_1200" else given[model, c, s].p)


def test_gates_redone_by_sql_from_written_rows(spark, routed, tmp_path):
    preds, _, out = routed
    preds.write.parquet(str(tmp_path / "preds"))
    sql = f"""WITH src AS (SELECT surface AS grp, 'G0' AS incumbent, candidate, contest_id, min(contest_date) AS block, avg(pow(p - label, 2)) AS brier,
      avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS log_loss FROM '{tmp_path}/preds/*.parquet' GROUP BY surface, candidate, contest_id), {gate_sql('src', 'gate')}
      SELECT grp, point_best, winner, incumbent_retained, round(mean_brier_delta, 12), round(se_brier_delta, 12) FROM gate"""
    got = {(r.surface, r.point_best, r.winner, r.incumbent_retained, round(r.mean_brier_delta, 12), round(r.se_brier_delta, 12))
           for r in out.decisions.filter("gate = 'whole'").collect()}
    assert got == set(duckdb.sql(sql).fetchall())


def test_band_without_contests_keeps_the_global_winner(spark):
    preds = forecast(spark, "turf", {"G0": lambda d: 0.1, "G3": lambda d: 0.5, "R3": lambda d: 0.6}, distances=(1200,))
    out = search.route_by_gates(preds, BANDS)
    assert {(r.lo, r.model_id) for r in out.routes.collect()} == {(1000, "R3"), (1401, "G3")}


def test_grouped_gate_is_the_single_gate(spark):
    preds = forecast(spark, "turf", {"G0": lambda d: 0.3, "G3": lambda d: 0.32, "R3": lambda d: 0.29})
    losses = metrics.contest_losses(preds.withColumn("g", F.lit(1)), by=("g", "candidate"))
    single = {r.candidate: r for r in selection.score_table(losses.drop("g")).collect()}
    for r in selection.grouped_scores(losses, ["g"]).collect():
        s = single[r.candidate]
        assert (r.is_best, r.within_brier, r.within_log_loss) == (s.is_best, s.within_brier, s.within_log_loss)
        assert r.mean_brier_delta == pytest.approx(s.mean_brier_delta) and r.se_log_loss_delta == pytest.approx(s.se_log_loss_delta)
    own = spark.createDataFrame([(1, "nobody")], "g int, incumbent string")
    with pytest.raises(Exception, match="incumbent"):
        selection.grouped_gate(losses, ["g"], own).collect()
    with pytest.raises(Exception, match="identical contests"):
        selection.grouped_scores(losses.filter("candidate <> 'G0' OR contest_id > 2"), ["g"]).collect()


def test_overlapping_bands_are_refused(spark):
    frame = forecast(spark, "turf", {"a": lambda d: 0.1}, contests=2)
    with pytest.raises(ContractError):
        search.composite({(1000, 1400): frame, (1400, 1600): frame}, "R3")


# --- search and store -----------------------------------------------------------------


@pytest.fixture(scope="module")
def panel(spark):
    rows = field(spark, rotating(contests=60, n=8, gap=30, distance_m=[1200, 1400, 1600, 1200, 2000], venue=[1, 2, 3]))
    return materialize(history.strict_prior_blocks(history.build_panel(rows)), "panel")


SCOPES = {"A": Scope("turf", 1200, 1200), "C": Scope("turf")}


def test_search_is_resumed_where_it_stopped(spark, panel):
    folder, source = new_folder(spark, "search"), source_of(panel, ["contest_id", "subject_id", "label"])
    years = (2003, 2004)
    calls = []

    def failing(train, rows, blocks, surface):
        calls.append(blocks)
        if "regime" in blocks:
            raise RuntimeError("the driver is lost")
        return search.predict_rates(train, rows, blocks, surface)

    with pytest.raises(RuntimeError):
        search.scope_search(panel, SCOPES["A"], SCOPES, years, failing, ResultStore(spark, source, folder))
    again = ResultStore(spark, source, folder)
    done = again.ledger().count()
    assert done == 2 * 2 * 2
    out = search.scope_search(panel, SCOPES["A"], SCOPES, years, search.predict_rates, again)
    assert len(again.built) == again.ledger().count() - done > 0
    assert not any(json.loads(k)["blocks"] in ([], ["near"]) for k in again.built)
    fresh = search.scope_search(panel, SCOPES["A"], SCOPES, years, search.predict_rates, ResultStore(spark, source))
    assert sorted(map(tuple, out.gates.collect())) == sorted(map(tuple, fresh.gates.collect()))
    assert out.winner == fresh.winner and out.finalists.filter("is_winner").first()["candidate"] == out.winner
    third = ResultStore(spark, source, folder)
    search.scope_search(panel, SCOPES["A"], SCOPES, years, failing, third)
    assert third.built == []
    with pytest.raises(ContractError):
        ResultStore(spark, "other rows", folder)


def test_accepted_block_must_beat_the_gate(spark, panel):
    """Only one block helps, and training on one distance helps more: that block and scope are kept."""

    def planted(train, rows, blocks, surface):
        skill = (0.5 if "regime" in blocks else 0.1) / train.select("distance_m").distinct().count()
        wobble = (F.col("subject_id") * 7 + F.col("contest_id") * 3) % 5 * 0.01
        return rows.withColumn("p", F.lit(0.3) + skill * (F.col("label") - 0.3) + wobble)

    out = search.scope_search(panel, SCOPES["A"], SCOPES, (2003, 2004), planted, ResultStore(spark))
    assert {(r.family, r.block): r.accepted for r in out.gates.collect()} == {
        (f, b): b == "regime" for f in SCOPES for b in search.BLOCKS
    }
    assert out.winner == "A_regime" and out.blocks == ("regime",) and out.scope == SCOPES["A"]


def test_features_are_fitted_once_a_fold(spark, panel):
    rows = cohorts.select_cohort(panel, "turf")
    configurations = [
        Configuration("linear", "C1", 2, {"config": {"C": C_GRID[-1]}}), Configuration("linear", "C0.01", 1, {"config": {"C": C_GRID[0]}}),
        Configuration("random_forest", "RF01", 1, {"config": CONFIGS["random_forest"]["RF01"], "rounds": 3}),
        Configuration("hist_gradient_boosting", "HGB01", 1, {"config": CONFIGS["hist_gradient_boosting"]["HGB01"], "rounds": 2}),
    ]
    folds, fitted = VectorFolds(rows, panel, Recipe("all")), []
    build = folds.build
    folds.build = lambda train, scored, prior: fitted.append(prior) or build(train, scored, prior)
    store = ResultStore(spark)
    out = search.nested_search(folds, {2003: (2002,), 2004: (2002, 2003)}, configurations, store, "linear")
    assert len(fitted) == out.folds.count() == 3
    asked = [tuple(json.loads(k).items()) for k in store.built if "configurations" in k]
    assert len(asked) == len(set(map(str, asked))) and len(asked) >= 2 * 4
    chosen = {(r.outer_year, r.family): r for r in out.tuning.filter("is_selected").collect()}
    assert set(chosen) == {(o, f) for o in (2003, 2004) for f in ("linear", "random_forest", "hist_gradient_boosting")}
    for r in out.tuning.collect():
        best = chosen[r.outer_year, r.family]
        assert not r.within_brier or best.complexity_rank <= r.complexity_rank
    scored = rows.filter(F.year("contest_date").isin(2003, 2004)).count()
    assert out.predictions.count() == 3 * scored and out.predictions.filter("p IS NULL OR p < 0 OR p > 1").count() == 0
    assert out.decision.count() == 1


def test_inner_years_lie_before(spark, panel):
    rows = cohorts.select_cohort(panel, "turf")
    one = [Configuration("career", "a", 1, {"blocks": (), "strength": 6.0})]
    for outer in ({2003: (2003,)}, {2003: ()}):
        with pytest.raises(ContractError):
            search.nested_search(RateFolds(rows), outer, one, ResultStore(spark))
    with pytest.raises(ContractError):
        search.nested_search(RateFolds(rows), {1999: (1998,)}, one, ResultStore(spark))


def test_rates_are_judged_once_a_contest_and_kept_when_chosen(spark, panel):
    rows = cohorts.select_cohort(panel, "turf")
    some = [Configuration(f, f"{f}_{k}", k, {"blocks": b, "strength": 40.0 / k}) for f, b in (("career", ()), ("near", ("near",))) for k in (1, 2, 3)]
    folds, store, outer = RateFolds(rows), ResultStore(spark), {2003: (2002,), 2004: (2002, 2003)}
    out = search.nested_search(folds, outer, some, store, "career")
    names = [json.loads(k)["configurations"] for k in store.built if "configurations" in k]
    assert names and all(len(n) <= 2 for n in names)  # one a family, not all six
    facts = {r.fold: r.prior for r in out.folds.collect()}
    inner = [
        folds.predict({"scored": rows.filter(F.year("contest_date") == i)}, some, {"prior": facts[i]}).withColumn("outer_year", F.lit(o))
        for o, years in outer.items() for i in years
    ]
    ranks = spark.createDataFrame([(c.name, c.complexity_rank) for c in some], "candidate string, complexity_rank int")
    long = inner[0].unionByName(inner[1]).unionByName(inner[2]).withColumn("family", F.split("candidate", "_")[0])
    want = selection.grouped_simplest(metrics.contest_losses(long, by=("outer_year", "family", "candidate")), ["outer_year", "family"], ranks)
    assert set(out.tuning.columns) == set(want.columns)
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(want.columns).collect())
    assert plain(out.tuning) == plain(want)
