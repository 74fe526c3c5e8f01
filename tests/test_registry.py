"""Production models: refits that are found again, versions that were changed, and contests that must not be scored."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldform.contracts import ContractError
from fieldform.operators import history, quality
from fieldform.plans import registry
from fieldform.plans.models import Recipe
from fieldform.plans.registry import ROUTING, ModelSpec, RateFits, RecipeFits
from fieldform.plans.search import BLOCKS, Scope, pooled_rate
from fieldform.scale import materialize, new_folder
from fieldform.sources.snapshot import current_id
from tests.helpers import field, rotating

THROUGH = "2003-06-30"
ROUTES = [
    ("turf", 1000, 1400, "R3", False), ("turf", 1401, 2000, "G0", False), ("turf", 1200, 1200, "held_1200", True),
]
HELD = {"turf": ModelSpec(Scope("turf", 1200, 1200), ("near",))}


@pytest.fixture(scope="module")
def panel(spark):
    rows = field(spark, rotating(contests=60, n=8, gap=30, distance_m=[1200, 1400, 1600, 1200, 2400], venue=[1, 2, 3]))
    return materialize(history.strict_prior_blocks(history.build_panel(rows)), "panel")


@pytest.fixture(scope="module")
def compiled(spark):
    return registry.compile_routing(spark.createDataFrame(ROUTES, ROUTING), HELD)


@pytest.fixture(scope="module")
def made(spark, panel, compiled):
    root = new_folder(spark, "registry")
    return root, registry.refit(panel, *compiled, RateFits(), root, THROUGH)


def test_routes_name_what_they_learn_from(compiled):
    routes, specs = compiled
    assert specs == {
        "turf_R3_1000_1400": ModelSpec(Scope("turf", 1000, 1400), BLOCKS),
        "turf_G0": ModelSpec(Scope("turf", 1000, 2000), ()),
        "turf_held_1200": HELD["turf"],
    }
    assert {(r.lo, r.model_id, r.is_override) for r in routes.collect()} == {
        (1000, "turf_R3_1000_1400", False), (1401, "turf_G0", False), (1200, "turf_held_1200", True)
    }
    assert registry.routing_faults(routes, specs) == []


@pytest.mark.parametrize(
    ("route", "fault"),
    [
        (("turf", 1300, 1500, "turf_G0", False), "overlaps"),
        (("turf", 2401, 2400, "turf_G0", False), "not a range"),
        (("turf", 1600, 1700, "turf_held_1200", True), "not a range"),
        (("turf", 2001, 2400, "nobody", False), "unknown"),
        (("turf", 2001, 2400, "turf_G0", False), "does not learn"),
        (("dirt", 1000, 1400, "turf_G0", False), "does not learn"),
        ((None, 1000, 1400, "turf_G0", False), "without surface"),
    ],
)
def test_faulty_routes_are_refused(spark, panel, compiled, route, fault):
    routes, specs = compiled
    bad = routes.unionByName(spark.createDataFrame([route], ROUTING))
    assert any(fault in f for f in registry.routing_faults(bad, specs))
    with pytest.raises(ContractError, match=fault):
        registry.refit(panel, bad, specs, RateFits(), new_folder(spark, "registry"), THROUGH)


def test_registry_tells_the_training_rows(panel, compiled, made):
    for r in made[1].collect():
        rows = compiled[1][r.model_id].scope.rows(panel).filter(F.col("contest_date") <= THROUGH).collect()
        assert (r.train_rows, r.train_contests) == (len(rows), len({x.contest_id for x in rows}))
        assert (r.trained_from, r.trained_through) == (min(x.contest_date for x in rows), max(x.contest_date for x in rows))
        assert r.prior == pytest.approx(sum(x.label for x in rows) / len(rows))
        assert r.max_abs_error == 0 and r.parity_rows == sum(x.contest_date == r.trained_through for x in rows)


def test_same_request_finds_the_models(spark, panel, compiled, made):
    root, first = made
    version = current_id(spark, root)
    folders = {r.folder for r in first.collect()}
    again = registry.refit(panel.repartition(3), *compiled, RateFits(), root, THROUGH)
    assert {r.folder for r in again.collect()} == folders and current_id(spark, root) == version
    other = new_folder(spark, "registry")
    changed = panel.withColumn("label", F.when(F.col("contest_id") == 5, 1 - F.col("label")).otherwise(F.col("label")))
    assert {r.fingerprint for r in registry.refit(changed, *compiled, RateFits(), other, THROUGH).collect()} != {r.fingerprint for r in first.collect()}
    assert current_id(spark, other) != version


def test_a_lost_refit_keeps_the_current_version(spark, panel, compiled):
    class Failing(RateFits):
        def save(self, spark, fitted, path):
            raise RuntimeError("the driver is lost")

    root = new_folder(spark, "registry")
    registry.refit(panel, *compiled, RateFits(), root, "2002-12-31")
    version = current_id(spark, root)
    with pytest.raises(RuntimeError):
        registry.refit(panel, *compiled, Failing(), root, THROUGH)
    assert current_id(spark, root) == version == registry.current(spark, root, RateFits()).version
    registry.refit(panel, *compiled, RateFits(), root, THROUGH)
    assert current_id(spark, root) != version


def test_a_model_that_reads_back_otherwise_stops_the_refit(spark, panel, compiled):
    class Drifting(RateFits):
        def load(self, spark, path):
            return super().load(spark, path) + 1e-12

    root = new_folder(spark, "registry")
    with pytest.raises(ContractError, match="read back"):
        registry.refit(panel, *compiled, Drifting(), root, THROUGH)
    assert current_id(spark, root) is None


def test_changed_versions_are_refused(spark, panel, compiled):
    routes, specs = compiled
    root = new_folder(spark, "registry")
    with pytest.raises(ContractError, match="no models"):
        registry.current(spark, root, RateFits())
    registry.refit(panel, routes, specs, RateFits(), root, THROUGH)
    assert registry.current(spark, root, RateFits(), routes.repartition(2)).specs == specs
    with pytest.raises(ContractError, match="given routes"):
        registry.current(spark, root, RateFits(), routes.filter("NOT is_override"))
    with pytest.raises(ContractError, match="given routes"):
        registry.current(spark, root, RateFits(), routes.limit(0))
    with pytest.raises(ContractError, match="another kind"):
        registry.current(spark, root, RateFits(3.0))
    stored = f"{root}/versions/{current_id(spark, root)}/routing"
    materialize(spark.read.parquet(stored).withColumn("hi", F.when(F.col("lo") == 1401, 1900).otherwise(F.col("hi")))).write.mode("overwrite").parquet(stored)
    with pytest.raises(ContractError, match="stored routes"):
        registry.current(spark, root, RateFits())


def test_training_needs_rows_and_labels(spark, panel, compiled):
    with pytest.raises(ContractError, match="known labels"):
        registry.refit(panel, *compiled, RateFits(), new_folder(spark, "registry"), "1999-01-01")
    unknown = panel.withColumn("label", F.when(F.col("contest_id") != 20, F.col("label")))
    with pytest.raises(ContractError, match="known labels"):
        registry.refit(unknown, *compiled, RateFits(), new_folder(spark, "registry"), THROUGH)


def test_every_entry_has_a_probability_or_a_reason(spark, panel, made):
    production = registry.current(spark, made[0], RateFits())
    out = {(r.contest_id, r.subject_id): r for r in registry.score(production, panel, refuse=False).collect()}
    assert len(out) == panel.count()
    priors = {r.model_id: r.prior for r in made[1].collect()}
    want = {}
    for name, spec in production.specs.items():
        for r in panel.withColumn("p", pooled_rate(spec.blocks, priors[name])).collect():
            want[name, r.contest_id, r.subject_id] = r.p
    days = {r.model_id: r.trained_through for r in made[1].collect()}
    for r in panel.collect():
        got = out[r.contest_id, r.subject_id]
        model = {1200: "turf_held_1200", 1400: "turf_R3_1000_1400", 1600: "turf_G0"}.get(r.distance_m)
        reason = "no_route" if model is None else "trained_too_late" if days[model] >= r.contest_date else "too_few_starts" if r.career_starts < 3 else None
        assert got.reason == reason and got.route == ("market-only" if reason else "nonmarket-shadow")
        assert got.model_id == ("" if reason else model)
        assert got.p_nonmarket == (None if reason else pytest.approx(want[model, r.contest_id, r.subject_id], abs=0))
    assert {r.reason for r in out.values()} == {None, "no_route", "trained_too_late"}
    assert sum(r.entries for r in registry.reasons(registry.score(production, panel, refuse=False)).collect()) == len(out)


def test_contests_that_must_not_be_scored(spark, panel, made):
    production = registry.current(spark, made[0], RateFits())
    late = panel.filter(F.col("contest_date") > "2003-12-31").filter("distance_m <= 1600")
    ids = sorted(r.contest_id for r in late.select("contest_id").distinct().collect())
    assert registry.score(production, late).filter("reason IS NOT NULL").count() == 0
    one, two, three, four = ids[:4]
    odd = F.col("subject_id") == 3
    rows = (
        late.filter(~((F.col("contest_id") == one) & odd))
        .withColumn("distance_m", F.when((F.col("contest_id") == two) & odd, 1000).otherwise(F.col("distance_m")))
        .withColumn("career_starts", F.when((F.col("contest_id") == three) & odd, None).otherwise(F.col("career_starts")))
        .withColumn("surface", F.when((F.col("contest_id") == four) & odd, None).otherwise(F.col("surface")))
    )
    rows = rows.unionByName(late.filter(F.col("contest_id") == four).withColumn("contest_id", F.lit(None).cast("long")))
    out = registry.score(production, rows, refuse=False).collect()
    assert len(out) == rows.count()
    found = {}
    for r in out:
        found.setdefault(r.contest_id, set()).add(r.reason)
    assert found[one] == {"incomplete_field"} and found[two] == found[four] == {"mixed_contest"}
    assert found[three] == {None, "too_few_starts"} and found[None] == {"no_route"}
    with pytest.raises(Exception, match="must not be scored"):
        registry.score(production, rows)
    with pytest.raises(Exception, match="trained_too_late"):
        registry.score(production, panel)
    assert registry.score(production, panel.limit(0)).count() == 0
    again = registry.score(production, late.unionByName(late), refuse=False)
    assert again.count() == 2 * late.count() and again.filter("reason <> 'incomplete_field'").count() == 0


def test_models_of_spark_ml_are_kept_and_read_back(spark, panel, compiled):
    routes, specs = compiled
    routes, specs = routes.filter("lo = 1401"), {"turf_G0": specs["turf_G0"]}
    kind, root = RecipeFits(Recipe("linear"), panel), new_folder(spark, "registry")
    entry = registry.refit(panel, routes, specs, kind, root, THROUGH).first()
    assert entry.max_abs_error == 0 and entry.parity_rows == 8
    production = registry.current(spark, root, kind)
    late = panel.filter(F.col("contest_date") > THROUGH)
    out = registry.score(production, late).collect()
    assert {(r.model_id, r.reason) for r in out} == {("turf_G0", None), ("", "no_route")}
    assert all(0 < r.p_nonmarket < 1 for r in out if r.reason is None)


def test_month_checkpoints(spark):
    day = dt.date
    ledger = spark.createDataFrame(
        [(1, day(2024, 1, 20)), (1, day(2024, 1, 20)), (2, day(2024, 2, 29)), (3, day(2024, 4, 2)), (4, day(2024, 4, 30)), (5, day(2024, 1, 3)), (6, None)],
        "contest_id long, contest_date date",
    )
    rows = spark.createDataFrame([(1,), (1,), (2,), (5,), (None,)], "contest_id long")
    out = [tuple(r) for r in quality.month_checkpoints(ledger, rows, "2024-01-15", "2024-04-10").orderBy("cutoff").collect()]
    assert out == [
        (day(2024, 1, 15), day(2024, 1, 31), 1, 1, 0, 2, day(2024, 1, 20), day(2024, 1, 31)),
        (day(2024, 2, 1), day(2024, 2, 29), 2, 2, 0, 3, day(2024, 2, 29), day(2024, 2, 29)),
        (day(2024, 3, 1), day(2024, 3, 31), 2, 2, 0, 3, day(2024, 2, 29), day(2024, 3, 31)),
        (day(2024, 4, 1), day(2024, 4, 10), 3, 2, 1, 3, day(2024, 2, 29), day(2024, 4, 1)),
    ]
    assert [r.expected for r in quality.month_checkpoints(ledger.limit(0), rows, "2024-01-15", "2024-02-10").collect()] == [0, 0]
    assert quality.month_checkpoints(ledger, rows, "2024-05-01", "2024-04-10").count() == 0
