"""What the registered queries ask of their operators."""

from __future__ import annotations

from functools import reduce

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import spec
from checks.registry import CHECKS
from fieldform.operators import cohorts
from fieldform.plans import evaluation, models, panels, registry
from fieldform.plans.panels import panel
from fieldform.sources.testtables import table


@pytest.mark.parametrize(
    "name, rounds", [("fit_random_forest", 500), ("fit_hist_gradient_boosting", 300), ("fit_gradient_boosting_relative", 500)]
)
def test_tree_queries_fit_all_rounds(spark, sf, monkeypatch, name, rounds):
    asked = []
    monkeypatch.setattr(models, "fit", lambda recipe, train, panel: asked.append(recipe))
    monkeypatch.setattr(models, "score", lambda fitted, rows, panel: rows)
    CHECKS[name].build(spark, sf)
    (estimator,) = [models._estimator(r, 1) for r in asked]
    assert estimator.getOrDefault("numTrees" if name == "fit_random_forest" else "maxIter") == rounds


def test_consensus_counts_every_order(spark, sf):
    got = spec.run(CHECKS["consensus_map_all"], spark, sf)
    orders = table(spark, sf, "orders")
    assert got.agg(F.sum("evidence")).first()[0] == orders.count()
    assert got.where("k % 2 = 1").count() > 0


def test_ablation_drops_every_block(spark, sf, monkeypatch):
    asked = []

    def listed(cohort, panel, years, recipes):
        asked.extend(recipes)
        return cohort.limit(0).select(F.lit("").alias("candidate"), *evaluation.PRED[1:-1], F.lit(0.0).alias("p"))

    monkeypatch.setattr(evaluation, "expanding_oof", listed)
    CHECKS["block_ablation"].build(spark, sf)
    assert [r.dropped for r in asked] == [(), *[(b,) for b in models.NUMERIC_BLOCKS]]


def test_recipes_of_a_fold_share_their_medians(spark, sf, monkeypatch):
    asked, real = [], models.exact_medians
    monkeypatch.setattr(models, "exact_medians", lambda df, columns: asked.append(columns) or real(df, columns))
    rows = panel(spark, sf)
    chosen, recipes = cohorts.select_cohort(rows, "turf"), [models.Recipe("a"), models.with_dropped(models.Recipe("a"), "recent")]
    both = evaluation.expanding_oof(chosen, rows, [2000], recipes)
    assert len(asked) == 1
    for recipe in recipes:
        alone = evaluation.expanding_oof(chosen, rows, [2000], [recipe]).withColumnRenamed("p", "q")
        met = both.join(alone, ["candidate", "contest_id", "subject_id"])
        assert met.count() == alone.count() > 0 and met.filter("abs(p - q) > 1e-6").isEmpty()


def test_greedy_steps_fit_each_recipe_once(spark, sf, monkeypatch):
    asked = []

    def flat(cohort, panel, years, recipes):
        asked.extend(r.name for r in recipes)
        parts = [cohort.filter(F.year("contest_date").isin(years)).select(F.lit(r.name).alias("candidate"), *evaluation.PRED[1:-1], F.lit(0.2).alias("p")) for r in recipes]
        return reduce(DataFrame.unionByName, parts)

    monkeypatch.setattr(evaluation, "expanding_oof", flat)
    assert CHECKS["greedy_blocks"].build(spark, sf).count() == 4
    assert asked == ["linear", "linear+relative", "linear+trend"]


def test_trees_train_on_no_more_tasks_than_run_at_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "exact_medians", lambda df, columns: seen.append(df.rdd.getNumPartitions()) or {c: 0.0 for c in columns})
    monkeypatch.setattr(models, "_estimator", lambda recipe, rows: VectorAssembler(inputCols=["features"], outputCol="probability"))
    rows = panel(spark, sf).repartition(40)
    models.fit(models.Recipe("t", family="random_forest", config={}), cohorts.select_cohort(rows, "turf"), rows)
    assert seen[0] <= spark.sparkContext.defaultParallelism


def test_search_panel_equals_the_blocks_panel(spark, sf):
    narrow = panels.search_panel(spark, sf)
    panels._written.pop((spark.sparkContext.applicationId, f"{sf}#search"), None)
    wide = panels.blocks_panel(spark, sf).select(narrow.columns)
    assert narrow.exceptAll(wide).isEmpty() and wide.exceptAll(narrow).isEmpty()


def test_scores_write_only_what_they_read(spark, sf, monkeypatch):
    written, real = [], registry.materialize
    monkeypatch.setattr(registry, "materialize", lambda df, name: written.append(df.columns) or real(df, name))
    CHECKS["registry_scores"].build(spark, sf)
    assert 0 < len(written[-1]) < 20
