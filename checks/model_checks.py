"""Models: fits are compared by rows only; their contracts are compared with SQL where it exists."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.spec import check
from fieldform import scale
from fieldform.operators import cohorts, metrics
from fieldform.plans import evaluation, models
from fieldform.plans.panels import blocks_panel, panel
from fieldform.plans.models import Recipe

KEYS = "contest_id:i subject_id:i "


def year_of():
    return F.year("contest_date")


LINEAR = Recipe("linear")


def cohort(spark, sf, surface="turf"):
    return cohorts.select_cohort(panel(spark, sf), surface)


def split(rows, year):
    return rows.filter(year_of() < year), rows.filter(year_of() == year)


FOLD = 2000  # the validation year of the tables


@check("feature_matrix", KEYS + "slots:i known:i")
def _(spark, sf):
    rows = panel(spark, sf)
    train, held = split(cohort(spark, sf), FOLD)
    numeric, categorical = LINEAR.columns()
    data = models.features(train, rows, 0.2, LINEAR)
    stages = models.feature_stages(data, numeric, categorical, scale=True).fit(data)
    out = stages.transform(models.features(held, rows, 0.2, LINEAR)).withColumn("_x", vector_to_array("features"))
    return out.select(
        "contest_id", "subject_id", F.size("_x").alias("slots"), F.size(F.filter("_x", lambda v: ~F.isnan(v))).alias("known")
    )


@check("fit_linear", KEYS + "p:f")
def _(spark, sf):
    train, held = split(cohort(spark, sf), FOLD)
    return models.score(models.fit_linear(train, panel(spark, sf)), held, panel(spark, sf))


def trees(spark, sf, family, config, **kw):
    train, held = split(cohort(spark, sf), FOLD)
    rows = panel(spark, sf)
    return models.score(models.fit_trees(train, rows, family, config, **kw), held, rows)


@check("fit_random_forest", KEYS + "p:f")
def _(spark, sf):
    return trees(spark, sf, "random_forest", "RF01")


@check("fit_hist_gradient_boosting", KEYS + "p:f")
def _(spark, sf):
    return trees(spark, sf, "hist_gradient_boosting", "HGB01")


@check("fit_gradient_boosting_relative", KEYS + "p:f")
def _(spark, sf):
    return trees(spark, sf, "xgboost", "XGB01", extras=("relative", "trend", "interaction"))


@check("fit_linear_blocks", KEYS + "p:f")
def _(spark, sf):
    rows = blocks_panel(spark, sf)
    train, held = split(cohorts.select_cohort(rows, "turf"), FOLD)
    recipe = Recipe("linear_blocks", extras=("relative", "near", "regime"))
    return models.score(models.fit(recipe, train, rows), held, rows)


@check(
    "fold_guard",
    "rule:s violations:i",
    """SELECT 'training_not_earlier' AS rule, count(*) AS violations FROM cohort WHERE year(contest_date) = 1998 AND month(contest_date) <= 3
UNION ALL SELECT 'scored_other_year', count(*) FROM cohort WHERE year(contest_date) = 1997 AND month(contest_date) = 12
UNION ALL SELECT 'shared_contests', count(DISTINCT contest_id) FROM cohort WHERE contest_date BETWEEN DATE '1997-12-01' AND DATE '1998-03-31'""",
)
def _(spark, sf):
    rows = cohort(spark, sf)
    train = rows.filter("contest_date <= DATE '1998-03-31'")
    scored = rows.filter("contest_date BETWEEN DATE '1997-12-01' AND DATE '1998-12-31'")
    return evaluation.fold_guard(train, scored, 1998)


@check("expanding_oof", "candidate:s " + KEYS + "label:i p:f")
def _(spark, sf):
    recipes = [LINEAR, Recipe("linear_strong", config={"C": 0.01})]
    return evaluation.expanding_oof(cohort(spark, sf), panel(spark, sf), [1999, FOLD], recipes)


@check("nested_tuning", "outer_year:i candidate:s complexity_rank:i is_best:i is_selected:i")
def _(spark, sf):
    recipes = [Recipe("C0.01", config={"C": 0.01}), Recipe("C1", config={"C": 1.0})]
    return evaluation.nested_tuning(cohort(spark, sf), panel(spark, sf), [FOLD], 1, recipes)[1]


@check("block_ablation", "candidate:s contests:i mean_brier_delta:f se_brier_delta:f")
def _(spark, sf):
    return evaluation.block_ablation(cohort(spark, sf), panel(spark, sf), [FOLD], LINEAR)


@check("greedy_blocks", "extra:s candidate:s macro_brier:f mean_brier_delta:f se_brier_delta:f kept:i")
def _(spark, sf):
    return evaluation.greedy_blocks(cohort(spark, sf), panel(spark, sf), [FOLD], LINEAR, ["relative", "trend"])[1]


@check("band_routing", "surface:s lo:i hi:i model_id:s is_override:i")
def _(spark, sf):
    rows, chosen = panel(spark, sf), cohort(spark, sf)
    both = evaluation.expanding_oof(chosen, rows, [FOLD], [Recipe("overall")])
    bands = [(1000, 1600), (1601, 2600)]
    for lo, hi in bands:
        part = evaluation.expanding_oof(chosen.filter(F.col("distance_m").between(lo, hi)), rows, [FOLD], [Recipe("band")])
        both = both.unionByName(part)
    heads = rows.select("contest_id", "distance_m").distinct()
    return evaluation.band_routing(both.join(heads, "contest_id"), "turf", bands, "overall", "band")


@check("score_routed", KEYS + "p_nonmarket:f route:s model_id:s")
def _(spark, sf):
    rows = panel(spark, sf)
    train, _ = split(cohort(spark, sf), FOLD)
    path = scale.new_folder(spark, "model")
    models.save(models.fit(Recipe("turf"), train, rows), path)
    fits = {"turf-all": models.load(path)}
    routing = spark.createDataFrame(
        [("turf", 1000, 2600, "turf-all", False)], "surface string, lo int, hi int, model_id string, is_override boolean"
    )
    context = rows.filter(year_of() == FOLD)
    return evaluation.score_routed(fits, context, routing)


def contributions(spark, sf):
    rows = panel(spark, sf)
    train, held = split(cohort(spark, sf), FOLD)
    fitted = models.fit(LINEAR, train, rows)
    return fitted, held.withColumn("year", year_of().cast("string")), rows


@check("linear_contributions", KEYS + "feature:s contribution:f")
def _(spark, sf):
    fitted, held, rows = contributions(spark, sf)
    return models.linear_contributions(fitted, held, rows, ["contest_id", "subject_id"])


@check("linear_importance", "scope:s year:s grain:s name:s rows:i mean_abs:f share_of_total:f")
def _(spark, sf):
    fitted, held, rows = contributions(spark, sf)
    long = models.linear_contributions(fitted, held, rows, ["contest_id", "subject_id", "surface", "year"])
    families = {c: block for block, cols in models.NUMERIC_BLOCKS.items() for c in cols}
    return metrics.importance_rollup(long, families, scope="surface")


@check("top_coefficients", "term:s source:s coefficient:f")
def _(spark, sf):
    fitted, held, rows = contributions(spark, sf)
    return models.top_coefficients(fitted, models.transform(fitted, held, rows))
