"""Out-of-fold evaluation, tuning, ablation, routing and the staged market recipe.

The driver loops over years and candidates; every fit, score and comparison inside the
loop is a Spark job, and only names of winners come back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldform.functions.probability import convex_blend
from fieldform.operators import metrics, selection
from fieldform.operators.cohorts import assign_route
from fieldform.operators.joins import disjoint_check
from fieldform.plans.models import NUMERIC_BLOCKS, Fitted, Recipe, fit_all, score, with_dropped, with_extra
from fieldform.plans.predictions import long_predictions
from fieldform.scale import materialize


def year_of():
    return F.year("contest_date")


PRED = ("candidate", "contest_id", "contest_date", "subject_id", "label", "p")


def fold_guard(train: DataFrame, evaluation: DataFrame, year: int) -> DataFrame:
    """Violations of an outer fold: training rows from the year on, other years scored, shared contests."""
    late = train.agg(F.count_if(year_of() >= year).alias("violations")).select(F.lit("training_not_earlier").alias("rule"), "violations")
    other = evaluation.agg(F.count_if(year_of() != year).alias("violations")).select(F.lit("scored_other_year").alias("rule"), "violations")
    shared = disjoint_check(train, evaluation, "contest_id").select(
        F.lit("shared_contests").alias("rule"), F.col("overlap").alias("violations")
    )
    return late.unionByName(other).unionByName(shared)


def expanding_oof(cohort: DataFrame, panel: DataFrame, years: Sequence[int], recipes: Sequence[Recipe]) -> DataFrame:
    """Each year scored by models trained on strictly earlier years; one long table."""
    parts = []
    for year in years:
        train, rows = cohort.filter(year_of() < year), cohort.filter(year_of() == year)
        for fitted in fit_all(recipes, train, panel):
            parts.append(score(fitted, rows, panel).withColumn("candidate", F.lit(fitted.recipe.name)).select(*PRED))
    return materialize(reduce(DataFrame.unionByName, parts), "oof")


def winner(decision: DataFrame) -> str:
    return decision.first()["winner"]


def nested_tuning(
    cohort: DataFrame, panel: DataFrame, outer: Sequence[int], inner: int, recipes: Sequence[Recipe]
) -> tuple[DataFrame, DataFrame]:
    """Per outer year, choose the simplest recipe within one standard error on the ``inner``
    years before it, then score the outer year.  Returns predictions and choices."""
    spark = cohort.sparkSession
    ranks = spark.createDataFrame(
        [(r.name, i) for i, r in enumerate(recipes, 1)], "candidate string, complexity_rank int"
    )
    parts, tables, scored = [], [], {}

    def inside_of(year: int) -> DataFrame:
        """An inner year learns from the years before it, whichever outer years ask for it."""
        if year not in scored:
            scored[year] = expanding_oof(cohort, panel, [year], recipes)
        return scored[year]

    for year in outer:
        inside = reduce(DataFrame.unionByName, [inside_of(y) for y in range(year - inner, year)])
        table = materialize(
            selection.select_simplest_one_se(metrics.contest_losses(inside), ranks).withColumn("outer_year", F.lit(year)),
            "tuning",
        )
        chosen = table.filter("is_selected").first()["candidate"]
        if year in scored:
            own = scored[year].filter(F.col("candidate") == chosen)
        else:
            own = expanding_oof(cohort, panel, [year], [next(r for r in recipes if r.name == chosen)])
        parts.append(own.withColumn("outer_year", F.lit(year)))
        tables.append(table)
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, tables)


def block_ablation(
    cohort: DataFrame, panel: DataFrame, years: Sequence[int], recipe: Recipe, blocks: Sequence[str] | None = None
) -> DataFrame:
    """Paired loss of dropping each feature block against the full recipe; all blocks that the recipe holds, unless some are named."""
    blocks = [b for b in NUMERIC_BLOCKS if b not in recipe.dropped] if blocks is None else blocks
    preds = expanding_oof(cohort, panel, years, [recipe, *[with_dropped(recipe, b) for b in blocks]])
    return selection.paired_delta(materialize(metrics.contest_losses(preds), "losses"), recipe.name)


def greedy_blocks(
    cohort: DataFrame, panel: DataFrame, years: Sequence[int], recipe: Recipe, extras: Sequence[str]
) -> tuple[Recipe, DataFrame]:
    """Offer extra blocks one after the other; each is adopted only through the one-error gate.

    The losses of a recipe are found once, however many blocks it meets.
    """
    steps, found = [], {}

    def losses_of(own: Recipe) -> DataFrame:
        if own.name not in found:
            found[own.name] = materialize(metrics.contest_losses(expanding_oof(cohort, panel, years, [own])), "losses")
        return found[own.name]

    for extra in extras:
        offered = with_extra(recipe, extra)
        losses = losses_of(recipe).unionByName(losses_of(offered))
        table, decision = selection.select_one_se(losses, recipe.name)
        best = winner(decision)
        steps.append(
            materialize(table, "step").select(
                F.lit(extra).alias("extra"), "candidate", "macro_brier", "mean_brier_delta", "se_brier_delta",
                (F.col("candidate") == best).alias("kept"),
            )
        )
        recipe = offered if best == offered.name else recipe
    return recipe, reduce(DataFrame.unionByName, steps)


def band_routing(
    preds: DataFrame, surface: str, bands: Sequence[tuple[int, int]], overall: str, banded: str
) -> DataFrame:
    """Routing rows (surface, lo, hi, model_id, is_override): the band model of a distance band
    replaces the overall one only through the one-error gate on the contests of that band.

    ``preds`` holds both candidates with ``distance_m``.
    """
    rows = []
    for lo, hi in bands:
        losses = metrics.contest_losses(preds.filter(F.col("distance_m").between(lo, hi)))
        _, decision = selection.select_one_se(losses, overall)
        rows.append(
            decision.select(
                F.lit(surface).alias("surface"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                F.when(F.col("winner") == banded, F.lit(f"{banded}_{lo}_{hi}")).otherwise(F.lit(overall)).alias("model_id"),
                F.lit(False).alias("is_override"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def score_routed(models: Mapping[str, Fitted], context: DataFrame, routing: DataFrame, min_prior: int = 3) -> DataFrame:
    """Score eligible entries with the model of their contest; everything else falls back to the market.

    One transform per model over its own contests; the models are few and known to the plan.
    """
    heads = context.select("contest_id", "surface", "distance_m", "field_size", "turn_direction").distinct()
    routed = assign_route(heads, routing).select("contest_id", "model_id")
    rows = context.join(routed, "contest_id")
    eligible = (F.col("career_starts") >= min_prior) & F.col("model_id").isin(*models)
    parts = [
        score(fitted, rows.filter(eligible & (F.col("model_id") == name)), context).select(
            "contest_id", "subject_id", F.col("p").alias("p_nonmarket")
        )
        for name, fitted in models.items()
    ]
    scored = reduce(DataFrame.unionByName, parts)
    own = F.col("p_nonmarket").isNotNull()
    return (
        rows.join(scored, ["contest_id", "subject_id"], "left")
        .withColumn("route", F.when(own, "nonmarket-shadow").otherwise("market-only"))
        .withColumn("model_id", F.when(own, F.col("model_id")).otherwise(""))
    )


def staged_recipe(preds: DataFrame, calibrate: int, gate: int, audit: int) -> dict[str, DataFrame]:
    """Calibrate on one year, gate market and blend on the next, audit on the last.

    ``preds`` is wide: keys, label, ``p_market`` and ``p_model``.  Calibration lines and
    decisions are one-row tables, written so that each is computed once.
    """
    def year(*values: int) -> DataFrame:
        return preds.filter(year_of().isin(*values))

    def lines(rows: DataFrame) -> dict[str, DataFrame]:
        return {p: materialize(metrics.calibration_line(rows, p), "line") for p in ("p_market", "p_model")}

    def calibrated(rows: DataFrame, fitted: Mapping[str, DataFrame]) -> DataFrame:
        for p, line in fitted.items():
            rows = metrics.calibrate(rows, line, p, f"{p}_cal")
        return rows

    first = lines(year(calibrate))
    gated = materialize(calibrated(year(gate), first), "gate")
    pair = long_predictions(
        gated.withColumnsRenamed({"p_market": "p_market_raw", "p_market_cal": "p_market_calibrated"}),
        ("market_raw", "market_calibrated"),
    )
    market_table, market_decision = selection.select_one_se(metrics.contest_losses(pair), "market_raw")
    market_decision = materialize(market_decision, "decision")
    use_calibrated = market_decision.agg(F.first("winner")).scalar() == "market_calibrated"
    base = F.when(use_calibrated, F.col("p_market_cal")).otherwise(F.col("p_market"))
    blend_table, blend_decision = selection.blend_one_se(gated.withColumn("p_base", base), "p_base", "p_model_cal")
    blend_decision = materialize(blend_decision, "decision")
    weight = blend_decision.agg(F.first("weight")).scalar()

    final = calibrated(year(audit), lines(year(calibrate, gate)))
    final = final.withColumn("p_base", base).withColumn("p_blend", convex_blend("p_base", "p_model_cal", weight))
    final = materialize(final.withColumnsRenamed({"p_market": "p_market_raw", "p_model": "p_model_raw"}), "audit")
    names = ("market_raw", "base", "model_raw", "model_cal", "blend")
    long = long_predictions(final, names)
    scores = metrics.candidate_scores(metrics.contest_losses(long))
    line = metrics.calibration_line(long, by=["candidate"]).select("candidate", "intercept", "slope")
    gaps = metrics.ece(metrics.reliability_table(long, by=["candidate"]), ["candidate"]).select("candidate", "ece")
    return {
        "market_gate": market_table,
        "market_decision": market_decision,
        "blend_gate": blend_table,
        "blend_decision": blend_decision,
        "audit": scores.join(line, "candidate").join(gaps, "candidate"),
    }
