"""Market and probability operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.spec import check
from fieldform.functions.probability import beta_shrink, convex_blend, field_size_baseline
from fieldform.operators import market, metrics, relative, selection
from fieldform.plans.panels import panel
from fieldform.plans.predictions import predictions, training_prior
from fieldform.sources.testtables import entries

KEYS = "contest_id:i subject_id:i "


@check(
    "market_win_prob",
    KEYS + "p_win:f overround:f",
    """SELECT contest_id, subject_id,
  CASE WHEN bool_and(coalesce(win_odds > 1, false)) OVER c THEN (1 / win_odds) / sum(1 / win_odds) OVER c END AS p_win,
  CASE WHEN bool_and(coalesce(win_odds > 1, false)) OVER c THEN sum(1 / win_odds) OVER c END AS overround
FROM starters WINDOW c AS (PARTITION BY contest_id)""",
)
def _(spark, sf):
    return market.market_win_prob(entries(spark, sf).filter("status <> 'scratched'"))


@check("harville_top_k", KEYS + "p_first:f p_second:f p_third:f p_top:f", "SELECT * FROM market")
def _(spark, sf):
    rows = entries(spark, sf).filter("status <> 'scratched'")
    complete = market.market_reasons(entries(spark, sf)).filter("reason = 'complete'")
    priced = rows.join(complete, "contest_id", "left_semi").withColumn("strength", 1 / F.col("win_odds"))
    return market.harville_top_k(priced, "strength")


@check(
    "rebuild_market",
    KEYS + "market_field_size:i overround:f market_p_win:f market_p_top3:f",
    "SELECT *, field_size AS market_field_size, p_first AS market_p_win, p_top AS market_p_top3 FROM market",
)
def _(spark, sf):
    return market.rebuild_market(entries(spark, sf))[0]


@check("market_reasons", "reason:s contests:i", "SELECT reason, count(*) AS contests FROM reasons GROUP BY reason")
def _(spark, sf):
    return market.rebuild_market(entries(spark, sf))[1]


@check(
    "place_strength",
    KEYS + "place_strength:f",
    """SELECT contest_id, subject_id, CASE WHEN count(raw) OVER c = count(*) OVER c THEN 3 * raw / sum(raw) OVER c END AS place_strength
FROM (SELECT *, 2 / ((1 + win_odds / 8) + (1 + win_odds / 5)) AS raw FROM starters) WINDOW c AS (PARTITION BY contest_id)""",
)
def _(spark, sf):
    rows = entries(spark, sf).filter("status <> 'scratched'")
    rows = rows.withColumn("low", 1 + F.col("win_odds") / 8).withColumn("high", 1 + F.col("win_odds") / 5)
    return market.place_strength(rows, "low", "high")


@check("logit_shift_to_sum", KEYS + "p_form:f", "SELECT * FROM wide")
def _(spark, sf):
    rows = panel(spark, sf)
    priced = market.market_reasons(entries(spark, sf)).filter("reason = 'complete'")
    form = rows.join(priced, "contest_id", "left_semi").withColumn(
        "form", beta_shrink("career_top3", "career_starts", training_prior(rows))
    )
    return market.logit_shift_to_sum(form, "form").withColumnRenamed("p_adjusted", "p_form")


@check(
    "beta_shrink",
    KEYS + "career_shrunk:f turf_shrunk:f same_distance_shrunk:f same_course_shrunk:f log_days_since_prev:f log_career_starts:f",
    "SELECT * FROM engineered",
)
def _(spark, sf):
    rows = panel(spark, sf)
    return relative.engineer_features(rows, training_prior(rows))


@check(
    "field_size_baseline",
    KEYS + "p:f",
    "SELECT contest_id, subject_id, CASE WHEN field_size > 3 THEN least(greatest(3.0 / field_size, 1e-12), 1 - 1e-12) END AS p FROM starters",
)
def _(spark, sf):
    return panel(spark, sf).select("contest_id", "subject_id", field_size_baseline("field_size").alias("p"))


@check("convex_blend", KEYS + "p:f", "SELECT *, 0.75 * p_market + 0.25 * p_form AS p FROM wide")
def _(spark, sf):
    return predictions(spark, sf).withColumn("p", convex_blend("p_market", "p_form", 0.25))


GRID = """
WITH grid AS (SELECT i * 0.05 AS weight FROM range(21) t(i)),
bp AS (SELECT g.weight, contest_id, contest_date, label, (1 - g.weight) * p_market + g.weight * p_form AS p FROM wide, grid g),
bl AS (SELECT *, (p - label) * (p - label) AS b,
  -(label * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - label) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12))) AS l FROM bp),
bs AS (SELECT weight, avg(b) AS brier, avg(l) AS log_loss, count(*) AS rows, count(DISTINCT contest_id) AS contests FROM bl GROUP BY weight),
pick AS (SELECT weight AS w FROM bs ORDER BY brier, log_loss, weight LIMIT 1),
bc AS (SELECT weight, contest_id, min(contest_date) AS block, avg(b) AS brier, avg(l) AS log_loss FROM bl GROUP BY 1, 2),
ms AS (SELECT weight, avg(brier) AS macro_brier, avg(log_loss) AS macro_log_loss FROM bc GROUP BY weight),
mbest AS (SELECT weight AS w FROM ms ORDER BY macro_brier, macro_log_loss, weight LIMIT 1),
bd AS (SELECT c.weight, c.block, c.brier - r.brier AS d FROM bc c JOIN bc r ON r.contest_id = c.contest_id, mbest WHERE r.weight = mbest.w),
ba AS (SELECT weight, avg(d) AS m, count(*) AS n FROM bd GROUP BY weight),
bg AS (SELECT d.weight, d.block, sum(d.d - a.m) AS s FROM bd d JOIN ba a ON a.weight = d.weight GROUP BY 1, 2),
be AS (SELECT a.weight, a.m, sqrt(count(*) / (count(*) - 1.0) * sum(pow(s, 2)) / pow(a.n, 2)) AS se
  FROM ba a JOIN bg g ON g.weight = a.weight GROUP BY a.weight, a.m, a.n)
----
"""


@check(
    "blend_grid",
    "weight:f brier:f log_loss:f rows:i contests:i is_selected:i is_nearby:i",
    GRID + """SELECT bs.*, CASE WHEN weight = pick.w THEN 1 ELSE 0 END AS is_selected,
  CASE WHEN abs(weight - pick.w) <= 0.1 + 1e-12 THEN 1 ELSE 0 END AS is_nearby FROM bs, pick""",
)
def _(spark, sf):
    return selection.blend_grid(predictions(spark, sf), "p_market", "p_form")


@check(
    "blend_one_se",
    "weight:f macro_brier:f macro_log_loss:f mean_brier_delta:f se_brier_delta:f within_brier:i is_best:i",
    GRID + """SELECT ms.*, be.m AS mean_brier_delta, be.se AS se_brier_delta,
  CASE WHEN be.m <= be.se + 1e-15 THEN 1 ELSE 0 END AS within_brier, CASE WHEN ms.weight = mbest.w THEN 1 ELSE 0 END AS is_best
FROM ms JOIN be ON be.weight = ms.weight, mbest""",
)
def _(spark, sf):
    return selection.blend_one_se(predictions(spark, sf), "p_market", "p_form")[0]


@check(
    "blend_decision",
    "winner:s point_best:s incumbent_retained:i weight:f",
    GRID + """SELECT CASE WHEN keep THEN 'blend_w0.00' ELSE best END AS winner, best AS point_best, CAST(keep AS INT) AS incumbent_retained,
  CASE WHEN keep THEN 0.0 ELSE w END AS weight
FROM (SELECT mbest.w, 'blend_w' || printf('%.2f', mbest.w) AS best, (SELECT m <= se + 1e-15 FROM be WHERE weight = 0) AS keep FROM mbest)""",
)
def _(spark, sf):
    return selection.blend_one_se(predictions(spark, sf), "p_market", "p_form")[1]


# The Newton iteration of the calibration line, unrolled for DuckDB.
# Plain Newton steps, more than enough here: the optimum is unique, however it is reached.
STEPS = 14


def newton_sql(source: str, p: str, steps: int = STEPS) -> str:
    parts = [
        f"nx AS (SELECT ln(least(greatest({p}, 1e-9), 1 - 1e-9) / (1 - least(greatest({p}, 1e-9), 1 - 1e-9))) AS x, "
        f"CAST(label AS DOUBLE) AS y FROM {source})",
        "n0 AS (SELECT ln(avg(y) / (1 - avg(y))) AS a, CAST(0 AS DOUBLE) AS b FROM nx)",
    ]
    for i in range(steps):
        parts.append(
            f"n{i + 1} AS (SELECT a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, "
            f"b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM ("
            f"SELECT any_value(a) AS a, any_value(b) AS b, sum(y - mu) AS g0, sum((y - mu) * x) AS g1, sum(mu * (1 - mu)) AS h0, "
            f"sum(mu * (1 - mu) * x) AS h1, sum(mu * (1 - mu) * x * x) AS h2 FROM ("
            f"SELECT nx.*, n{i}.*, 1 / (1 + exp(-(a + b * x))) AS mu FROM nx, n{i})))"
        )
    return "WITH " + ",\n".join(parts)


@check(
    "fit_logit_calibrator",
    "intercept:f slope:f rows:i converged:s",
    newton_sql("wide", "p_market") + f"\n----\nSELECT a AS intercept, b AS slope, 'true' AS converged, (SELECT count(*) FROM nx) AS rows FROM n{STEPS}",
)
def _(spark, sf):
    return metrics.calibration_line(predictions(spark, sf), "p_market")


@check(
    "apply_logit_calibrator",
    KEYS + "p_calibrated:f",
    newton_sql("wide", "p_market")
    + f"\n----\nSELECT contest_id, subject_id, 1 / (1 + exp(-(a + b * ln(p_market / (1 - p_market))))) AS p_calibrated FROM wide, n{STEPS}",
)
def _(spark, sf):
    wide = predictions(spark, sf)
    return metrics.calibrate(wide, metrics.calibration_line(wide, "p_market"), "p_market", "p_calibrated")


@check(
    "sensitivity_range",
    KEYS + "p_min:f p_max:f best_rank:i worst_rank:i",
    """SELECT contest_id, subject_id, min(p) AS p_min, max(p) AS p_max, min(rank) AS best_rank, max(rank) AS worst_rank
FROM (SELECT *, row_number() OVER (PARTITION BY candidate, contest_id ORDER BY round(p, 9) DESC, entry_no) AS rank FROM preds)
GROUP BY contest_id, subject_id""",
)
def _(spark, sf):
    from fieldform.operators.ranking import rank_first
    from fieldform.plans.predictions import long_predictions

    long = long_predictions(predictions(spark, sf)).withColumn("_p", F.round("p", 9))
    return selection.sensitivity_range(rank_first(long, "_p", ["candidate", "contest_id"], name="rank"))
