"""Scores, calibration, selection and relative features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.market_checks import newton_sql  # noqa: F401
from checks.spec import check
from checks.staged_checks import lines_sql
from fieldform.operators import cohorts, metrics, ranking, relative, selection
from fieldform.plans.panels import blocks_panel, panel
from fieldform.plans.predictions import long_predictions, predictions, training_prior

KEYS = "contest_id:i subject_id:i "


def preds(spark, sf):
    return long_predictions(predictions(spark, sf))


def losses(spark, sf):
    return metrics.contest_losses(preds(spark, sf))


@check("entry_losses", "candidate:s " + KEYS + "brier:f log_loss:f", "SELECT * FROM entry_loss")
def _(spark, sf):
    return metrics.entry_losses(preds(spark, sf))


@check(
    "micro_scores",
    "candidate:s rows:i micro_brier:f micro_log_loss:f observed_rate:f mean_predicted:f",
    "SELECT candidate, count(*) AS rows, avg(brier) AS micro_brier, avg(log_loss) AS micro_log_loss, avg(label) AS observed_rate, "
    "avg(p) AS mean_predicted FROM entry_loss GROUP BY candidate",
)
def _(spark, sf):
    return metrics.micro_scores(preds(spark, sf))


@check("contest_losses", "candidate:s contest_id:i block:d rows:i brier:f log_loss:f", "SELECT * FROM losses")
def _(spark, sf):
    return losses(spark, sf)


@check(
    "candidate_scores",
    "candidate:s macro_brier:f macro_log_loss:f micro_brier:f micro_log_loss:f contests:i rows:i",
    "SELECT * FROM scores",
)
def _(spark, sf):
    return metrics.candidate_scores(losses(spark, sf))


@check(
    "clustered_mean_se",
    "candidate:s n:i clusters:i mean_brier:f se_brier:f",
    """
WITH m AS (SELECT candidate, avg(brier) AS mean_brier, count(*) AS n FROM losses GROUP BY candidate),
g AS (SELECT l.candidate, l.block, sum(l.brier - m.mean_brier) AS s FROM losses l JOIN m ON m.candidate = l.candidate GROUP BY 1, 2)
----
SELECT m.candidate, m.n, m.mean_brier, count(*) AS clusters, sqrt(count(*) / (count(*) - 1.0) * sum(s * s) / pow(m.n, 2)) AS se_brier
FROM m JOIN g ON g.candidate = m.candidate GROUP BY m.candidate, m.n, m.mean_brier""",
)
def _(spark, sf):
    return selection.clustered_mean_se(losses(spark, sf), "brier", "block", ["candidate"])


DELTA = "contests:i clusters:i mean_brier_delta:f se_brier_delta:f mean_log_loss_delta:f se_log_loss_delta:f "


@check("paired_delta", "candidate:s unpaired:i " + DELTA, "SELECT *, 0 AS unpaired FROM deltas")
def _(spark, sf):
    table = losses(spark, sf)
    return selection.paired_delta(table, selection.best_candidate(metrics.candidate_scores(table)))


@check(
    "select_one_se",
    "candidate:s macro_brier:f mean_brier_delta:f se_brier_delta:f is_best:i within_brier:i within_log_loss:i",
    """SELECT s.candidate, s.macro_brier, d.*, CAST(s.candidate = best.best AS INT) AS is_best,
  CAST(d.mean_brier_delta <= d.se_brier_delta + 1e-15 AS INT) AS within_brier,
  CAST(d.mean_log_loss_delta <= d.se_log_loss_delta + 1e-15 AS INT) AS within_log_loss
FROM scores s JOIN (SELECT * EXCLUDE (contests, candidate), candidate AS dc FROM deltas) d ON d.dc = s.candidate, best""",
)
def _(spark, sf):
    return selection.select_one_se(losses(spark, sf), "market")[0]


DECIDED = """SELECT CASE WHEN keep THEN '{0}' ELSE best END AS winner, best AS point_best, '{0}' AS incumbent,
  CAST(keep AS INT) AS incumbent_retained
FROM (SELECT best.best, d.mean_brier_delta <= {1} * d.se_brier_delta + 1e-15 AS keep FROM best, deltas d WHERE d.candidate = '{0}')"""


@check("selection_decision", "winner:s point_best:s incumbent:s incumbent_retained:i", DECIDED.format("uniform", "1.0"))
def _(spark, sf):
    return selection.select_one_se(losses(spark, sf), "uniform")[1]


@check(
    "select_simplest_one_se",
    "candidate:s complexity_rank:i macro_brier:f within_brier:i is_selected:i",
    """
WITH c(candidate, complexity_rank) AS (VALUES ('uniform', 1), ('form', 2), ('market', 3)),
t AS (SELECT s.candidate, s.macro_brier, s.macro_log_loss, c.complexity_rank, d.mean_brier_delta <= d.se_brier_delta + 1e-15 AS near
  FROM scores s JOIN c ON c.candidate = s.candidate JOIN deltas d ON d.candidate = s.candidate),
pick AS (SELECT candidate AS x FROM t WHERE near ORDER BY complexity_rank, macro_brier, macro_log_loss, candidate LIMIT 1)
----
SELECT t.*, CAST(near AS INT) AS within_brier, CAST(candidate = pick.x AS INT) AS is_selected FROM t, pick""",
)
def _(spark, sf):
    ranks = spark.createDataFrame([("uniform", 1), ("form", 2), ("market", 3)], "candidate string, complexity_rank int")
    return selection.select_simplest_one_se(losses(spark, sf), ranks)


BINS = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY pr, contest_id, subject_id) AS rk,
  count(*) OVER (PARTITION BY candidate) AS n FROM (SELECT *, round(p, 9) AS pr FROM preds)),
b AS (SELECT candidate, CAST(greatest(ceil((rk - 1) * 10 / (n - 1.0)) - 1, 0) AS BIGINT) AS bin, count(*) AS rows, avg(pr) AS mean_predicted,
  avg(label) AS observed_rate, min(pr) AS min_predicted, max(pr) AS max_predicted, avg(label) - avg(pr) AS gap FROM r GROUP BY 1, 2)
----
"""


@check(
    "reliability_table",
    "candidate:s bin:i rows:i mean_predicted:f observed_rate:f min_predicted:f max_predicted:f gap:f",
    BINS + "SELECT * FROM b",
)
def _(spark, sf):
    rows = preds(spark, sf).withColumn("p", F.round("p", 9))
    return metrics.reliability_table(rows, by=["candidate"])


@check(
    "reliability_table_global",
    "bin:i rows:i mean_predicted:f observed_rate:f gap:f",
    """
WITH r AS (SELECT *, row_number() OVER (ORDER BY pr, contest_id, subject_id) AS rk, count(*) OVER () AS n
  FROM (SELECT *, round(p_market, 9) AS pr FROM wide))
----
SELECT CAST(greatest(ceil((rk - 1) * 10 / (n - 1.0)) - 1, 0) AS BIGINT) AS bin, count(*) AS rows, avg(pr) AS mean_predicted,
  avg(label) AS observed_rate, avg(label) - avg(pr) AS gap FROM r GROUP BY 1""",
)
def _(spark, sf):
    return metrics.reliability_table(predictions(spark, sf).withColumn("p", F.round("p_market", 9)))


@check("ece", "candidate:s ece:f rows:i", BINS + "SELECT candidate, sum(rows * abs(gap)) / sum(rows) AS ece, sum(rows) AS rows FROM b GROUP BY candidate")
def _(spark, sf):
    rows = preds(spark, sf).withColumn("p", F.round("p", 9))
    return metrics.ece(metrics.reliability_table(rows, by=["candidate"]), ["candidate"])


@check(
    "field_sum_check",
    "candidate:s contests:i mean_sum:f max_abs_error:f",
    "SELECT candidate, count(*) AS contests, avg(s) AS mean_sum, max(abs(s - 3)) AS max_abs_error "
    "FROM (SELECT candidate, contest_id, sum(p) AS s FROM preds GROUP BY 1, 2) GROUP BY candidate",
)
def _(spark, sf):
    return metrics.field_sum_check(preds(spark, sf))


@check(
    "subgroup_diagnostics",
    "candidate:s dimension:s level:s rows:i contests:i macro_brier:f macro_log_loss:f micro_brier:f baseline_macro_brier:f brier_skill:f "
    "observed_rate:f mean_predicted:f calibration_gap:f",
    """
WITH u AS (SELECT u.dimension, u.level, q.* FROM entry_loss q, LATERAL (VALUES ('overall', 'all'), ('year', year), ('field_size_band', field_size_band),
  ('contest_class', contest_class), ('venue', CAST(venue AS VARCHAR)), ('rest_band', rest_band), ('starts_band', starts_band)) u(dimension, level)),
c AS (SELECT candidate, dimension, level, contest_id, count(*) AS n, avg(brier) AS b, avg(log_loss) AS l, avg(pow(p_uniform - label, 2)) AS bb,
  sum(label) AS y, sum(p) AS sp FROM u GROUP BY 1, 2, 3, 4)
----
SELECT candidate, dimension, level, sum(n) AS rows, count(*) AS contests, avg(b) AS macro_brier, avg(l) AS macro_log_loss, sum(b * n) / sum(n) AS micro_brier,
  avg(bb) AS baseline_macro_brier, 1 - avg(b) / avg(bb) AS brier_skill, sum(y) / sum(n) AS observed_rate, sum(sp) / sum(n) AS mean_predicted,
  sum(y) / sum(n) - sum(sp) / sum(n) AS calibration_gap
FROM c GROUP BY candidate, dimension, level""",
)
def _(spark, sf):
    return by_candidate(spark, sf, calibration=False)


@check(
    "subgroup_calibration",
    "candidate:s dimension:s level:s rows:i intercept:f slope:f",
    f"""WITH u AS MATERIALIZED (SELECT q.candidate || '|' || u.dimension || '|' || u.level AS grp, q.candidate, u.dimension, u.level, q.p, q.label AS y FROM preds q, LATERAL (VALUES ('overall', 'all'),
  ('year', year), ('field_size_band', field_size_band), ('contest_class', contest_class), ('venue', CAST(venue AS VARCHAR)), ('rest_band', rest_band), ('starts_band', starts_band)) u(dimension, level)),
{lines_sql('u', 'line')}
---- /*recursive*/
SELECT g.candidate, g.dimension, g.level, l.rows, l.intercept, l.slope FROM line l JOIN (SELECT DISTINCT grp, candidate, dimension, level FROM u) g ON g.grp = l.grp""",
)
def _(spark, sf):
    return by_candidate(spark, sf)


def by_candidate(spark, sf, **kw):
    wide = predictions(spark, sf)
    parts = [
        metrics.subgroup_diagnostics(wide.withColumn("p", F.col(f"p_{c}")), **kw).withColumn("candidate", F.lit(c))
        for c in ("market", "uniform", "form")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check(
    "contest_review",
    "contest_id:i rows:i brier:f log_loss:f leader_mass:f leader_ranks:s",
    """SELECT contest_id, count(*) AS rows, avg(pow(p - label, 2)) AS brier,
  avg(-(label * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - label) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))) AS log_loss,
  sum(CASE WHEN label = 1 THEN p END) AS leader_mass,
  array_to_string(list_sort(list(rk) FILTER (WHERE label = 1)), ';') AS leader_ranks
FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY p DESC, entry_no) AS rk
      FROM (SELECT contest_id, entry_no, label, round(p_market, 9) AS p FROM wide)) GROUP BY contest_id""",
)
def _(spark, sf):
    return metrics.contest_review(predictions(spark, sf).withColumn("p", F.round("p_market", 9)))


@check(
    "rank_first",
    KEYS + "rank:i",
    "SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY round(p_form, 9) DESC, entry_no) AS rank FROM wide",
)
def _(spark, sf):
    return ranking.rank_first(predictions(spark, sf).withColumn("p", F.round("p_form", 9)), "p")


@check(
    "top_regrets",
    KEYS + "regret:f",
    "SELECT contest_id, subject_id, round(pow(p_form - label, 2) - pow(p_market - label, 2), 9) AS regret FROM wide "
    "ORDER BY round(pow(p_form - label, 2) - pow(p_market - label, 2), 9) DESC, contest_id, subject_id LIMIT 10",
)
def _(spark, sf):
    wide = predictions(spark, sf)
    return selection.top_regrets(wide, "p_form", "p_market", k=10)


@check(
    "loo_mean",
    KEYS + "career_shrunk:f career_shrunk_others:f recent3_finish_pct_others:f",
    """SELECT contest_id, subject_id, career_shrunk,
  (sum(career_shrunk) OVER c - career_shrunk) / nullif(count(career_shrunk) OVER c - 1, 0) AS career_shrunk_others,
  (sum(recent3_finish_pct) OVER c - recent3_finish_pct) / nullif(count(recent3_finish_pct) OVER c - 1, 0) AS recent3_finish_pct_others
FROM engineered WINDOW c AS (PARTITION BY contest_id)""",
)
def _(spark, sf):
    rows = panel(spark, sf)
    rows = relative.engineer_features(rows, training_prior(rows))
    return relative.loo_mean(rows, ["career_shrunk", "recent3_finish_pct"])


REL = "rel_career:f rel_same_distance:f rel_same_course:f rel_recent3_finish:f rel_recent3_time:f"


@check(
    "relative_ability",
    KEYS + REL,
    "SELECT r.* FROM relative r JOIN cohort c ON c.contest_id = r.contest_id AND c.subject_id = r.subject_id",
)
def _(spark, sf):
    rows = panel(spark, sf)
    return relative.relative_ability(cohorts.select_cohort(rows, "turf"), rows, training_prior(rows))


@check(
    "feature_coverage",
    "feature:s source:s context_rows:i source_non_null:i output_non_null:i eligible_rows:i eligible_non_null:i eligible_coverage:f",
    """
WITH p(feature, source) AS (VALUES ('rel_career', 'career_shrunk'), ('rel_recent3_finish', 'recent3_finish_pct'), ('rel_recent3_time', 'recent3_rel_time'),
  ('rel_same_distance', 'same_distance_shrunk'), ('rel_same_course', 'same_course_shrunk')),
x AS (SELECT r.contest_id, r.subject_id, u.feature, u.s, u.o FROM relative r, LATERAL (VALUES ('rel_career', career_shrunk, rel_career),
  ('rel_recent3_finish', recent3_finish_pct, rel_recent3_finish), ('rel_recent3_time', recent3_rel_time, rel_recent3_time),
  ('rel_same_distance', same_distance_shrunk, rel_same_distance), ('rel_same_course', same_course_shrunk, rel_same_course)) u(feature, s, o)
  WHERE r.contest_id IN (SELECT contest_id FROM cohort)),
y AS (SELECT x.*, c.subject_id IS NOT NULL AS inside FROM x LEFT JOIN cohort c ON c.contest_id = x.contest_id AND c.subject_id = x.subject_id)
----
SELECT p.feature, p.source, count(*) AS context_rows, count(y.s) AS source_non_null, count(y.o) AS output_non_null,
  count(CASE WHEN inside THEN 1 END) AS eligible_rows, count(CASE WHEN inside THEN y.o END) AS eligible_non_null,
  count(CASE WHEN inside THEN y.o END) / count(CASE WHEN inside THEN 1 END) AS eligible_coverage
FROM y JOIN p ON p.feature = y.feature GROUP BY p.feature, p.source""",
)
def _(spark, sf):
    rows = panel(spark, sf)
    chosen = cohorts.select_cohort(rows, "turf")
    prior = training_prior(rows)
    context = relative.relative_ability(relative.full_context(rows, chosen), rows, prior)
    eligible = context.join(chosen.select("contest_id", "subject_id"), ["contest_id", "subject_id"], "left_semi")
    return relative.feature_coverage(context, eligible, [(source, out) for source, out, _ in relative.RELATIVE_RULES])


@check(
    "interactions",
    KEYS + "draw_x_front:f front_x_pressure:f rest_x_age:f",
    "SELECT *, draw_pct * (1 - recent4_early_pct) AS draw_x_front, (1 - recent4_early_pct) * front_share AS front_x_pressure, "
    "ln(1 + days_since_prev) * age AS rest_x_age FROM panel",
)
def _(spark, sf):
    return relative.interactions(panel(spark, sf))


@check(
    "block_features",
    KEYS + "turf_shrunk:f near_shrunk:f near_log_starts:f near_zero:f near_missing:f near_relative:f regime_relative:f "
    "course_distance_zero:f course_distance_relative:f rel_career:f",
    """
WITH d AS (SELECT r.*, b.same_surface_starts, b.same_surface_top3, near_starts, (near_top3 + 6 * q.m) / (near_starts + 6.0) AS near_shrunk,
  (regime_top3 + 6 * q.m) / (regime_starts + 6.0) AS regime_shrunk, course_distance_starts,
  (course_distance_top3 + 6 * q.m) / (course_distance_starts + 6.0) AS cd_shrunk, (b.same_surface_top3 + 6 * q.m) / (b.same_surface_starts + 6.0) AS own_turf
  FROM relative r JOIN blocks b ON b.contest_id = r.contest_id AND b.subject_id = r.subject_id, prior q WHERE r.surface = 'dirt')
----
SELECT * FROM (SELECT contest_id, subject_id, field_size, career_starts, own_turf AS turf_shrunk, near_shrunk, ln(1 + near_starts) AS near_log_starts,
  CASE WHEN near_starts = 0 THEN 1 ELSE 0 END AS near_zero, 0 AS near_missing, rel_career,
  near_shrunk - (sum(near_shrunk) OVER c - near_shrunk) / nullif(count(*) OVER c - 1, 0) AS near_relative,
  regime_shrunk - (sum(regime_shrunk) OVER c - regime_shrunk) / nullif(count(*) OVER c - 1, 0) AS regime_relative,
  CASE WHEN course_distance_starts = 0 THEN 1 ELSE 0 END AS course_distance_zero,
  cd_shrunk - (sum(cd_shrunk) OVER c - cd_shrunk) / nullif(count(*) OVER c - 1, 0) AS course_distance_relative
FROM d WINDOW c AS (PARTITION BY contest_id)) WHERE field_size >= 8 AND career_starts >= 3""",
)
def _(spark, sf):
    context = blocks_panel(spark, sf)
    chosen = cohorts.select_cohort(context, "dirt")
    return relative.block_features(chosen, context.filter("surface = 'dirt'"), training_prior(context), surface="dirt")
