"""Shared SQL for the DuckDB side: the contest fixture and what is derived from it.

Written directly over rows (row windows, pair joins), independent of how the Spark side
computes the same thing.
"""

from __future__ import annotations

CTES: dict[str, str] = {}

CTES["fx_o"] = """
SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS contest_id, o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
       CAST(o_orderdate AS DATE) AS d
FROM orders"""
CTES["fx_h"] = """
SELECT contest_id, min_by(d, o_orderkey) AS contest_date, min_by(o_orderstatus, o_orderkey) AS st,
       min_by(o_orderpriority, o_orderkey) AS contest_class, min_by(o_custkey, o_orderkey) AS ck
FROM fx_o GROUP BY contest_id"""
CTES["fx_r"] = """
SELECT fx_o.contest_id, l.l_partkey AS subject_id, l.*,
       row_number() OVER (PARTITION BY fx_o.contest_id, l.l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey,
         l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
FROM lineitem l JOIN fx_o ON l.l_orderkey = fx_o.o_orderkey"""
CTES["fx_e"] = """
SELECT contest_id, subject_id, row_number() OVER (PARTITION BY contest_id ORDER BY subject_id) AS entry_no,
       l_extendedprice AS price, l_quantity AS qty, l_tax AS tax, l_discount AS disc,
       CASE WHEN l_returnflag = 'N' AND l_discount >= 0.095 THEN 'scratched'
            WHEN l_returnflag = 'R' AND l_tax >= 0.075 THEN 'dnf' ELSE 'finished' END AS status
FROM fx_r WHERE rn = 1"""
CTES["entries"] = """
SELECT e.contest_id, h.contest_date, e.subject_id, e.entry_no, e.status,
  CASE h.st WHEN 'F' THEN 'turf' WHEN 'O' THEN 'dirt' ELSE 'synthetic' END AS surface,
  CAST(h.ck % 10 AS INT) AS venue, CAST(1000 + 200 * (h.ck % 9) AS INT) AS distance_m, h.contest_class,
  CASE WHEN h.ck % 20 = 0 THEN 'straight' WHEN h.ck % 2 = 0 THEN 'right' ELSE 'left' END AS turn_direction,
  p.p_brand AS grp, p.p_size AS age, 48 + CAST(round(e.tax * 100) AS INT) AS weight,
  count(*) OVER (PARTITION BY e.contest_id) AS declared_size,
  CAST(sum(CASE WHEN e.status <> 'scratched' THEN 1 ELSE 0 END) OVER (PARTITION BY e.contest_id) AS BIGINT) AS field_size,
  CASE WHEN e.status = 'finished' THEN row_number() OVER (PARTITION BY e.contest_id, e.status
       ORDER BY e.price DESC, e.subject_id) END AS finish_position,
  CASE WHEN e.status = 'finished' THEN round(60 + (105000 - e.price) / 1000, 1) END AS time_s,
  CASE WHEN e.status <> 'scratched' THEN row_number() OVER (PARTITION BY e.contest_id,
       CASE WHEN e.status = 'scratched' THEN 0 ELSE 1 END ORDER BY e.qty DESC, e.subject_id) END AS early_position,
  CASE WHEN e.disc < 0.005 AND e.tax < 0.005 THEN NULL ELSE 1.2 + e.qty END AS win_odds
FROM fx_e e JOIN fx_h h ON e.contest_id = h.contest_id JOIN part p ON p.p_partkey = e.subject_id"""
CTES["starters"] = """
SELECT *, CASE WHEN finish_position BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS label,
  (finish_position - 1) / CAST(nullif(field_size - 1, 0) AS DOUBLE) AS finish_pct,
  CASE WHEN early_position BETWEEN 1 AND field_size
       THEN (early_position - 1) / CAST(nullif(field_size - 1, 0) AS DOUBLE) END AS early_pct,
  CASE WHEN declared_size <= 1 THEN 0.0 ELSE (entry_no - 1) / CAST(declared_size - 1 AS DOUBLE) END AS draw_pct,
  CASE WHEN contest_class IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS is_open_plus,
  CASE WHEN contest_class = '1-URGENT' THEN 1 ELSE 0 END AS is_graded,
  date_diff('day', DATE '1970-01-01', contest_date) AS day
FROM entries WHERE status <> 'scratched'"""
CTES["timed"] = """
SELECT *, (time_s - winner_time) / CASE WHEN winner_time > 0 THEN winner_time END AS rel_time
FROM (SELECT *, min(CASE WHEN finish_position = 1 THEN time_s END) OVER (PARTITION BY contest_id) AS winner_time
      FROM starters)"""
# One start per subject and day.
CTES["reps"] = """
SELECT * FROM timed QUALIFY row_number() OVER (PARTITION BY subject_id, contest_date ORDER BY contest_id) = 1"""
# The last four starts before each day of a subject, of all starts of earlier days.
CTES["earlier"] = """
SELECT d.subject_id, d.contest_date, e.contest_date AS prev_date, e.distance_m, e.surface, e.weight, e.finish_pct, e.label,
  e.is_open_plus, e.is_graded, e.rel_time, e.early_pct,
  row_number() OVER (PARTITION BY d.subject_id, d.contest_date ORDER BY e.contest_date DESC, e.contest_id DESC) AS rn
FROM (SELECT DISTINCT subject_id, contest_date FROM starters) d
LEFT JOIN timed e ON e.subject_id = d.subject_id AND e.contest_date < d.contest_date
QUALIFY rn <= 4"""
CTES["rep_recent"] = """
SELECT subject_id, contest_date, max(CASE WHEN rn = 1 THEN prev_date END) AS prev_date,
  max(CASE WHEN rn = 1 THEN distance_m END) AS prev_distance_m, max(CASE WHEN rn = 1 THEN surface END) AS prev_surface,
  max(CASE WHEN rn = 1 THEN weight END) AS prev_weight,
  avg(CASE WHEN rn <= 3 THEN finish_pct END) AS recent3_finish_pct, sum(CASE WHEN rn <= 3 THEN label END) AS recent3_top3,
  sum(CASE WHEN rn <= 3 THEN is_open_plus END) AS recent3_open_plus, sum(CASE WHEN rn <= 3 THEN is_graded END) AS recent3_graded,
  avg(CASE WHEN rn <= 3 THEN rel_time END) AS recent3_rel_time, avg(early_pct) AS recent4_early_pct
FROM earlier GROUP BY subject_id, contest_date"""
CTES["rep_trend"] = """
SELECT subject_id, contest_date,
  lag(recent3_finish_pct) OVER o - recent3_finish_pct AS trend_finish,
  lag(recent3_rel_time) OVER o - recent3_rel_time AS trend_time,
  recent3_top3 - lag(recent3_top3) OVER o AS trend_top3,
  lag(recent4_early_pct) OVER o - recent4_early_pct AS trend_early
FROM rep_recent WINDOW o AS (PARTITION BY subject_id ORDER BY contest_date)"""
CTES["counted"] = """
SELECT contest_id, subject_id,
  count(*) OVER (PARTITION BY subject_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS career_starts,
  coalesce(sum(label) OVER (PARTITION BY subject_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS career_top3,
  coalesce(sum(CASE WHEN surface = 'turf' THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turf_starts,
  coalesce(sum(CASE WHEN surface = 'turf' THEN label ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turf_top3,
  count(*) OVER (PARTITION BY subject_id, distance_m, surface ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_distance_starts,
  coalesce(sum(label) OVER (PARTITION BY subject_id, distance_m, surface ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS same_distance_top3,
  count(*) OVER (PARTITION BY subject_id, venue, surface ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_course_starts,
  coalesce(sum(label) OVER (PARTITION BY subject_id, venue, surface ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS same_course_top3
FROM starters"""
CTES["panel"] = """
SELECT t.*, c.* EXCLUDE (contest_id, subject_id), r.* EXCLUDE (subject_id, contest_date),
  v.* EXCLUDE (subject_id, contest_date),
  date_diff('day', r.prev_date, t.contest_date) AS days_since_prev,
  t.distance_m - r.prev_distance_m AS distance_change,
  CASE WHEN r.prev_surface IS NOT NULL THEN CASE WHEN t.surface = r.prev_surface THEN 0 ELSE 1 END END AS surface_changed,
  t.weight - r.prev_weight AS weight_change,
  avg(CASE WHEN r.recent4_early_pct <= 0.25 THEN 1.0 WHEN r.recent4_early_pct IS NOT NULL THEN 0.0 END)
    OVER (PARTITION BY t.contest_id) AS front_share
FROM timed t
JOIN counted c ON c.contest_id = t.contest_id AND c.subject_id = t.subject_id
JOIN rep_recent r ON r.subject_id = t.subject_id AND r.contest_date = t.contest_date
JOIN rep_trend v ON v.subject_id = t.subject_id AND v.contest_date = t.contest_date"""
# Every pair of a start and an earlier start on the same surface, totalled per block.
CTES["blocks"] = """
SELECT contest_id, subject_id,
  count(b_label) AS same_surface_starts, coalesce(sum(b_label), 0) AS same_surface_top3,
  count(CASE WHEN near THEN 1 END) AS near_starts, coalesce(sum(CASE WHEN near THEN b_label END), 0) AS near_top3,
  count(CASE WHEN regime THEN 1 END) AS regime_starts, coalesce(sum(CASE WHEN regime THEN b_label END), 0) AS regime_top3,
  count(CASE WHEN course THEN 1 END) AS course_distance_starts,
  coalesce(sum(CASE WHEN course THEN b_label END), 0) AS course_distance_top3
FROM (
  SELECT a.contest_id, a.subject_id, b.label AS b_label,
    abs(a.distance_m - b.distance_m) <= 200 AS near,
    (CASE WHEN a.distance_m <= 1400 THEN 0 WHEN a.distance_m <= 2000 THEN 1 WHEN a.distance_m <= 2600 THEN 2 ELSE 3 END)
      = (CASE WHEN b.distance_m <= 1400 THEN 0 WHEN b.distance_m <= 2000 THEN 1 WHEN b.distance_m <= 2600 THEN 2 ELSE 3 END) AS regime,
    a.distance_m = b.distance_m AND a.venue = b.venue AS course
  FROM starters a LEFT JOIN starters b
    ON a.subject_id = b.subject_id AND a.surface = b.surface AND b.contest_date < a.contest_date)
GROUP BY contest_id, subject_id"""

CTES["reasons"] = """
SELECT contest_id, starters, CASE WHEN starters = 0 THEN 'no_starters' WHEN bad > 0 THEN 'invalid_or_duplicate_number'
  WHEN starters < 4 THEN 'field_too_small' WHEN unpriced > 0 THEN 'missing_or_invalid_odds' ELSE 'complete' END AS reason
FROM (SELECT contest_id, count(CASE WHEN status <> 'scratched' THEN 1 END) AS starters,
        count(CASE WHEN status <> 'scratched' AND (entry_no IS NULL OR entry_no <= 0) THEN 1 END)
        + count(CASE WHEN status <> 'scratched' THEN entry_no END)
        - count(DISTINCT CASE WHEN status <> 'scratched' THEN entry_no END) AS bad,
        count(CASE WHEN status <> 'scratched' AND NOT coalesce(win_odds > 1, false) THEN 1 END) AS unpriced
      FROM entries GROUP BY contest_id)"""
CTES["win_prob"] = """
SELECT s.contest_id, s.subject_id, s.entry_no, s.field_size, (1 / win_odds) / sum(1 / win_odds) OVER (PARTITION BY s.contest_id) AS w,
  sum(1 / win_odds) OVER (PARTITION BY s.contest_id) AS overround
FROM starters s JOIN reasons r ON r.contest_id = s.contest_id WHERE r.reason = 'complete'"""
# Every ordered pair of starters, for the second and third place.
CTES["pair_terms"] = """
SELECT a.contest_id, a.subject_id,
  sum(b.w / (1 - b.w)) AS others, sum(a.w * b.w * (1 / (1 - a.w) + 1 / (1 - b.w)) / (1 - a.w - b.w)) AS v
FROM win_prob a JOIN win_prob b ON a.contest_id = b.contest_id AND a.subject_id <> b.subject_id
GROUP BY a.contest_id, a.subject_id"""
CTES["market"] = """
SELECT p.*, w AS p_first, w * others AS p_second,
  w * (sum(v) OVER (PARTITION BY p.contest_id) / 2 - v) AS p_third,
  w + w * others + w * (sum(v) OVER (PARTITION BY p.contest_id) / 2 - v) AS p_top
FROM win_prob p JOIN pair_terms t ON t.contest_id = p.contest_id AND t.subject_id = p.subject_id"""
CTES["prior"] = "SELECT avg(label) AS m FROM starters WHERE year(contest_date) BETWEEN 1995 AND 1999"
CTES["banded"] = """
SELECT p.*, CAST(year(contest_date) AS VARCHAR) AS year,
  CASE WHEN field_size IS NULL THEN 'UNKNOWN' WHEN field_size <= 11 THEN '<=11' WHEN field_size <= 14 THEN '12-14'
       WHEN field_size <= 16 THEN '15-16' ELSE '17+' END AS field_size_band,
  CASE WHEN days_since_prev IS NULL THEN 'UNKNOWN' WHEN days_since_prev <= 21 THEN '<=21' WHEN days_since_prev <= 35 THEN '22-35'
       WHEN days_since_prev <= 56 THEN '36-56' WHEN days_since_prev <= 90 THEN '57-90' ELSE '91+' END AS rest_band,
  CASE WHEN career_starts <= 5 THEN '3-5' WHEN career_starts <= 10 THEN '6-10' WHEN career_starts <= 20 THEN '11-20' ELSE '21+' END AS starts_band
FROM panel p"""
CTES["form_raw"] = """
SELECT b.*, m.p_top AS p_market, least(greatest(3.0 / b.field_size, 1e-12), 1 - 1e-12) AS p_uniform,
  (career_top3 + 6 * (SELECT m FROM prior)) / (career_starts + 6.0) AS form,
  ln(((career_top3 + 6 * (SELECT m FROM prior)) / (career_starts + 6.0)) /
     (1 - (career_top3 + 6 * (SELECT m FROM prior)) / (career_starts + 6.0))) AS x
FROM banded b JOIN market m ON m.contest_id = b.contest_id AND m.subject_id = b.subject_id"""
CTES["form_shift"] = """/*recursive*/
SELECT contest_id, 0 AS i, CAST(-40.0 AS DOUBLE) AS lo, CAST(40.0 AS DOUBLE) AS hi, least(3.0, count(*) - 1e-9) AS goal
FROM form_raw GROUP BY contest_id
UNION ALL
SELECT f.contest_id, f.i + 1,
  CASE WHEN sum(1 / (1 + exp(-(r.x + (f.lo + f.hi) / 2)))) < f.goal THEN (f.lo + f.hi) / 2 ELSE f.lo END,
  CASE WHEN sum(1 / (1 + exp(-(r.x + (f.lo + f.hi) / 2)))) < f.goal THEN f.hi ELSE (f.lo + f.hi) / 2 END, f.goal
FROM form_shift f JOIN form_raw r ON r.contest_id = f.contest_id WHERE f.i < 60
GROUP BY f.contest_id, f.i, f.lo, f.hi, f.goal"""
CTES["wide"] = """
SELECT r.* EXCLUDE (x, form), 1 / (1 + exp(-(r.x + (s.lo + s.hi) / 2))) AS p_form
FROM form_raw r JOIN form_shift s ON s.contest_id = r.contest_id AND s.i = 60"""
CTES["preds"] = """
SELECT 'market' AS candidate, p_market AS p, * FROM wide UNION ALL
SELECT 'uniform' AS candidate, p_uniform AS p, * FROM wide UNION ALL
SELECT 'form' AS candidate, p_form AS p, * FROM wide"""
CTES["entry_loss"] = """
SELECT *, (p - label) * (p - label) AS brier,
  -(label * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - label) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12))) AS log_loss
FROM preds"""
CTES["losses"] = """
SELECT candidate, contest_id, min(contest_date) AS block, count(*) AS rows, avg(brier) AS brier, avg(log_loss) AS log_loss
FROM entry_loss GROUP BY candidate, contest_id"""
CTES["scores"] = """
SELECT candidate, avg(brier) AS macro_brier, avg(log_loss) AS macro_log_loss,
  sum(brier * rows) / sum(rows) AS micro_brier, sum(log_loss * rows) / sum(rows) AS micro_log_loss,
  count(*) AS contests, sum(rows) AS rows
FROM losses GROUP BY candidate"""
CTES["best"] = "SELECT candidate AS best FROM scores ORDER BY macro_brier, macro_log_loss, candidate LIMIT 1"
CTES["diffs"] = """
SELECT l.candidate, l.block, l.brier - r.brier AS db, l.log_loss - r.log_loss AS dl
FROM losses l JOIN losses r ON r.contest_id = l.contest_id WHERE r.candidate = (SELECT best FROM best)"""
CTES["deltas"] = """
SELECT m.candidate, m.n AS contests, m.mb AS mean_brier_delta, m.ml AS mean_log_loss_delta, count(*) AS clusters,
  sqrt(count(*) / (count(*) - 1.0) * sum(pow(g.sb, 2)) / pow(m.n, 2)) AS se_brier_delta,
  sqrt(count(*) / (count(*) - 1.0) * sum(pow(g.sl, 2)) / pow(m.n, 2)) AS se_log_loss_delta
FROM (SELECT candidate, count(*) AS n, avg(db) AS mb, avg(dl) AS ml FROM diffs GROUP BY candidate) m
JOIN (SELECT d.candidate, d.block, sum(d.db - a.mb) AS sb, sum(d.dl - a.ml) AS sl FROM diffs d
      JOIN (SELECT candidate, avg(db) AS mb, avg(dl) AS ml FROM diffs GROUP BY candidate) a ON a.candidate = d.candidate
      GROUP BY d.candidate, d.block) g ON g.candidate = m.candidate
GROUP BY m.candidate, m.n, m.mb, m.ml"""
CTES["engineered"] = """
SELECT p.*, ln(1 + days_since_prev) AS log_days_since_prev,
  (career_top3 + 6 * q.m) / (career_starts + 6.0) AS career_shrunk, (turf_top3 + 6 * q.m) / (turf_starts + 6.0) AS turf_shrunk,
  (same_distance_top3 + 6 * q.m) / (same_distance_starts + 6.0) AS same_distance_shrunk,
  (same_course_top3 + 6 * q.m) / (same_course_starts + 6.0) AS same_course_shrunk,
  ln(1 + career_starts) AS log_career_starts
FROM panel p, prior q"""
CTES["relative"] = """
SELECT e.*,
  career_shrunk - (sum(career_shrunk) OVER c - career_shrunk) / nullif(count(career_shrunk) OVER c - 1, 0) AS rel_career,
  same_distance_shrunk - (sum(same_distance_shrunk) OVER c - same_distance_shrunk) / nullif(count(same_distance_shrunk) OVER c - 1, 0) AS rel_same_distance,
  same_course_shrunk - (sum(same_course_shrunk) OVER c - same_course_shrunk) / nullif(count(same_course_shrunk) OVER c - 1, 0) AS rel_same_course,
  (sum(recent3_finish_pct) OVER c - recent3_finish_pct) / nullif(count(recent3_finish_pct) OVER c - 1, 0) - recent3_finish_pct AS rel_recent3_finish,
  (sum(recent3_rel_time) OVER c - recent3_rel_time) / nullif(count(recent3_rel_time) OVER c - 1, 0) - recent3_rel_time AS rel_recent3_time
FROM engineered e WINDOW c AS (PARTITION BY contest_id)"""
CTES["cohort"] = """
SELECT * FROM panel WHERE surface = 'turf' AND field_size >= 8 AND career_starts >= 3"""
