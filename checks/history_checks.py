"""Window operators over subject histories."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.spec import check
from fieldform.operators import carried, history
from fieldform.plans.panels import panel
from fieldform.sources.testtables import light_starters

KEYS = "contest_id:i subject_id:i "
COUNTS = (
    "career_starts:i career_top3:i turf_starts:i turf_top3:i same_distance_starts:i same_distance_top3:i "
    "same_course_starts:i same_course_top3:i "
)
DELTAS = "prev_date:d days_since_prev:f distance_change:f surface_changed:f weight_change:f "
RECENT = (
    "recent3_finish_pct:f recent3_top3:f recent3_open_plus:f recent3_graded:f recent3_rel_time:f recent4_early_pct:f "
)
TREND = "trend_finish:f trend_time:f trend_top3:f trend_early:f "


@check("prior_counts", KEYS + COUNTS, "SELECT * FROM counted")
def _(spark, sf):
    return history.prior_counts(light_starters(spark, sf))


@check("prev_deltas", KEYS + DELTAS, "SELECT * FROM panel")
def _(spark, sf):
    return history.prev_deltas(light_starters(spark, sf))


@check("recent_form", KEYS + RECENT, "SELECT * FROM starters JOIN rep_recent USING (subject_id, contest_date)")
def _(spark, sf):
    return history.recent_form(light_starters(spark, sf))


@check("recent_trend", KEYS + TREND, "SELECT * FROM starters JOIN rep_trend USING (subject_id, contest_date)")
def _(spark, sf):
    return history.recent_trend(light_starters(spark, sf))


@check("winner_relative", KEYS + "winner_time:f rel_time:f", "SELECT * FROM timed")
def _(spark, sf):
    return history.winner_relative(light_starters(spark, sf))


@check("front_share", KEYS + "front_share:f", "SELECT * FROM panel")
def _(spark, sf):
    return history.front_share(history.recent_form(light_starters(spark, sf)))


@check(
    "build_panel",
    KEYS + "contest_date:d label:i draw_pct:f winner_time:f rel_time:f " + COUNTS + DELTAS + RECENT + TREND + "front_share:f",
    "SELECT * FROM panel",
)
def _(spark, sf):
    return history.build_panel(light_starters(spark, sf).drop("grp", "age"))


@check(
    "strict_prior_blocks",
    KEYS + "same_surface_starts:i same_surface_top3:i near_starts:i near_top3:i regime_starts:i regime_top3:i "
    "course_distance_starts:i course_distance_top3:i",
    "SELECT * FROM blocks",
)
def _(spark, sf):
    return history.strict_prior_blocks(light_starters(spark, sf))


# Targets: every contest of the last two years, scored from the history before each date.
ASOF_TARGET = "2000-01-01"


@check(
    "asof_context",
    KEYS + COUNTS + "prev_date:d days_since_prev:f distance_change:f weight_change:f "
    "last_finish_pct:f recent3_finish_pct:f recent3_top3:f recent3_rel_time:f recent4_early_pct:f front_share:f "
    "same_surface_starts:i near_starts:i near_top3:i",
    """
WITH h AS (SELECT * FROM timed WHERE contest_date < DATE '2000-01-01'),
t AS (SELECT * FROM starters WHERE contest_date >= DATE '2000-01-01'),
n AS (SELECT t.contest_id, t.subject_id, count(h.label) AS career_starts, coalesce(sum(h.label), 0) AS career_top3,
  count(CASE WHEN h.surface = 'turf' THEN 1 END) AS turf_starts,
  coalesce(sum(CASE WHEN h.surface = 'turf' THEN h.label END), 0) AS turf_top3,
  count(CASE WHEN h.surface = t.surface AND h.distance_m = t.distance_m THEN 1 END) AS same_distance_starts,
  coalesce(sum(CASE WHEN h.surface = t.surface AND h.distance_m = t.distance_m THEN h.label END), 0) AS same_distance_top3,
  count(CASE WHEN h.surface = t.surface AND h.venue = t.venue THEN 1 END) AS same_course_starts,
  coalesce(sum(CASE WHEN h.surface = t.surface AND h.venue = t.venue THEN h.label END), 0) AS same_course_top3,
  count(CASE WHEN h.surface = t.surface THEN 1 END) AS same_surface_starts,
  count(CASE WHEN h.surface = t.surface AND abs(h.distance_m - t.distance_m) <= 200 THEN 1 END) AS near_starts,
  coalesce(sum(CASE WHEN h.surface = t.surface AND abs(h.distance_m - t.distance_m) <= 200 THEN h.label END), 0) AS near_top3
  FROM t LEFT JOIN h ON h.subject_id = t.subject_id GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY contest_date DESC, contest_id DESC) AS rn FROM h),
l AS (SELECT subject_id, max(CASE WHEN rn = 1 THEN contest_date END) AS prev_date,
  max(CASE WHEN rn = 1 THEN distance_m END) AS pd, max(CASE WHEN rn = 1 THEN weight END) AS pw,
  max(CASE WHEN rn = 1 THEN finish_pct END) AS last_finish_pct,
  avg(CASE WHEN rn <= 3 THEN finish_pct END) AS recent3_finish_pct, sum(CASE WHEN rn <= 3 THEN label END) AS recent3_top3,
  avg(CASE WHEN rn <= 3 THEN rel_time END) AS recent3_rel_time,
  avg(CASE WHEN rn <= 4 THEN early_pct END) AS recent4_early_pct FROM k GROUP BY subject_id)
----
SELECT n.*, l.*, date_diff('day', l.prev_date, t.contest_date) AS days_since_prev, t.distance_m - l.pd AS distance_change,
  t.weight - l.pw AS weight_change,
  avg(CASE WHEN l.recent4_early_pct <= 0.25 THEN 1.0 WHEN l.recent4_early_pct IS NOT NULL THEN 0.0 END)
    OVER (PARTITION BY t.contest_id) AS front_share
FROM t JOIN n ON n.contest_id = t.contest_id AND n.subject_id = t.subject_id
LEFT JOIN l ON l.subject_id = t.subject_id""",
)
def _(spark, sf):
    rows = light_starters(spark, sf)
    past = rows.filter(F.col("contest_date") < ASOF_TARGET)
    roster = rows.filter(F.col("contest_date") >= ASOF_TARGET).drop(
        "finish_position", "time_s", "early_position", "label", "finish_pct", "early_pct"
    )
    last = history.last_k_per_subject(past, 1)
    out = history.asof_context(past, roster)
    return out.join(last.select("subject_id", F.col("finish_pct").alias("last_finish_pct")), "subject_id", "left")


@check(
    "last_k_per_subject",
    KEYS + "contest_date:d start_no:i",
    "SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY contest_date DESC, contest_id DESC) AS start_no "
    "FROM starters QUALIFY start_no <= 4",
)
def _(spark, sf):
    return history.last_k_per_subject(light_starters(spark, sf), 4)


@check(
    "strict_history_check",
    "rule:s violations:i",
    """
SELECT 'same_day' AS rule, count(*) AS violations FROM (SELECT 1 FROM starters GROUP BY subject_id, contest_date HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM starters GROUP BY contest_id, subject_id HAVING count(*) > 1)
UNION ALL SELECT 'not_before', count(*) FROM panel WHERE prev_date >= contest_date""",
)
def _(spark, sf):
    return history.strict_history_check(panel(spark, sf))


@check(
    "asof_slice",
    "rows:i rows_not_before:i age_days:f verdict:s",
    """
SELECT count(CASE WHEN contest_date < DATE '2001-03-01' THEN 1 END) AS rows,
  count(CASE WHEN contest_date >= DATE '2001-03-01' THEN 1 END) AS rows_not_before,
  date_diff('day', max(CASE WHEN contest_date < DATE '2001-03-01' THEN contest_date END), DATE '2001-03-01') AS age_days,
  CASE WHEN count(CASE WHEN contest_date < DATE '2001-03-01' THEN 1 END) = 0 THEN 'empty'
       WHEN date_diff('day', max(CASE WHEN contest_date < DATE '2001-03-01' THEN contest_date END), DATE '2001-03-01') > 7
       THEN 'stale' ELSE 'usable' END AS verdict
FROM starters""",
)
def _(spark, sf):
    return history.asof_slice(light_starters(spark, sf), "2001-03-01", 7, "2001-02-28")[1]


PROBED = tuple(c.split(":")[0] for c in (COUNTS + DELTAS + RECENT + TREND + "front_share:f").split())


@check(
    "leakage_probe",
    "predictor:s rows:i changed:i",
    f"SELECT unnest({list(PROBED)}) AS predictor, (SELECT count(*) FROM starters WHERE contest_date = "
    "(SELECT max(contest_date) FROM starters)) AS rows, 0 AS changed",
)
def _(spark, sf):
    rows = light_starters(spark, sf).drop("grp", "age")
    last = rows.agg(F.max("contest_date")).scalar()
    # Every outcome of the target rows changes, also those derived from others.
    place = F.col("field_size") - F.coalesce("finish_position", F.lit(0)) + 1
    outcomes = {
        "finish_position": place.cast("int"),
        "label": 1 - F.col("label"),
        "time_s": F.coalesce("time_s", F.lit(60.0)) + F.col("entry_no"),
        "early_position": (F.col("field_size") - F.coalesce("early_position", F.lit(0)) + 1).cast("int"),
        "early_pct": 1 - F.coalesce("early_pct", F.lit(0.25)),
        "finish_pct": (place - 1) / F.col("field_size"),
        "is_open_plus": 1 - F.col("is_open_plus"),
        "is_graded": 1 - F.col("is_graded"),
    }
    return history.leakage_probe(rows, history.build_panel, F.col("contest_date") == last, PROBED, outcomes)


@check(
    "carried_panel",
    KEYS + COUNTS + DELTAS + RECENT + TREND + "front_share:f",
    "SELECT * FROM panel WHERE contest_date > DATE '2000-03-31'",
)
def _(spark, sf):
    """The state through 1999, moved on by a quarter, and the panel of everything after it."""
    rows = light_starters(spark, sf)
    state = carried.extend(carried.carry(rows, dt.date(1999, 12, 31)), rows, dt.date(2000, 3, 31))
    return carried.carried_panel(state, rows.filter("contest_date > DATE '2000-03-31'"))
