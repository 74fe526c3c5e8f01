"""Contracts, cohorts, joins, reconciliation and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.spec import check
from fieldform import contracts
from fieldform.functions import contest as fc
from fieldform.functions.probability import field_size_baseline
from fieldform.operators import cohorts, history, joins, locks, metrics, quality, quantiles, ranking, relative, selection
from fieldform.plans.panels import panel
from fieldform.plans.predictions import SPLITS, predictions
from fieldform.sources.fingerprint import row_fingerprint
from fieldform.sources.testtables import entries, light_starters, table

KEYS = "contest_id:i subject_id:i "


# --- contracts and columns ------------------------------------------------------------


@check(
    "forbid_columns",
    "column_name:s non_null:i verdict:s",
    """SELECT * FROM (SELECT unnest(['contest_id', 'subject_id', 'time_s', 'win_odds']) AS column_name,
  unnest([count(contest_id), count(subject_id), count(time_s), count(win_odds)]) AS non_null,
  unnest(['required', 'required', 'extra', 'forbidden']) AS verdict FROM entries)""",
)
def _(spark, sf):
    few = entries(spark, sf).select("contest_id", "subject_id", "time_s", "win_odds")
    return contracts.column_report(few, ["contest_id", "subject_id"])


@check("allowlist_export", KEYS + "contest_date:d label:i career_starts:i", "SELECT * FROM panel")
def _(spark, sf):
    out = contracts.allowlist_export(panel(spark, sf), ["contest_id", "subject_id", "contest_date", "label", "career_starts"])
    return contracts.forbid_columns(out)


@check(
    "position_pct",
    KEYS + "finish_pct:f early_pct:f draw_pct:f pace:s",
    """SELECT *, CASE WHEN early_pct <= 0.2 THEN 'front' WHEN early_pct <= 0.45 THEN 'forward_mid' WHEN early_pct <= 0.7 THEN 'mid_rear'
  WHEN early_pct <= 1 THEN 'deep_rear' END AS pace FROM starters""",
)
def _(spark, sf):
    return light_starters(spark, sf).withColumn("pace", fc.pace_label("early_pct"))


@check(
    "distance_regime",
    "distance_m:i regime:i rows:i",
    "SELECT distance_m, CASE WHEN distance_m <= 1400 THEN 0 WHEN distance_m <= 2000 THEN 1 WHEN distance_m <= 2600 THEN 2 ELSE 3 END AS regime, "
    "count(*) AS rows FROM entries GROUP BY 1, 2",
)
def _(spark, sf):
    rows = entries(spark, sf).withColumn("regime", fc.distance_regime("distance_m"))
    return rows.groupBy("distance_m", "regime").agg(F.count("*").alias("rows"))


@check(
    "temporal_split",
    "split:s rows:i",
    "SELECT CASE WHEN year(contest_date) BETWEEN 1995 AND 1996 THEN 'warmup' WHEN year(contest_date) BETWEEN 1997 AND 1999 THEN 'train' "
    "WHEN year(contest_date) = 2000 THEN 'validation' WHEN year(contest_date) = 2001 THEN 'test' WHEN year(contest_date) >= 2002 THEN 'future' "
    "ELSE 'outside' END AS split, count(*) AS rows FROM starters GROUP BY 1",
)
def _(spark, sf):
    return cohorts.with_split(light_starters(spark, sf), SPLITS).groupBy("split").agg(F.count("*").alias("rows"))


@check("diagnostic_bands", KEYS + "year:s field_size_band:s rest_band:s starts_band:s", "SELECT * FROM banded")
def _(spark, sf):
    return metrics.diagnostic_bands(panel(spark, sf))


@check(
    "select_cohort",
    KEYS + "distance_m:i",
    "SELECT * FROM panel WHERE surface = 'turf' AND field_size >= 8 AND career_starts >= 3 AND distance_m BETWEEN 1200 AND 2000 "
    "AND turn_direction <> 'straight'",
)
def _(spark, sf):
    return cohorts.select_cohort(panel(spark, sf), "turf", lo=1200, hi=2000, exclude_straight=True)


@check(
    "course_mask",
    "straight:i rows:i contests:i",
    "SELECT CAST(lower(turn_direction) LIKE '%straight%' AS INT) AS straight, count(*) AS rows, count(DISTINCT contest_id) AS contests "
    "FROM entries GROUP BY 1",
)
def _(spark, sf):
    rows = entries(spark, sf).withColumn("straight", fc.course_mask("turn_direction").cast("int"))
    return rows.groupBy("straight").agg(F.count("*").alias("rows"), F.countDistinct("contest_id").alias("contests"))


ROUTES = [
    ("turf", 1000, 1400, "turf-short", False), ("turf", 1401, 2000, "turf-mid", False), ("turf", 1200, 1200, "turf-1200", True),
    ("dirt", 1000, 1800, "dirt-short", False), ("dirt", 1801, 2600, "dirt-long", False),
]


def routing_table(spark):
    return spark.createDataFrame(ROUTES, "surface string, lo int, hi int, model_id string, is_override boolean")


@check(
    "assign_route",
    "contest_id:i model_id:s",
    """
WITH r(surface, lo, hi, model_id) AS (VALUES ('turf', 1000, 1400, 'turf-short'), ('turf', 1401, 2000, 'turf-mid'),
  ('dirt', 1000, 1800, 'dirt-short'), ('dirt', 1801, 2600, 'dirt-long')),
c AS (SELECT DISTINCT contest_id, surface, distance_m, field_size, turn_direction FROM entries)
----
SELECT c.contest_id, CASE WHEN c.field_size < 8 OR c.turn_direction = 'straight' THEN NULL
  WHEN c.surface = 'turf' AND c.distance_m = 1200 THEN 'turf-1200' ELSE r.model_id END AS model_id
FROM c LEFT JOIN r ON r.surface = c.surface AND c.distance_m BETWEEN r.lo AND r.hi""",
)
def _(spark, sf):
    heads = entries(spark, sf).select("contest_id", "surface", "distance_m", "field_size", "turn_direction").distinct()
    return cohorts.assign_route(heads, routing_table(spark))


@check(
    "validate_roster",
    "rule:s contests:i violations:i",
    """SELECT 'field_size_wrong' AS rule, count(*) AS contests, count(*) AS violations
FROM (SELECT 1 FROM entries GROUP BY contest_id HAVING count(*) <> max(field_size))""",
)
def _(spark, sf):
    # The declared roster still counts scratched entries, so exactly the contests with a scratch fail.
    roster = entries(spark, sf).drop("win_odds", *contracts.OUTCOME_COLUMNS)
    found = quality.validate_roster(roster)
    return found.groupBy("rule").agg(F.count("*").alias("contests"), F.sum("violations").alias("violations"))


# --- joins ----------------------------------------------------------------------------


@check(
    "checked_join",
    KEYS + "career_starts:i p_market:f",
    "SELECT p.contest_id, p.subject_id, p.career_starts, m.p_top AS p_market FROM panel p LEFT JOIN market m "
    "ON m.contest_id = p.contest_id AND m.subject_id = p.subject_id",
)
def _(spark, sf):
    left = panel(spark, sf).select("contest_id", "subject_id", "career_starts")
    return joins.checked_join(left, predictions(spark, sf).select("contest_id", "subject_id", "p_market"), ["contest_id", "subject_id"])


@check(
    "reconcile_outer",
    "presence:s rows:i",
    """SELECT presence, count(*) AS rows FROM (SELECT CASE WHEN a.subject_id IS NOT NULL AND b.subject_id IS NOT NULL THEN 'both'
  WHEN a.subject_id IS NOT NULL THEN 'left' ELSE 'right' END AS presence
FROM (SELECT * FROM entries WHERE status <> 'dnf') a FULL JOIN (SELECT * FROM entries WHERE status <> 'scratched') b
ON a.contest_id = b.contest_id AND a.subject_id = b.subject_id) GROUP BY presence""",
)
def _(spark, sf):
    rows = entries(spark, sf).select("contest_id", "subject_id", "status")
    left = rows.filter("status <> 'dnf'").drop("status")
    right = rows.filter("status <> 'scratched'").drop("status")
    out = joins.reconcile_outer(left, right, ["contest_id", "subject_id"])
    return out.groupBy("presence").agg(F.count("*").alias("rows"))


@check(
    "full_context",
    KEYS + "field_size:i",
    "SELECT s.contest_id, s.subject_id, s.field_size FROM starters s JOIN (SELECT DISTINCT contest_id FROM cohort) c ON c.contest_id = s.contest_id",
)
def _(spark, sf):
    rows = panel(spark, sf)
    return relative.full_context(rows, cohorts.select_cohort(rows, "turf"))


@check(
    "complete_contests",
    KEYS + "field_size:i",
    "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY contest_id) AS n FROM panel WHERE career_starts >= 3) WHERE n = field_size",
)
def _(spark, sf):
    return cohorts.complete_contests(panel(spark, sf).filter("career_starts >= 3"))


@check(
    "reconcile_keys",
    "year:i expected:i actual:i missing:i unexpected:i",
    """
WITH e AS (SELECT DISTINCT contest_id, year(contest_date) AS year FROM entries WHERE venue <> 3),
a AS (SELECT DISTINCT contest_id, year(contest_date) AS year FROM entries WHERE distance_m <> 1400)
----
SELECT coalesce(e.year, a.year) AS year, count(e.year) AS expected, count(a.year) AS actual,
  count(CASE WHEN a.year IS NULL THEN 1 END) AS missing, count(CASE WHEN e.year IS NULL THEN 1 END) AS unexpected
FROM e FULL JOIN a ON a.contest_id = e.contest_id GROUP BY 1""",
)
def _(spark, sf):
    rows = entries(spark, sf).withColumn("year", F.year("contest_date"))
    return joins.reconcile_keys(rows.filter("venue <> 3"), rows.filter("distance_m <> 1400"), ["contest_id", "year"], ["year"])


@check(
    "disjoint_check",
    "overlap:i",
    "SELECT count(DISTINCT contest_id) AS overlap FROM entries WHERE contest_date = DATE '1999-12-31' OR contest_date = DATE '2000-01-01'",
)
def _(spark, sf):
    rows = entries(spark, sf)
    return joins.disjoint_check(
        rows.filter("contest_date <= DATE '2000-01-01'"), rows.filter("contest_date >= DATE '1999-12-31'"), "contest_id"
    )


# The roster view: scratched entries and one in 97 others withdrawn under another name.
ROSTER = """
WITH base AS (SELECT contest_id, entry_no, subject_id, 'S' || subject_id AS name, status FROM entries),
ro AS (SELECT contest_id, entry_no, subject_id, name, CASE WHEN status = 'scratched' THEN 'scratched'
  WHEN subject_id % 97 = 0 THEN 'excluded' ELSE 'active' END AS entry_status FROM base WHERE subject_id % 89 <> 0),
re AS (SELECT contest_id, entry_no, subject_id, name, status AS finish_status, status <> 'scratched' AS is_starter FROM base
  WHERE status <> 'scratched' OR subject_id % 2 = 0),
x AS (SELECT coalesce(ro.contest_id, re.contest_id) AS contest_id, entry_status, finish_status, is_starter,
  ro.contest_id IS NULL AS alien, re.contest_id IS NULL AS absent
  FROM ro FULL JOIN re ON ro.contest_id = re.contest_id AND ro.entry_no = re.entry_no AND ro.subject_id = re.subject_id AND ro.name = re.name),
v AS (SELECT *, CASE WHEN alien THEN 'not_in_roster' WHEN absent AND entry_status = 'active' THEN 'active_entry_without_result'
  WHEN absent THEN NULL WHEN finish_status = 'scratched' AND entry_status = 'excluded' THEN 'kinds_of_withdrawal_differ'
  WHEN finish_status = 'scratched' THEN NULL WHEN entry_status IN ('scratched', 'excluded') THEN 'starter_withdrawn_in_roster' END AS violation FROM x)
----
"""


def two_views(spark, sf):
    base = entries(spark, sf).withColumn("name", F.concat(F.lit("S"), "subject_id"))
    s = F.col("subject_id")
    roster = base.filter(s % 89 != 0).withColumn(
        "entry_status",
        F.when(F.col("status") == "scratched", "scratched").when(s % 97 == 0, "excluded").otherwise("active"),
    )
    results = base.filter((F.col("status") != "scratched") | (s % 2 == 0)).select(
        "contest_id", "entry_no", "subject_id", "name", F.col("status").alias("finish_status"),
        (F.col("status") != "scratched").alias("is_starter"),
    )
    return joins.verify_two_views(results, roster)


@check("verify_two_views", "violation:s rows:i", ROSTER + "SELECT violation, count(*) AS rows FROM v WHERE violation IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return two_views(spark, sf)[0].groupBy("violation").agg(F.count("*").alias("rows"))


@check(
    "verify_two_views_counts",
    "contest_id:i declared_entries:i actual_starters:i scratched:i excluded:i dnf:i violations:i",
    ROSTER + """SELECT contest_id, count(CASE WHEN NOT alien THEN 1 END) AS declared_entries, count(CASE WHEN is_starter THEN 1 END) AS actual_starters,
  count(CASE WHEN coalesce(finish_status, entry_status) = 'scratched' THEN 1 END) AS scratched,
  count(CASE WHEN coalesce(finish_status, entry_status) = 'excluded' THEN 1 END) AS excluded,
  count(CASE WHEN finish_status = 'dnf' THEN 1 END) AS dnf, count(violation) AS violations FROM v GROUP BY contest_id""",
)
def _(spark, sf):
    return two_views(spark, sf)[1]


@check(
    "table_diff",
    "column_name:s rows:i null_mismatches:i max_abs_error:f value_mismatches:i verdict:s",
    """
WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey % 50 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  o_totalprice + CASE WHEN o_orderkey % 11 = 0 THEN 0.25 ELSE 0 END AS o_totalprice,
  CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority,
  CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate + INTERVAL 90 SECOND ELSE o_orderdate END AS o_orderdate FROM orders WHERE o_orderkey % 60 <> 0),
j AS (SELECT a.o_orderkey AS ak, b.o_orderkey AS bk, a.o_custkey AS c1, b.o_custkey AS c2, a.o_totalprice AS t1, b.o_totalprice AS t2,
  a.o_orderstatus AS s1, b.o_orderstatus AS s2, a.o_orderpriority AS p1, b.o_orderpriority AS p2, a.o_orderdate AS d1, b.o_orderdate AS d2 FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey),
m AS (SELECT * FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL),
n AS (SELECT count(*) AS n FROM m)
----
SELECT '<keys>' AS column_name, n.n AS rows, (SELECT count(*) FROM j WHERE ak IS NULL OR bk IS NULL) AS null_mismatches, NULL AS max_abs_error,
  0 AS value_mismatches, 'different' AS verdict FROM n
UNION ALL SELECT 'o_custkey', n.n, (SELECT count(*) FROM m WHERE (c1 IS NULL) <> (c2 IS NULL)), (SELECT max(abs(c1 - c2)) FROM m), 0, 'different' FROM n
UNION ALL SELECT 'o_totalprice', n.n, 0, (SELECT max(abs(t1 - t2)) FROM m), (SELECT count(*) FROM m WHERE abs(t1 - t2) > 1e-10), 'allowed' FROM n
UNION ALL SELECT 'o_orderstatus', n.n, 0, NULL, (SELECT count(*) FROM m WHERE s1 <> s2), 'different' FROM n
UNION ALL SELECT 'o_orderpriority', n.n, 0, NULL, (SELECT count(*) FROM m WHERE p1 <> p2), 'equal' FROM n
UNION ALL SELECT 'o_orderdate', n.n, 0, (SELECT CAST(max(epoch(d2) - epoch(d1)) AS DOUBLE) FROM m), (SELECT count(*) FROM m WHERE d1 <> d2), 'different' FROM n
UNION ALL SELECT unnest(['gone', 'a', 'b']), n.n, n.n, NULL, 0, 'different' FROM n""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")
    k = F.col("o_orderkey")
    changed = rows.filter(k % 60 != 0).withColumns(
        {
            "o_custkey": F.when(k % 7 != 0, F.col("o_custkey")),
            "o_totalprice": F.col("o_totalprice") + F.when(k % 11 == 0, 0.25).otherwise(0),
            "o_orderstatus": F.when(k % 13 == 0, "X").otherwise(F.col("o_orderstatus")),
            "o_orderdate": F.col("o_orderdate") + F.when(k % 17 == 0, F.expr("INTERVAL 90 SECOND")).otherwise(F.expr("INTERVAL 0 SECOND")),
        }
    )
    # Columns that one side lacks, with names that a join could trip over.
    ours = rows.filter(k % 50 != 0).withColumns({"gone": F.lit(1), "a": F.lit(None).cast("int")})
    return joins.table_diff(ours, changed.withColumn("b", F.lit("x")), "o_orderkey", allowed=["o_totalprice"])


@check(
    "resolve_entities",
    "c_custkey:i resolved_id:s resolution:s",
    """
WITH known AS (SELECT DISTINCT c_mktsegment || CAST(c_nationkey AS VARCHAR) || CAST(c_custkey % 40 AS VARCHAR) AS name, c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT c_custkey, c_mktsegment || CAST(c_nationkey AS VARCHAR) || CAST(c_custkey % 40 AS VARCHAR) AS name, c_custkey + c_custkey % 2 AS official FROM customer),
k AS (SELECT name, count(DISTINCT id) AS n, min(CAST(id AS VARCHAR)) AS only_id FROM known GROUP BY name)
----
SELECT new.c_custkey, CASE WHEN k.n IS NULL THEN 'new' WHEN k.n = 1 THEN 'mapped' WHEN h.id IS NOT NULL THEN 'official' ELSE 'unresolved' END AS resolution,
  CASE WHEN k.n IS NULL THEN 'new:' || official WHEN k.n = 1 THEN k.only_id WHEN h.id IS NOT NULL THEN CAST(official AS VARCHAR) END AS resolved_id
FROM new LEFT JOIN k ON k.name = new.name LEFT JOIN known h ON h.name = new.name AND h.id = new.official""",
)
def _(spark, sf):
    rows = table(spark, sf, "customer")
    k = F.col("c_custkey")
    named = rows.withColumn("name", F.concat("c_mktsegment", F.col("c_nationkey").cast("string"), (k % 40).cast("string")))
    known = named.filter(k % 3 != 0).select("name", k.alias("subject_id"))
    new = named.select("c_custkey", "name", (k + k % 2).alias("official_id"))
    return joins.resolve_entities(new, known)


@check(
    "attach_predictions",
    KEYS + "label:i p_market:f p_form:f career_starts:i",
    "SELECT * FROM wide",
)
def _(spark, sf):
    wide = predictions(spark, sf)
    keys = ["contest_id", "subject_id"]
    return joins.attach_predictions(
        wide.select(*keys, "label"), wide.select(*keys, "p_market"), wide.select(*keys, "p_form", "career_starts"), on=keys
    )


@check(
    "upsert_contests",
    KEYS + "status:s age:i",
    """SELECT contest_id, subject_id, status, CASE WHEN contest_date >= DATE '2001-06-01' THEN age + 1 ELSE age END AS age FROM entries
WHERE venue <> 7""",
)
def _(spark, sf):
    rows = entries(spark, sf)
    fresh = rows.filter("contest_date >= DATE '2001-06-01'").withColumn("age", F.col("age") + 1)
    current = rows.filter("contest_date < DATE '2001-07-15'")
    return joins.upsert_contests(current, fresh, rows.filter("venue <> 7").select("contest_id").distinct())


@check(
    "stale_contests",
    "contest_id:i contest_date:d",
    """SELECT DISTINCT contest_id, contest_date FROM entries WHERE venue = 4 OR contest_date >= DATE '2001-07-02'""",
)
def _(spark, sf):
    rows = entries(spark, sf)
    ledger = rows.select("contest_id", "contest_date").distinct()
    return joins.stale_contests(ledger, rows.filter("venue <> 4"), "2001-07-15", 14)


@check(
    "union_by_name",
    "contest_id:i rows:i with_odds:i",
    "SELECT contest_id, count(*) AS rows, count(CASE WHEN status = 'finished' THEN win_odds END) AS with_odds FROM entries GROUP BY 1",
)
def _(spark, sf):
    rows = entries(spark, sf)
    out = joins.union_by_name(rows.filter("status = 'finished'"), rows.filter("status <> 'finished'").drop("win_odds"))
    return out.groupBy("contest_id").agg(F.count("*").alias("rows"), F.count("win_odds").alias("with_odds"))


@check("key_difference", KEYS, "SELECT contest_id, subject_id FROM entries WHERE status = 'scratched'")
def _(spark, sf):
    return joins.key_difference(entries(spark, sf), light_starters(spark, sf), ["contest_id", "subject_id"])


@check(
    "key_intersection",
    "subject_id:i",
    "SELECT DISTINCT subject_id FROM entries WHERE surface = 'turf' AND subject_id IN (SELECT subject_id FROM entries WHERE surface = 'synthetic')",
)
def _(spark, sf):
    rows = entries(spark, sf)
    return joins.key_intersection(rows.filter("surface = 'turf'"), rows.filter("surface = 'synthetic'"), ["subject_id"])


@check(
    "dedupe_keep_first",
    "subject_id:i contest_date:d contest_id:i status:s",
    "SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY contest_date, contest_id) = 1",
)
def _(spark, sf):
    return joins.dedupe_keep_first(entries(spark, sf), "subject_id", ["contest_date", "contest_id"])


@check(
    "one_start_per_day",
    "subject_id:i contest_date:d contest_id:i",
    "SELECT * FROM reps",
)
def _(spark, sf):
    return history.one_start_per_day(light_starters(spark, sf))


# --- quality --------------------------------------------------------------------------


@check(
    "field_completeness",
    "contest_id:i observed:i field_size:i repeated_subjects:i",
    "SELECT contest_id, count(*) AS observed, min(field_size) AS field_size, 0 AS repeated_subjects FROM starters WHERE subject_id % 41 <> 0 "
    "GROUP BY contest_id HAVING count(*) <> min(field_size)",
)
def _(spark, sf):
    return quality.field_completeness(light_starters(spark, sf).filter("subject_id % 41 <> 0"))


@check(
    "cube_counts",
    "grain:s year:f venue:f distance_m:f rows:i contests:i dates:i",
    """
WITH x AS (SELECT *, year(contest_date) AS year FROM panel)
----
SELECT CASE WHEN GROUPING(year) = 0 AND GROUPING(venue) = 0 AND GROUPING(distance_m) = 0 THEN 'year*distance_m*venue'
  WHEN GROUPING(year) = 0 AND GROUPING(venue) = 0 THEN 'year*venue' WHEN GROUPING(year) = 0 THEN 'year*distance_m' ELSE 'distance_m*venue' END AS grain,
  year, venue, distance_m, count(*) AS rows, count(DISTINCT contest_id) AS contests, count(DISTINCT contest_date) AS dates
FROM x GROUP BY GROUPING SETS ((year, distance_m), (year, venue), (distance_m, venue), (year, distance_m, venue))""",
)
def _(spark, sf):
    rows = panel(spark, sf).withColumn("year", F.year("contest_date"))
    sets = [("year", "distance_m"), ("year", "venue"), ("distance_m", "venue"), ("year", "distance_m", "venue")]
    return quality.cube_counts(rows, sets)


# Every column of the panel but the keys.
PANEL_COLUMNS = (
    "entry_no", "status", "surface", "venue", "distance_m", "contest_class", "turn_direction", "grp", "age", "weight", "declared_size",
    "field_size", "finish_position", "time_s", "early_position", "label", "finish_pct", "early_pct", "draw_pct", "is_open_plus",
    "is_graded", "winner_time", "rel_time", "career_starts", "career_top3", "turf_starts", "turf_top3", "prev_date", "days_since_prev",
    "distance_change", "surface_changed", "weight_change", "recent3_finish_pct", "recent3_top3", "recent3_open_plus", "recent3_graded",
    "recent3_rel_time", "recent4_early_pct", "trend_finish", "trend_time", "trend_top3", "trend_early", "front_share",
    "same_distance_starts", "same_distance_top3", "same_course_starts", "same_course_top3",
)


@check(
    "missingness",
    "year:i feature:s rows:i nulls:i null_rate:f",
    f"""SELECT year(contest_date) AS year, u.f AS feature, count(*) AS rows, count(*) - count(u.v) AS nulls, 1 - count(u.v) / count(*) AS null_rate
FROM panel, LATERAL (VALUES {", ".join(f"('{c}', CAST({c} AS VARCHAR))" for c in PANEL_COLUMNS)}) u(f, v) GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = panel(spark, sf).withColumn("year", F.year("contest_date"))
    return quality.missingness(rows, PANEL_COLUMNS, ["year"])


NUMBERS = tuple(
    c for c in PANEL_COLUMNS if c not in ("status", "surface", "contest_class", "turn_direction", "grp", "prev_date")
)


@check(
    "exact_medians",
    "feature:s median:f",
    f"""SELECT u.f AS feature, median(u.v) AS median FROM panel, LATERAL (VALUES {", ".join(f"('{c}', CAST({c} AS DOUBLE))" for c in NUMBERS)}) u(f, v)
GROUP BY 1""",
)
def _(spark, sf):
    found = quantiles.exact_medians(panel(spark, sf), NUMBERS)
    return spark.createDataFrame(list(found.items()), "feature string, median double")


@check(
    "panel_summary",
    "split:s rows:i contests:i subjects:i prevalence:f min_field:i max_field:i",
    """SELECT split, sum(n) AS rows, count(*) AS contests, any_value(k) AS subjects, sum(s) / sum(n) AS prevalence, min(n) AS min_field, max(n) AS max_field
FROM (SELECT CASE WHEN year(contest_date) <= 1996 THEN 'warmup' WHEN year(contest_date) <= 1999 THEN 'train' WHEN year(contest_date) = 2000 THEN 'validation'
  ELSE 'test' END AS split, contest_id, count(*) AS n, sum(label) AS s FROM panel GROUP BY 1, 2)
JOIN (SELECT CASE WHEN year(contest_date) <= 1996 THEN 'warmup' WHEN year(contest_date) <= 1999 THEN 'train' WHEN year(contest_date) = 2000 THEN 'validation'
  ELSE 'test' END AS split, count(DISTINCT subject_id) AS k FROM panel GROUP BY 1) USING (split) GROUP BY split""",
)
def _(spark, sf):
    return quality.panel_summary(cohorts.with_split(panel(spark, sf), SPLITS), ["split"])


@check(
    "field_distribution",
    "field:i contests:i",
    "SELECT field, count(*) AS contests FROM (SELECT contest_id, count(*) AS field FROM panel GROUP BY 1) GROUP BY 1",
)
def _(spark, sf):
    return quality.field_distribution(panel(spark, sf))


@check(
    "value_profile",
    "column_name:s value:s count:i width:i rank:i",
    """SELECT column_name, value, count, length(value) AS width, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank
FROM (SELECT u.c AS column_name, u.v AS value, count(*) AS count FROM events, LATERAL (VALUES ('event_type', event_type),
  ('user_id', CAST(user_id AS VARCHAR)), ('props', props), ('event_id', CAST(event_id AS VARCHAR)), ('ts', CAST(ts AS VARCHAR)),
  ('value', CAST(value AS VARCHAR))) u(c, v) GROUP BY 1, 2) QUALIFY rank <= 25""",
)
def _(spark, sf):
    return quality.value_profile(table(spark, sf, "events"), ["event_type", "user_id", "props", "event_id", "ts", "value"], 25)


@check(
    "yearly_rollup",
    "year:i days:i contests:i flat:i obstacle:i rows:i difference:i",
    """
WITH c AS (SELECT year(contest_date) AS year, contest_date, contest_id, count(*) AS n, min(CASE WHEN turn_direction = 'straight' THEN 'obstacle' ELSE 'flat' END) AS kind
  FROM starters GROUP BY 1, 2, 3)
----
SELECT year, count(DISTINCT contest_date) AS days, count(*) AS contests, count(CASE WHEN kind = 'flat' THEN 1 END) AS flat,
  count(CASE WHEN kind = 'obstacle' THEN 1 END) AS obstacle, sum(n) AS rows, count(*) - 500 AS difference FROM c GROUP BY year""",
)
def _(spark, sf):
    rows = light_starters(spark, sf)
    kind = F.when(F.col("turn_direction") == "straight", "obstacle").otherwise("flat")
    bench = rows.select(F.year("contest_date").alias("year")).distinct().withColumn("benchmark", F.lit(500))
    return quality.yearly_rollup(rows, kind, bench)


@check(
    "card_slots",
    "contest_date:d venue:i numbers:i outside:i present:s unfilled:s complete:i",
    """
WITH n AS (SELECT DISTINCT contest_date, venue, CAST(contest_id % 14 AS INT) AS no FROM entries)
----
SELECT contest_date, venue, count(*) AS numbers, count(CASE WHEN no NOT BETWEEN 1 AND 12 THEN 1 END) AS outside,
  coalesce(array_to_string(list_sort(list(no) FILTER (WHERE no BETWEEN 1 AND 12)), ';'), '') AS present,
  array_to_string(list_filter(range(1, 13), lambda x: NOT list_contains(list(no), CAST(x AS INT))), ';') AS unfilled,
  CASE WHEN count(CASE WHEN no BETWEEN 1 AND 12 THEN 1 END) = 12 THEN 1 ELSE 0 END AS complete
FROM n GROUP BY contest_date, venue""",
)
def _(spark, sf):
    rows = entries(spark, sf).withColumn("no", (F.col("contest_id") % 14).cast("int"))
    return quality.card_slots(rows, ["contest_date", "venue"], "no")


CONSENSUS = """
WITH f AS (SELECT o_custkey % 300 AS k, o_orderpriority AS v, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p FROM orders),
g AS (SELECT k, v, count(*) AS n, min(p) AS p FROM f GROUP BY 1, 2)
----
"""


@check(
    "consensus_map",
    "k:i value:s n_values:i evidence:i",
    CONSENSUS + "SELECT k, arg_min(v, p) AS value, count(*) AS n_values, sum(n) AS evidence FROM g GROUP BY k",
)
def _(spark, sf):
    facts = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 300).alias("k"), F.col("o_orderpriority").alias("v"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("p"),
    )
    return quality.consensus_map(facts, "k", "v", "p")[0]


@check(
    "consensus_map_all",
    "k:i value:s n_values:i evidence:i",
    """
WITH f AS (SELECT o_custkey AS k, o_orderpriority AS v, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p FROM orders),
g AS (SELECT k, v, count(*) AS n, min(p) AS p FROM f GROUP BY 1, 2)
----
SELECT k, arg_min(v, p) AS value, count(*) AS n_values, sum(n) AS evidence FROM g GROUP BY k""",
)
def _(spark, sf):
    facts = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("p"),
    )
    return quality.consensus_map(facts, "k", "v", "p")[0]


@check(
    "consensus_conflicts",
    "c_nationkey:i n_values:i",
    "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_values FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1",
)
def _(spark, sf):
    return quality.consensus_map(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")[1]


@check(
    "inventory_evidence",
    "card:s n:i agreeing:i methods:i verdict:s",
    """
WITH c AS (SELECT CAST(contest_date AS VARCHAR) || '/' || venue AS card, count(DISTINCT contest_id) AS n, count(*) AS rows, min(contest_id) % 5 AS r FROM entries GROUP BY 1)
----
SELECT card, n, (CASE WHEN r <> 0 THEN 1 ELSE 0 END) + (CASE WHEN rows % 3 = n THEN 1 ELSE 0 END) AS agreeing, 2 AS methods,
  CASE WHEN r <> 0 OR rows % 3 = n THEN 'count_evidence' WHEN rows % 2 = 0 THEN 'override' ELSE 'rejected' END AS verdict FROM c""",
)
def _(spark, sf):
    card = F.concat_ws("/", F.col("contest_date").cast("string"), F.col("venue").cast("string"))
    cards = entries(spark, sf).groupBy(card.alias("card")).agg(
        F.countDistinct("contest_id").alias("n"), F.count("*").alias("rows"), (F.min("contest_id") % 5).alias("r")
    )
    headers = cards.select("card", F.lit("headers").alias("method"), F.when(F.col("r") == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    labels = cards.select("card", F.lit("labels").alias("method"), (F.col("rows") % 3).alias("n"))
    overrides = cards.filter("rows % 2 = 0").select("card", "n")
    return quality.inventory_evidence(cards.select("card", "n"), headers.unionByName(labels), overrides)


def ledger_with_events(spark, sf):
    heads = entries(spark, sf).select("contest_id", "contest_date").distinct()
    events = heads.filter("contest_id % 53 = 0").select(
        "*", F.lit("abandoned").alias("status"), F.lit("https://example.org/notice").alias("url"), F.lit("weather").alias("reason")
    )
    return quality.apply_events(quality.build_ledger(heads), events)


@check(
    "apply_events",
    "contest_id:i contest_date:d contest_status:s status_reason:s",
    """SELECT DISTINCT contest_id, contest_date, CASE WHEN contest_id % 53 = 0 THEN 'abandoned' ELSE 'expected_result' END AS contest_status,
  CASE WHEN contest_id % 53 = 0 THEN 'weather' ELSE '' END AS status_reason FROM entries""",
)
def _(spark, sf):
    return ledger_with_events(spark, sf)


@check(
    "expected_results",
    "contest_id:i contest_date:d",
    "SELECT DISTINCT contest_id, contest_date FROM entries WHERE contest_id % 53 <> 0",
)
def _(spark, sf):
    return quality.expected_results(ledger_with_events(spark, sf))


@check(
    "complete_through",
    "missing:i complete_through:d",
    """SELECT count(*) AS missing, coalesce(min(contest_date) - INTERVAL 1 DAY, DATE '2001-06-30') AS complete_through
FROM (SELECT DISTINCT contest_id, contest_date FROM entries WHERE contest_date <= DATE '2001-06-30' AND contest_date >= DATE '2001-03-01' AND venue = 2)""",
)
def _(spark, sf):
    rows = entries(spark, sf)
    have = rows.filter("NOT (contest_date >= DATE '2001-03-01' AND venue = 2)")
    return quality.complete_through(rows.select("contest_id", "contest_date").distinct(), have, "2001-06-30")


@check(
    "month_checkpoints",
    "first_day:d cutoff:d expected:i confirmed:i missing:i rows:i latest:d complete_through:d",
    """
WITH due AS (SELECT contest_id, contest_date, count(*) AS n, bool_or(contest_date >= DATE '2000-03-01' AND venue = 2) AS gone FROM entries GROUP BY ALL),
months AS (SELECT greatest(m, DATE '1994-11-15') AS first_day, least(last_day(m), DATE '2001-06-20') AS cutoff
  FROM (SELECT unnest(generate_series(DATE '1994-11-01', DATE '2001-06-20', INTERVAL 1 MONTH))::DATE AS m))
----
SELECT first_day, cutoff, count(contest_id) AS expected, count(contest_id) FILTER (NOT gone) AS confirmed, count(contest_id) FILTER (gone) AS missing,
  coalesce(sum(n) FILTER (NOT gone), 0) AS rows, max(contest_date) FILTER (NOT gone) AS latest,
  coalesce(min(contest_date) FILTER (gone) - INTERVAL 1 DAY, cutoff) AS complete_through
FROM months LEFT JOIN due ON contest_date BETWEEN DATE '1994-11-15' AND cutoff GROUP BY first_day, cutoff""",
)
def _(spark, sf):
    rows = entries(spark, sf)
    have = rows.filter("NOT (contest_date >= DATE '2000-03-01' AND venue = 2)")
    return quality.month_checkpoints(rows.select("contest_id", "contest_date"), have, "1994-11-15", "2001-06-20")


@check(
    "audit_snapshot",
    "rule:s violations:i",
    """
WITH e AS (SELECT * FROM entries WHERE subject_id % 101 <> 0), s AS (SELECT * FROM e WHERE status <> 'scratched'),
n AS (SELECT contest_id, count(*) AS n, min(field_size) AS f, min(declared_size) AS d, count(CASE WHEN finish_position = 1 THEN 1 END) AS w FROM s GROUP BY 1),
dn AS (SELECT contest_id, count(*) AS n FROM e GROUP BY 1)
----
SELECT unnest(['history_repeated_subject', 'history_repeated_number', 'history_contest_set', 'audit_repeated_subject', 'audit_repeated_number',
  'audit_contest_set', 'history_non_starter', 'time_missing_or_not_positive', 'time_finer_than_tenths', 'audit_unknown_status', 'starter_not_declared',
  'declared_starter_without_result', 'condition_contest_date', 'condition_venue', 'condition_surface', 'condition_distance_m']) AS rule, 0 AS violations
UNION ALL SELECT 'history_after_cutoff', count(*) FROM s WHERE contest_date > DATE '2001-07-01'
UNION ALL SELECT 'audit_after_cutoff', count(*) FROM e WHERE contest_date > DATE '2001-07-01'
UNION ALL SELECT 'field_size_wrong', count(*) FROM n WHERE n <> f
UNION ALL SELECT 'declared_size_wrong', count(*) FROM n JOIN dn ON dn.contest_id = n.contest_id WHERE dn.n <> n.d
UNION ALL SELECT 'no_winner', count(*) FROM n WHERE w = 0""",
)
def _(spark, sf):
    audit = entries(spark, sf).filter("subject_id % 101 <> 0")
    ledger = audit.groupBy("contest_id").agg(*[F.min(c).alias(c) for c in ("contest_date", "venue", "surface", "distance_m")])
    return quality.audit_snapshot(audit.filter("status <> 'scratched'"), audit, ledger, "2001-07-01")


@check(
    "qa_gate",
    "rule:s violations:i",
    """SELECT 'no_time' AS rule, count(*) AS violations FROM starters WHERE time_s IS NULL
UNION ALL SELECT 'number_out_of_range', count(*) FROM starters WHERE entry_no < 1 OR entry_no > declared_size
UNION ALL SELECT 'size_order', count(*) FROM starters WHERE declared_size < field_size""",
)
def _(spark, sf):
    return quality.qa_gate(
        light_starters(spark, sf),
        {
            "no_time": F.col("time_s").isNull(),
            "number_out_of_range": (F.col("entry_no") < 1) | (F.col("entry_no") > F.col("declared_size")),
            "size_order": F.col("declared_size") < F.col("field_size"),
        },
    )


@check(
    "subject_coverage",
    "subject_id:i expected:i actual:i missing:i extra:i",
    """SELECT subject_id, count(CASE WHEN status <> 'scratched' THEN 1 END) AS expected, count(CASE WHEN status <> 'dnf' THEN 1 END) AS actual,
  count(CASE WHEN status = 'dnf' THEN 1 END) AS missing, count(CASE WHEN status = 'scratched' THEN 1 END) AS extra FROM entries GROUP BY subject_id""",
)
def _(spark, sf):
    rows = entries(spark, sf)
    return quality.subject_coverage(rows.filter("status <> 'scratched'"), rows.filter("status <> 'dnf'"))


@check(
    "first_qualifying_window",
    "status:s window_end:d contests:i dates:i elapsed_days:i",
    """
WITH d AS (SELECT contest_date, count(DISTINCT contest_id) AS n FROM entries GROUP BY 1),
r AS (SELECT contest_date, sum(n) OVER (ORDER BY contest_date) AS contests, row_number() OVER (ORDER BY contest_date) AS dates,
  date_diff('day', min(contest_date) OVER (), contest_date) AS elapsed_days FROM d)
----
SELECT CASE WHEN h.contest_date IS NULL THEN 'collecting' ELSE 'review_ready' END AS status, h.contest_date AS window_end,
  coalesce(h.contests, r.contests) AS contests, coalesce(h.dates, r.dates) AS dates, coalesce(h.elapsed_days, r.elapsed_days) AS elapsed_days
FROM r LEFT JOIN (SELECT * FROM r WHERE contests >= 1000 AND dates >= 60 AND elapsed_days >= 90 ORDER BY contest_date LIMIT 1) h ON true
ORDER BY r.contest_date DESC LIMIT 1""",
)
def _(spark, sf):
    return quality.first_qualifying_window(entries(spark, sf), 1000, 60, 90)


def review_sql(contests: int, dates: int, days: int) -> str:
    return f"""
WITH rd AS (SELECT contest_date, count(DISTINCT contest_id) AS n FROM wide GROUP BY 1),
rr AS (SELECT contest_date, sum(n) OVER (ORDER BY contest_date) AS contests, row_number() OVER (ORDER BY contest_date) AS dates,
  date_diff('day', min(contest_date) OVER (), contest_date) AS elapsed_days FROM rd),
rw AS (SELECT * FROM rr WHERE contests >= {contests} AND dates >= {dates} AND elapsed_days >= {days} ORDER BY contest_date LIMIT 1),
rc(candidate, w) AS (VALUES ('w000', 0.0), ('w010', 0.1), ('w025', 0.25), ('w050', 0.5), ('w100', 1.0)),
rp AS (SELECT c.candidate, x.contest_id, x.contest_date, x.label, (1 - c.w) * x.p_market + c.w * x.p_form AS p
  FROM wide x JOIN rw ON x.contest_date <= rw.contest_date, rc c),
rl AS (SELECT candidate, contest_id, contest_date, avg(pow(p - label, 2)) AS b,
  avg(-(label * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - label) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))) AS l FROM rp GROUP BY 1, 2, 3),
rb AS (SELECT candidate AS best FROM rl GROUP BY candidate ORDER BY avg(b), avg(l), candidate LIMIT 1),
rx AS (SELECT i.contest_date, i.b - o.b AS d FROM rl i JOIN rl o ON o.contest_id = i.contest_id, rb WHERE i.candidate = 'w000' AND o.candidate = rb.best),
rm AS (SELECT avg(d) AS m, count(*) AS n FROM rx),
rk AS (SELECT rm.m <= sqrt(count(*) / (count(*) - 1.0) * sum(pow(s, 2)) / pow(rm.n, 2)) + 1e-15 AS keep
  FROM (SELECT contest_date, sum(d - (SELECT m FROM rm)) AS s FROM rx GROUP BY 1), rm GROUP BY rm.m, rm.n)
----
SELECT CASE WHEN h.contest_date IS NULL THEN 'collecting' ELSE 'review_ready' END AS status, h.contest_date AS window_end,
  coalesce(h.contests, r.contests) AS contests, coalesce(h.dates, r.dates) AS dates, coalesce(h.elapsed_days, r.elapsed_days) AS elapsed_days,
  CASE WHEN keep THEN 'w000' ELSE best END AS winner, best AS point_best, CAST(keep AS VARCHAR) AS incumbent_retained
FROM rr r LEFT JOIN rw h ON true LEFT JOIN rb ON true LEFT JOIN rk ON true ORDER BY r.contest_date DESC LIMIT 1"""


REVIEWED = "status:s window_end:d contests:i dates:i elapsed_days:i winner:s point_best:s incumbent_retained:s"


def review_input(spark, sf):
    rows = predictions(spark, sf)
    weights = {"w000": 0.0, "w010": 0.1, "w025": 0.25, "w050": 0.5, "w100": 1.0}
    return rows.select(
        "contest_id", "contest_date", "label", *[((1 - w) * F.col("p_market") + w * F.col("p_form")).alias(f"p_{n}") for n, w in weights.items()]
    )


@check("review_decision", REVIEWED, review_sql(1000, 60, 90))
def _(spark, sf):
    return selection.review_decision(review_input(spark, sf))


@check("review_decision_early", REVIEWED, review_sql(200, 30, 90))
def _(spark, sf):
    return selection.review_decision(review_input(spark, sf), contests=200, dates=30, days=90)


@check("review_collecting", REVIEWED, review_sql(10**9, 60, 90))
def _(spark, sf):
    return selection.review_decision(review_input(spark, sf), contests=10**9)


LOCK_ROWS = """
WITH lk AS (SELECT w.contest_id, w.contest_date, w.subject_id, w.entry_no, w.field_size, w.surface, w.distance_m, e.turn_direction,
  p_market, CASE WHEN career_starts >= 3 THEN p_form END AS p_nonmarket, career_starts >= 3 AS own, w.contest_id % 4 AS r
  FROM wide w JOIN entries e ON e.contest_id = w.contest_id AND e.subject_id = w.subject_id),
per AS (SELECT contest_id, count(*) AS n, min(field_size) AS f, max(CASE WHEN own THEN 1 ELSE 0 END) AS own, min(surface) AS surface,
  min(turn_direction) AS td, min(r) AS r FROM lk GROUP BY contest_id)
----
"""


def lock_input(spark, sf):
    wide = predictions(spark, sf)
    turn = entries(spark, sf).select("contest_id", "subject_id", "turn_direction")
    own = F.col("career_starts") >= 3
    start = F.col("contest_date").cast("timestamp") + F.expr("INTERVAL 15 HOURS")
    r = F.col("contest_id") % 4
    rows = wide.join(turn, ["contest_id", "subject_id"]).select(
        "contest_id", "contest_date", "subject_id", "entry_no", "field_size", "surface", "distance_m", "turn_direction", "p_market",
        F.when(own, F.col("p_form")).alias("p_nonmarket"),
        F.when(own, "nonmarket-shadow").otherwise("market-only").alias("route"),
        F.when(own, "m1").otherwise("").alias("model_id"),
        start.alias("start_at"),
        # One contest in four is locked too early, one is priced too long before.
        (start - F.when(r == 3, F.expr("INTERVAL 700 SECONDS")).otherwise(F.expr("INTERVAL 570 SECONDS"))).alias("locked_at"),
    )
    age = F.when(r == 2, F.expr("INTERVAL 400 SECONDS")).otherwise(F.expr("INTERVAL 120 SECONDS"))
    return rows.withColumn("market_asof", F.col("locked_at") - age)


@check(
    "make_lock",
    KEYS + "p_w000:f p_w010:f p_w025:f p_w050:f p_w100:f",
    LOCK_ROWS + """SELECT contest_id, subject_id, p_market AS p_w000, 0.9 * p_market + 0.1 * coalesce(p_nonmarket, p_market) AS p_w010,
  0.75 * p_market + 0.25 * coalesce(p_nonmarket, p_market) AS p_w025, 0.5 * p_market + 0.5 * coalesce(p_nonmarket, p_market) AS p_w050,
  coalesce(p_nonmarket, p_market) AS p_w100
FROM lk WHERE contest_id IN (SELECT contest_id FROM per WHERE n >= 8 AND n = f AND own = 1 AND surface <> 'synthetic' AND td <> 'straight' AND r < 2)""",
)
def _(spark, sf):
    return locks.make_lock(lock_input(spark, sf))[0]


@check(
    "lock_violations",
    "rule:s contests:i",
    LOCK_ROWS + """SELECT rule, count(DISTINCT contest_id) AS contests FROM (
  SELECT contest_id, 'lock_time' AS rule FROM per WHERE r = 3 UNION ALL SELECT contest_id, 'price_age' FROM per WHERE r = 2
  UNION ALL SELECT contest_id, 'surface' FROM per WHERE surface = 'synthetic' UNION ALL SELECT contest_id, 'straight' FROM per WHERE td = 'straight'
  UNION ALL SELECT contest_id, 'field_too_small' FROM per WHERE n < 8 UNION ALL SELECT contest_id, 'no_model_candidate' FROM per WHERE own = 0) GROUP BY rule""",
)
def _(spark, sf):
    found = locks.lock_violations(lock_input(spark, sf))
    return found.groupBy("rule").agg(F.countDistinct("contest_id").alias("contests"))


@check(
    "validate_published_lock",
    "rule:s contests:i",
    """SELECT 'sum' AS rule, count(*) AS contests FROM (SELECT contest_id FROM preds WHERE candidate = 'form' AND contest_id % 5 = 0 GROUP BY 1)
UNION ALL SELECT 'bounds', count(DISTINCT contest_id) FROM wide WHERE contest_id % 7 = 0""",
)
def _(spark, sf):
    wide = ranking.rank_first(predictions(spark, sf), "p_form")
    p = F.col("p_form")
    form = wide.select(
        "contest_id", "subject_id", "rank", "p_market", p.alias("p_model_raw"), p.alias("p_model_calibrated"),
        F.when(F.col("contest_id") % 5 == 0, p * 0.99).otherwise(p).alias("p_ensemble"),
        F.when(F.col("contest_id") % 7 == 0, p * 1.0001).otherwise(p * 0.5).alias("uncertainty_low"),
        F.least(p * 1.5, F.lit(1.0)).alias("uncertainty_high"),
    )
    found = locks.validate_published_lock(form)
    return found.groupBy("rule").agg(F.countDistinct("contest_id").alias("contests"))


REVIEW = """
WITH x AS (SELECT contest_id, max(CASE WHEN subject_id % 211 = 0 THEN 1 ELSE 0 END) AS gap FROM wide GROUP BY 1)
----
"""


def review(spark, sf):
    locked = predictions(spark, sf).select("contest_id", "contest_date", "subject_id", F.col("p_market").alias("p_w000"))
    outcomes = predictions(spark, sf).filter("subject_id % 211 <> 0").select("contest_id", "subject_id", "label")
    events = locked.filter("contest_id % 31 = 0").select("contest_id", F.lit("race_cancelled").alias("reason")).distinct()
    return quality.lock_review_join(locked, outcomes, events)


@check(
    "lock_review_join",
    KEYS + "label:i p_w000:f",
    REVIEW + "SELECT contest_id, subject_id, label, p_market AS p_w000 FROM wide WHERE contest_id % 31 <> 0 AND contest_id NOT IN (SELECT contest_id FROM x WHERE gap = 1)",
)
def _(spark, sf):
    return review(spark, sf)[0]


@check(
    "lock_review_exclusions",
    "contest_id:i reason:s",
    REVIEW + "SELECT contest_id, CASE WHEN contest_id % 31 = 0 THEN 'race_cancelled' ELSE 'missing_official_outcomes' END AS reason FROM x "
    "WHERE contest_id % 31 = 0 OR gap = 1",
)
def _(spark, sf):
    return review(spark, sf)[1]


def _field(text):
    return f"coalesce(length({text}) || ':' || {text}, '-')"


# The second and third field hold a separator, run into each other or are NULL in some rows.
FINGERPRINT = f"""
WITH f AS (SELECT surface, CAST(contest_id AS VARCHAR) AS a, CASE WHEN contest_id % 5 <> 0 THEN 'x' || repeat('|', CAST(contest_id % 3 AS INT)) END AS b,
  repeat('|', CAST(2 - contest_id % 3 AS INT)) || CAST(subject_id AS VARCHAR) AS c FROM entries),
h AS (SELECT surface, sha256({_field('a')} || {_field('b')} || {_field('c')}) AS d FROM f)
----
SELECT surface AS candidate, count(*) AS rows, {" || '-' || ".join(
    f"CAST(sum(CAST('0x' || substr(d, {1 + 15 * k}, 15) AS BIGINT)) AS VARCHAR)" for k in range(4))} AS fingerprint FROM h GROUP BY surface"""


@check(
    "row_fingerprint",
    "candidate:s rows:i fingerprint:s",
    FINGERPRINT,
)
def _(spark, sf):
    m = F.col("contest_id") % 3
    rows = entries(spark, sf).select(
        F.col("surface").alias("candidate"), F.col("contest_id").alias("a"),
        F.when(F.col("contest_id") % 5 != 0, F.concat(F.lit("x"), F.expr("repeat('|', int(contest_id % 3))"))).alias("b"),
        F.concat(F.when(m == 0, "||").when(m == 1, "|").otherwise(""), F.col("subject_id").cast("string")).alias("c"),
    )
    return row_fingerprint(rows, ["a", "b", "c"], ["candidate"])


@check("field_size", KEYS + "n_declared:i n_starters:i", "SELECT *, declared_size AS n_declared, field_size AS n_starters FROM entries")
def _(spark, sf):
    return ranking.field_sizes(entries(spark, sf))


@check("stable_order", KEYS + "position:i", "SELECT *, row_number() OVER (ORDER BY contest_date, contest_id, entry_no) AS position FROM entries")
def _(spark, sf):
    from fieldform.scale import rank_rows

    rows = entries(spark, sf)
    ordered = ranking.stable_order(rows, ["contest_date", "contest_id"], "entry_no")
    return rank_rows(ordered, [], [F.col("contest_date"), F.col("contest_id"), F.col("entry_no")], "position")


@check(
    "uniform_baseline_by_field",
    "field_size:i p:f contests:i",
    "SELECT field_size, CASE WHEN field_size > 3 THEN 3.0 / field_size END AS p, count(DISTINCT contest_id) AS contests FROM starters GROUP BY 1",
)
def _(spark, sf):
    rows = light_starters(spark, sf).groupBy("field_size").agg(F.countDistinct("contest_id").alias("contests"))
    return rows.withColumn("p", field_size_baseline("field_size"))
