"""Snapshots of parts, agreement of sources, and the leakage probe over every year."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.history_checks import PROBED
from checks.spec import check
from fieldform import scale
from fieldform.operators import history, quality
from fieldform.sources import parts
from fieldform.sources.testtables import entries, light_starters, table, whole_entries


def updated(spark, sf):
    """All entries as a first version, then one day with other weights and one contest less in the ledger."""
    rows, root = whole_entries(spark, sf), scale.new_folder(spark, "parts")
    ledger = scale.materialize(rows.select("contest_id", "contest_date").distinct(), "ledger")
    before = parts.apply_parts(spark, rows, ledger, root)
    day = rows.agg(F.max_by("contest_date", F.struct(F.datediff(F.lit("1999-06-15").cast("date"), "contest_date") >= 0, "contest_date"))).scalar()
    fresh = rows.filter(F.col("contest_date") == day).withColumn("weight", F.col("weight") + 1)
    gone = rows.agg(F.min("contest_id")).scalar()
    after = parts.apply_parts(spark, fresh, ledger.filter(F.col("contest_id") != gone), root)
    return before, after


UPDATED = """
WITH d AS (SELECT max(contest_date) AS day FROM entries WHERE contest_date <= DATE '1999-06-15'),
g AS (SELECT min(contest_id) AS gone FROM entries),
m AS (SELECT e.*, strftime(contest_date, '%Y-%m') AS part FROM entries e),
t AS (SELECT strftime(day, '%Y-%m') AS part FROM d UNION SELECT part FROM m, g WHERE contest_id = gone),
n AS (SELECT 'audit' AS table_name, part, count(*) FILTER (contest_id <> gone) AS rows FROM m, g GROUP BY part
  UNION ALL SELECT 'history', part, count(*) FILTER (contest_id <> gone AND status <> 'scratched') FROM m, g GROUP BY part
  UNION ALL SELECT 'ledger', part, count(DISTINCT contest_id) FILTER (contest_id <> gone) FROM m, g GROUP BY part)
----
"""


@check(
    "publish_parts",
    "table_name:s part:s rows:i state:s",
    UPDATED + """SELECT table_name, part, rows, CASE WHEN rows = 0 THEN 'gone'
  WHEN (table_name <> 'ledger' AND part IN (SELECT part FROM t)) OR part IN (SELECT part FROM m, g WHERE contest_id = gone) THEN 'written' ELSE 'kept' END AS state FROM n""",
)
def _(spark, sf):
    return parts.changed_parts(*updated(spark, sf))


@check(
    "read_part_table",
    "contest_id:i subject_id:i weight:i",
    UPDATED + "SELECT contest_id, subject_id, weight + CASE WHEN contest_date = day THEN 1 ELSE 0 END AS weight FROM entries, d, g WHERE contest_id <> gone",
)
def _(spark, sf):
    return parts.read_part_table(updated(spark, sf)[1], "audit", verify=True)


def stated(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("value"), F.to_date("l_shipdate").alias("day"), "l_orderkey",
    )
    return quality.latest_statements(rows, "k", "value", "source", ["day", "l_orderkey"])


STATED = """
WITH s AS (SELECT l_partkey AS k, l_returnflag AS source, l_linestatus AS value, CAST(l_shipdate AS DATE) AS day FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey DESC, l_linestatus DESC) = 1)"""


@check(
    "source_agreement",
    "source_a:s source_b:s shared:i agreeing:i share:f",
    STATED + """
----
SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared, count(*) FILTER (a.value = b.value) AS agreeing, count(*) FILTER (a.value = b.value) / count(*) AS share
FROM s a JOIN s b ON a.k = b.k AND a.source < b.source GROUP BY 1, 2""",
)
def _(spark, sf):
    return quality.source_agreement(stated(spark, sf), "k", "value", "source")


PREFERRED = STATED + """,
p(source, first_year, last_year, priority) AS (VALUES ('A', 1990, 2000, 1), ('N', 2001, 2100, 1), ('R', 1990, 2100, 2)),
w AS (SELECT k, value, s.source, day, priority FROM s JOIN p ON p.source = s.source AND year(day) BETWEEN first_year AND last_year
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY priority, day DESC, s.source) = 1)"""


def preferred(spark, sf):
    order = spark.createDataFrame([("A", 1990, 2000, 1), ("N", 2001, 2100, 1), ("R", 1990, 2100, 2)], "source string, first_year int, last_year int, priority int")
    return quality.preferred_statement(stated(spark, sf), order, "k", "value", "source", "day")


@check("preferred_statement", "k:i value:s source:s day:d priority:i", PREFERRED + "\n----\nSELECT * FROM w")
def _(spark, sf):
    return preferred(spark, sf)


@check(
    "anchor_report",
    "k:i expected:s found:s verdict:s",
    PREFERRED + """
----
SELECT a.k, a.expected, w.value AS found, CASE WHEN w.k IS NULL THEN 'missing' WHEN w.value = a.expected THEN 'ok' ELSE 'wrong' END AS verdict
FROM (SELECT p_partkey - 5 AS k, CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'O' END AS expected FROM part) a LEFT JOIN w ON w.k = a.k""",
)
def _(spark, sf):
    anchors = table(spark, sf, "part").select((F.col("p_partkey") - 5).alias("k"), F.when(F.col("p_size") % 2 == 0, "F").otherwise("O").alias("expected"))
    return quality.anchor_report(preferred(spark, sf), anchors, "k", "value")


def outcome_changes():
    place = F.col("field_size") - F.coalesce("finish_position", F.lit(0)) + 1
    inverted = {
        "finish_position": place.cast("int"), "label": 1 - F.col("label"), "time_s": F.coalesce("time_s", F.lit(60.0)) + F.col("entry_no"),
        "early_position": (F.col("field_size") - F.coalesce("early_position", F.lit(0)) + 1).cast("int"),
        "early_pct": 1 - F.coalesce("early_pct", F.lit(0.25)), "finish_pct": (place - 1) / F.col("field_size"),
        "is_open_plus": 1 - F.col("is_open_plus"), "is_graded": 1 - F.col("is_graded"),
    }
    return {"inverted": inverted, "nulled": {c: F.lit(None) for c in inverted}}


@check(
    "leakage_closure",
    "probe:i variant:s level:s predictor:s rows:i changed:i",
    f"""WITH f AS (SELECT year(contest_date) AS probe, first(contest_id ORDER BY contest_date, contest_id) AS contest_id FROM starters GROUP BY 1),
n AS (SELECT f.probe, count(*) AS rows FROM starters s JOIN f ON f.contest_id = s.contest_id GROUP BY 1)
----
SELECT probe, v.variant, predictor, rows, 0 AS changed, CASE WHEN predictor = 'front_share' THEN 'field' ELSE 'entry' END AS level
FROM n, (VALUES ('inverted'), ('nulled')) v(variant), (SELECT unnest({list(PROBED)}) AS predictor)""",
)
def _(spark, sf):
    return history.leakage_closure(light_starters(spark, sf).drop("grp", "age"), history.build_panel, PROBED, ["front_share"], outcome_changes())
