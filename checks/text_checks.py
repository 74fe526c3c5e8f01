"""Raw text to the standard form, and sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.spec import check
from checks.tables import CTES
from fieldform import scale
from fieldform.functions import parse
from fieldform.operators import cohorts, metrics, quality, relative, standardize
from fieldform.plans.panels import panel
from fieldform.plans.predictions import SPLITS, long_predictions, predictions, training_prior
from fieldform.sources import readers, records, snapshot, writers
from fieldform.sources.testtables import entries, table, whole_entries

KEYS = "contest_id:i subject_id:i "

# Raw text of entries and contests; the same expressions run in both engines.
RAW_ENTRY = {
    "rank_text": "CASE WHEN status = 'finished' THEN CAST(finish_position AS STRING) || CASE WHEN subject_id % 7 = 0 THEN '(2)' ELSE '' END "
    "WHEN status = 'dnf' THEN CASE WHEN subject_id % 2 = 0 THEN '中' ELSE '競走中止' END "
    "WHEN subject_id % 2 = 0 THEN ' 取 ' ELSE '除外' END",
    "time_text": "CASE WHEN time_s IS NULL THEN '' ELSE CAST(CAST(floor(round(time_s * 10) / 600) AS INT) AS STRING) || ':' || "
    "lpad(CAST(CAST(floor(round(time_s * 10) / 10) AS INT) % 60 AS STRING), 2, '0') || '.' || CAST(CAST(round(time_s * 10) AS INT) % 10 AS STRING) END",
    "passage": "CASE WHEN early_position IS NULL THEN '' ELSE CAST(early_position AS STRING) || '-' || CAST(entry_no AS STRING) END",
    "sex_age": "CASE subject_id % 5 WHEN 0 THEN '牡' WHEN 1 THEN '牝' WHEN 2 THEN 'セ' WHEN 3 THEN 'せん' ELSE '?' END || CAST(age AS STRING)",
    "weight_text": "CASE WHEN entry_no % 4 = 0 THEN '▲' WHEN entry_no % 4 = 1 THEN '☆' ELSE '' END || CAST(weight AS STRING) || "
    "CASE WHEN entry_no % 3 = 0 THEN 'kg' WHEN entry_no % 3 = 1 THEN '.5' ELSE '' END",
}
RAW_CONTEST = {
    "class_text": "CASE contest_class WHEN '1-URGENT' THEN 'オープン' WHEN '2-HIGH' THEN '3勝クラス' WHEN '3-MEDIUM' THEN '500万下' "
    "WHEN '4-NOT SPECIFIED' THEN '未勝利' END",
    "title": "CASE WHEN contest_id % 17 = 0 THEN '東京障害' WHEN contest_id % 19 = 0 THEN '記念(G2)' WHEN contest_id % 23 = 0 THEN NULL "
    "WHEN contest_id % 29 = 0 THEN 'メイクデビュー新馬' ELSE '特別' END",
    "key_text": "CAST(year(contest_date) AS STRING) || lpad(CAST(venue + 1 AS STRING), 2, '0') || '03' || "
    "lpad(CAST(contest_id % 8 + 1 AS STRING), 2, '0') || lpad(CAST(contest_id % 12 + 1 AS STRING), 2, '0')",
    "course_text": "CASE WHEN contest_id % 31 = 0 THEN NULL WHEN surface = 'turf' THEN '芝' WHEN surface = 'dirt' THEN 'ダ' END",
    "official_kind": "CASE WHEN contest_id % 17 = 0 THEN CASE WHEN contest_id % 2 = 0 THEN 'obstacle' END WHEN contest_id % 3 = 0 THEN 'flat' END",
}
CTES["raw_entry"] = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in RAW_ENTRY.items()) + " FROM entries"
CTES["raw_contest"] = (
    "SELECT contest_id, contest_date, venue, surface, distance_m, contest_class, year(contest_date) AS year, "
    + ", ".join(f"{e} AS {n}" for n, e in RAW_CONTEST.items())
    + " FROM (SELECT DISTINCT contest_id, contest_date, venue, surface, distance_m, contest_class FROM entries)"
)


def raw_entry(spark, sf):
    return entries(spark, sf).select("*", *[F.expr(e).alias(n) for n, e in RAW_ENTRY.items()])


def raw_contest(spark, sf):
    heads = entries(spark, sf).select("contest_id", "contest_date", "venue", "surface", "distance_m", "contest_class").distinct()
    return heads.select("*", F.year("contest_date").alias("year"), *[F.expr(e).alias(n) for n, e in RAW_CONTEST.items()])


@check(
    "decompose_key",
    "key_text:s key_year:i key_venue:i key_meeting:i key_day:i key_no:i",
    "SELECT key_text, year AS key_year, venue + 1 AS key_venue, 3 AS key_meeting, contest_id % 8 + 1 AS key_day, contest_id % 12 + 1 AS key_no FROM raw_contest",
)
def _(spark, sf):
    return standardize.decompose_key(raw_contest(spark, sf), "key_text")


@check(
    "key_conflicts",
    "rule:s conflicts:i",
    "SELECT 'venue' AS rule, count(CASE WHEN contest_id % 40 = 0 THEN 1 END) AS conflicts FROM raw_contest UNION ALL SELECT 'year', 0",
)
def _(spark, sf):
    rows = standardize.decompose_key(raw_contest(spark, sf), "key_text")
    rows = rows.withColumn("venue", F.col("venue") + 1 + F.when(F.col("contest_id") % 40 == 0, 1).otherwise(0))
    return standardize.conflict_counts(rows, {"venue": ("key_venue", "venue"), "year": ("key_year", "year")})


@check(
    "parse_status",
    KEYS + "position:f status:s is_starter:i",
    """SELECT contest_id, subject_id, finish_position AS position, CASE WHEN status = 'scratched' AND subject_id % 2 = 0 THEN 'nonstarter'
  WHEN status = 'scratched' THEN 'excluded' ELSE status END AS status, CAST(status <> 'scratched' AS INT) AS is_starter FROM raw_entry""",
)
def _(spark, sf):
    return raw_entry(spark, sf).select("contest_id", "subject_id", parse.parse_status("rank_text").alias("r")).select("contest_id", "subject_id", "r.*")


@check("parse_time", KEYS + "seconds:f", "SELECT contest_id, subject_id, time_s AS seconds FROM raw_entry")
def _(spark, sf):
    return raw_entry(spark, sf).withColumn("seconds", parse.parse_time("time_text"))


@check(
    "parse_first_rank",
    KEYS + "early:f",
    "SELECT contest_id, subject_id, CASE WHEN turn_direction <> 'straight' THEN early_position END AS early FROM raw_entry",
)
def _(spark, sf):
    return raw_entry(spark, sf).withColumn("early", parse.parse_first_rank("passage", "turn_direction"))


@check(
    "parse_sex_age",
    KEYS + "sex:s age:f",
    """SELECT contest_id, subject_id, CASE subject_id % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 4 THEN 'U' ELSE 'G' END AS sex,
  CASE WHEN subject_id % 5 <> 4 THEN age END AS age FROM raw_entry""",
)
def _(spark, sf):
    return raw_entry(spark, sf).select("contest_id", "subject_id", parse.parse_sex_age("sex_age").alias("r")).select("contest_id", "subject_id", "r.*")


@check(
    "parse_weight",
    KEYS + "kg:f",
    "SELECT contest_id, subject_id, weight + CASE WHEN entry_no % 3 = 1 THEN 0.5 ELSE 0 END AS kg FROM raw_entry",
)
def _(spark, sf):
    return raw_entry(spark, sf).withColumn("kg", parse.parse_weight("weight_text"))


@check(
    "normalize_category",
    "contest_id:i contest_kind:s surface_kind:s",
    """SELECT contest_id, CASE WHEN contest_id % 29 = 0 AND contest_id % 17 <> 0 AND contest_id % 19 <> 0 AND contest_id % 23 <> 0 THEN 'Newcomer'
  WHEN contest_class = '4-NOT SPECIFIED' THEN 'Maiden' WHEN contest_class = '3-MEDIUM' THEN 'Class1' WHEN contest_class = '2-HIGH' THEN 'Class3'
  WHEN contest_class = '1-URGENT' THEN 'Open' WHEN contest_id % 19 = 0 AND contest_id % 17 <> 0 THEN 'Open' ELSE 'Other' END AS contest_kind,
  CASE course_text WHEN '芝' THEN 'turf' WHEN 'ダ' THEN 'dirt' END AS surface_kind FROM raw_contest""",
)
def _(spark, sf):
    return raw_contest(spark, sf).select(
        "contest_id",
        parse.contest_class("class_text", "title", "Other").alias("contest_kind"),
        parse.map_values("course_text", parse.SURFACES).alias("surface_kind"),
    )


@check(
    "regex_flags",
    "contest_id:i is_obstacle:f is_graded:f",
    """SELECT contest_id, CASE WHEN title IS NOT NULL THEN CAST(contest_id % 17 = 0 AS INT) END AS is_obstacle,
  CASE WHEN title IS NOT NULL THEN CAST(contest_id % 19 = 0 AND contest_id % 17 <> 0 AS INT) END AS is_graded FROM raw_contest""",
)
def _(spark, sf):
    patterns = {"is_obstacle": parse.OBSTACLE_PATTERN, "is_graded": parse.GRADE_PATTERN}
    return standardize.regex_flags(raw_contest(spark, sf), "title", patterns)


OFFICIAL = {
    "official_surface": "CASE WHEN contest_id % 6 = 0 THEN surface END",
    "source_surface": "CASE WHEN contest_id % 9 = 0 THEN 'turf' WHEN contest_id % 5 <> 0 THEN surface END",
    "official_distance": "distance_m + CASE WHEN contest_id % 10 = 0 THEN 100 ELSE 0 END",
    "source_distance": "CASE WHEN contest_id % 4 <> 0 THEN distance_m END",
}
CTES["two_sources"] = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in OFFICIAL.items()) + " FROM raw_contest"
MERGED = {"final_surface": ("official_surface", "source_surface"), "final_distance": ("source_distance", "official_distance")}


def two_sources(spark, sf):
    return raw_contest(spark, sf).select("*", *[F.expr(e).alias(n) for n, e in OFFICIAL.items()])


@check(
    "merge_authoritative",
    "contest_id:i final_surface:s final_distance:i",
    "SELECT contest_id, coalesce(official_surface, source_surface) AS final_surface, coalesce(source_distance, official_distance) AS final_distance FROM two_sources",
)
def _(spark, sf):
    return standardize.merge_authoritative(two_sources(spark, sf), MERGED)[0]


@check(
    "merge_conflicts",
    "contest_id:i column_name:s kept:s rejected:s",
    """SELECT contest_id, 'final_surface' AS column_name, official_surface AS kept, source_surface AS rejected FROM two_sources WHERE official_surface <> source_surface
UNION ALL SELECT contest_id, 'final_distance', CAST(source_distance AS VARCHAR), CAST(official_distance AS VARCHAR) FROM two_sources WHERE source_distance <> official_distance""",
)
def _(spark, sf):
    return standardize.merge_authoritative(two_sources(spark, sf), MERGED)[1]


@check(
    "apply_overrides",
    "contest_id:i distance_m:i distance_m_source:s",
    """SELECT contest_id, CASE WHEN contest_id % 37 = 0 THEN 1234 ELSE distance_m END AS distance_m,
  CASE WHEN contest_id % 37 = 0 THEN 'override' ELSE 'computed' END AS distance_m_source FROM raw_contest""",
)
def _(spark, sf):
    rows = raw_contest(spark, sf)
    fixes = rows.filter("contest_id % 37 = 0").select("contest_id", F.lit(1234).alias("distance_m"))
    return standardize.apply_overrides(rows, fixes, "contest_id", ["distance_m"])


@check(
    "recover_metadata",
    KEYS + "surface:s distance_m:f recovered:i",
    """
WITH e AS (SELECT *, CASE WHEN contest_id % 31 = 0 THEN NULL ELSE surface END AS s2, CASE WHEN contest_id % 31 = 0 THEN NULL ELSE distance_m END AS d2,
  min(CASE WHEN finish_position = 1 THEN time_s END) OVER (PARTITION BY contest_id) AS best FROM entries)
----
SELECT contest_id, subject_id, CASE WHEN s2 IS NULL AND best < 63 THEN 'turf' ELSE s2 END AS surface,
  CASE WHEN s2 IS NULL AND best < 63 THEN 1000 ELSE d2 END AS distance_m, CAST(coalesce(s2 IS NULL AND best < 63, false) AS INT) AS recovered FROM e""",
)
def _(spark, sf):
    hole = F.col("contest_id") % 31 == 0
    rows = entries(spark, sf).withColumns({c: F.when(~hole, F.col(c)) for c in ("surface", "distance_m")})
    return standardize.recover_metadata(rows, "surface", {"surface": F.lit("turf"), "distance_m": F.lit(1000)}, 63.0)


KINDS = """
WITH k AS (SELECT contest_id, CASE WHEN official_kind IS NOT NULL THEN official_kind WHEN title LIKE '%障害%' THEN 'obstacle'
  WHEN course_text IS NOT NULL THEN 'flat' ELSE 'unknown' END AS kind FROM raw_contest)
----
"""


def kinds(spark, sf):
    rows = standardize.regex_flags(raw_contest(spark, sf), "title", {"is_obstacle": parse.OBSTACLE_PATTERN})
    rows = rows.withColumn("surface", parse.map_values("course_text", parse.SURFACES))
    return standardize.classify_contests(rows, "official_kind", "is_obstacle")


@check("classify_contests", "contest_id:i kind:s", KINDS + "SELECT * FROM k WHERE kind <> 'unknown'")
def _(spark, sf):
    return kinds(spark, sf)[0]


@check("classify_quarantine", "contest_id:i kind:s", KINDS + "SELECT * FROM k WHERE kind = 'unknown'")
def _(spark, sf):
    return kinds(spark, sf)[1]


REASONS = """
WITH z AS (SELECT *, CASE WHEN title LIKE '%障害%' THEN 'obstacle' WHEN course_text IS NULL THEN 'missing_surface' ELSE 'included' END AS reason FROM raw_contest)
----
"""


def excluded(spark, sf):
    rules = {"obstacle": F.col("title").rlike(parse.OBSTACLE_PATTERN), "missing_surface": F.col("course_text").isNull()}
    return standardize.exclusion_reasons(raw_contest(spark, sf), rules)


@check("exclusion_reasons", "contest_id:i reason:s", REASONS + "SELECT * FROM z WHERE reason <> 'included'")
def _(spark, sf):
    return excluded(spark, sf)[0]


@check(
    "exclusion_counts",
    "year:i contests:i obstacle:i missing_surface:i included:i",
    REASONS + "SELECT year, count(*) AS contests, count(CASE WHEN reason = 'obstacle' THEN 1 END) AS obstacle, "
    "count(CASE WHEN reason = 'missing_surface' THEN 1 END) AS missing_surface, count(CASE WHEN reason = 'included' THEN 1 END) AS included FROM z GROUP BY year",
)
def _(spark, sf):
    return excluded(spark, sf)[1]


@check("normalize_name", "c_custkey:i name:s", "SELECT c_custkey, replace(c_name, ' ', '') AS name FROM customer")
def _(spark, sf):
    wide = F.translate("c_name", "0123456789#", "０１２３４５６７８９＃")
    return table(spark, sf, "customer").select("c_custkey", parse.nfkc(F.concat(F.lit("　"), wide)).alias("name"))


# --- sources and sinks ----------------------------------------------------------------

SPLIT_SQL = (
    "CASE WHEN year(contest_date) <= 1996 THEN 'warmup' WHEN year(contest_date) <= 1999 THEN 'train' "
    "WHEN year(contest_date) = 2000 THEN 'validation' ELSE 'test' END"
)


def export(spark, sf):
    """Write the panel by split and year; returns the folder and the manifest."""
    path = scale.new_folder(spark, "export")
    rows = cohorts.with_split(panel(spark, sf), SPLITS).withColumn("year", F.year("contest_date"))
    rows = rows.select("contest_id", "subject_id", "label", "career_starts", "rel_time", "split", "year")
    return path, writers.write_partitioned(rows, path, ["split", "year"])


@check(
    "read_panel",
    KEYS + "label:i career_starts:i rel_time:f year:i",
    "SELECT *, year(contest_date) AS year FROM panel WHERE year(contest_date) BETWEEN 1997 AND 1999",
)
def _(spark, sf):
    path, _ = export(spark, sf)
    schema = T.StructType.fromDDL("contest_id string, subject_id string, label int, career_starts long, rel_time double, split string, year int")
    return readers.read_panel(spark, path, schema).filter("split = 'train'")


@check(
    "write_partitioned",
    "split:s year:i rows:i contests:i",
    f"SELECT {SPLIT_SQL} AS split, year(contest_date) AS year, count(*) AS rows, count(DISTINCT contest_id) AS contests FROM starters GROUP BY 1, 2",
)
def _(spark, sf):
    return export(spark, sf)[1]


@check(
    "read_entries_csv",
    "contest_id:s subject_id:s contest_date:d time_s:f win_odds:f surface:s",
    "SELECT lpad(CAST(contest_id AS VARCHAR), 12, '0') AS contest_id, subject_id, contest_date, time_s, win_odds, surface FROM entries",
)
def _(spark, sf):
    path = scale.new_folder(spark, "csv")
    cols = ["subject_id", "contest_date", "time_s", "win_odds", "surface", "status"]
    rows = entries(spark, sf).select(F.lpad(F.col("contest_id").cast("string"), 12, "0").alias("contest_id"), *cols)
    rows.write.mode("overwrite").option("header", True).csv(path)
    schema = T.StructType.fromDDL("contest_id string, subject_id string, contest_date date, time_s double, win_odds double, surface string, status string")
    return readers.read_entries_csv(spark, path, schema, ["contest_id", "subject_id", "contest_date", "time_s", "win_odds", "surface"])


LINE = (
    "CAST(c_custkey AS STRING) || ',' || c_mktsegment || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ',' || "
    "CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE CAST(c_nationkey AS STRING) END END || CASE WHEN c_custkey % 13 = 0 THEN ',extra' ELSE '' END"
)
# A line that is short by one field and long by one field has the right width but the wrong type.
BROKEN = "(c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0)"


def lines(spark, sf):
    text = table(spark, sf, "customer").select(F.expr(LINE).alias("value"))
    schema = T.StructType.fromDDL("c_custkey bigint, c_mktsegment string, c_nationkey int")
    return readers.quarantine_malformed(text, schema, scope=F.col("value").contains("BUILDING"))


@check("quarantine_good", "c_custkey:i c_mktsegment:s c_nationkey:i", f"SELECT * FROM customer WHERE NOT {BROKEN}")
def _(spark, sf):
    return lines(spark, sf)[0]


@check(
    "quarantine_malformed",
    "lines:i malformed:i malformed_in_scope:i",
    f"SELECT count(*) AS lines, count(CASE WHEN {BROKEN} THEN 1 END) AS malformed, "
    f"count(CASE WHEN {BROKEN} AND c_mktsegment = 'BUILDING' THEN 1 END) AS malformed_in_scope FROM customer",
)
def _(spark, sf):
    return lines(spark, sf)[2]


def snapshot_parts(spark, sf):
    audit = whole_entries(spark, sf)
    ledger = audit.select("contest_id", "contest_date").distinct()
    return audit, audit.filter("status <> 'scratched' AND NOT (venue = 5 AND contest_date >= DATE '2001-01-01')"), ledger


@check(
    "publish_snapshot",
    "table_name:s rows:i through:s complete_through:s missing_contests:i",
    """
WITH c AS (SELECT DISTINCT contest_id, contest_date FROM entries WHERE venue = 5 AND contest_date >= DATE '2001-01-01' AND contest_date <= DATE '2001-06-30'),
t AS (SELECT count(*) AS m, CAST(CAST(coalesce(min(contest_date) - INTERVAL 1 DAY, DATE '2001-06-30') AS DATE) AS VARCHAR) AS d FROM c)
----
SELECT n.table_name, n.rows, '2001-06-30' AS through, t.d AS complete_through, t.m AS missing_contests FROM (
  SELECT 'history' AS table_name, count(*) AS rows FROM entries WHERE status <> 'scratched' AND NOT (venue = 5 AND contest_date >= DATE '2001-01-01')
  UNION ALL SELECT 'audit', count(*) FROM entries UNION ALL SELECT 'ledger', count(DISTINCT contest_id) FROM entries) n, t""",
)
def _(spark, sf):
    audit, history, ledger = snapshot_parts(spark, sf)
    root = scale.new_folder(spark, "snapshots")
    return snapshot.publish_snapshot(history, audit, ledger, root, "2001-06-30")


def merged(spark, sf):
    rows = whole_entries(spark, sf)
    early, late = rows.filter("contest_date < DATE '1998-01-01'"), rows.filter("contest_date >= DATE '1998-01-01'")
    again = rows.filter("contest_id % 211 = 0 AND contest_date < DATE '1998-01-01'")
    published = rows.filter("contest_id % 101 = 0 AND contest_id % 211 <> 0").withColumn("age", F.col("age") + F.when(F.col("subject_id") % 9 == 0, 1).otherwise(0))
    ledger = rows.filter("venue <> 8").select("contest_id", "contest_date").distinct()
    return snapshot.merge_shards([early, late, again.drop("win_odds")], ledger, published)


@check(
    "merge_shards",
    "rule:s violations:i",
    """SELECT 'repeated_subject' AS rule, count(*) AS violations FROM entries WHERE contest_id % 211 = 0 AND contest_date < DATE '1998-01-01'
UNION ALL SELECT 'repeated_number', count(*) FROM entries WHERE contest_id % 211 = 0 AND contest_date < DATE '1998-01-01'
UNION ALL SELECT 'missing_contest', 0 UNION ALL SELECT 'unknown_contest', count(DISTINCT contest_id) FROM entries WHERE venue = 8
UNION ALL SELECT 'published_fact_changed', count(*) FROM entries WHERE contest_id % 101 = 0 AND contest_id % 211 <> 0 AND subject_id % 9 = 0""",
)
def _(spark, sf):
    return merged(spark, sf)[1]


@check(
    "merge_shards_rows",
    "contest_id:i rows:i",
    "SELECT contest_id, count(*) * CASE WHEN contest_id % 211 = 0 AND contest_date < DATE '1998-01-01' THEN 2 ELSE 1 END AS rows FROM entries GROUP BY contest_id, contest_date",
)
def _(spark, sf):
    return merged(spark, sf)[0].groupBy("contest_id").agg(F.count("*").alias("rows"))


@check(
    "report_bundle",
    "part:s candidate:s level:s rows:i value:f",
    """
WITH rk AS (SELECT candidate, p, label, row_number() OVER (PARTITION BY candidate ORDER BY p, contest_id, subject_id) AS r,
  count(*) OVER (PARTITION BY candidate) AS n FROM preds)
----
SELECT 'scores' AS part, candidate, 'all' AS level, rows, macro_brier AS value FROM scores
UNION ALL SELECT 'paired', l.candidate, 'all', count(*), avg(l.brier - r.brier) FROM losses l JOIN losses r ON r.contest_id = l.contest_id
WHERE r.candidate = 'uniform' GROUP BY 2
UNION ALL SELECT 'losses', candidate, CAST(contest_id AS VARCHAR), rows, brier FROM losses
UNION ALL SELECT 'reliability', candidate, CAST(CAST(greatest(ceil((r - 1) * 10 / (n - 1.0)) - 1, 0) AS BIGINT) AS VARCHAR), count(*), avg(label) - avg(p)
FROM rk GROUP BY 2, 3
UNION ALL SELECT 'folds', candidate, CAST(year(block) AS VARCHAR), sum(rows), count(*) FROM losses GROUP BY 2, 3""",
)
def _(spark, sf):
    out = scale.new_folder(spark, "report")
    writers.report_bundle(long_predictions(predictions(spark, sf)), "uniform", out)
    shown = {
        "scores": (F.lit("all"), "rows", "macro_brier"),
        "paired": (F.lit("all"), "contests", "mean_brier_delta"),
        "losses": (F.col("contest_id").cast("string"), "rows", "brier"),
        "reliability": (F.col("bin").cast("string"), "rows", "gap"),
        "folds": (F.col("year").cast("string"), "rows", "contests"),
    }
    parts = [
        spark.read.parquet(f"{out}/{part}").select(
            F.lit(part).alias("part"), "candidate", level.alias("level"), F.col(rows).alias("rows"), F.col(value).cast("double").alias("value")
        )
        for part, (level, rows, value) in shown.items()
    ]
    return reduce(DataFrame.unionByName, parts)


FAMILIES = {"career_shrunk": "history", "turf_shrunk": "history", "draw_pct": "entry", "front_share": "field"}
COEFFICIENTS = {"career_shrunk": 2.0, "turf_shrunk": 1.0, "draw_pct": -0.5, "front_share": 0.25}


@check(
    "importance_rollup",
    "scope:s year:s grain:s name:s rows:i mean_abs:f mean_signed:f nonzero_share:f share_of_total:f",
    """
WITH c AS (SELECT contest_id, subject_id, surface, CAST(year(contest_date) AS VARCHAR) AS year, u.f, u.fam, coalesce(u.v, 0) AS v FROM engineered,
  LATERAL (VALUES ('career_shrunk', 'history', 2.0 * career_shrunk), ('turf_shrunk', 'history', turf_shrunk), ('draw_pct', 'entry', -0.5 * draw_pct),
  ('front_share', 'field', 0.25 * front_share)) u(f, fam, v)),
g AS (SELECT contest_id, subject_id, surface, year, 'feature' AS grain, f AS name, v FROM c
  UNION ALL SELECT contest_id, subject_id, surface, year, 'family', fam, sum(v) FROM c GROUP BY contest_id, subject_id, surface, year, fam),
s AS (SELECT surface AS scope, coalesce(year, 'ALL') AS year, grain, name, count(*) AS rows, avg(abs(v)) AS mean_abs, avg(v) AS mean_signed,
  count(CASE WHEN v <> 0 THEN 1 END) / count(*) AS nonzero_share FROM g GROUP BY GROUPING SETS ((surface, year, grain, name), (surface, grain, name)))
----
SELECT *, mean_abs / sum(mean_abs) OVER (PARTITION BY scope, year, grain) AS share_of_total FROM s""",
)
def _(spark, sf):
    rows = panel(spark, sf)
    rows = relative.engineer_features(rows, training_prior(rows)).withColumn("year", F.year("contest_date").cast("string"))
    items = [
        F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f) * c, F.lit(0.0)).alias("contribution"))
        for f, c in COEFFICIENTS.items()
    ]
    long = rows.select("contest_id", "subject_id", F.col("surface").alias("scope"), "year", F.explode(F.array(*items)).alias("_i"))
    return metrics.importance_rollup(long.select("contest_id", "subject_id", "scope", "year", "_i.*"), FAMILIES)


@check(
    "lock_conflicts",
    "rule:s violations:i",
    "SELECT 'repeated_versions' AS rule, count(DISTINCT contest_id) AS violations FROM wide WHERE contest_id % 43 = 0 UNION ALL SELECT 'changed_models', 1",
)
def _(spark, sf):
    locked = predictions(spark, sf).select(
        "contest_id", F.lit("a").alias("lock_id"), F.when(F.col("contest_id") % 2 == 0, "m1").otherwise("m2").alias("model_hash")
    )
    second = locked.filter("contest_id % 43 = 0").withColumn("lock_id", F.lit("b"))
    return quality.lock_conflicts(locked.unionByName(second))


# --- JSON records -----------------------------------------------------------------------

RECORD = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("detail", T.StructType([T.StructField("k", T.LongType())])),
    ]
)


def record_lines(spark, sf):
    """Events as JSON lines; one in fifty is broken in each of six ways."""
    whole = F.concat(
        F.lit('{"event_id": '), "event_id", F.lit(', "user_id": '), "user_id", F.lit(', "kind": "'), "event_type", F.lit('", "amount": '),
        F.col("value").cast("string"), F.lit(', "detail": '), "props", F.lit("}"),
    )
    turn = F.col("event_id") % 50
    text = (
        F.when(turn == 1, F.substring(whole, 1, 20))
        .when(turn == 2, F.regexp_replace(whole, '"user_id": ', '"user_id": "u" , "user": '))
        .when(turn == 3, F.regexp_replace(whole, '"user_id": [0-9]+, ', ""))
        .when(turn == 4, F.regexp_replace(whole, r"\}$", ', "note": 1}'))
        .when(turn == 5, F.lit("  "))
        .when(turn == 6, F.concat(F.lit("["), whole, F.lit("]")))
        .otherwise(whole)
    )
    return table(spark, sf, "events").select(text.alias("value"))


def json_records(spark, sf):
    return records.read_records(record_lines(spark, sf), RECORD, ["event_id", "user_id"])


WHOLE = (
    "SELECT event_id, user_id, event_type AS kind, value AS amount, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events "
    "WHERE event_id % 50 NOT BETWEEN 1 AND 6"
)


@check("json_records", "event_id:i user_id:i kind:s amount:f k:i", WHOLE)
def _(spark, sf):
    return json_records(spark, sf)[0].withColumn("k", F.col("detail.k"))


@check(
    "json_quarantine",
    "reason:s field:s lines:i",
    """SELECT CASE event_id % 50 WHEN 2 THEN 'wrong_type' WHEN 3 THEN 'missing_field' WHEN 4 THEN 'unknown_field' WHEN 5 THEN 'empty'
  ELSE 'not_an_object' END AS reason, CASE event_id % 50 WHEN 3 THEN 'user_id' WHEN 4 THEN 'note' END AS field, count(*) AS lines
FROM events WHERE event_id % 50 BETWEEN 1 AND 6 GROUP BY 1, 2""",
)
def _(spark, sf):
    return json_records(spark, sf)[1].groupBy("reason", "field").agg(F.count("*").alias("lines"))


@check("json_round_trip", "event_id:i user_id:i kind:s amount:f k:i", WHOLE)
def _(spark, sf):
    written = records.write_records(json_records(spark, sf)[0])
    return records.read_records(written, RECORD, ["event_id", "user_id"])[0].withColumn("k", F.col("detail.k"))
