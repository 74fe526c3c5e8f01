"""Parsing, contracts, reconciliation, snapshots, updates and model plans."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldform import contracts
from fieldform.functions import contest as fc
from fieldform.functions import parse
from fieldform.functions.probability import apply_logit_calibrator, beta_shrink, field_size_baseline
from fieldform.operators import cohorts, history, joins, quality, relative
from fieldform.plans import evaluation, models
from fieldform.plans.models import Recipe
from fieldform.scale import materialize
from fieldform.sources import readers, snapshot, writers
from fieldform.streaming.updates import apply_update, follow_shards
from tests.helpers import SCHEMA, by_key, declared, entry, field, rotating


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


# --- parsing --------------------------------------------------------------------------


def test_status_texts(spark):
    got = one(spark, parse.parse_status("x"), "1", "12(3)", "", None, "取", "除外", "中", "競走中止", "失格", "??")
    assert [(r["position"], r["status"], r["is_starter"]) for r in got] == [
        (1, "finished", True), (12, "finished", True), (None, "nonstarter", False), (None, "nonstarter", False),
        (None, "nonstarter", False), (None, "excluded", False), (None, "dnf", True), (None, "dnf", True),
        (None, "disqualified", True), (None, "other:??", True),
    ]


def test_time_texts(spark):
    assert one(spark, parse.parse_time("x"), "1:34.5", "58.9", "", "1:34.5 (3)", None) == [94.5, 58.9, None, None, None]
    assert one(spark, parse.parse_time("x", whole=False), "1:34.5 1/2", "58.9") == [94.5, 58.9]


def test_sex_age_weight_and_passage(spark):
    assert [tuple(r) for r in one(spark, parse.parse_sex_age("x"), "牡3", "せん5", "セ 4", "?")] == [("M", 3), ("G", 5), ("G", 4), ("U", None)]
    assert one(spark, parse.parse_weight("x"), "▲52", "☆◇54.5kg", "x") == [52.0, 54.5, None]
    assert one(spark, parse.parse_first_rank("x"), "10-9-8", " 3", "") == [10, 3, None]
    assert one(spark, parse.parse_first_rank("x", F.lit("直線")), "10-9") == [None]


def test_names_are_normalized(spark):
    assert one(spark, parse.nfkc("x"), "ＡＢＣ　１２", "ｱｲ", None) == ["ABC12", "アイ", None]


def test_boundaries(spark):
    assert one(spark, fc.distance_regime("x"), 1400, 1401, 2000, 2600, 2601, None, kind="int") == [0, 1, 1, 2, 3, None]
    assert one(spark, fc.pace_label("x"), 0.2, 0.45, 0.7, 0.71, None, 1.2, kind="double") == [
        "front", "forward_mid", "mid_rear", "deep_rear", None, None,
    ]
    assert one(spark, fc.right_closed("x", fc.FIELD_BANDS, "17+"), 11, 12, 16, 17, None, kind="int") == [
        "<=11", "12-14", "15-16", "17+", "UNKNOWN",
    ]
    assert one(spark, fc.course_mask("x"), "STRAIGHT", "直線", "left", None) == [True, True, False, False]


def test_shrinkage(spark):
    df = spark.createDataFrame([(0, 0), (3, 4), (None, 4)], "s int, n int")
    got = [r[0] for r in df.select(beta_shrink("s", "n", 0.2)).collect()]
    assert got == [pytest.approx(0.2), pytest.approx(4.2 / 10), None]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(5, 4)], "s int, n int").select(beta_shrink("s", "n", 0.2)).collect()


def test_baseline_and_calibrator(spark):
    assert one(spark, field_size_baseline("x"), 3, 4, 12, kind="int") == [None, 0.75, 0.25]
    identity = apply_logit_calibrator(F.col("x"), F.lit(0.0), F.lit(1.0))
    assert one(spark, identity, 0.1, 0.7, kind="double") == [pytest.approx(0.1), pytest.approx(0.7)]


# --- contracts and joins --------------------------------------------------------------


def test_contracts(spark):
    df = spark.range(1).withColumn("Final_Odds", F.lit(1))
    with pytest.raises(contracts.ContractError):
        contracts.forbid_columns(df)
    with pytest.raises(contracts.ContractError):
        contracts.allowlist_export(df, ["id", "missing"])
    with pytest.raises(contracts.ContractError):
        contracts.forbid_outcomes(df.withColumn("label", F.lit(1)))


def test_checked_join_refuses_wrong_cardinality(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(1, 1), (1, 2)], "k int, y int")
    with pytest.raises(contracts.ContractError):
        joins.checked_join(a, b, "k")
    assert joins.checked_join(a, b, "k", "inner", "1:m").count() == 2
    with pytest.raises(contracts.ContractError):
        joins.checked_join(a, b.limit(1), "k", complete=True)


def test_leave_one_out_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.4), (1, 3, None), (2, 1, 0.9)], "contest_id long, subject_id long, x double")
    got = by_key(relative.loo_mean(df, "x"), "x_others")
    assert got == {(1, 1): pytest.approx(0.4), (1, 2): pytest.approx(0.2), (1, 3): None, (2, 1): None}


def test_relative_ability_uses_ineligible_peers(spark):
    panel = history.build_panel(field(spark, rotating(5)))
    one_entry = panel.filter("contest_id = 4 AND subject_id = 0")
    out = relative.relative_ability(one_entry, panel, 0.3)
    assert out.count() == 1 and out.first()["rel_career"] is not None


def test_routing(spark):
    routing = spark.createDataFrame(
        [("turf", 1000, 1400, "short", False), ("turf", 1401, 2000, "mid", False), ("turf", 1200, 1200, "exact", True)],
        "surface string, lo int, hi int, model_id string, is_override boolean",
    )
    rows = [(1, 1200, 8, "left"), (2, 1400, 8, "left"), (3, 1401, 8, None), (4, 2200, 8, "left"), (5, 1400, 7, "left"), (6, 1400, 9, "straight")]
    df = spark.createDataFrame([(i, "turf", d, f, t) for i, d, f, t in rows], "contest_id int, surface string, distance_m int, field_size int, turn_direction string")
    got = {r["contest_id"]: r["model_id"] for r in cohorts.assign_route(df, routing).collect()}
    assert got == {1: "exact", 2: "short", 3: "mid", 4: None, 5: None, 6: None}


def test_entities(spark):
    known = spark.createDataFrame([("A", "1"), ("B", "2"), ("B", "3")], "name string, subject_id string")
    new = spark.createDataFrame([("A", "9"), ("B", "3"), ("B", "7"), ("C", "5")], "name string, official_id string")
    got = sorted((r["name"], r["official_id"], r["resolved_id"], r["resolution"]) for r in joins.resolve_entities(new, known).collect())
    assert got == [("A", "9", "1", "mapped"), ("B", "3", "3", "official"), ("B", "7", None, "unresolved"), ("C", "5", "new:5", "new")]


def test_roster_violations(spark):
    roster = declared(spark, rotating(1, 4)).drop("finish_position", "time_s", "early_position")
    assert quality.validate_roster(roster).count() == 0
    broken = roster.withColumn("entry_no", F.when(F.col("subject_id") == 0, 9).otherwise(F.col("entry_no")))
    assert {r["rule"] for r in quality.validate_roster(broken).collect()} == {"invalid_number"}
    with pytest.raises(contracts.ContractError):
        quality.validate_roster(declared(spark, rotating(1, 4)))


def test_events_must_be_verified(spark):
    ledger = declared(spark, rotating(2)).select("contest_id", "contest_date").distinct()
    event = ledger.filter("contest_id = 1").selectExpr("*", "'abandoned' status", "'https://x' url", "'fog' reason")
    ledger = quality.build_ledger(ledger)
    assert quality.expected_results(quality.apply_events(ledger, event)).count() == 1
    for change in ({"status": F.lit("lost")}, {"url": F.lit("ftp://x")}, {"contest_date": F.date_add("contest_date", 1)}):
        with pytest.raises(PySparkException):
            quality.apply_events(ledger, event.withColumns(change)).collect()


def test_window_is_collecting_until_all_thresholds(spark):
    rows = declared(spark, rotating(10, gap=10))
    assert quality.first_qualifying_window(rows, 4, 4, 30).first()["window_end"].isoformat() == "2000-01-31"
    late = quality.first_qualifying_window(rows, 11, 1, 1).first()
    assert (late["status"], late["window_end"], late["contests"]) == ("collecting", None, 10)


# --- sources, snapshots, updates ------------------------------------------------------


def test_malformed_lines(spark):
    lines = spark.createDataFrame([("1,a,2",), ("2,b",), ("3,c,4,5",), ("x,d,6",)], "value string")
    good, bad, counts = readers.quarantine_malformed(lines, T.StructType.fromDDL("a int, b string, c int"))
    assert [tuple(r) for r in good.collect()] == [(1, "a", 2)]
    assert bad.count() == 3 and counts.first()["malformed"] == 3


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b"\xef\xbb\xbf" + "id,n\n007,3\n".encode())
    df = readers.read_entries_csv(spark, str(path), T.StructType.fromDDL("id string, n int"))
    assert [tuple(r) for r in df.collect()] == [("007", 3)]


def test_partitioned_export_is_read_back_with_pruning(spark, tmp_path):
    rows = field(spark, rotating(6)).select("contest_id", "subject_id", "label", (F.col("contest_id") % 2).alias("split"))
    manifest = writers.write_partitioned(rows, str(tmp_path / "p"), ["split"])
    assert {r["split"]: (r["rows"], r["contests"]) for r in manifest.collect()} == {0: (15, 3), 1: (15, 3)}
    back = readers.read_panel(spark, str(tmp_path / "p"), T.StructType.fromDDL("contest_id string, label int, split int"))
    assert back.filter("split = 1").count() == 15


def test_snapshots_are_idempotent_and_checked(spark, tmp_path):
    root = str(tmp_path / "root")
    audit = declared(spark, rotating(4))
    ledger = audit.select("contest_id", "contest_date").distinct()
    first = snapshot.publish_snapshot(audit, audit, ledger, root, "2000-12-31").first()["snapshot_id"]
    again = snapshot.publish_snapshot(audit.orderBy("subject_id"), audit, ledger, root, "2000-12-31").first()["snapshot_id"]
    assert first == again and spark.read.parquet(f"{root}/pointer").count() == 1
    part = audit.filter("contest_id < 3")
    second = snapshot.publish_snapshot(part, audit, ledger, root, "2000-12-31").first()
    assert second["snapshot_id"] != first and second["complete_through"] == "2000-02-29" and second["missing_contests"] == 1
    assert snapshot.read_current(spark, root)[0].count() == 15
    with pytest.raises(contracts.ContractError):
        snapshot.publish_snapshot(audit.unionByName(audit), audit, ledger, root, "2000-12-31")
    with pytest.raises(contracts.ContractError):
        snapshot.publish_snapshot(audit, audit, ledger.filter("contest_id > 0"), root, "2000-12-31")
    part.write.mode("append").parquet(f"{root}/snapshots/{second['snapshot_id']}/history")
    with pytest.raises(contracts.ContractError):
        snapshot.read_current(spark, root)


def test_update_replaces_whole_contests(spark, tmp_path):
    root = str(tmp_path / "root")
    audit = declared(spark, rotating(3))
    ledger = audit.select("contest_id", "contest_date").distinct()
    apply_update(spark, audit, ledger, root, "2000-12-31")
    fresh = audit.filter("contest_id = 2 AND subject_id <> 0").withColumn("age", F.lit(9))
    apply_update(spark, fresh, ledger, root, "2000-12-31")
    rows = snapshot.read_current(spark, root)[1]
    assert rows.count() == 14 and rows.filter("age = 9").count() == 4


def test_stream_of_shards_ends_in_the_same_state(spark, tmp_path):
    audit = declared(spark, rotating(4))
    ledger = audit.select("contest_id", "contest_date").distinct()
    shards, root = str(tmp_path / "shards"), str(tmp_path / "root")
    for c in range(4):
        audit.filter(F.col("contest_id") == c).coalesce(1).write.mode("append").parquet(shards)
    query = follow_shards(
        spark, shards, T.StructType.fromDDL(SCHEMA), ledger, root, "2000-12-31", str(tmp_path / "cp"), files_per_batch=2
    )
    query.awaitTermination()
    rows = snapshot.read_current(spark, root)[1]
    diff = joins.table_diff(rows, audit, ["contest_id", "subject_id"]).filter("verdict <> 'equal'")
    assert rows.count() == 20 and diff.count() == 0


# --- models ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def panel(spark):
    kw = {"distance_m": [1200, 1400, 1600], "grp": ["a", "b"]}
    rows = materialize(field(spark, rotating(60, 6, 19, **kw)))
    return materialize(history.strict_prior_blocks(history.build_panel(rows)))


def test_fit_refuses_later_rows_and_reloads_equal(spark, panel, tmp_path):
    rows = panel.filter("career_starts >= 3")
    early, late = rows.filter("contest_date < DATE '2002-01-01'"), rows.filter("contest_date >= DATE '2002-01-01'")
    fitted = models.fit_linear(early, panel, extras=("relative", "near"))
    p = by_key(models.score(fitted, late, panel), "p")
    assert all(0 < x < 1 for x in p.values())
    models.save(fitted, str(tmp_path / "m"))
    again = by_key(models.score(models.load(str(tmp_path / "m")), late, panel), "p")
    assert again == {k: pytest.approx(x, abs=1e-12) for k, x in p.items()}
    with pytest.raises(PySparkException):
        models.score(fitted, early, panel).select("p").collect()


def test_contributions_add_up_to_the_logit(spark, panel):
    rows = panel.filter("career_starts >= 3")
    early, late = rows.filter("contest_date < DATE '2002-01-01'"), rows.filter("contest_date >= DATE '2002-01-01'")
    fitted = models.fit_linear(early, panel)
    long = models.linear_contributions(fitted, late, panel, ["contest_id", "subject_id"])
    total = by_key(long.groupBy("contest_id", "subject_id").agg(F.sum("contribution").alias("c")), "c")
    p = by_key(models.score(fitted, late, panel).withColumn("z", F.ln(F.col("p") / (1 - F.col("p")))), "z")
    b = fitted.model.stages[-1].intercept
    assert all(total[k] + b == pytest.approx(p[k], abs=1e-9) for k in p)


def test_folds_train_on_earlier_years_only(spark, panel):
    rows = panel.filter("career_starts >= 3")
    out = evaluation.expanding_oof(rows, panel, [2001, 2002], [Recipe("a"), Recipe("b", config={"C": 0.01})])
    assert {tuple(r) for r in out.select("candidate", F.year("contest_date")).distinct().collect()} == {
        ("a", 2001), ("a", 2002), ("b", 2001), ("b", 2002),
    }
    guard = evaluation.fold_guard(rows.filter("year(contest_date) < 2001"), rows.filter("year(contest_date) = 2001"), 2001)
    assert {r["violations"] for r in guard.collect()} == {0}


def test_unknown_blocks_and_levels_are_refused(spark, panel):
    with pytest.raises(contracts.ContractError):
        Recipe("x", extras=("nothing",)).columns()
    with pytest.raises(contracts.ContractError):
        relative.block_features(panel, panel, 0.3, ["nothing"])
