"""Snapshots of parts, agreement of sources and the leakage closure on planted rows."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.lifecycle_checks import outcome_changes
from fieldform.contracts import ContractError
from fieldform.operators import history, joins, quality
from fieldform.sources import parts
from fieldform.sources.fingerprint import row_fingerprint
from fieldform.streaming.updates import follow_parts
from tests.helpers import SCHEMA, declared, field, rotating


def files(root):
    return set(glob.glob(f"{root}/data/**/*.parquet", recursive=True))


@pytest.fixture()
def base(spark, tmp_path):
    audit = declared(spark, rotating(12))  # one contest every 20 days
    ledger = audit.select("contest_id", "contest_date").distinct()
    root = str(tmp_path / "root")
    return audit, ledger, root, parts.apply_parts(spark, audit, ledger, root)


def states(before, after, name):
    return {r.part: r.state for r in parts.changed_parts(before, after).filter(F.col("table_name") == name).collect()}


def same(got, want):
    return joins.table_diff(got, want, ["contest_id", "subject_id"]).filter("verdict <> 'equal'").count() == 0 and got.count() == want.count()


def test_an_update_of_one_day_rewrites_one_part(spark, base):
    audit, ledger, root, first = base
    held = files(root)
    fresh = audit.filter("contest_id = 3").withColumn("age", F.lit(9))
    second = parts.apply_parts(spark, fresh, ledger, root)
    assert sorted(states(first, second, "audit").values()) == ["kept"] * (first.filter("table_name = 'audit'").count() - 1) + ["written"]
    assert len(files(root) - held) == 2 and held <= files(root)  # one part of audit and of history
    want = audit.filter("contest_id <> 3").unionByName(fresh)
    tables = parts.read_parts(spark, root)
    assert same(tables["audit"], want) and same(tables["history"], want.filter("status = 'finished'"))
    # The version before is still there, and a table's fingerprint is the sum of its parts'.
    old = parts.read_manifest(spark, root, [r for r in glob.glob(f"{root}/manifests/*") if not r.endswith(parts.current_version(spark, root))][0].rsplit("/", 1)[1])
    assert same(parts.read_part_table(old, "audit", verify=True), audit)
    whole = row_fingerprint(want, sorted(want.columns)).first()
    assert parts.table_fingerprint(second, "audit") == (whole["rows"], whole["fingerprint"])


def test_same_content_is_the_same_version(spark, base):
    audit, ledger, root, first = base
    version = parts.current_version(spark, root)
    again = parts.apply_parts(spark, audit.filter("contest_id = 5"), ledger, root)
    assert parts.current_version(spark, root) == version
    assert set(states(first, again, "audit").values()) == {"kept"}
    assert spark.read.parquet(f"{root}/pointer").count() == 1


def test_moved_and_dropped_contests_touch_both_months(spark, base):
    audit, ledger, root, first = base
    moved = audit.filter("contest_id = 2").withColumn("contest_date", F.to_date(F.lit("2000-08-20")))
    plan = ledger.filter("contest_id NOT IN (0, 2)").unionByName(moved.select("contest_id", "contest_date").distinct())
    second = parts.apply_parts(spark, moved, plan, root)
    want = audit.filter("contest_id NOT IN (0, 2)").unionByName(moved)
    assert same(parts.read_parts(spark, root)["audit"], want)
    changed = {p for p, s in states(first, second, "audit").items() if s != "kept"}
    assert changed == {"2000-01", "2000-02", "2000-08"}
    assert second.filter("table_name = 'ledger'").agg(F.sum("rows")).first()[0] == 11


def test_refusals_and_damaged_parts(spark, base):
    audit, ledger, root, _ = base
    with pytest.raises(ContractError):
        parts.apply_parts(spark, audit.withColumn("contest_id", F.lit(99)), ledger, root)
    double = audit.filter("contest_id = 1")
    with pytest.raises(ContractError):
        parts.apply_parts(spark, double.unionByName(double), ledger, root)
    manifest = parts.read_manifest(spark, root)
    folder = manifest.filter("table_name = 'audit' AND part = '2000-01'").first()["folder"]
    audit.filter("contest_id = 7").write.mode("append").parquet(f"{folder}/part=2000-01")
    with pytest.raises(ContractError):
        parts.read_parts(spark, root)


def test_stream_reaches_the_same_state(spark, tmp_path):
    audit = declared(spark, rotating(5))
    ledger = audit.select("contest_id", "contest_date").distinct()
    shards, root = str(tmp_path / "shards"), str(tmp_path / "root")
    for c in range(5):
        audit.filter(F.col("contest_id") == c).coalesce(1).write.mode("append").parquet(shards)
    follow_parts(spark, shards, T.StructType.fromDDL(SCHEMA), ledger, root, str(tmp_path / "cp"), files_per_batch=2).awaitTermination()
    assert same(parts.read_parts(spark, root)["audit"], audit)
    assert parts.read_manifest(spark, str(tmp_path / "empty")) is None


# --- sources --------------------------------------------------------------------------


def test_planted_mismatch_and_wrong_anchor(spark):
    facts = spark.createDataFrame(
        [("k1", "a", "2001-01-01", 1), ("k1", "a", "2001-02-01", 2), ("k1", "b", "2001-02-01", 1), ("k2", "a", "x", 1), ("k2", "b", "y", 1),
         ("k3", "b", None, 1), ("k3", "c", None, 1), (None, "a", "z", 1), ("k4", "c", "only", 1)],
        "k string, source string, value string, at int",
    )
    stated = quality.latest_statements(facts, "k", "value", "source", ["at"])
    assert {(r.k, r.source): r.value for r in stated.collect()}["k1", "a"] == "2001-02-01"
    agreement = quality.source_agreement(stated, "k", "value", "source")
    assert {(r.source_a, r.source_b): (r.shared, r.agreeing) for r in agreement.collect()} == {("a", "b"): (2, 1), ("b", "c"): (1, 1)}
    anchors = spark.createDataFrame([("k1", "2001-02-01"), ("k2", "y"), ("k9", "q")], "k string, expected string")
    report = quality.anchor_report(stated.filter("source = 'a'"), anchors, "k", "value")
    assert {r.k: r.verdict for r in report.collect()} == {"k1": "ok", "k2": "wrong", "k9": "missing"}
    with pytest.raises(ContractError, match="a/b: 1; anchor k2"):
        quality.refuse_disagreement(agreement, report)
    quality.refuse_disagreement(agreement.filter("agreeing = shared"), report.filter("verdict <> 'wrong'"))


# --- leakage --------------------------------------------------------------------------


def test_closure_finds_a_planted_leak(spark):
    rows = field(spark, rotating(30, 6, 40, venue=[1, 2]))
    columns = ["career_starts", "career_top3", "recent3_finish_pct", "same_course_top3", "front_share"]
    clean = history.leakage_closure(rows, history.build_panel, columns, ["front_share"], outcome_changes())
    found = clean.collect()
    assert {r.probe for r in found} == {r[0] for r in rows.select(F.year("contest_date")).distinct().collect()}
    assert all(r.changed == 0 and r.rows == 6 for r in found)
    assert {r.level for r in found if r.predictor == "front_share"} == {"field"}
    # The closure holds what the predictors need: they equal those of the whole table.
    sample = history.closure_sample(rows)
    own = history.build_panel(sample.drop("probe", "is_target")).join(sample.filter("is_target").select("contest_id", "subject_id"), ["contest_id", "subject_id"])
    own = own.withColumns({c: F.expr(f"{c} div 10000") for c in ("contest_id", "subject_id")}).select("contest_id", "subject_id", *columns)
    whole = history.build_panel(rows).select("contest_id", "subject_id", *columns)
    assert own.count() > 0 and own.exceptAll(whole).count() == 0

    def leaky(entries):
        return history.build_panel(entries).withColumn("career_top3", F.col("career_top3") + F.col("label"))

    leak = history.leakage_closure(rows, leaky, columns, ["front_share"], outcome_changes())
    assert {r.predictor for r in leak.filter("changed > 0").collect()} == {"career_top3"}
