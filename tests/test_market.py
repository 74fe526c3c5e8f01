from __future__ import annotations

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from fieldform.operators import locks, market, ranking
from fieldform import scale

ODDS = [2.0, 3.5, 3.5, 8.0, 15.0, 40.0, 3.5]


def contest(spark, odds, contest_id=1):
    return [(contest_id, i, i + 1, "finished", o) for i, o in enumerate(odds)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "contest_id long, subject_id long, entry_no int, status string, win_odds double")


def enumerated(odds, k=3):
    w = [1 / o for o in odds]
    total = sum(w)
    w = [x / total for x in w]
    out = [0.0] * len(w)
    for order in permutations(range(len(w)), k):
        mass, p = 1.0, 1.0
        for i in order:
            p *= w[i] / mass
            mass -= w[i]
        for i in order:
            out[i] += p
    return out


@pytest.mark.parametrize("chunk, limit", [(2, 4), (256, 4), (256, 4096)])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_places_match_enumeration(spark, monkeypatch, chunk, limit, k):
    """Arrays for small contests and chunk against chunk for large ones agree with enumeration."""
    monkeypatch.setattr(market, "CHUNK", chunk)
    monkeypatch.setattr(market, "ARRAY_ROWS", limit)
    rows = frame(spark, contest(spark, ODDS) + contest(spark, [2.0, 3.0, 4.0, 5.0], 2)).withColumn("x", 1 / F.col("win_odds"))
    got = {(r["contest_id"], r["subject_id"]): r["p_top"] for r in market.harville_top_k(rows, "x", k=k).collect()}
    for cid, odds in ((1, ODDS), (2, [2.0, 3.0, 4.0, 5.0])):
        for i, want in enumerate(enumerated(odds, k)):
            assert got[(cid, i)] == pytest.approx(want, abs=1e-12)


def test_too_few_entries_give_null(spark):
    rows = frame(spark, contest(spark, [2.0, 3.0, 4.0])).withColumn("x", 1 / F.col("win_odds"))
    assert {r["p_top"] for r in market.harville_top_k(rows, "x").collect()} == {None}


def test_rebuild_market_reasons_in_order(spark):
    rows = contest(spark, ODDS, 1) + contest(spark, [2.0, 3.0, 4.0], 2) + contest(spark, [2.0, None, 4.0, 5.0], 3)
    rows += [(4, 1, 1, "finished", 2.0), (4, 2, 1, "finished", 3.0)] + [(5, 1, 1, "scratched", 2.0)]
    rows += contest(spark, [2.0, 1.0, 4.0, 5.0], 6) + [(7, 1, 0, "finished", None)]
    priced, counts = market.rebuild_market(frame(spark, rows))
    reasons = {r["reason"]: r["contests"] for r in counts.collect()}
    assert reasons == {
        "complete": 1, "field_too_small": 1, "missing_or_invalid_odds": 2, "invalid_or_duplicate_number": 2, "no_starters": 1,
    }
    assert priced.agg(F.sum("market_p_top3")).first()[0] == pytest.approx(3.0)
    assert priced.agg(F.sum("market_p_win")).first()[0] == pytest.approx(1.0)


def test_win_probabilities_need_valid_prices(spark):
    out = market.market_win_prob(frame(spark, contest(spark, [2.0, 4.0], 1) + contest(spark, [2.0, 1.0], 2))).collect()
    assert {r["p_win"] for r in out if r["contest_id"] == 2} == {None}
    assert sum(r["p_win"] for r in out if r["contest_id"] == 1) == pytest.approx(1.0)


def test_place_strength_sums(spark):
    rows = frame(spark, contest(spark, ODDS)).withColumn("lo", F.col("win_odds")).withColumn("hi", F.col("win_odds") * 2)
    out = market.place_strength(rows, "lo", "hi").collect()
    assert sum(r["place_strength"] for r in out) == pytest.approx(3.0)


@pytest.mark.parametrize("limit", [3, 4_096])
def test_shift_reaches_the_sum_and_keeps_order(spark, monkeypatch, limit):
    """The bracket search over all tasks (small limit) agrees with the array bisection."""
    monkeypatch.setattr(market, "ARRAY_ROWS", limit)
    ps = [0.9, 0.05, 0.2, 0.2, 0.6, 0.01, 0.33]
    rows = spark.createDataFrame(
        [(1, i, p) for i, p in enumerate(ps)] + [(2, i, 0.5) for i in range(3)], "contest_id long, subject_id long, p double"
    )
    out = market.logit_shift_to_sum(rows, "p").collect()
    one = {r["subject_id"]: r for r in out if r["contest_id"] == 1}
    assert sum(r["p_adjusted"] for r in one.values()) == pytest.approx(3.0, abs=1e-12)
    shifts = {round(r["shift"], 9) for r in one.values()}
    assert len(shifts) == 1
    order = sorted(one, key=lambda i: ps[i])
    assert order == sorted(one, key=lambda i: (one[i]["p_adjusted"], order.index(i)))
    assert sum(r["p_adjusted"] for r in out if r["contest_id"] == 2) == pytest.approx(3.0, abs=1e-6)


@pytest.mark.parametrize("by", [[], ["contest_id"], ["contest_id", "subject_id"]])
def test_ranks_by_range_equal_ranks_by_window(spark, monkeypatch, by):
    rows = spark.range(3000).select(
        (F.col("id") % 3).alias("contest_id"), (F.col("id") % 2).alias("subject_id"), F.col("id").alias("entry_no"),
        (F.hash("id") % 50).cast("double").alias("p"),
    )
    order = [F.desc("p"), F.col("entry_no")]
    plain = scale.rank_rows(rows.withColumn("g", F.lit(1)), by or ["g"], order, "r", largest=3000).drop("g")
    monkeypatch.setattr(scale, "GROUP_ROWS", 10)
    spread = scale.rank_rows(rows, by, order, "r")
    cols = ["contest_id", "entry_no", "r"]
    assert sorted(map(tuple, plain.select(*cols).collect())) == sorted(map(tuple, spread.select(*cols).collect()))


def test_first_come_ranks(spark):
    rows = spark.createDataFrame([(1, 3, 0.2), (1, 1, 0.2), (1, 2, 0.5)], "contest_id long, entry_no int, p double")
    assert {r["entry_no"]: r["rank"] for r in ranking.rank_first(rows, "p").collect()} == {2: 1, 1: 2, 3: 3}


def lock_rows(spark, **changes):
    base = {
        "contest_id": 1, "contest_date": "2000-01-01", "field_size": 8, "surface": "turf", "distance_m": 1600,
        "turn_direction": "left", "p_market": 0.375, "p_nonmarket": 0.4, "route": "nonmarket-shadow", "model_id": "m",
        "start_at": "2000-01-01 15:00:00", "market_asof": "2000-01-01 14:48:00", "locked_at": "2000-01-01 14:50:30",
    }
    rows = []
    for i in range(8):
        row = {**base, "subject_id": i, "entry_no": i + 1}
        if i == 7:
            row.update(p_nonmarket=None, route="market-only", model_id="")
        row.update({k: v(i) if callable(v) else v for k, v in changes.items()})
        rows.append(row)
    schema = (
        "contest_id long, contest_date string, field_size int, surface string, distance_m int, turn_direction string, "
        "p_market double, p_nonmarket double, route string, model_id string, start_at string, market_asof string, "
        "locked_at string, subject_id long, entry_no int"
    )
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    times = {c: F.to_timestamp(c) for c in ("start_at", "market_asof", "locked_at")}
    return df.withColumns({**times, "contest_date": F.to_date("contest_date")})


def test_lock_blends_and_falls_back(spark):
    locked, violations, manifest = locks.make_lock(lock_rows(spark))
    rows = {r["subject_id"]: r for r in locked.collect()}
    assert violations.count() == 0 and manifest.first()["rows"] == 8
    assert rows[0]["p_w025"] == pytest.approx(0.75 * 0.375 + 0.25 * 0.4)
    assert rows[7]["p_w100"] == pytest.approx(0.375)


@pytest.mark.parametrize(
    "changes, rule",
    [
        ({"locked_at": "2000-01-01 14:48:30"}, "lock_time"),
        ({"market_asof": "2000-01-01 14:44:00"}, "price_age"),
        ({"market_asof": "2000-01-01 14:51:00"}, "price_age"),
        ({"distance_m": 3000}, "distance"),
        ({"turn_direction": "Straight"}, "straight"),
        ({"p_market": 1.5}, "market_probability"),
        ({"route": "market-only", "p_nonmarket": None}, "no_model_candidate"),
        ({"entry_no": lambda i: 1 if i == 3 else i + 1}, "repeated_entry_no"),
        ({"field_size": 9}, "roster_incomplete"),
        ({"contest_date": "2000-01-02"}, "start_date"),
    ],
)
def test_lock_refusals(spark, changes, rule):
    locked, violations, _ = locks.make_lock(lock_rows(spark, **changes))
    assert locked.count() == 0
    assert rule in {r["rule"] for r in violations.collect()}


def test_lock_local_date(spark):
    """A start at 20:00 UTC is already the next day nine hours further east."""
    rows = lock_rows(spark, start_at="2000-01-01 20:00:00", locked_at="2000-01-01 19:50:30", market_asof="2000-01-01 19:49:00")
    assert locks.make_lock(rows)[1].count() == 0
    assert {r["rule"] for r in locks.make_lock(rows, local_zone="Asia/Tokyo")[1].collect()} == {"start_date"}




def test_rows_meet_their_places_where_they_are(spark):
    rows = spark.createDataFrame([(c, i, 1.0 + i % 3) for c in range(5) for i in range(4 + c)] + [(None, 0, 2.0), (9, 0, -1.0)], "contest_id long, no int, x double")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = market.harville_top_k(rows, "x", largest=8)
        plan = out._jdf.queryExecution().executedPlan().toString()
        # Rows and arrays move by contest alone; rows do not meet their places by strength.
        moves = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
        assert moves and all("," not in keys for keys in moves)
        got = {(r["contest_id"], r["no"]): r["p_top"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert len(got) == 32 and got[None, 0] is None and got[9, 0] is None
    for c in range(5):
        assert abs(sum(got[c, i] for i in range(4 + c)) - 3) < 1e-9
