"""Features from a carried state equal those of the whole history, in any order of batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldform.contracts import ContractError
from fieldform.operators import carried, history
from fieldform.scale import materialize, new_folder
from tests.helpers import day, entry, field

KEYS = ("contest_id", "subject_id")


def entries(seed=3, days=40, **kw):
    """Contests of varying subjects every two or three days; some subjects start several times a day."""
    draw, rows, contest, when = random.Random(seed), [], 0, 0
    for _ in range(days):
        when += draw.choice([2, 3])
        for _ in range(draw.choice([1, 1, 3])):
            runners = draw.sample(range(9), 5)
            places = draw.sample(range(1, 6), 5)
            extra = {"distance_m": draw.choice([1200, 1400]), "venue": draw.choice([1, 2]), "surface": draw.choice(["turf", "dirt"])}
            rows += [entry(contest, when, s, k + 1, p, 5, weight=50 + p, **extra, **kw) for k, (s, p) in enumerate(zip(runners, places, strict=True))]
            contest += 1
    return rows


def values(df, columns):
    return {(r[0], r[1]): tuple(round(x, 9) if isinstance(x, float) else x for x in r[2:]) for r in df.select(*KEYS, *columns).collect()}


def test_panel_after_a_cut_and_after_steps(spark):
    rows = materialize(field(spark, entries()))
    whole = history.build_panel(rows)
    columns = [c for c in whole.columns if c not in KEYS]
    cut, later = day(40), day(70)
    state = carried.carry(rows, cut)
    assert state.daily.groupBy("subject_id").count().agg(F.max("count")).first()[0] <= 2
    want = values(whole.filter(F.col("contest_date") > F.lit(cut)), columns)
    assert values(carried.carried_panel(state, rows.filter(F.col("contest_date") > F.lit(cut))), columns) == want
    path = new_folder(spark, "state")
    carried.save_state(state, path)
    moved = carried.extend(carried.load_state(spark, path), rows, later)
    got = values(carried.carried_panel(moved, rows.filter(F.col("contest_date") > F.lit(later))), columns)
    assert got == {k: want[k] for k in got} and len(got) > 0
    with pytest.raises(ContractError):
        carried.carried_panel(moved, rows)
    with pytest.raises(ContractError):
        carried.extend(moved, rows, cut)


def test_batches_in_any_order_with_corrections(spark):
    """Days arrive shuffled within the window, and some contests again with other outcomes."""
    rows = materialize(field(spark, entries(seed=8, days=14)))
    fixed = materialize(rows.withColumns({"weight": F.when(F.col("contest_id") % 4 == 1, F.col("weight") + 3).otherwise(F.col("weight")),
                                          "label": F.when(F.col("contest_id") % 4 == 1, 1 - F.col("label")).otherwise(F.col("label"))}))
    dates = sorted(r[0] for r in rows.select("contest_date").distinct().collect())
    draw, latest = random.Random(2), {}
    whole = history.build_panel(fixed)
    columns = [c for c in whole.columns if c not in KEYS]
    state, window = carried.carry(rows, dt.date(1999, 12, 31)), None
    groups = [dates[k : k + 4] for k in range(0, len(dates), 4)]  # within the recheck window of each other
    for group in groups:
        draw.shuffle(group)
        half = group[: len(group) // 2] or group
        for some, table in ((half, rows), (group, fixed)):
            batch = table.filter(F.col("contest_date").isin(some))
            state, window, panel = carried.advance(state, window, batch)
            latest |= values(panel, columns)
    assert latest == values(whole, columns)
    assert state.through == dates[-1] - dt.timedelta(days=14)
    with pytest.raises(ContractError):
        carried.advance(state, window, rows.filter(F.col("contest_date") == F.lit(dates[0])))
