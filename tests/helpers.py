"""Small entry tables for tests."""

from __future__ import annotations

import datetime as dt

from fieldform.sources.testtables import standard_starters

SCHEMA = (
    "contest_id long, contest_date date, subject_id long, entry_no int, status string, surface string, venue int, "
    "distance_m int, contest_class string, turn_direction string, grp string, age int, weight int, declared_size long, "
    "field_size long, finish_position int, time_s double, early_position int"
)


def day(n: int) -> dt.date:
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


def entry(contest, when, subject, no, place, n=4, **kw):
    row = {
        "contest_id": contest, "contest_date": day(when), "subject_id": subject, "entry_no": no, "status": "finished",
        "surface": "turf", "venue": 1, "distance_m": 1200, "contest_class": "3-MEDIUM", "turn_direction": "left",
        "grp": "a", "age": 4, "weight": 54, "declared_size": n, "field_size": n, "finish_position": place,
        "time_s": 70.0 + (place or 9), "early_position": no,
    }
    row.update(kw)
    return tuple(row[c.split()[0]] for c in SCHEMA.split(", "))


def declared(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def field(spark, rows):
    return standard_starters(declared(spark, rows))


def rotating(contests=6, n=5, gap=20, **kw):
    """Contests of the same subjects with rotating places."""
    out = []
    for c in range(contests):
        for s in range(n):
            extra = {k: v[c % len(v)] if isinstance(v, (list, tuple)) else v for k, v in kw.items()}
            out.append(entry(c, c * gap, s, s + 1, (s + c) % n + 1, n, **extra))
    return out


def by_key(df, *cols):
    rows = df.select("contest_id", "subject_id", *cols).collect()
    return {(r[0], r[1]): tuple(r[2:]) if len(cols) > 1 else r[2] for r in rows}
