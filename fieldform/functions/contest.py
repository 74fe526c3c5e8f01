"""Columns on positions, distances, dates and bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldform.functions.probability import col

# Default regime cuts, pace cuts, diagnostic bands, straight-course tokens.
REGIME_CUTS = (1400, 2000, 2600)
PACE_CUTS = ((0.20, "front"), (0.45, "forward_mid"), (0.70, "mid_rear"))
FIELD_BANDS = ((11, "<=11"), (14, "12-14"), (16, "15-16"))
REST_BANDS = ((21, "<=21"), (35, "22-35"), (56, "36-56"), (90, "57-90"))
START_BANDS = ((5, "3-5"), (10, "6-10"), (20, "11-20"))
STRAIGHT_TOKENS = ("straight", "直線")


def epoch_day(date: str | Column) -> Column:
    return F.datediff(col(date), F.lit("1970-01-01").cast("date"))


def month_end(date: str | Column, last: Column | None = None) -> Column:
    """Last day of the month, or ``last`` where that comes earlier."""
    end = F.last_day(col(date))
    return end if last is None else F.least(end, last)


def is_label(position: str | Column, places: int = 3) -> Column:
    """1 for a position in the first places; a starter without position is a known 0."""
    return F.when(col(position).between(1, places), 1).otherwise(0)


def position_pct(position: str | Column, size: str | Column) -> Column:
    """(position - 1) / (size - 1); NULL outside 1..size."""
    p, n = col(position), col(size)
    return F.when((p >= 1) & (p <= n) & (n > 1), (p - 1) / (n - 1))


def relative_time(time: str | Column, best: str | Column) -> Column:
    t, b = col(time), col(best)
    return F.when(b > 0, (t - b) / b)


def draw_pct(number: str | Column, declared: str | Column) -> Column:
    """Draw over the declared size, so that scratches do not move it."""
    no, n = col(number), col(declared)
    return F.when(n <= 1, F.lit(0.0)).otherwise((no - 1) / (n - 1))


def right_closed(value: str | Column, cuts: Sequence[tuple], last: str) -> Column:
    """First band whose upper bound is not below the value; NULL becomes UNKNOWN."""
    v = col(value)
    out = F.when(v.isNull(), "UNKNOWN")
    for upper, label in cuts:
        out = out.when(v <= upper, label)
    return out.otherwise(last)


def pace_label(pct: str | Column) -> Column:
    return F.when(col(pct).between(0, 1), right_closed(pct, PACE_CUTS, "deep_rear"))


def distance_regime(distance: str | Column, cuts: Sequence[float] = REGIME_CUTS) -> Column:
    """Index of the right-closed bucket; NULL stays NULL."""
    d = col(distance)
    out = F.when(d.isNull(), F.lit(None).cast("int"))
    for i, cut in enumerate(cuts):
        out = out.when(d <= cut, F.lit(i))
    return out.otherwise(F.lit(len(cuts)))


def temporal_split(date: str | Column, bounds: Mapping[str, tuple[int, int | None]]) -> Column:
    """Split name by calendar year; ``bounds`` maps name to (first, last or None)."""
    year = F.year(col(date))
    out = F.when(F.lit(False), F.lit(""))
    for name, (first, last) in bounds.items():
        hit = year >= first if last is None else year.between(first, last)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("outside"))


def course_mask(direction: str | Column, tokens: Sequence[str] = STRAIGHT_TOKENS) -> Column:
    """True where the text holds any token, ignoring case; unknown text is False."""
    text = F.lower(col(direction))
    hit = F.lit(False)
    for token in tokens:
        hit = hit | text.contains(token.lower())
    return F.coalesce(hit, F.lit(False))
