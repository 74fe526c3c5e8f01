"""Exact medians of many columns without sorting any of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldform.contracts import ContractError

# A sketch of this accuracy leaves about one value in 500 open, so a column needs few rounds; sketches of all
# columns meet in one task, so they are kept small.
ACCURACY = 2_000


@dataclass
class Target:
    """A rank (from 0) of one column; its value lies strictly between ``lo`` and ``hi``, None being no bound."""

    column: str
    rank: int
    inside: int
    below: int = 0
    lo: float | None = None
    hi: float | None = None
    value: float | None = None

    def open_values(self) -> Column:
        value = known(self.column)
        within = F.lit(True)
        if self.lo is not None:
            within &= value > F.lit(self.lo)
        if self.hi is not None:
            within &= value < F.lit(self.hi)
        return F.when(within, value)

    def narrow(self, a: float, b: float, less: int, at_a: int, between: int, at_b: int) -> None:
        """Keep the part of the open range that holds the rank, given the counts around ``a`` and ``b``."""
        place = self.rank - self.below
        if place < less:
            self.hi, self.inside = a, less
        elif place < less + at_a:
            self.value = a
        elif place < less + at_a + between:
            self.lo, self.hi, self.below, self.inside = a, b, self.below + less + at_a, between
        elif place < less + at_a + between + at_b:
            self.value = b
        else:
            passed = less + at_a + between + at_b
            self.lo, self.below, self.inside = b, self.below + passed, self.inside - passed


def known(column: str) -> Column:
    """The value as a double, NaN counting as unknown and -0.0 as 0.0."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value + F.lit(0.0))


def exact_medians(df: DataFrame, columns: Sequence[str], accuracy: int = ACCURACY) -> dict[str, float | None]:
    """The median of every column: the middle value, or the mean of the two middle values.

    Each round reads the table twice, for all columns at once: a mergeable sketch proposes two
    values around each wanted rank, then the values below, at and between them are counted.
    Counts decide, so the result is exact whatever the sketch says; the range that stays open
    loses both values with all their repeats, so ties cannot hold it up.  Nothing is sorted or
    gathered: one row of sketches reaches the driver.  Write or cache the table beforehand.

    NULL and NaN are left out; a column without any known value, or an empty table, gives None.
    Two infinite middle values of unlike sign have no mean and give NaN.  An accuracy below 10
    would leave most of a range open and is refused.
    """
    if accuracy < 10:
        raise ContractError("the sketch needs an accuracy of 10 or more")
    if not columns:
        return {}
    counts = df.agg(*[F.count(known(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    targets = {
        (c, rank): Target(c, rank, counts[f"n{i}"])
        for i, c in enumerate(columns)
        for rank in ((counts[f"n{i}"] - 1) // 2, counts[f"n{i}"] // 2)
        if counts[f"n{i}"]
    }
    while todo := [t for t in targets.values() if t.value is None]:
        _round(df, todo, accuracy)
    out: dict[str, float | None] = {}
    for i, c in enumerate(columns):
        n = counts[f"n{i}"]
        low, high = (targets[c, rank].value for rank in ((n - 1) // 2, n // 2)) if n else (None, None)
        out[c] = None if low is None else low if low == high else low / 2 + high / 2
    return out


def _round(df: DataFrame, todo: Sequence[Target], accuracy: int) -> None:
    """Ranks of a column that still share an open range share its sketch and its counts."""
    shared: dict[tuple, list[Target]] = {}
    for t in todo:
        shared.setdefault((t.column, t.lo, t.hi), []).append(t)
    groups = list(shared.values())
    proposals = []
    for i, group in enumerate(groups):
        # Ranks a sketch's error to either side, and one value more, so that few values stay between.
        error = 1.0 / accuracy + 1.0 / group[0].inside
        middles = [(t.rank - t.below + 0.5) / t.inside for t in group]
        ends = [max(0.0, min(middles) - error), min(1.0, max(middles) + error)]
        proposals.append(F.percentile_approx(group[0].open_values(), ends, accuracy).alias(f"t{i}"))
    found = df.agg(*proposals).first()
    counts = []
    for i, group in enumerate(groups):
        a, b = found[f"t{i}"]
        value = group[0].open_values()
        counts += [
            F.count_if(value < F.lit(a)).alias(f"less{i}"),
            F.count_if(value == F.lit(a)).alias(f"a{i}"),
            F.count_if((value > F.lit(a)) & (value < F.lit(b))).alias(f"mid{i}"),
            F.count_if((value == F.lit(b)) & (value > F.lit(a))).alias(f"b{i}"),
        ]
    sizes = df.agg(*counts).first()
    for i, group in enumerate(groups):
        a, b = found[f"t{i}"]
        for t in group:
            t.narrow(a, b, *(sizes[f"{name}{i}"] for name in ("less", "a", "mid", "b")))
