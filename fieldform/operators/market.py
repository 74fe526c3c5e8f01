"""Market prices to probabilities, and per-contest normalization.

Contests that fit an array are solved in one aggregation by contest, in Arrow batches.
Larger ones are reduced to their distinct strengths and worked on in bounded chunks over
all tasks.  Neither path puts pairs of entries into rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldform.functions.probability import col, logit, sigmoid
from fieldform.scale import ARRAY_ROWS, GROUP_ROWS, largest_group, materialize, with_group

CONTEST = "contest_id"
CHUNK = 256
BLOCK_CELLS = 2_000_000
MIN_FIELD = 4


def valid_odds(odds: str | Column) -> Column:
    """Finite decimal odds above 1, else NULL."""
    o = col(odds).cast("double")
    return F.when((o > 1) & ~F.isnan(o) & (o < float("inf")), o)


def market_win_prob(df: DataFrame, odds: str = "win_odds", contest: str = CONTEST) -> DataFrame:
    """Normalized 1/odds and the overround; NULL for a contest with any invalid price."""
    raw = 1 / valid_odds(odds)
    out = with_group(
        df.withColumn("_raw", raw),
        contest,
        F.sum("_raw").alias("_sum"),
        F.count_if(F.col("_raw").isNull()).alias("_bad"),
    )
    ok = F.col("_bad") == 0
    return (
        out.withColumn("p_win", F.when(ok, F.col("_raw") / F.col("_sum")))
        .withColumn("overround", F.when(ok, F.col("_sum")))
        .drop("_raw", "_sum", "_bad")
    )


def harville_top_k(
    df: DataFrame, strength: str, contest: str = CONTEST, k: int = 3, *, largest: int | None = None
) -> DataFrame:
    """P(first), P(second), P(third) and their sum over the first k places.

    Places are filled one after the other, each with probability proportional to the
    strengths that remain.  ``strength`` must be a stored positive column (1/odds or a win
    probability); it is normalized here.  With w the win probability, a = w/(1-w) and
    S = sum(a):  P2 = w(S - a);  P3 = w(T - V), where V collects the two-step terms of all
    others with this entry and T is half their total.  Contests with at most k entries
    or an unusable strength get NULL.  ``largest`` is a known upper bound on the entries of a contest.
    """
    if k not in (1, 2, 3):
        raise ValueError("k must be 1, 2 or 3")
    rows = df.select(contest, F.col(strength).cast("double").alias("_x"))
    columns = ("p_first", "p_second", "p_third")[:k]
    if (largest_group(rows, [contest]) if largest is None else largest) <= ARRAY_ROWS:
        return _with_places(df, strength, contest, columns)
    sizes = rows.groupBy(contest).agg(F.count("*").alias("_n"))
    small = rows.join(sizes.filter(F.col("_n") <= ARRAY_ROWS), contest, "left_semi")
    big = rows.join(sizes.filter(F.col("_n") > ARRAY_ROWS), contest, "left_semi")
    places = _places_by_array(small, contest, k).unionByName(_places_by_chunks(big, contest, k))
    found = places.select(F.col(contest).alias("_c"), "_x", *columns, _top(columns))
    on = (df[contest] == F.col("_c")) & (df[strength] == F.col("_x"))
    return df.join(found, on, "left").drop("_c", "_x")


def _top(columns: Sequence[str]) -> Column:
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])).alias("p_top")


def _with_places(df: DataFrame, strength: str, contest: str, columns: Sequence[str]) -> DataFrame:
    """The same when all contests fit an array: rows meet their contest's places by contest, where they already are."""
    rows = df.select(contest, F.col(strength).cast("double").alias("_x"))
    solved = _solved_arrays(rows, contest, len(columns)).select(F.col(contest).alias("_c"), "_keys", "_p")
    n, at = F.size("_keys"), F.array_position("_keys", F.col(strength).cast("double"))
    met = df.join(solved, df[contest] == F.col("_c"), "left").withColumn("_at", F.when(F.col("_c").isNotNull(), at.cast("int")))
    # Places of the distinct strengths lie end to end; no contest, or no place in it, gives NULL.
    cells = [F.when(F.col("_at") > 0, F.get("_p", i * n + F.col("_at") - 1)).alias(c) for i, c in enumerate(columns)]
    return met.select(*df.columns, *cells).select("*", _top(columns))


def _unusable(x: Column) -> Column:
    return F.count_if(x.isNull() | ~(x > 0)).alias("_bad")


def _solved_arrays(rows: DataFrame, contest: str, k: int) -> DataFrame:
    """(contest, distinct strengths ascending, their places): one shuffle by contest."""
    arrays = rows.groupBy(contest).agg(F.collect_list("_x").alias("_xs"), _unusable(F.col("_x")))
    arrays = arrays.filter((F.col("_bad") == 0) & (F.size("_xs") > k))
    return arrays.select(contest, F.array_sort(F.array_distinct("_xs")).alias("_keys"), places_of_contest("_xs").alias("_p"))


def _places_by_array(rows: DataFrame, contest: str, k: int) -> DataFrame:
    """(contest, strength, places) of contests that fit an array."""
    solved, n = _solved_arrays(rows, contest, k), F.size("_keys")
    cells = F.arrays_zip(
        F.col("_keys").alias("_x"),
        *[F.slice("_p", 1 + i * n, n).alias(c) for i, c in enumerate(("p_first", "p_second", "p_third"))],
    )
    return solved.select(contest, F.explode(cells).alias("_e")).select(contest, "_e.*")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def places_of_contest(strengths: pd.Series) -> pd.Series:
    """First, second and third place probabilities of the distinct strengths, ascending, end to end.

    A batch is solved by field size: contests with equally many distinct strengths form one
    dense block, cut so that a block never holds more than BLOCK_CELLS pairs.
    """
    sizes = np.array([len(x) for x in strengths])
    flat = np.concatenate(list(strengths))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])])
    x, m = flat[first], np.diff(np.r_[first, len(flat)])
    n = np.bincount(owner[first], minlength=len(sizes))
    begin = np.r_[0, np.cumsum(n)[:-1]]
    out: list = [None] * len(sizes)
    for size in np.unique(n):
        members = np.flatnonzero(n == size)
        for part in np.array_split(members, -(-len(members) * size * size // BLOCK_CELLS)):
            cells = begin[part][:, None] + np.arange(size)
            solved = _places(x[cells], m[cells])
            for i, row in zip(part, solved, strict=True):
                out[i] = row
    return pd.Series(out)


def _places(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rows of contests with the same number of distinct strengths x and their counts m."""
    w = x / (x * m).sum(axis=-1, keepdims=True)
    a = w / (1 - w)
    v = _pair_sums(w, w, m)
    second = w * ((m * a).sum(axis=-1, keepdims=True) - a)
    third = w * ((m * v).sum(axis=-1, keepdims=True) / 2 - v)
    return np.concatenate([w, second, third], axis=-1)


def _pair_sums(own: np.ndarray, w: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each own strength, the sum over the others of w w' (1/(1-w) + 1/(1-w')) / (1-w-w').

    Entries of equal strength share a value: one of them is the entry itself.
    """
    a, b = own[..., :, None], w[..., None, :]
    others = m[..., None, :] - (a == b)
    with np.errstate(divide="ignore", invalid="ignore"):
        term = a * b * (1 / (1 - a) + 1 / (1 - b)) / (1 - a - b)
    return np.where(others > 0, others * term, 0.0).sum(axis=-1)


def _places_by_chunks(rows: DataFrame, contest: str, k: int) -> DataFrame:
    """The same for contests of any size: distinct strengths in chunks, chunk against chunk.

    Work per row of the self-join is a dense block of at most about CHUNK x CHUNK values, so
    one huge contest is spread over all tasks.
    """
    hist = rows.groupBy(contest, "_x").agg(F.count("*").alias("m"))
    hist = with_group(
        hist,
        contest,
        F.sum(F.col("m") * F.col("_x")).alias("_mass"),
        F.sum("m").alias("_n"),
        F.count("*").alias("_distinct"),
        _unusable(F.col("_x")),
    ).filter((F.col("_bad") == 0) & (F.col("_n") > k))
    hist = materialize(hist.withColumn("w", F.col("_x") / F.col("_mass")), "strengths")
    chunks = hist.groupBy(
        contest, F.pmod(F.xxhash64("_x"), F.ceil(F.col("_distinct") / CHUNK)).alias("_chunk")
    ).agg(F.collect_list(F.struct("_x", "w", "m")).alias("_e"))
    own = chunks.select(contest, F.col("_e").alias("_own"))
    other = chunks.select(contest, F.col("_e.w").alias("_w"), F.col("_e.m").cast("array<double>").alias("_m"))
    pairs = own.join(other, contest).select(
        contest, F.arrays_zip(F.col("_own").alias("_own"), pair_totals(F.col("_own.w"), "_w", "_m").alias("_v")).alias("_c")
    )
    parts = (
        pairs.select(contest, F.explode("_c").alias("_c"))
        .select(contest, "_c._own.*", "_c._v")
        .groupBy(contest, "_x")
        .agg(F.first("w").alias("w"), F.first("m").alias("m"), F.sum("_v").alias("_v"))
    )
    w, m = F.col("w"), F.col("m")
    parts = with_group(parts, contest, F.sum(m * w / (1 - w)).alias("_s"), F.sum(m * F.col("_v") / 2).alias("_t"))
    return parts.select(
        contest, "_x", w.alias("p_first"), (w * (F.col("_s") - w / (1 - w))).alias("p_second"),
        (w * (F.col("_t") - F.col("_v"))).alias("p_third"),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pair_totals(own: pd.Series, w: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([_pair_sums(a, b, c) for a, b, c in zip(own, w, m, strict=True)])


def place_strength(
    df: DataFrame, low: str, high: str, contest: str = CONTEST, total: float = 3.0
) -> DataFrame:
    """Inverse of the price interval midpoint, scaled to a contest total; a strength, not a probability."""
    lo, hi = F.col(low), F.col(high)
    raw = F.when((lo > 0) & (hi >= lo), 2 / (lo + hi))
    out = with_group(
        df.withColumn("_raw", raw),
        contest,
        F.sum("_raw").alias("_sum"),
        F.count_if(F.col("_raw").isNull()).alias("_bad"),
    )
    value = F.when(F.col("_bad") == 0, total * F.col("_raw") / F.col("_sum"))
    return out.withColumn("place_strength", value).drop("_raw", "_sum", "_bad")


def market_reasons(entries: DataFrame, odds: str = "win_odds", contest: str = CONTEST) -> DataFrame:
    """One row per contest with the first reason that bars its market, or ``complete``."""
    return _market_facts(entries, odds, contest, largest_group(entries, [contest])).drop("overround")


def _market_facts(entries: DataFrame, odds: str, contest: str, largest: int) -> DataFrame:
    """``market_reasons`` with the sum of 1/odds over the starters."""
    ran = F.col("status") != "scratched"
    price = F.when(ran, 1 / valid_odds(odds)).alias("_price")
    rows = entries.select(contest, F.when(ran, F.col("entry_no")).alias("_no"), ran.alias("_ran"), price)
    if largest <= GROUP_ROWS:
        # Both groupings take the one shuffle by contest; a larger contest combines its numbers before it.
        rows = rows.repartition(contest)
    numbers = rows.groupBy(contest, "_no").agg(
        F.count_if("_ran").alias("_starters"),
        F.count_if(F.col("_ran") & F.col("_price").isNull()).alias("_unpriced"),
        F.sum("_price").alias("_price"),
    )
    bad_number = (F.col("_starters") > 0) & (
        F.col("_no").isNull() | (F.col("_no") <= 0) | (F.col("_starters") > 1)
    )
    facts = numbers.groupBy(contest).agg(
        F.sum("_starters").alias("starters"),
        F.count_if(bad_number).alias("_bad"),
        F.sum("_unpriced").alias("_unpriced"),
        F.sum("_price").alias("overround"),
    )
    reason = (
        F.when(F.col("starters") == 0, "no_starters")
        .when(F.col("_bad") > 0, "invalid_or_duplicate_number")
        .when(F.col("starters") < MIN_FIELD, "field_too_small")
        .when(F.col("_unpriced") > 0, "missing_or_invalid_odds")
        .otherwise("complete")
    )
    return facts.select(contest, "starters", reason.alias("reason"), "overround")


def rebuild_market(
    entries: DataFrame, odds: str = "win_odds", contest: str = CONTEST
) -> tuple[DataFrame, DataFrame]:
    """Market of every complete contest over all starters, and counts of exclusion reasons."""
    largest = largest_group(entries, [contest])
    # One row a contest, read by the counts, by the entries and by their strengths.
    facts = materialize(_market_facts(entries, odds, contest, largest), "market-facts")
    complete = facts.filter(F.col("reason") == "complete").select(
        contest, F.col("starters").alias("market_field_size"), F.col("overround").alias("_overround")
    )
    priced = entries.filter(F.col("status") != "scratched").join(complete, contest)
    priced = priced.withColumn("strength", 1 / F.col(odds))
    market = harville_top_k(priced, "strength", contest, largest=largest).withColumnRenamed("_overround", "overround")
    market = market.withColumnRenamed("p_first", "market_p_win").withColumnRenamed("p_top", "market_p_top3")
    counts = facts.groupBy("reason").agg(F.count("*").alias("contests"))
    return market.drop("p_second", "p_third", "strength"), counts


# --- one logit offset per contest -----------------------------------------------------

LOW, HIGH, STEPS, SECTIONS = -40.0, 40.0, 60, 32


def logit_shift_to_sum(df: DataFrame, p: str, contest: str = CONTEST, slots: float = 3.0) -> DataFrame:
    """Shift the logits of each contest by one offset so that its probabilities sum to ``slots``.

    A contest with any unknown probability has no such offset and gets NULL, as do rows without a contest.
    Contests that fit an array are bisected after one aggregation.  Larger ones are solved
    exactly as well, by repeated sums over all tasks that narrow the bracket 32-fold.
    """
    rows = df.withColumn("_x", logit(p))
    if largest_group(rows, [contest]) <= ARRAY_ROWS:
        shifts = _bisect_arrays(rows, contest, slots)
    else:
        sizes = rows.groupBy(contest).agg(F.count("*").alias("_n"))
        small = rows.join(sizes.filter(F.col("_n") <= ARRAY_ROWS), contest, "left_semi")
        big = rows.join(sizes.filter(F.col("_n") > ARRAY_ROWS), contest, "left_semi")
        shifts = _bisect_arrays(small, contest, slots).unionByName(_narrow_sums(big, contest, slots))
    return rows.join(shifts, contest, "left").withColumn("p_adjusted", sigmoid(F.col("_x") + F.col("shift"))).drop("_x")


def _target(n: Column, slots: float) -> Column:
    return F.least(F.lit(float(slots)), n - 1e-9)


def _bisect_arrays(rows: DataFrame, contest: str, slots: float) -> DataFrame:
    arrays = rows.groupBy(contest).agg(
        F.collect_list("_x").alias("_xs"), F.count("*").alias("_n"), _target(F.count("*"), slots).alias("_goal")
    )
    # Of an empty array nothing could be summed; of one with gaps not all would be.
    arrays = arrays.filter((F.size("_xs") == F.col("_n")) & F.col(contest).isNotNull())
    return arrays.select(contest, bisected_shift("_xs", "_goal").alias("shift"))


@F.pandas_udf(T.DoubleType())
def bisected_shift(xs: pd.Series, goal: pd.Series) -> pd.Series:
    """Offset per array at which the logistic sum meets the goal; all arrays of a batch at once."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in xs])[:-1]]).astype(int)
    flat, sizes = np.concatenate(list(xs)), np.array([len(x) for x in xs])
    lo, hi = np.full(len(xs), LOW), np.full(len(xs), HIGH)
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        below = np.add.reduceat(1 / (1 + np.exp(-(flat + np.repeat(mid, sizes)))), starts) < goal.to_numpy()
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return pd.Series((lo + hi) / 2)


def _narrow_sums(rows: DataFrame, contest: str, slots: float) -> DataFrame:
    rows = materialize(rows.select(contest, "_x"), "large-contests")
    known = rows.groupBy(contest).agg(_target(F.count("*"), slots).alias("_goal"), (F.count("_x") == F.count("*")).alias("_known"))
    bracket = known.filter(F.col("_known") & F.col(contest).isNotNull()).drop("_known")
    bracket = bracket.select("*", F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"))
    rounds = 12  # 80 / 32**12 is far below the spacing of doubles
    for _ in range(rounds):
        width = (F.col("hi") - F.col("lo")) / SECTIONS
        points = [F.col("lo") + j * width for j in range(1, SECTIONS)]
        sums = (
            rows.join(bracket, contest)
            .groupBy(contest, "_goal", "lo", "hi")
            .agg(*[F.sum(sigmoid(F.col("_x") + pt)).alias(f"_s{j}") for j, pt in enumerate(points)])
        )
        below = sum(
            (F.when(F.col(f"_s{j}") < F.col("_goal"), 1).otherwise(0) for j in range(SECTIONS - 1)), F.lit(0)
        )
        lo = F.col("lo") + below * width
        bracket = materialize(sums.select(contest, "_goal", lo.alias("lo"), (lo + width).alias("hi")), "bracket")
    return bracket.select(contest, ((F.col("lo") + F.col("hi")) / 2).alias("shift"))

