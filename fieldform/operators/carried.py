"""Panel features from a state carried forward, in place of the whole history.

Of each subject the state keeps at most two rows of the kind that ``daily_starts`` makes: its last day, and
everything before it with the last starts that any summary needs.  Of its courses it keeps the totals.  A new day is
a few more such rows behind the state's, and the same windows as for the whole history run over them, so features
equal those of ``build_panel`` while the work follows new entries and the number of subjects.

Days within ``recheck_days`` of the newest are not folded into the state: late contests and corrections replace
whole contests there, and all features of that window are made again.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldform.contracts import ContractError, forbid_columns, require_columns
from fieldform.operators import history
from fieldform.operators.history import CELL, CONTEST, DAY, DEPTH, PANEL_REQUIRED, SUBJECT
from fieldform.scale import materialize

COUNTS = ("n", "s", "turf_n", "turf_s")
RECHECK_DAYS = 14  # fixed value


@dataclass(frozen=True)
class Carried:
    """State through a day: ``daily`` has at most two rows a subject, ``cells`` one a subject and course."""

    daily: DataFrame
    cells: DataFrame
    through: dt.date


def _fold(daily: DataFrame) -> DataFrame:
    """Rows of ``daily_starts`` folded to the last day of each subject and all days before it."""
    newest = Window.partitionBy(SUBJECT).orderBy(F.desc(DAY))
    placed = daily.withColumn("_last", F.row_number().over(newest) == 1)
    starts = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(DAY, "starts"))), lambda x: x["starts"]))
    out = placed.groupBy(SUBJECT, "_last").agg(F.max(DAY).alias(DAY), *[F.sum(c).alias(c) for c in COUNTS], starts.alias("starts"))
    from_ = F.greatest(F.size("starts") - (DEPTH - 1), F.lit(1))
    return out.withColumn("starts", F.slice("starts", from_, DEPTH)).select(SUBJECT, DAY, *COUNTS, "starts")


def _fold_cells(cells: DataFrame) -> DataFrame:
    rest = [c for c in CELL if c != DAY]
    return cells.groupBy(*rest).agg(F.max(DAY).alias(DAY), *[F.sum(c).alias(c) for c in ("n", "s", "u")]).select(*CELL, "n", "s", "u")


def _rows(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    # Starts of a row are told by their order alone, so that folded ones stay comparable.
    return history.daily_starts(history.winner_relative(entries)).select(SUBJECT, DAY, *COUNTS, "starts"), history.history_cells(entries)


def carry(entries: DataFrame, through: dt.date) -> Carried:
    """The state after all entries up to and including ``through``."""
    daily, cells = _rows(entries.filter(F.col(DAY) <= F.lit(through)))
    return Carried(materialize(_fold(daily), "carried"), materialize(_fold_cells(cells), "carried"), through)


def extend(state: Carried, entries: DataFrame, through: dt.date) -> Carried:
    """The state moved on to ``through`` by the entries of the days in between."""
    if through < state.through:
        raise ContractError("a state is not moved back")
    between = entries.filter((F.col(DAY) > F.lit(state.through)) & (F.col(DAY) <= F.lit(through)))
    daily, cells = _rows(between)
    return Carried(
        materialize(_fold(state.daily.unionByName(daily)), "carried"), materialize(_fold_cells(state.cells.unionByName(cells)), "carried"), through
    )


def carried_panel(state: Carried, entries: DataFrame) -> DataFrame:
    """``build_panel`` for entries of days after the state, which stands for everything before them."""
    require_columns(entries, PANEL_REQUIRED)
    forbid_columns(entries)
    if entries.filter(~(F.col(DAY) > F.lit(state.through))).head(1):
        raise ContractError(f"entries must lie after {state.through}, the day of the state")
    daily, cells = _rows(entries)
    # Only subjects that run again are asked for.
    asked = entries.select(SUBJECT).distinct()
    states = history.day_states(state.daily.join(asked, SUBJECT, "left_semi").unionByName(daily))
    before = states.select(SUBJECT, DAY, F.lag("state").over(Window.partitionBy(SUBJECT).orderBy(DAY)).alias("state"))
    counts = history.cell_counts(state.cells.join(asked, SUBJECT, "left_semi").unionByName(cells))
    return history.panel_of(history.winner_relative(entries), before, counts)


def advance(
    state: Carried, window: DataFrame | None, fresh: DataFrame, recheck_days: int = RECHECK_DAYS
) -> tuple[Carried, DataFrame, DataFrame]:
    """Take in a batch of whole contests, late and corrected ones included: new state, new window, panel of the window.

    ``window`` holds the entries after the state's day.  Contests of ``fresh`` replace those of the window; one on or
    before the state's day is refused, as the days before the window are closed.
    """
    if fresh.filter(~(F.col(DAY) > F.lit(state.through))).head(1):
        raise ContractError(f"contests on or before {state.through} are closed")
    if window is not None:
        fresh = window.join(fresh.select(CONTEST).distinct(), CONTEST, "left_anti").select(*fresh.columns).unionByName(fresh)
    open_ = materialize(fresh, "window")
    panel = materialize(carried_panel(state, open_), "panel")
    newest = open_.agg(F.max(DAY)).first()[0]
    cut = max(state.through, newest - dt.timedelta(days=recheck_days)) if newest else state.through
    return extend(state, open_, cut), open_.filter(F.col(DAY) > F.lit(cut)), panel


def save_state(state: Carried, path: str) -> None:
    state.daily.write.parquet(f"{path}/daily")
    state.cells.write.parquet(f"{path}/cells")
    # Last: a folder without it is no state.
    state.daily.sparkSession.range(1).select(F.lit(state.through).alias("through")).write.parquet(f"{path}/through")


def load_state(spark: SparkSession, path: str) -> Carried:
    through = spark.read.parquet(f"{path}/through").first()["through"]
    return Carried(spark.read.parquet(f"{path}/daily"), spark.read.parquet(f"{path}/cells"), through)
