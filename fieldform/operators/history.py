"""Leakage-safe history of each subject, strictly before the day of the entry.

Entries are first combined per subject and day, so that an ordered window never sees
more rows of one subject than there are calendar days, however many entries a hot
subject has.  The day states are then joined back to every entry.

Same-day entries never see each other.  Summaries of single starts (last three, previous
distance) run over all starts of earlier days in the order of day and contest id, so each day
keeps as many of its last starts as the longest summary needs; counts use all entries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldform import scale
from fieldform.contracts import forbid_columns, require_columns
from fieldform.functions.contest import distance_regime, epoch_day, relative_time
from fieldform.scale import materialize, with_group

SUBJECT, DAY, CONTEST = "subject_id", "contest_date", "contest_id"
CELL = (SUBJECT, DAY, "surface", "distance_m", "venue")
START_FIELDS = (
    "distance_m", "surface", "weight", "finish_pct", "early_pct", "rel_time", "label", "is_open_plus", "is_graded",
)
RECENT = (
    ("finish_pct", "recent3_finish_pct", 3, "avg"),
    ("label", "recent3_top3", 3, "sum"),
    ("is_open_plus", "recent3_open_plus", 3, "sum"),
    ("is_graded", "recent3_graded", 3, "sum"),
    ("rel_time", "recent3_rel_time", 3, "avg"),
    ("early_pct", "recent4_early_pct", 4, "avg"),
)
RECENT_FIELDS = tuple(dict.fromkeys(src for src, _, _, _ in RECENT))
DEPTH = max(k for _, _, k, _ in RECENT)
TRENDS = {
    "trend_finish": ("recent3_finish_pct", -1),
    "trend_time": ("recent3_rel_time", -1),
    "trend_top3": ("recent3_top3", 1),
    "trend_early": ("recent4_early_pct", -1),
}
# Blocks of earlier starts: name -> equality keys besides the subject.
COUNT_GROUPS = {"same_distance": ("surface", "distance_m"), "same_course": ("surface", "venue")}
BLOCK_KEYS = {
    "same_surface": ("surface",),
    "regime": ("surface", "regime"),
    "course_distance": ("surface", "distance_m", "venue"),
}
BLOCKS = ("near", "regime", "course_distance")
PANEL_REQUIRED = (
    CONTEST, SUBJECT, DAY, "entry_no", "field_size", "declared_size", "surface", "venue", "distance_m",
    "weight", "finish_position", "time_s", "early_pct", "finish_pct", "label", "is_open_plus", "is_graded", "draw_pct",
)


def winner_relative(entries: DataFrame) -> DataFrame:
    """Winner time of each contest and the relative loss of every entry."""
    best = F.min(F.when(F.col("finish_position") == 1, F.col("time_s"))).alias("winner_time")
    return with_group(entries, CONTEST, best).withColumn("rel_time", relative_time("time_s", "winner_time"))


# --- states per subject and day -------------------------------------------------------


def daily_totals(entries: DataFrame) -> DataFrame:
    """One row per subject and day: counts over all entries, combined map-side."""
    turf = F.lower("surface") == "turf"
    return entries.groupBy(SUBJECT, DAY).agg(
        F.count("*").alias("n"),
        F.sum("label").alias("s"),
        F.count_if(turf).alias("turf_n"),
        F.sum(F.when(turf, F.col("label")).otherwise(0)).alias("turf_s"),
    )


def daily_starts(entries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``daily_totals`` with the last ``depth`` starts of the day, oldest first.

    The rank is a filter, so Spark cuts each day to ``depth`` rows before the shuffle as well: a subject with a
    great many starts on one day sends no more of them than any other.
    """
    totals = daily_totals(entries)
    if depth == 0:
        return totals
    newest = Window.partitionBy(SUBJECT, DAY).orderBy(F.desc(CONTEST))
    narrow = entries.select(SUBJECT, DAY, CONTEST, *START_FIELDS).filter(F.col(SUBJECT).isNotNull() & F.col(DAY).isNotNull())
    last = narrow.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= depth)
    starts = F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("_at"), *START_FIELDS)))
    return totals.join(last.groupBy(SUBJECT, DAY).agg(starts.alias("starts")), [SUBJECT, DAY])


def _recent(starts: Column, source: str, k: int, op: str) -> Column:
    """Mean or sum of the known values of the last ``k`` of ``starts``, newest first; NULL if none is known.

    Sums of doubles depend on their order and ``front_share`` cuts a mean at a value that means often hit, so they
    are added in the order in which the starts are ranked.
    """
    tail = F.slice(starts, F.greatest(F.size(starts) - (k - 1), F.lit(1)), k)
    known = F.filter(F.transform(tail, lambda s: s[source].cast("double")), lambda x: x.isNotNull())
    total = F.aggregate(F.reverse(known), F.lit(0.0), lambda a, x: a + x)
    value = total / F.size(known) if op == "avg" else total.cast("long")
    return F.when(F.size(known) > 0, value)


def day_states(daily: DataFrame, depth: int = DEPTH) -> DataFrame:
    """State of a subject at the end of each of its days; ``depth`` 0 has the counts alone, 1 the last start as well."""
    upto = Window.partitionBy(SUBJECT).orderBy(DAY)
    totals = upto.rowsBetween(Window.unboundedPreceding, 0)
    counts = ["n", "s", "turf_n", "turf_s"]
    summed = [F.sum(c).over(totals).alias(c) for c in counts]
    if depth == 0:
        return daily.select(SUBJECT, DAY, *summed).select(SUBJECT, DAY, F.struct(*counts).alias("state"))
    # A day has at least one start, so the last starts lie in as many last days.
    lately = F.flatten(F.collect_list("starts").over(upto.rowsBetween(1 - depth, 0))) if depth > 1 else F.col("starts")
    out = daily.select(SUBJECT, DAY, *summed, lately.alias("lately")).withColumn("last", F.element_at("lately", -1))
    state = [
        *counts,
        F.col(DAY).alias("prev_date"),
        F.col("last.distance_m").alias("prev_distance_m"),
        F.col("last.surface").alias("prev_surface"),
        F.col("last.weight").alias("prev_weight"),
    ]
    if depth > 1:
        out = out.withColumn("recent", F.struct(*[_recent(F.col("lately"), src, k, op).alias(name) for src, name, k, op in RECENT]))
        state += [*[F.col(f"recent.{name}").alias(name) for _, name, _, _ in RECENT], F.lag("recent").over(upto).alias("before")]
    return out.select(SUBJECT, DAY, F.struct(*state).alias("state"))


def prior_states(entries: DataFrame, targets: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """(subject, day, state strictly before that day) for the days of entries or of targets."""
    states = day_states(daily_starts(entries, depth), depth)
    order = Window.partitionBy(SUBJECT).orderBy(DAY)
    if targets is None:
        return states.select(SUBJECT, DAY, F.lag("state").over(order).alias("state"))
    asked = targets.select(SUBJECT, DAY).distinct().withColumn("asked", F.lit(0))
    both = states.withColumn("asked", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    # A question sorts before the state of its own day, so it only sees earlier days.
    seen = Window.partitionBy(SUBJECT).orderBy(DAY, "asked").rowsBetween(Window.unboundedPreceding, -1)
    last = both.select(SUBJECT, DAY, "asked", F.last("state", ignorenulls=True).over(seen).alias("state"))
    return last.filter(F.col("asked") == 0).drop("asked")


def history_cells(entries: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Starts, successes and unknown outcomes per subject, day and course; targets add empty cells."""
    cells = entries.groupBy(*CELL).agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("label", F.lit(0))).alias("s"),
        F.count_if(F.col("label").isNull()).alias("u"),
    )
    if targets is not None:
        zero = F.lit(0).cast("long")
        empty = targets.select(*CELL).distinct().select("*", zero.alias("n"), zero.alias("s"), zero.alias("u"))
        cells = cells.unionByName(empty).groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ("n", "s", "u")])
    return cells


def _strictly_before(keys: Sequence[str], day: str | Column = "day") -> Window:
    return Window.partitionBy(SUBJECT, *keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)


def _before(value: str | Column, keys: Sequence[str], day: str | Column = "day") -> Column:
    return F.coalesce(F.sum(value).over(_strictly_before(keys, day)), F.lit(0))


def cell_counts(cells: DataFrame) -> DataFrame:
    """Prior starts and successes in the same distance+surface and same venue+surface."""
    return cells.withColumn("day", epoch_day(DAY)).select(*CELL, *_count_columns())


def _count_columns(n: str | Column = "n", s: str | Column = "s", day: str | Column = "day") -> list[Column]:
    cols = []
    for name, keys in COUNT_GROUPS.items():
        cols += [_before(n, keys, day).alias(f"{name}_starts"), _before(s, keys, day).alias(f"{name}_top3")]
    return cols


def cell_blocks(
    cells: DataFrame, tolerance: int = 200, blocks: Sequence[str] = ("same_surface", *BLOCKS), counts: bool = False
) -> DataFrame:
    """Prior starts and successes by block; an unknown key or prior outcome gives NULL.

    ``counts`` adds the columns of ``cell_counts`` to the same pass.
    """
    if "near" in blocks:
        cells = materialize(cells, "cells")  # read three times below
    dated = cells.withColumn("day", epoch_day(DAY)).withColumn("regime", distance_regime("distance_m"))
    out = dated.select(
        *CELL,
        *(_count_columns() if counts else []),
        *[c for name in blocks if name != "near" for c in _block_columns(name, BLOCK_KEYS[name])],
    )
    if "near" in blocks:
        near = near_counts(dated, tolerance)
        keys = (SUBJECT, "surface", "distance_m", DAY)
        out = out.join(near, list(keys), "left")
    return out


def _block_columns(name: str, keys: Sequence[str]) -> list[Column]:
    usable = F.lit(True)
    for key in keys:
        usable = usable & F.col(key).isNotNull()
    known = usable & (_before("u", keys) == 0)
    return [
        F.when(known, _before("n", keys)).alias(f"{name}_starts"),
        F.when(known, _before("s", keys)).alias(f"{name}_top3"),
    ]


def near_counts(dated: DataFrame, tolerance: int) -> DataFrame:
    """Prior totals within ``tolerance`` metres on the same surface.

    Starts meet the distinct distances of their subject through distance buckets as wide
    as the tolerance, and are totalled per distance and day before the running sum, so
    work follows starts times nearby distances and never pairs of starts.
    """
    usable = dated.filter(F.col("surface").isNotNull() & F.col("distance_m").isNotNull())
    bucket = F.floor(F.col("distance_m") / tolerance)
    daily = usable.groupBy(SUBJECT, "surface", "distance_m", DAY, "day").agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "u")]
    )
    # Distances of a subject are far fewer than its starts, so they are the side that is tripled.
    asked = usable.select(SUBJECT, "surface", F.col("distance_m").alias("at"), bucket.alias("_b")).distinct()
    asked = asked.withColumn("bucket", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))).drop("_b")
    near = daily.withColumn("bucket", bucket).join(asked, [SUBJECT, "surface", "bucket"]).filter(
        F.abs(F.col("at") - F.col("distance_m")) <= tolerance
    )
    totals = near.groupBy(SUBJECT, "surface", F.col("at").alias("distance_m"), DAY, "day").agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "u")]
    )
    return totals.select(
        SUBJECT, "surface", "distance_m", DAY, *_block_columns("near", ("surface", "distance_m"))
    )


def _join_cells(entries: DataFrame, cells: DataFrame) -> DataFrame:
    """Join on the cell keys where a NULL course key equals a NULL course key."""
    right = cells.select(*[F.col(k).alias(f"_{k}") for k in CELL], *[c for c in cells.columns if c not in CELL])
    on = [entries[k] == F.col(f"_{k}") for k in (SUBJECT, DAY)]
    on += [entries[k].eqNullSafe(F.col(f"_{k}")) for k in CELL[2:]]
    return entries.join(right, on, "left").drop(*[f"_{k}" for k in CELL])


# --- operators ------------------------------------------------------------------------


def _state_counts() -> list[Column]:
    def c(name: str) -> Column:
        return F.coalesce(F.col(f"state.{name}"), F.lit(0))

    return [
        c("n").alias("career_starts"),
        c("s").alias("career_top3"),
        c("turf_n").alias("turf_starts"),
        c("turf_s").alias("turf_top3"),
    ]


def _state_deltas() -> list[Column]:
    prev = F.col("state.prev_surface")
    return [
        F.col("state.prev_date").alias("prev_date"),
        F.datediff(DAY, "state.prev_date").alias("days_since_prev"),
        (F.col("distance_m") - F.col("state.prev_distance_m")).alias("distance_change"),
        F.when(prev.isNotNull(), F.when(F.col("surface").eqNullSafe(prev), 0).otherwise(1)).alias("surface_changed"),
        (F.col("weight") - F.col("state.prev_weight")).alias("weight_change"),
    ]


def _state_recent() -> list[Column]:
    return [F.col(f"state.{name}").alias(name) for _, name, _, _ in RECENT]


def _state_trends() -> list[Column]:
    return [
        ((F.col(f"state.{src}") - F.col(f"state.before.{src}")) * sign).alias(name)
        for name, (src, sign) in TRENDS.items()
    ]


def _with_state(entries: DataFrame, states: DataFrame, *cols: Column) -> DataFrame:
    return entries.join(states, [SUBJECT, DAY], "left").select(entries["*"], *cols)


def prior_counts(entries: DataFrame) -> DataFrame:
    """Earlier starts and successes: career, turf, same distance, same course."""
    out = _with_state(entries, prior_states(entries, depth=0), *_state_counts())
    return _join_cells(out, cell_counts(history_cells(entries)))


def prev_deltas(entries: DataFrame) -> DataFrame:
    """Days and changes since the previous start; NULL at the first."""
    return _with_state(entries, prior_states(_with_start_fields(entries), depth=1), *_state_deltas())


def recent_form(entries: DataFrame) -> DataFrame:
    """Means and counts over the last three (four) starts; no earlier start gives NULL."""
    timed = winner_relative(entries)
    return _with_state(timed, prior_states(timed), *_state_recent())


def recent_trend(entries: DataFrame) -> DataFrame:
    """Change of the recent summaries since the previous start."""
    timed = winner_relative(entries)
    return _with_state(timed, prior_states(timed), *_state_trends())


def _with_start_fields(entries: DataFrame) -> DataFrame:
    missing = [c for c in START_FIELDS if c not in entries.columns]
    return entries.select("*", *[F.lit(None).cast("double").alias(c) for c in missing])


def strict_prior_blocks(
    history: DataFrame, targets: DataFrame | None = None, tolerance: int = 200
) -> DataFrame:
    """Block histories of every entry of ``targets`` (or of the history itself).

    While no subject exceeds ``GROUP_ROWS``, entries that are their own targets move once, to one pass over their subject.
    """
    if targets is None and scale.largest_group(history, [SUBJECT]) <= scale.GROUP_ROWS:
        return _blocks_by_subject(history, tolerance)
    cells = cell_blocks(history_cells(history, targets), tolerance)
    return _join_cells(history if targets is None else targets, cells)


def front_share(entries: DataFrame, source: str = "recent4_early_pct", cut: float = 0.25) -> DataFrame:
    """Share of the field with a known and forward early position."""
    return with_group(entries, CONTEST, _forward(F.col(source), cut))


def _forward(x: Column, cut: float = 0.25) -> Column:
    return F.avg(F.when(x <= cut, 1.0).when(x.isNotNull(), 0.0)).alias("front_share")


def _with_features(rows: DataFrame, states: DataFrame, cells: DataFrame) -> DataFrame:
    """Join the field share, the courses and, last, the states: rows are not moved again once they have all columns."""
    shares = _with_state(rows.select(CONTEST, SUBJECT, DAY), states, F.col("state.recent4_early_pct").alias("_early"))
    shared = rows.join(shares.groupBy(CONTEST).agg(_forward(F.col("_early"))), CONTEST, "left")
    out = _with_state(
        _join_cells(shared, cells), states, *_state_counts(), *_state_deltas(), *_state_recent(), *_state_trends()
    )
    last = ["front_share", *[c for c in cells.columns if c not in CELL]]
    return out.select(*[c for c in out.columns if c not in last], *last)


def build_panel(entries: DataFrame, by_contest: bool = False) -> DataFrame:
    """Entry-level features from starters: counts, deltas, recent form and field context.

    While no subject exceeds ``GROUP_ROWS``, wide rows move twice: by contest to the facts of their field, and by
    subject to one pass over its starts.  Otherwise states per day are joined back, as everywhere else in this module.
    With ``by_contest``, the entries lie in buckets by contest: facts of the fields are written and meet the wide rows
    there, so these move once, when the shuffles of the facts are gone.
    """
    require_columns(entries, PANEL_REQUIRED)
    forbid_columns(entries)
    if scale.largest_group(entries, [SUBJECT]) <= scale.GROUP_ROWS:
        return _panel_by_subject(entries, by_contest)
    timed = winner_relative(entries)
    return panel_of(timed, prior_states(timed), cell_counts(history_cells(entries)))


def _by_subject(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_dated", F.col(SUBJECT).isNotNull() & F.col(DAY).isNotNull()).repartition(SUBJECT)


def _in_order() -> Window:
    """Starts in their order; those without a subject or a day have no history and are none to others."""
    return Window.partitionBy(SUBJECT, "_dated").orderBy(DAY, CONTEST)


def _lately(*fields: str) -> Column:
    return F.collect_list(F.struct(*fields)).over(_in_order().rowsBetween(-DEPTH, -1))


def _before_day(value: str | Column) -> Column:
    """``value`` at the first start of the day, which has seen what lies before the day and no more."""
    of_day = Window.partitionBy(SUBJECT, "_dated", DAY).orderBy(CONTEST)
    return F.first(value).over(of_day.rowsBetween(Window.unboundedPreceding, 0))


def _contest_runs(entries: DataFrame) -> DataFrame:
    """Winning times and early places of the entries before their days; rows without a contest have no field."""
    first = F.when(F.col("finish_position") == 1, F.col("time_s")).alias("_first")
    rows = _by_subject(entries.select(CONTEST, SUBJECT, DAY, "early_pct", first)).withColumn("_lately", _lately("early_pct"))
    early = _before_day(_recent(F.col("_lately"), "early_pct", DEPTH, "avg"))
    return rows.select(CONTEST, DAY, "_first", F.when(F.col("_dated"), early).alias("_early")).filter(F.col(CONTEST).isNotNull())


def _contest_facts(entries: DataFrame, cut: float = 0.25) -> DataFrame:
    """Winner time and share of forward runners of each contest, one row for each of its days."""
    days = _contest_runs(entries).groupBy(CONTEST, DAY).agg(
        F.min("_first").alias("_first"), F.count("_early").alias("_known"), F.count_if(F.col("_early") <= cut).alias("_forward")
    )
    whole = Window.partitionBy(CONTEST)
    known = F.sum("_known").over(whole)
    return days.select(
        F.col(CONTEST).alias("_contest"),
        F.col(DAY).alias("_day"),
        F.min("_first").over(whole).alias("winner_time"),
        F.when(known > 0, F.sum("_forward").over(whole) / known).alias("front_share"),
    )


def _whole_facts(entries: DataFrame, cut: float = 0.25) -> DataFrame:
    """The same, one row a contest."""
    known = F.count("_early")
    return _contest_runs(entries).groupBy(F.col(CONTEST).alias("_contest")).agg(
        F.min("_first").alias("winner_time"),
        F.when(known > 0, F.count_if(F.col("_early") <= cut) / known).alias("front_share"),
    )


def _panel_by_subject(entries: DataFrame, by_contest: bool) -> DataFrame:
    met = F.col(CONTEST) == F.col("_contest")
    if by_contest:
        rows = entries.join(materialize(_whole_facts(entries), "contest-facts"), met, "left")
    else:
        rows = entries.join(_contest_facts(entries), met & F.col(DAY).eqNullSafe(F.col("_day")), "left").drop("_day")
    own = [CONTEST, *[c for c in entries.columns if c != CONTEST], "winner_time", "rel_time"]
    rows = _by_subject(rows.drop("_contest")).withColumn("rel_time", relative_time("time_s", "winner_time"))
    rows = rows.select(*own, "front_share", "_dated")
    # Courses count every start of the subject, as their cells do.
    rows = rows.withColumn("_day", epoch_day(DAY)).select("*", *_count_columns(F.lit(1), F.coalesce("label", F.lit(0)), "_day"))
    cells = [f"{name}_{kind}" for name in COUNT_GROUPS for kind in ("starts", "top3")]
    turf, earlier = F.lower("surface") == "turf", _in_order().rowsBetween(Window.unboundedPreceding, -1)
    seen = {
        "n": F.count(F.lit(1)).over(earlier),
        "s": F.sum("label").over(earlier),
        "turf_n": F.count_if(turf).over(earlier),
        "turf_s": F.sum(F.when(turf, F.col("label")).otherwise(0)).over(earlier),
        "prev_date": F.lag(DAY).over(_in_order()),
        **{f"prev_{c}": F.lag(c).over(_in_order()) for c in ("distance_m", "surface", "weight")},
    }
    rows = rows.select("*", F.struct(*[c.alias(name) for name, c in seen.items()]).alias("_seen"), _lately(*RECENT_FIELDS).alias("_lately"))
    recent = F.struct(*[_recent(F.col("_lately"), src, k, op).alias(name) for src, name, k, op in RECENT])
    rows = rows.withColumns({"_seen": _before_day("_seen"), "_recent": _before_day(recent)})
    # The start before the first of this day knows what the day before had seen.
    rows = rows.withColumn("_past", F.lag("_recent").over(_in_order())).withColumn("_past", _before_day("_past"))
    known = [F.col(f"_seen.{c}") for c in seen] + [F.col(f"_recent.{name}") for _, name, _, _ in RECENT]
    rows = rows.withColumn("state", F.when(F.col("_dated"), F.struct(*known, F.col("_past").alias("before"))))
    return rows.select(
        *own, *_state_counts(), *_state_deltas(), *_state_recent(), *_state_trends(), "front_share",
        *[F.when(F.col("_dated"), F.col(c)).alias(c) for c in cells],
    )


def _blocks_by_subject(entries: DataFrame, tolerance: int) -> DataFrame:
    """The blocks of ``cell_blocks`` from windows over the starts of a subject.

    All columns of an entry travel as one value.  For the nearby distances, a start is repeated, without that value, for
    each distance of its subject that it counts for; the row of its own distance then holds the total.
    """
    keys = [SUBJECT, DAY, "surface", "distance_m", "venue", "label"]
    rows = _by_subject(entries.select(*keys, F.struct(*entries.columns).alias("_row"))).select(
        *[c for c in keys if c != "label"], "_row", "_dated", epoch_day(DAY).alias("day"), distance_regime("distance_m").alias("regime"),
        F.lit(1).alias("n"), F.coalesce("label", F.lit(0)).alias("s"), F.col("label").isNull().cast("int").alias("u"),
    )
    rows = rows.select("*", *[c for name, own in BLOCK_KEYS.items() for c in _block_columns(name, own)])
    usable = F.col("surface").isNotNull() & F.col("distance_m").isNotNull()
    rows = rows.withColumn("_distances", F.collect_set("distance_m").over(Window.partitionBy(SUBJECT, "surface")))
    own = F.col("distance_m")
    counted = F.filter("_distances", lambda at: (at == own) | (F.abs(at - own) <= tolerance))
    rows = rows.withColumn("_at", F.explode(F.when(usable, counted).otherwise(F.array(own)))).withColumn("_own", F.col("_at").eqNullSafe(own))
    found = [f"{name}_{kind}" for name in BLOCK_KEYS for kind in ("starts", "top3")]
    narrow = [F.when(F.col("_own"), F.col(c)).alias(c) for c in ("_row", *found)]
    rows = rows.select(SUBJECT, "surface", "distance_m", "day", "_at", "_own", "_dated", "n", "s", "u", *narrow)
    near = _block_columns("near", ("surface", "_at"))
    rows = rows.select("_row", "_own", "_dated", *found, *near).filter("_own")
    return rows.select("_row.*", *[F.when(F.col("_dated"), F.col(c)).alias(c) for c in (*found, "near_starts", "near_top3")])


def panel_of(timed: DataFrame, states: DataFrame, cells: DataFrame) -> DataFrame:
    """The panel of entries from the states before their days and the counts of their courses."""
    return _with_features(timed, states, cells)


def asof_context(history: DataFrame, targets: DataFrame, tolerance: int = 200) -> DataFrame:
    """Panel features of target entries from history strictly before each target date.

    ``targets`` may hold any number of contests and dates; they never count as history.
    """
    timed = winner_relative(history)
    states = prior_states(timed, targets)
    cells = cell_blocks(history_cells(history, targets), tolerance, counts=True)
    return _with_features(targets, states, cells)


def strict_history_check(panel: DataFrame) -> DataFrame:
    """Violations: same-day repeats of a subject, duplicate keys, non-strict previous dates."""
    same_day = panel.groupBy(SUBJECT, DAY).count().filter("count > 1").agg(F.count("*").alias("violations"))
    duplicate = panel.groupBy(CONTEST, SUBJECT).count().filter("count > 1").agg(F.count("*").alias("violations"))
    out = same_day.select(F.lit("same_day").alias("rule"), "violations").unionByName(
        duplicate.select(F.lit("duplicate_key").alias("rule"), "violations")
    )
    if "prev_date" in panel.columns:
        late = panel.agg(F.count_if(F.col("prev_date") >= F.col(DAY)).alias("violations"))
        out = out.unionByName(late.select(F.lit("not_before").alias("rule"), "violations"))
    return out


def one_start_per_day(entries: DataFrame) -> DataFrame:
    """The entry with the lowest contest id of each subject and day."""
    order = Window.partitionBy(SUBJECT, DAY).orderBy(CONTEST)
    return entries.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def last_k_per_subject(history: DataFrame, k: int, by: str = SUBJECT) -> DataFrame:
    """The last k starts of each subject, newest first.

    The rank filter is applied before the shuffle as well, so a hot subject sends at most
    k rows per input task.
    """
    order = Window.partitionBy(by).orderBy(F.desc(DAY), F.desc(CONTEST))
    return history.withColumn("start_no", F.row_number().over(order)).filter(F.col("start_no") <= k)


def asof_slice(
    history: DataFrame, cutoff: str, max_age_days: int, certified_through: str
) -> tuple[DataFrame, DataFrame]:
    """History before ``cutoff`` and one row that says whether it may be used.

    Rejected when nothing is left, when rows reach the cutoff, when the newest row is
    older than ``max_age_days`` or when completeness is certified for an earlier day than
    the one before the cutoff.
    """
    day = F.lit(cutoff).cast("date")
    kept = history.filter(F.col(DAY) < day)
    report = history.agg(
        F.count_if(F.col(DAY) < day).alias("rows"),
        F.count_if(F.col(DAY) >= day).alias("rows_not_before"),
        F.datediff(day, F.max(F.when(F.col(DAY) < day, F.col(DAY)))).alias("age_days"),
    ).withColumn(
        "verdict",
        F.when(F.col("rows") == 0, "empty")
        .when(F.col("age_days") > max_age_days, "stale")
        .when(F.lit(certified_through).cast("date") < F.date_sub(day, 1), "not_certified")
        .otherwise("usable"),
    )
    return kept, report


def linked_rows(entries: DataFrame, targets: Column) -> DataFrame:
    """All rows that predictors of target rows may depend on, with ``_target`` on the target rows.

    These are all contests, earlier or later, of every subject that runs in a contest of a target row, with their
    whole fields: the histories of the field, and the winners that those histories are measured against.
    """
    fields = entries.join(entries.filter(targets).select(CONTEST).distinct(), CONTEST, "left_semi")
    subjects = materialize(fields.select(SUBJECT).filter(F.col(SUBJECT).isNotNull()).distinct(), "linked-subjects")
    theirs = entries.join(subjects, SUBJECT, "left_semi")
    rows = entries.join(theirs.select(CONTEST).distinct(), CONTEST, "left_semi")
    # Their starts without a contest have no field, but count in their histories.
    lone = theirs.filter(F.col(CONTEST).isNull()).select(rows.columns)
    return rows.unionByName(lone).withColumn("_target", F.coalesce(targets, F.lit(False)))


def leakage_probe(
    entries: DataFrame, build, targets: Column, columns: Sequence[str], outcomes: Mapping[str, Column]
) -> DataFrame:
    """Replace the outcomes of target rows, rebuild, and count predictors that moved (must be 0).

    Every target row and predictor is compared.  Both builds run over ``linked_rows``, so ``build`` may look at the
    starts of a row's subject and at the fields of its own and its field's contests; what it takes from yet other rows
    is the same in both builds unless it comes from the altered rows, which are all there.
    """
    rows = materialize(linked_rows(entries, targets), "probe-rows")
    aimed, rows = rows.filter("_target"), rows.select("_target", *entries.columns)
    altered = rows.select(
        *[F.when(F.col("_target"), outcomes[c]).otherwise(F.col(c)).alias(c) if c in outcomes else F.col(c) for c in entries.columns]
    )
    keys = [CONTEST, SUBJECT]
    seen = aimed.select(*keys)
    left = build(rows.drop("_target")).join(seen, keys, "left_semi").select(*keys, *columns)
    right = build(altered).join(seen, keys, "left_semi").select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    moved = [F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(c) for c in columns]
    wide = left.join(right, keys).agg(F.count("*").alias("rows"), *moved)
    return wide.unpivot(["rows"], list(columns), "predictor", "changed")


def closure_sample(entries: DataFrame) -> DataFrame:
    """For the first contest of each year, everything its predictors may depend on, as a table of its own.

    A probe holds the target contest, and every earlier contest in which a subject of the target ran, with its whole
    field.  Contests and subjects get ids of their own in each probe, so all years are rebuilt by one plan while the
    outcomes of one year's target never count as history of another's.  ``probe`` is the year, ``is_target`` marks the target's rows.
    """
    first = entries.groupBy(F.year(DAY).alias("probe")).agg(F.min(F.struct(DAY, CONTEST)).alias("_t"))
    targets = first.filter("probe IS NOT NULL").select("probe", F.col(f"_t.{DAY}").alias("_day"), F.col(f"_t.{CONTEST}").alias("_target"))
    # Each step is written, so the next join knows its size and need not move all entries to meet a few keys.
    targets = materialize(targets, "closure-targets")
    subjects = entries.join(targets, entries[CONTEST] == F.col("_target")).select("probe", "_day", "_target", SUBJECT).distinct()
    subjects = materialize(subjects, "closure-subjects")
    theirs = entries.select(SUBJECT, CONTEST, F.col(DAY).alias("_when")).join(subjects, SUBJECT)
    theirs = theirs.filter((F.col("_when") < F.col("_day")) | (F.col(CONTEST) == F.col("_target"))).select("probe", "_target", CONTEST).distinct()
    theirs = materialize(theirs, "closure-contests")
    rows = entries.join(theirs, CONTEST).withColumn("is_target", F.col(CONTEST) == F.col("_target")).drop("_target")
    own = lambda c: (F.col(c) * 10_000 + F.col("probe")).alias(c)
    return rows.select(*[own(c) if c in (CONTEST, SUBJECT) else F.col(c) for c in entries.columns], "probe", "is_target")


def leakage_closure(
    entries: DataFrame, build, columns: Sequence[str], field_columns: Sequence[str], outcomes: Mapping[str, Mapping[str, Column]]
) -> DataFrame:
    """``probe, variant, level, predictor, rows, changed`` over the closure sample; ``changed`` must be 0.

    ``outcomes`` maps each variant (outcomes nulled, inverted, ...) to replacements of the target rows.  Predictors in
    ``field_columns``, which compare within the target's field, are reported apart.
    """
    sample = materialize(closure_sample(entries), "closure")
    keys = [CONTEST, SUBJECT]
    targets = sample.filter("is_target").select(*keys, "probe")

    def rebuilt(rows: DataFrame) -> DataFrame:
        return build(rows.drop("probe", "is_target")).select(*keys, *columns)

    left = materialize(rebuilt(sample).join(targets, keys), "probe")
    parts = []
    for variant, changes in outcomes.items():
        altered = sample.select(*[F.when(F.col("is_target"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in sample.columns])
        right = rebuilt(altered).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
        # Left: a target row that the altered build loses counts as changed.
        moved = [F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(c) for c in columns]
        wide = left.join(right, keys, "left").groupBy("probe").agg(F.count("*").alias("rows"), *moved)
        parts.append(wide.unpivot(["probe", "rows"], list(columns), "predictor", "changed").withColumn("variant", F.lit(variant)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("level", F.when(F.col("predictor").isin(*field_columns), "field").otherwise("entry"))
