"""Choosing between candidates by paired losses with a date-clustered one-standard-error gate.

``losses`` is the output of ``contest_losses``: (candidate, contest_id, block, rows, brier,
log_loss).  Candidate tables are small; decisions are one-row DataFrames, never driver code.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldform.functions.probability import brier, convex_blend, log_loss
from fieldform.operators.metrics import candidate_scores
from fieldform.operators.quality import first_qualifying_window
from fieldform.scale import materialize, names

CONTEST = "contest_id"
GATE_SLACK = 1e-15  # fixed value
DEFAULT_WEIGHTS = tuple(round(i * 0.05, 10) for i in range(21))


def clustered_mean_se(df: DataFrame, values: Sequence[str] | str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and cluster-robust standard error of each value column.

    Var = G/(G-1) * sum over clusters of (sum of centred values)^2 / n^2; one cluster gives
    an infinite error.  Clusters are totalled first, so nothing larger than the number of
    clusters is shuffled twice.
    """
    cols = names(values)
    keys = names(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    sums = rows.groupBy(*keys, cluster).agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in cols])
    out = _mean_se_of_sums(sums, cols, keys)
    return out if by else out.drop("_all")


def _mean_se_of_sums(sums: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The same from one row per group and cluster: rows ``_n`` and the sum of each value."""
    means = sums.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.count("*").alias("clusters"),
        *[(F.sum(c) / F.sum("_n")).alias(f"mean_{c}") for c in cols],
    )
    squares = sums.join(means, keys).groupBy(*keys, "n", "clusters", *[f"mean_{c}" for c in cols]).agg(
        *[F.sum(F.pow(F.col(c) - F.col("_n") * F.col(f"mean_{c}"), 2)).alias(f"_q_{c}") for c in cols]
    )
    g = F.col("clusters")

    def error(c: str) -> Column:
        variance = g / (g - 1) * F.col(f"_q_{c}") / (F.col("n") * F.col("n"))
        return F.when(g < 2, F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))))

    return squares.select("*", *[error(c).alias(f"se_{c}") for c in cols]).drop(*[f"_q_{c}" for c in cols])


def best_candidate(scores: DataFrame, order: Sequence[str] = ("macro_brier", "macro_log_loss", "candidate")) -> Column:
    """Name of the point-best candidate as a scalar."""
    return scores.agg(F.min_by("candidate", F.struct(*order))).scalar()


def paired_delta(losses: DataFrame, reference: Column | str) -> DataFrame:
    """Candidate minus reference per contest, summarized with date-clustered errors.

    Candidates must cover the contests of the reference: ``unpaired`` counts the ones that do not.
    """
    name = F.lit(reference) if isinstance(reference, str) else reference
    ref = losses.filter(F.col("candidate") == name).select(
        CONTEST, "block", F.col("brier").alias("_rb"), F.col("log_loss").alias("_rl")
    )
    joined = losses.join(ref, [CONTEST, "block"]).select(
        "candidate", "block",
        (F.col("brier") - F.col("_rb")).alias("brier"),
        (F.col("log_loss") - F.col("_rl")).alias("log_loss"),
    )
    stats = clustered_mean_se(joined, ["brier", "log_loss"], "block", ["candidate"])
    expected = losses.groupBy("candidate").agg(F.count("*").alias("_own"))
    total = ref.agg(F.count("*")).scalar()
    gap = F.greatest(F.col("_own"), total) - F.coalesce(F.col("n"), F.lit(0))
    return expected.join(stats, "candidate", "left").withColumn("unpaired", gap).drop("_own").withColumnsRenamed(DELTAS)


DELTAS = {
    "n": "contests", "mean_brier": "mean_brier_delta", "se_brier": "se_brier_delta", "mean_log_loss": "mean_log_loss_delta",
    "se_log_loss": "se_log_loss_delta",
}


def within(delta: str, error: str, k: float) -> Column:
    return F.col(delta) <= k * F.col(error) + GATE_SLACK


def score_table(losses: DataFrame, k: float = 1.0) -> DataFrame:
    """Scores of all candidates with their paired difference to the point-best one."""
    scores = candidate_scores(losses)
    best = best_candidate(scores)
    return _judged(scores, paired_delta(losses, best).drop("contests"), best, k)


def _judged(scores: DataFrame, delta: DataFrame, best: Column, k: float) -> DataFrame:
    covered = F.when(F.col("unpaired") == 0, F.col("mean_brier_delta")).otherwise(
        F.raise_error(F.lit("candidates must cover identical contests")).cast("double")
    )
    return (
        scores.join(delta, "candidate")
        .withColumn("mean_brier_delta", covered)
        .withColumn("is_best", F.col("candidate") == best)
        .withColumn("within_brier", within("mean_brier_delta", "se_brier_delta", k))
        .withColumn("within_log_loss", within("mean_log_loss_delta", "se_log_loss_delta", k))
    )


def select_one_se(losses: DataFrame, incumbent: str | None, k: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Keep the incumbent while it lies within k standard errors of the best, else take the best."""
    if k < 0:
        raise ValueError("k must not be negative")
    # Scores, reference and differences all read the losses; compute them once.
    table = score_table(materialize(losses, "losses"), k)
    return table, _decided(table, incumbent)


def _decided(table: DataFrame, incumbent: str | None) -> DataFrame:
    is_incumbent = F.col("candidate") == F.lit(incumbent)
    kept = F.coalesce(F.max(F.when(is_incumbent, F.col("within_brier"))), F.lit(False))
    decision = table.agg(
        F.max(F.when(F.col("is_best"), F.col("candidate"))).alias("point_best"),
        kept.alias("incumbent_retained"),
        F.count_if(is_incumbent).alias("_present"),
    )
    present = F.lit(incumbent is None) | (F.col("_present") == 1)
    winner = F.when(F.col("incumbent_retained"), F.lit(incumbent)).otherwise(F.col("point_best"))
    failed = F.raise_error(F.lit("the incumbent is not among the candidates")).cast("string")
    return decision.select(
        F.when(present, winner).otherwise(failed).alias("winner"),
        "point_best",
        F.lit(incumbent).cast("string").alias("incumbent"),
        "incumbent_retained",
    )


def grouped_scores(losses: DataFrame, by: Sequence[str], k: float = 1.0) -> DataFrame:
    """``score_table`` of every group of ``by`` at once, with the point-best candidate of the group."""
    if k < 0:
        raise ValueError("k must not be negative")
    keys = names(by)
    losses = materialize(losses, "losses")
    scores = candidate_scores(losses, (*keys, "candidate"))
    order = F.struct("macro_brier", "macro_log_loss", "candidate")
    best = scores.groupBy(*keys).agg(F.min_by("candidate", order).alias("point_best"))
    scores = scores.join(best, keys)
    # One row per group and contest: far fewer than entries, and each group has one reference.
    ref = losses.join(best, keys).filter("candidate = point_best").select(
        *keys, CONTEST, "block", F.col("brier").alias("_rb"), F.col("log_loss").alias("_rl")
    )
    gaps = losses.join(ref, [*keys, CONTEST, "block"]).select(
        *keys, "candidate", "block", (F.col("brier") - F.col("_rb")).alias("brier"), (F.col("log_loss") - F.col("_rl")).alias("log_loss")
    )
    stats = clustered_mean_se(gaps, ["brier", "log_loss"], "block", [*keys, "candidate"]).withColumnsRenamed({c: d for c, d in DELTAS.items() if c != "n"})
    return _grouped_table(scores, stats, keys, k)


def _grouped_table(scores: DataFrame, stats: DataFrame, keys: Sequence[str], k: float = 1.0) -> DataFrame:
    expected = scores.groupBy(*keys).agg(F.min("contests").alias("_least"), F.max("contests").alias("_most"))
    out = scores.join(expected, keys).join(stats, [*keys, "candidate"], "left")
    covered = F.when((F.col("_least") == F.col("_most")) & (F.col("n") == F.col("contests")), F.col("mean_brier_delta")).otherwise(
        F.raise_error(F.lit("candidates must cover identical contests")).cast("double")
    )
    return (
        out.withColumn("mean_brier_delta", covered)
        .drop("n", "_least", "_most")
        .withColumn("is_best", F.col("candidate") == F.col("point_best"))
        .withColumn("within_brier", within("mean_brier_delta", "se_brier_delta", k))
        .withColumn("within_log_loss", within("mean_log_loss_delta", "se_log_loss_delta", k))
    )


def grouped_gate(losses: DataFrame, by: Sequence[str], incumbents: DataFrame, k: float = 1.0) -> DataFrame:
    """One decision per group: the incumbent while it lies within k standard errors of the best, else the best.

    ``incumbents`` has one row (``by``..., incumbent) for each group; an incumbent that is no candidate fails the job.
    """
    keys = names(by)
    table = grouped_scores(losses, keys, k).join(incumbents, keys)
    own = F.col("candidate") == F.col("incumbent")
    decided = table.groupBy(*keys, "incumbent", "point_best").agg(
        F.max(F.when(own, F.col("within_brier"))).alias("incumbent_retained"), F.first("contests").alias("contests"),
        F.max(F.when(own, F.col("mean_brier_delta"))).alias("mean_brier_delta"), F.max(F.when(own, F.col("se_brier_delta"))).alias("se_brier_delta"),
    )
    failed = F.raise_error(F.lit("the incumbent is not among the candidates")).cast("string")
    winner = F.when(F.col("incumbent_retained"), F.col("incumbent")).when(~F.col("incumbent_retained"), F.col("point_best")).otherwise(failed)
    return decided.withColumn("winner", winner)


def grouped_simplest(losses: DataFrame, by: Sequence[str], complexity: DataFrame) -> DataFrame:
    """``select_simplest_one_se`` for every group of ``by`` at once; ``complexity`` ranks the candidates."""
    keys = names(by)
    return _simplest(grouped_scores(losses, keys), keys, complexity)


def _simplest(table: DataFrame, keys: Sequence[str], complexity: DataFrame) -> DataFrame:
    table = table.join(complexity, "candidate")
    order = F.when(F.col("within_brier"), F.struct("complexity_rank", "macro_brier", "macro_log_loss", "candidate"))
    chosen = table.groupBy(*keys).agg(F.min(order).alias("_first")).select(*keys, F.col("_first.candidate").alias("selected"))
    return table.join(chosen, keys).withColumn("is_selected", F.col("candidate") == F.col("selected")).drop("selected")


def select_simplest_one_se(losses: DataFrame, complexity: DataFrame) -> DataFrame:
    """Among candidates within one standard error of the best, the least complex one."""
    table = score_table(materialize(losses, "losses")).join(complexity, "candidate")
    order = F.struct("complexity_rank", "macro_brier", "macro_log_loss", "candidate")
    chosen = table.filter("within_brier").agg(F.min_by("candidate", order)).scalar()
    return table.withColumn("is_selected", F.col("candidate") == chosen)


# --- review of locked weights ---------------------------------------------------------

# What a review needs before any score is shown.
REVIEW_CONTESTS, REVIEW_DATES, REVIEW_DAYS = 1000, 60, 90
LOCKED = ("w000", "w010", "w025", "w050", "w100")


def review_decision(
    df: DataFrame, locked: Sequence[str] = LOCKED, contests: int = REVIEW_CONTESTS, dates: int = REVIEW_DATES,
    days: int = REVIEW_DAYS,
) -> DataFrame:
    """One row: ``collecting`` with counts only, or the decision over the rows up to the first qualifying day.

    ``df`` has (contest_id, contest_date, label) and ``p_<name>`` for each locked candidate; the first of
    them is the incumbent.  Rows after the window never enter the decision.
    """
    window = materialize(first_qualifying_window(df, contests, dates, days), "window")
    row = window.first()
    none = F.lit(None)
    if row["window_end"] is None:
        return window.select(
            "*", none.cast("string").alias("winner"), none.cast("string").alias("point_best"), none.cast("boolean").alias("incumbent_retained")
        )
    inside = df.filter(F.col("contest_date") <= F.lit(row["window_end"]))
    # One wide aggregation per contest; candidates unfold after it.
    means = [f(f"p_{c}", "label") for c in locked for f in (brier, log_loss)]
    wide = inside.groupBy(CONTEST, F.col("contest_date").alias("block")).agg(
        F.count("*").alias("rows"), *[F.avg(m).alias(f"m{i}") for i, m in enumerate(means)]
    )
    items = [
        F.struct(F.lit(c).alias("candidate"), F.col(f"m{2 * i}").alias("brier"), F.col(f"m{2 * i + 1}").alias("log_loss"))
        for i, c in enumerate(locked)
    ]
    losses = wide.select(CONTEST, "block", "rows", F.explode(F.array(*items)).alias("_i")).select(CONTEST, "block", "rows", "_i.*")
    decision = select_one_se(losses, locked[0])[1].drop("incumbent")
    # Two tables of one row each.
    return window.withColumn("_one", F.lit(1)).join(decision.withColumn("_one", F.lit(1)), "_one").drop("_one")


# --- many candidates in one row a contest ----------------------------------------------


def _unfold(wide: DataFrame, keys: Sequence[str], items: Sequence[Column]) -> DataFrame:
    return wide.select(*keys, F.explode(F.array(*items)).alias("_i")).select("_i.*", *keys)


def wide_scores(wide: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """``candidate_scores`` from one row a contest with ``rows`` and the mean losses ``_b<i>`` and ``_l<i>`` of each candidate."""
    n = F.sum("rows")
    aggs = [F.count("*").alias("contests"), n.alias("rows")]
    for i in range(len(candidates)):
        for kind, name in (("b", "brier"), ("l", "log_loss")):
            own = F.col(f"_{kind}{i}")
            aggs += [F.avg(own).alias(f"macro_{name}{i}"), (F.sum(own * F.col("rows")) / n).alias(f"micro_{name}{i}")]
    scores = ("macro_brier", "macro_log_loss", "micro_brier", "micro_log_loss")
    items = [F.struct(F.lit(c).alias("candidate"), *[F.col(f"{s}{i}").alias(s) for s in scores]) for i, c in enumerate(candidates)]
    out = _unfold(wide.agg(*aggs).filter("contests > 0"), ["contests", "rows"], items)
    return out.select("candidate", *scores, "contests", "rows")


def wide_day_sums(wide: DataFrame, candidates: Sequence[str], reference: Callable[[str, int], Column], contest: str = CONTEST) -> DataFrame:
    """(candidate, block, _n, brier, log_loss): differences to ``reference(kind, i)``, the loss that candidate i is held against.

    As in a join by contest and day, rows that lack either meet no reference.
    """
    size = range(len(candidates))
    sums = [F.sum(F.col(f"_{kind}{i}") - reference(kind, i)).alias(f"_{kind}{i}") for kind in ("b", "l") for i in size]
    known = wide.filter(F.col(contest).isNotNull() & F.col("block").isNotNull())
    by_block = known.groupBy("block").agg(F.count("*").alias("_n"), *sums)
    items = [F.struct(F.lit(c).alias("candidate"), F.col(f"_b{i}").alias("brier"), F.col(f"_l{i}").alias("log_loss")) for i, c in enumerate(candidates)]
    return _unfold(by_block, ["block", "_n"], items)


def wide_simplest(wide: Mapping[object, DataFrame], key: str, family: Mapping[str, str], complexity: DataFrame) -> DataFrame:
    """``grouped_simplest`` by ``key`` and family; ``wide`` holds one row a contest for each value of ``key``.

    ``family`` names the family of each candidate, in the order of the losses.  Nothing is joined by contest.
    """
    candidates, keys = [*family], [key, "family"]
    spark = complexity.sparkSession
    families = F.broadcast(spark.createDataFrame([*family.items()], "candidate string, family string"))  # one row a candidate
    scores = [wide_scores(rows, candidates).withColumn(key, F.lit(value)) for value, rows in wide.items()]
    scores = materialize(reduce(DataFrame.unionByName, scores).join(families, "candidate"), "scores")
    best = scores.groupBy(*keys).agg(F.min_by("candidate", F.struct("macro_brier", "macro_log_loss", "candidate")).alias("point_best"))
    best = materialize(best, "best")
    first = {(r[key], r["family"]): candidates.index(r["point_best"]) for r in best.collect()}  # one row a group

    def held(value: object) -> Callable[[str, int], Column]:
        return lambda kind, i: F.col(f"_{kind}{first.get((value, family[candidates[i]]), i)}")

    days = [wide_day_sums(rows, candidates, held(value)).withColumn(key, F.lit(value)) for value, rows in wide.items()]
    days = materialize(reduce(DataFrame.unionByName, days).join(families, "candidate"), "days")
    stats = _mean_se_of_sums(days, ["brier", "log_loss"], [*keys, "candidate"]).withColumnsRenamed({c: d for c, d in DELTAS.items() if c != "n"})
    return _simplest(_grouped_table(scores.join(best, keys), stats, keys), keys, complexity)


# --- blends ---------------------------------------------------------------------------


def blend_name(weight: float) -> str:
    return f"blend_w{weight:.2f}"


def _grid(weights: Sequence[float]) -> list[float]:
    grid = sorted({round(w, 10) for w in weights})
    if not grid or grid[0] < 0 or grid[-1] > 1:
        raise ValueError("weights must lie in [0, 1]")
    if 0.0 not in grid:
        raise ValueError("the grid must hold the market-only weight 0")
    return grid


def _blend_contests(df: DataFrame, market: str, model: str, grid: Sequence[float], contest: str, block: str, y: str) -> DataFrame:
    """One row per contest and block: ``rows`` and the mean losses ``_b<i>`` and ``_l<i>`` of each blend.

    Entries meet by contest once, with five narrow columns and before they unfold by weight.  A blend is unknown
    where a price or a label is, so all weights count the same entries.
    """
    m, n = F.col("_m"), F.col("_n")
    rows = df.select(F.col(contest), F.col(block).alias("block"), F.col(market).alias("_m"), F.col(model).alias("_n"), F.col(y)).repartition(contest)
    p = [convex_blend(m, n, F.lit(w)) for w in grid]
    losses = [(f"_{kind}{i}", f(q, y)) for i, q in enumerate(p) for kind, f in (("b", brier), ("l", log_loss))]
    known = [F.count(c).alias(f"_known{name[1]}") for name, c in losses[:2]]
    out = rows.groupBy(contest, "block").agg(F.count("*").alias("rows"), *known, *[F.sum(c).alias(name) for name, c in losses])
    means = [F.when(F.col(f"_known{name[1]}") > 0, F.col(name) / F.col(f"_known{name[1]}")).alias(name) for name, _ in losses]
    return out.select(contest, "block", "rows", *means)


def blend_losses(
    df: DataFrame, market: str, model: str, weights: Sequence[float] = DEFAULT_WEIGHTS,
    contest: str = CONTEST, block: str = "contest_date", y: str = "label",
) -> DataFrame:
    """Contest losses of every blend weight in one pass; contests unfold by weight after it."""
    grid = _grid(weights)
    items = [
        F.struct(F.lit(blend_name(w)).alias("candidate"), F.lit(w).alias("weight"), F.col(f"_b{i}").alias("brier"), F.col(f"_l{i}").alias("log_loss"))
        for i, w in enumerate(grid)
    ]
    out = _unfold(_blend_contests(df, market, model, grid, contest, block, y), [contest, "block", "rows"], items)
    return out.select("candidate", "weight", contest, "block", "rows", "brier", "log_loss")


def _weighted(scores: DataFrame, grid: Sequence[float]) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for w in grid for x in (blend_name(w), w)])
    return scores.withColumn("weight", weight[F.col("candidate")])


def blend_grid(df: DataFrame, market: str, model: str, weights: Sequence[float] = DEFAULT_WEIGHTS,
               radius: float = 0.1) -> DataFrame:
    """Micro scores per weight; the best has the lowest Brier, then log loss, then weight."""
    grid = _grid(weights)
    wide = _blend_contests(df, market, model, grid, CONTEST, "contest_date", "label")
    scores = materialize(_weighted(wide_scores(wide, [blend_name(w) for w in grid]), grid), "blend-scores").select(
        "weight", F.col("micro_brier").alias("brier"), F.col("micro_log_loss").alias("log_loss"), "rows", "contests"
    )
    chosen = scores.agg(F.min_by("weight", F.struct("brier", "log_loss", "weight"))).scalar()
    near = F.abs(F.col("weight") - chosen) <= radius + 1e-12
    return scores.withColumn("is_selected", F.col("weight") == chosen).withColumn("is_nearby", near)


def blend_one_se(
    df: DataFrame, market: str, model: str, weights: Sequence[float] = DEFAULT_WEIGHTS
) -> tuple[DataFrame, DataFrame]:
    """Blend grid under the gate with the market (weight 0) as the incumbent.

    Losses stay one row a contest, so scores and paired differences are sums over it and nothing is joined by contest.
    """
    grid = _grid(weights)
    wide = materialize(_blend_contests(df, market, model, grid, CONTEST, "contest_date", "label"), "blend-losses")
    blends = [blend_name(w) for w in grid]
    scores = materialize(_weighted(wide_scores(wide, blends), grid), "blend-scores")
    best = best_candidate(scores)
    place = F.array_position(F.array(*[F.lit(c) for c in blends]), best).cast("int") - 1
    top = {kind: F.get(F.array(*[F.col(f"_{kind}{i}") for i in range(len(grid))]), place) for kind in ("b", "l")}
    days = materialize(wide_day_sums(wide, blends, lambda kind, _: top[kind]), "blend-days")
    stats = _mean_se_of_sums(days, ["brier", "log_loss"], ["candidate"])
    total = scores.select("candidate", F.col("contests").alias("_own"))
    delta = total.join(stats, "candidate", "left").withColumn("unpaired", F.col("_own") - F.coalesce(F.col("n"), F.lit(0)))
    table = _judged(scores.drop("weight"), delta.drop("_own", "n").withColumnsRenamed(DELTAS), best, 1.0)
    registry = scores.select("candidate", "weight")
    return table.join(registry, "candidate"), _decided(table, blend_name(0.0)).join(registry.withColumnRenamed("candidate", "winner"), "winner")


def sensitivity_range(variants: DataFrame, contest: str = CONTEST, entry: str = "subject_id") -> DataFrame:
    """Spread of the probability and of the rank of each entry over all variants."""
    return variants.groupBy(contest, entry).agg(
        F.min("p").alias("p_min"), F.max("p").alias("p_max"),
        F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"),
    )


def top_regrets(df: DataFrame, p_a: str, p_b: str, y: str = "label", k: int = 5) -> DataFrame:
    """Entries where candidate a lost most against b in squared error."""
    regret = brier(p_a, y) - brier(p_b, y)
    return df.withColumn("regret", regret).orderBy(F.desc("regret"), CONTEST, "subject_id").limit(k)
