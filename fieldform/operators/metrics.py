"""Proper scores, calibration and diagnostics over a long table of predictions.

``preds`` holds (candidate, contest_id, contest_date, subject_id, label, p).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldform.functions.contest import FIELD_BANDS, REST_BANDS, START_BANDS, right_closed
from fieldform.functions.probability import apply_logit_calibrator, brier, field_size_baseline, log_loss, logit
from fieldform.scale import materialize, names, rank_rows, with_group

CONTEST, BLOCK = "contest_id", "contest_date"
DIMENSIONS = ("year", "field_size_band", "contest_class", "venue", "rest_band", "starts_band")


def entry_losses(df: DataFrame, p: str = "p", y: str = "label") -> DataFrame:
    """Brier on the raw probability, log loss on the clipped one."""
    valid = F.col(p).between(0, 1) & F.col(y).isin(0, 1)
    checked = F.when(valid, F.col(p).cast("double")).otherwise(
        F.raise_error(F.lit("probabilities must lie in [0, 1] and labels be 0 or 1")).cast("double")
    )
    return df.withColumn("brier", brier(checked, y)).withColumn("log_loss", log_loss(checked, y))


def micro_scores(df: DataFrame, by: Sequence[str] = ("candidate",), p: str = "p", y: str = "label") -> DataFrame:
    return (
        entry_losses(df, p, y)
        .groupBy(*by)
        .agg(
            F.count("*").alias("rows"),
            F.avg("brier").alias("micro_brier"),
            F.avg("log_loss").alias("micro_log_loss"),
            F.avg(y).alias("observed_rate"),
            F.avg(p).alias("mean_predicted"),
        )
    )


def contest_losses(
    preds: DataFrame, by: Sequence[str] = ("candidate",), contest: str = CONTEST, block: str = BLOCK, y: str = "label"
) -> DataFrame:
    """Mean losses per contest; the date block must be known and constant in a contest."""
    out = (
        entry_losses(preds, "p", y)
        .groupBy(*by, contest)
        .agg(
            F.min(block).alias("block"),
            F.max(block).alias("_last"),
            F.count(block).alias("_dated"),
            F.count("*").alias("rows"),
            F.avg("brier").alias("brier"),
            F.avg("log_loss").alias("log_loss"),
        )
    )
    return _sound(out)


def _sound(losses: DataFrame) -> DataFrame:
    sound = (F.col("block") == F.col("_last")) & (F.col("_dated") == F.col("rows"))
    failed = F.raise_error(F.lit("block must be known and constant within each contest")).cast("date")
    return losses.withColumn("block", F.when(sound, F.col("block")).otherwise(failed)).drop("_last", "_dated")


def wide_contest_losses(
    rows: DataFrame, probabilities: Sequence[Column], contest: str = CONTEST, block: str = BLOCK, y: str = "label"
) -> DataFrame:
    """``contest_losses`` of many forecasts, one row a contest: ``rows`` and the means ``_b<i>`` and ``_l<i>`` of each.

    Entries meet by contest once and do not unfold by forecast.  ``rows`` should hold little besides what forecasts read.
    """
    failed = F.raise_error(F.lit("probabilities must lie in [0, 1] and labels be 0 or 1")).cast("double")
    met, means = rows.repartition(contest), []
    met = met.select(contest, block, y, *[p.cast("double").alias(f"_p{i}") for i, p in enumerate(probabilities)])
    for i in range(len(probabilities)):
        p = F.col(f"_p{i}")
        checked = F.when(p.between(0, 1) & F.col(y).isin(0, 1), p).otherwise(failed)
        means += [F.avg(brier(checked, y)).alias(f"_b{i}"), F.avg(log_loss(checked, y)).alias(f"_l{i}")]
    return _sound(
        met.groupBy(contest).agg(
            F.min(block).alias("block"), F.max(block).alias("_last"), F.count(block).alias("_dated"), F.count("*").alias("rows"), *means
        )
    )


def candidate_scores(losses: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Macro scores (equal contest weight) and micro scores (equal entry weight)."""
    n = F.sum("rows")
    return losses.groupBy(*by).agg(
        F.avg("brier").alias("macro_brier"),
        F.avg("log_loss").alias("macro_log_loss"),
        (F.sum(F.col("brier") * F.col("rows")) / n).alias("micro_brier"),
        (F.sum(F.col("log_loss") * F.col("rows")) / n).alias("micro_log_loss"),
        F.count("*").alias("contests"),
        n.alias("rows"),
    )


def reliability_table(
    df: DataFrame, p: str = "p", y: str = "label", q: int = 10, by: Sequence[str] = (),
    tie: Sequence[str] = (CONTEST, "subject_id"),
) -> DataFrame:
    """Equal-frequency bins over first-come ranks of the probability.

    Bin edges are the linear quantiles of the ranks 1..n and close on the right.
    """
    if q < 2:
        raise ValueError("at least 2 bins are needed")
    keys = names(by)
    ranked = rank_rows(df.select(*keys, p, y, *tie), keys, [F.col(p), *[F.col(t) for t in tie]], "_r")
    if keys:
        ranked = with_group(ranked, keys, F.count("*").alias("_n"))
    else:
        ranked = ranked.withColumn("_n", ranked.agg(F.count("*")).scalar())
    bins = F.least(F.lit(q), F.col("_n"))
    edge = F.ceil((F.col("_r") - 1) * bins / (F.col("_n") - 1.0)) - 1
    return (
        ranked.withColumn("bin", F.when(F.col("_n") > 1, F.greatest(edge, F.lit(0))).otherwise(0))
        .groupBy(*keys, "bin")
        .agg(
            F.count("*").alias("rows"),
            F.avg(p).alias("mean_predicted"),
            F.avg(y).alias("observed_rate"),
            F.min(p).alias("min_predicted"),
            F.max(p).alias("max_predicted"),
        )
        .withColumn("gap", F.col("observed_rate") - F.col("mean_predicted"))
    )


def ece(reliability: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row-weighted mean absolute calibration gap."""
    gap = F.sum(F.col("rows") * F.abs("gap")) / F.sum("rows")
    return reliability.groupBy(*by).agg(gap.alias("ece"), F.sum("rows").alias("rows"))


def field_sum_check(df: DataFrame, p: str = "p", by: Sequence[str] = ("candidate",), slots: float = 3.0) -> DataFrame:
    sums = df.groupBy(*by, CONTEST).agg(F.sum(p).alias("_sum"))
    return sums.groupBy(*by).agg(
        F.count("*").alias("contests"),
        F.avg("_sum").alias("mean_sum"),
        F.max(F.abs(F.col("_sum") - slots)).alias("max_abs_error"),
    )


# --- calibration line -----------------------------------------------------------------

MOST_STEPS, SCORE_TOLERANCE = 60, 1e-9
#: Parts of a Newton step that one pass tries if the whole step loses; the first that does not lose likelihood is taken.
PARTS = (1.0, 0.5, 0.25, 0.0625, 0.00390625)
BROADCAST_GROUPS = 10_000


def calibration_line(
    df: DataFrame, p: str = "p", y: str = "label", by: Sequence[str] = (), min_rows: int = 10
) -> DataFrame:
    """Unpenalized fit of logit(P(y)) = intercept + slope * logit(p), for every group at once.

    Newton steps from (logit of the rate, 0).  One pass over the rows evaluates a step, and smaller parts of it
    once a group has lost likelihood by a whole one; groups that are done leave the later passes.  ``converged`` says that both score equations hold.  Fewer than ``min_rows`` rows,
    a single outcome, equal logits throughout or separated outcomes have no finite line and give NULL.
    """
    keys = names(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    rows = rows.filter(F.col(p).isNotNull()).select(*keys, logit(p).alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = materialize(rows, "logits")
    fit = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("_y").alias("positives"))
    usable = (F.col("rows") >= min_rows) & (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    zero = F.lit(0.0)
    fit = fit.select(
        *keys, "rows", "positives", F.when(usable, F.ln(F.col("positives") / (F.col("rows") - F.col("positives")))).alias("a"), zero.alias("b"),
        zero.alias("da"), zero.alias("db"), F.lit(float("-inf")).alias("best"), (~F.coalesce(usable, F.lit(False))).alias("done"),
        F.lit(False).alias("converged"),
    )
    fit = materialize(fit, "lines")
    hint = F.broadcast if fit.count() <= BROADCAST_GROUPS else (lambda side: side)
    # Most often the whole step is taken, so its parts are tried only once some group has lost by it.
    parts = PARTS[:1]
    for _ in range(MOST_STEPS):
        if not fit.filter("not done").head(1):
            break
        step = materialize(_newton_step(rows, fit, keys, hint, parts), "lines")
        if len(parts) == 1 and step.filter("_lost").head(1):
            parts = PARTS
            step = materialize(_newton_step(rows, fit, keys, hint, parts), "lines")
        fit = step.drop("_lost")
    found = F.col("converged")
    # The step that is left is known and too small to matter to the scores, but not always to the line.
    line = [F.when(found, F.col(c) + F.col(f"d{c}")).alias(name) for c, name in (("a", "intercept"), ("b", "slope"))]
    out = fit.select(*keys, "rows", "positives", *line, "converged")
    return out.drop("_all") if not by else out


def _newton_step(rows: DataFrame, fit: DataFrame, keys: list[str], hint, parts: Sequence[float]) -> DataFrame:
    """Take the longest part of each pending step that does not lose likelihood, and find the next step.

    ``_lost`` marks groups that none of the parts helps.
    """
    x, y = F.col("_x"), F.col("_y")
    sums = []
    for k, part in enumerate(parts):
        z = F.col("a") + part * F.col("da") + (F.col("b") + part * F.col("db")) * x
        mu = 1 / (1 + F.exp(-z))
        w = mu * (1 - mu)
        gain = y * z - F.greatest(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))
        sums += [F.sum(v).alias(f"{n}{k}") for n, v in (("l", gain), ("g", y - mu), ("j", (y - mu) * x), ("h", w), ("i", w * x), ("k", w * x * x))]
    active = fit.filter("not done").select(*keys, "a", "b", "da", "db")
    seen = rows.join(hint(active), keys).groupBy(*keys).agg(*sums)
    taken = F.lit(None).cast("struct<part:double,l:double,g:double,j:double,h:double,i:double,k:double>")
    for k in reversed(range(len(parts))):
        tried = F.struct(F.lit(parts[k]).alias("part"), *[F.col(f"{n}{k}").alias(n) for n in "lgjhik"])
        # Equal likelihood up to rounding is no loss.
        held = F.col(f"l{k}") >= F.col("best") - 1e-12 * F.abs(F.col("best"))
        taken = F.when(F.coalesce(held | (F.col("best") == float("-inf")), F.lit(False)), tried).otherwise(taken)
    joined = fit.join(hint(seen), keys, "left").withColumn("t", F.when(~F.col("done"), taken))
    t = {n: F.col(f"t.{n}") for n in ("part", *"lgjhik")}
    det = t["h"] * t["k"] - t["i"] * t["i"]
    small = F.greatest(F.abs(t["g"]), F.abs(t["j"])) <= SCORE_TOLERANCE * F.col("rows")
    solvable = F.coalesce(det > 1e-12 * t["h"] * t["k"], F.lit(False))
    # Probabilities of 0 and 1 throughout: the outcomes are separated and the line runs off.
    solvable = solvable & (t["h"] > 1e-7 * F.col("rows"))
    moved = F.col("t").isNotNull()
    held = lambda new, old: F.when(moved, new).otherwise(F.col(old)).alias(old)
    return joined.select(
        *keys, "rows", "positives",
        held(F.col("a") + t["part"] * F.col("da"), "a"), held(F.col("b") + t["part"] * F.col("db"), "b"),
        held(F.when(solvable, (t["k"] * t["g"] - t["i"] * t["j"]) / det).otherwise(0.0), "da"),
        held(F.when(solvable, (t["h"] * t["j"] - t["i"] * t["g"]) / det).otherwise(0.0), "db"),
        held(t["l"], "best"),
        # Done when the scores vanish, when no part of the step helps, or when there is no step.
        (F.col("done") | ~moved | small | ~solvable).alias("done"),
        F.when(F.col("done"), F.col("converged")).otherwise(F.coalesce(moved & small & solvable, F.lit(False))).alias("converged"),
        (~F.col("done") & ~moved).alias("_lost"),
    )


def calibrate(df: DataFrame, line: DataFrame, p: str, out: str) -> DataFrame:
    """Apply a one-row calibration line as scalars."""
    a = line.agg(F.first("intercept")).scalar()
    b = line.agg(F.first("slope")).scalar()
    return df.withColumn(out, apply_logit_calibrator(p, a, b))


# --- subgroups ------------------------------------------------------------------------


def diagnostic_bands(panel: DataFrame) -> DataFrame:
    """Outcome-free strata; unknown values get their own level."""
    return panel.select(
        "*",
        F.year(BLOCK).cast("string").alias("year"),
        right_closed("field_size", FIELD_BANDS, "17+").alias("field_size_band"),
        right_closed("days_since_prev", REST_BANDS, "91+").alias("rest_band"),
        right_closed("career_starts", START_BANDS, "21+").alias("starts_band"),
    )


def subgroup_diagnostics(preds: DataFrame, dims: Sequence[str] = DIMENSIONS, calibration: bool = True) -> DataFrame:
    """Scores, skill over 3/field and calibration per level of each dimension, and overall.

    ``preds`` must carry the dimension columns and ``field_size``.
    """
    level = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("level"))]
    level += [
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("UNKNOWN")).alias("level"))
        for d in dims
    ]
    base = field_size_baseline("field_size")
    long = preds.select(
        CONTEST, BLOCK, "label", "p", base.alias("base"), F.explode(F.array(*level)).alias("_l")
    ).select(CONTEST, BLOCK, "label", "p", "base", "_l.*")
    by = ["dimension", "level"]
    scored = entry_losses(long).withColumn("_bb", brier("base", "label")).withColumn("_bl", log_loss("base", "label"))
    per_contest = scored.groupBy(*by, CONTEST).agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(c) for c in ("brier", "log_loss", "_bb", "_bl", "label", "p")],
    )

    def macro(c: str) -> Column:
        return F.avg(F.col(c) / F.col("n"))

    out = per_contest.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("contests"),
        macro("brier").alias("macro_brier"),
        macro("log_loss").alias("macro_log_loss"),
        (F.sum("brier") / F.sum("n")).alias("micro_brier"),
        (F.sum("log_loss") / F.sum("n")).alias("micro_log_loss"),
        macro("_bb").alias("baseline_macro_brier"),
        macro("_bl").alias("baseline_macro_log_loss"),
        (F.sum("label") / F.sum("n")).alias("observed_rate"),
        (F.sum("p") / F.sum("n")).alias("mean_predicted"),
    )
    out = out.withColumn("brier_skill", 1 - F.col("macro_brier") / F.col("baseline_macro_brier")).withColumn(
        "calibration_gap", F.col("observed_rate") - F.col("mean_predicted")
    )
    if not calibration:
        return out
    line = calibration_line(long, by=by).select(*by, "intercept", "slope")
    return out.join(line, by, "left")


def contest_review(df: DataFrame, p: str = "p", y: str = "label", contest: str = CONTEST) -> DataFrame:
    """One row per contest: losses, mass on the actual leaders and their forecast ranks."""
    ranked = rank_rows(df, contest, [F.desc(p), F.col("entry_no")], "_rank")
    hit = F.col(y) == 1
    # Only labelled entries are collected: a handful per contest, whatever its size.
    return (
        entry_losses(ranked, p, y)
        .groupBy(contest)
        .agg(
            F.count("*").alias("rows"),
            F.avg("brier").alias("brier"),
            F.avg("log_loss").alias("log_loss"),
            F.sum(F.when(hit, F.col(p))).alias("leader_mass"),
            F.array_join(F.sort_array(F.collect_list(F.when(hit, F.col("_rank")))), ";").alias("leader_ranks"),
        )
    )


def importance_rollup(
    contributions: DataFrame, families: Mapping[str, str], scope: str = "scope", year: str = "year"
) -> DataFrame:
    """Mean absolute, mean signed and non-zero share of contributions by feature and family.

    ``contributions`` is long: (entry key, scope, year, feature, contribution).  Terms of one
    family are summed inside a row first.  Every scope also gets the total over years.

    An entry is one row of sums for the features of ``families``, combined before its shuffle; only other
    features, all of the family "other", take rows of their own there.
    """
    known = {name: label for name, label in families.items() if label != "other"}
    keys = [CONTEST, "subject_id", scope, year]
    feature, value = F.col("feature"), F.col("contribution")
    none = F.lit(None).cast("string")

    def level(grain: Column, name: Column) -> Column:
        return F.struct(grain.alias("grain"), name.alias("name"))

    alone = F.array(level(F.lit("feature"), feature), level(F.lit("family"), F.lit("other")))
    levels = F.when(F.coalesce(feature.isin(*known), F.lit(False)), F.array(level(none, none))).otherwise(alone)
    of = {name: (F.col(f"_s{i}"), F.col(f"_n{i}") > 0) for i, name in enumerate(known)}
    sums = [F.sum(F.when(feature == name, value)).alias(f"_s{i}") for i, name in enumerate(known)]
    counts = [F.count_if(feature == name).alias(f"_n{i}") for i, name in enumerate(known)]
    entries = (
        contributions.select(*keys, "feature", "contribution", F.explode(levels).alias("_l"))
        .groupBy(*keys, "_l.grain", "_l.name")
        .agg(F.sum(value).alias("c"), *sums, *counts)
    )

    def item(grain: Column, name: Column, c: Column, there: Column) -> Column:
        return F.when(there, F.struct(grain.alias("grain"), name.alias("name"), c.alias("c")))

    items = [item(F.lit("feature"), F.lit(name), c, there) for name, (c, there) in of.items()]
    for label in dict.fromkeys(known.values()):
        members = [of[name] for name in known if known[name] == label]
        total = reduce(Column.__add__, [F.coalesce(c, F.lit(0)) for c, _ in members])
        seen = F.coalesce(*[c for c, _ in members]).isNotNull()
        items.append(item(F.lit("family"), F.lit(label), F.when(seen, total), reduce(Column.__or__, [there for _, there in members])))
    own = F.array(item(F.col("grain"), F.col("name"), F.col("c"), F.lit(True)))
    unfolded = F.when(F.col("grain").isNull(), F.array_compact(F.array(*items))).otherwise(own) if items else own
    grouped = entries.select(*keys, F.explode(unfolded).alias("_i")).select(*keys, "_i.*")
    c = F.col("c")
    sums = grouped.groupingSets(
        [[scope, year, "grain", "name"], [scope, "grain", "name"]], scope, year, "grain", "name"
    ).agg(
        F.grouping(year).alias("_all_years"),
        F.sum(F.abs(c)).alias("_abs"),
        F.sum(c).alias("_signed"),
        F.count_if(c != 0).alias("_nonzero"),
        F.count("*").alias("rows"),
    )
    sums = sums.withColumn("year", F.when(F.col("_all_years") == 1, "ALL").otherwise(F.col(year).cast("string")))
    out = sums.select(
        F.col(scope).alias("scope"), "year", "grain", "name", "rows",
        (F.col("_abs") / F.col("rows")).alias("mean_abs"),
        (F.col("_signed") / F.col("rows")).alias("mean_signed"),
        (F.col("_nonzero") / F.col("rows")).alias("nonzero_share"),
    )
    out = with_group(out, ["scope", "year", "grain"], F.sum("mean_abs").alias("_total"))
    return out.withColumn("share_of_total", F.col("mean_abs") / F.col("_total")).drop("_total")
