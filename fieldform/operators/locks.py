"""Pre-event locks: admission rules per contest and the blended columns that are frozen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldform.contracts import forbid_outcomes, require_columns
from fieldform.functions.contest import course_mask
from fieldform.functions.probability import convex_blend
from fieldform.scale import with_group
from fieldform.sources.fingerprint import row_fingerprint

CONTEST, SUBJECT = "contest_id", "subject_id"
# Fixed values of the admission rules.
WEIGHTS = (0.0, 0.10, 0.25, 0.50, 1.0)
WINDOW_SECONDS = (540, 600)
MAX_PRICE_AGE = 300
MIN_FIELD = 8
DISTANCES = (1000, 2600)
ROUTES = ("market-only", "nonmarket-shadow")
REQUIRED = (
    CONTEST, "contest_date", SUBJECT, "entry_no", "field_size", "surface", "distance_m", "turn_direction",
    "p_market", "p_nonmarket", "route", "model_id", "start_at", "market_asof", "locked_at",
)


def lock_violations(df: DataFrame, local_zone: str = "UTC") -> DataFrame:
    """(contest, rule, violations) for every broken admission rule.

    Times are per row: scheduled start, price snapshot and lock.  The start must fall on the
    contest date in ``local_zone``.
    """
    require_columns(df, REQUIRED)
    forbid_outcomes(df)
    left = F.unix_timestamp("start_at") - F.unix_timestamp("locked_at")
    age = F.unix_timestamp("locked_at") - F.unix_timestamp("market_asof")
    own = F.col("route") == "nonmarket-shadow"

    def known(p: str):
        return F.coalesce(F.col(p).between(0, 1), F.lit(False))

    rows = {
        "lock_time": ~F.coalesce(left.between(*WINDOW_SECONDS), F.lit(False)),
        "price_age": ~F.coalesce(age.between(0, MAX_PRICE_AGE), F.lit(False)),
        "surface": ~F.coalesce(F.col("surface").isin("turf", "dirt"), F.lit(False)),
        "distance": ~F.coalesce(F.col("distance_m").between(*DISTANCES), F.lit(False)),
        "straight": F.col("turn_direction").isNull() | course_mask("turn_direction"),
        "start_date": F.to_date(F.from_utc_timestamp("start_at", local_zone)) != F.col("contest_date"),
        "market_probability": ~known("p_market"),
        "model_probability": F.when(own, ~known("p_nonmarket")).otherwise(F.col("p_nonmarket").isNotNull()),
        "route": ~F.coalesce(F.col("route").isin(*ROUTES), F.lit(False)),
        "missing_subject": F.col(SUBJECT).isNull(),
    }
    per_subject = df.groupBy(CONTEST, SUBJECT, "entry_no").agg(
        F.count("*").alias("_n"),
        F.min("field_size").alias("_f_lo"), F.max("field_size").alias("_f_hi"),
        F.min("surface").alias("_s_lo"), F.max("surface").alias("_s_hi"),
        F.min("distance_m").alias("_d_lo"), F.max("distance_m").alias("_d_hi"),
        F.count_if(own).alias("_own"),
        *[F.count_if(rule).alias(name) for name, rule in rows.items()],
    )
    n = F.sum("_n")
    facts = per_subject.groupBy(CONTEST).agg(
        *[F.sum(name).alias(name) for name in rows],
        F.when((F.min("_f_lo") != n) | (F.max("_f_hi") != n), 1).otherwise(0).alias("roster_incomplete"),
        F.when(n < MIN_FIELD, 1).otherwise(0).alias("field_too_small"),
        F.when(F.min("_s_lo") != F.max("_s_hi"), 1).otherwise(0).alias("surface_varies"),
        F.when(F.min("_d_lo") != F.max("_d_hi"), 1).otherwise(0).alias("distance_varies"),
        F.when(F.sum("_own") == 0, 1).otherwise(0).alias("no_model_candidate"),
    )
    names = [*rows, "roster_incomplete", "field_too_small", "surface_varies", "distance_varies", "no_model_candidate"]
    facts = facts.select(CONTEST, *[F.col(c).cast("long").alias(c) for c in names])
    found = facts.unpivot([CONTEST], names, "rule", "violations").filter("violations > 0")
    repeats = [
        df.groupBy(CONTEST, key).count().filter("count > 1").groupBy(CONTEST).agg(
            F.lit(f"repeated_{key}").alias("rule"), F.sum(F.col("count") - 1).alias("violations")
        )
        for key in (SUBJECT, "entry_no")
    ]
    return found.unionByName(repeats[0]).unionByName(repeats[1])


def make_lock(
    df: DataFrame, weights: Sequence[float] = WEIGHTS, local_zone: str = "UTC"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Admitted rows with blended columns, violations of the refused contests, and a manifest.

    Entries without an own forecast fall back to the market in every blend.
    """
    violations = lock_violations(df, local_zone)
    admitted = df.join(violations.select(CONTEST).distinct(), CONTEST, "left_anti")
    own = F.when(F.col("route") == "nonmarket-shadow", F.col("p_nonmarket")).otherwise(F.col("p_market"))
    locked = admitted.select(
        "*", *[convex_blend("p_market", own, w).alias(f"p_w{round(w * 100):03d}") for w in weights]
    )
    manifest = row_fingerprint(locked, locked.columns, by=[CONTEST])
    return locked, violations, manifest


def validate_published_lock(df: DataFrame, total: float = 3.0, tol: float = 1e-9) -> DataFrame:
    """Violations of the older lock contract: ranks 1..n, probabilities in range, sum and bounds."""
    ps = ("p_market", "p_model_raw", "p_model_calibrated", "p_ensemble", "uncertainty_low", "uncertainty_high")
    bad = F.lit(False)
    for p in ps:
        bad = bad | ~F.coalesce(F.col(p).between(0, 1), F.lit(False))
    outside = (F.col("uncertainty_low") > F.col("p_ensemble")) | (F.col("uncertainty_high") < F.col("p_ensemble"))
    sized = with_group(df, CONTEST, F.count("*").alias("_n"))
    per_rank = sized.groupBy(CONTEST, "rank").agg(
        F.count("*").alias("n"), F.max("_n").alias("_n"), F.sum("p_ensemble").alias("p"),
        F.count_if(bad).alias("bad"), F.count_if(outside).alias("outside"),
    )
    misplaced = (F.col("n") > 1) | F.col("rank").isNull() | ~F.col("rank").between(1, F.col("_n"))
    facts = per_rank.groupBy(CONTEST).agg(
        F.count_if(misplaced).alias("rank"),
        F.sum("bad").alias("probability"),
        F.sum("outside").alias("bounds"),
        F.when(F.abs(F.sum("p") - total) > tol, 1).otherwise(0).cast("long").alias("sum"),
    )
    return facts.unpivot([CONTEST], ["rank", "probability", "bounds", "sum"], "rule", "violations").filter("violations > 0")
