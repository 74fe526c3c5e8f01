"""Features of an entry against the rest of its full field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldform.contracts import ContractError, forbid_columns
from fieldform.functions.probability import beta_shrink
from fieldform.operators.history import BLOCKS
from fieldform.scale import names, with_group

CONTEST, SUBJECT = "contest_id", "subject_id"
HISTORIES = ("career", "turf", "same_distance", "same_course")
# source, output, sign: +1 where more is better, -1 where less is better
RELATIVE_RULES = (
    ("career_shrunk", "rel_career", 1),
    ("same_distance_shrunk", "rel_same_distance", 1),
    ("same_course_shrunk", "rel_same_course", 1),
    ("recent3_finish_pct", "rel_recent3_finish", -1),
    ("recent3_rel_time", "rel_recent3_time", -1),
)
INTERACTIONS = ("draw_x_front", "front_x_pressure", "rest_x_age")


def engineer_features(df: DataFrame, prior: float | Column, strength: float = 6.0) -> DataFrame:
    """Shrunk success rates and log counts of every history pair, and the log rest period."""
    forbid_columns(df)
    cols = [F.log1p("days_since_prev").alias("log_days_since_prev")]
    for h in HISTORIES:
        cols.append(beta_shrink(f"{h}_top3", f"{h}_starts", prior, strength).alias(f"{h}_shrunk"))
        cols.append(F.log1p(f"{h}_starts").alias(f"log_{h}_starts"))
    return df.select("*", *cols)


def full_context(panel: DataFrame, contests: DataFrame) -> DataFrame:
    """Every starter of the contests that appear in ``contests``."""
    return panel.join(contests.select(CONTEST).distinct(), CONTEST, "left_semi")


def loo_mean(df: DataFrame, columns: str | Sequence[str], by: str = CONTEST) -> DataFrame:
    """Mean over the other rows of the group as ``<column>_others``.

    NULL where the own value is unknown or nobody else has one.  All columns share one
    aggregation and one join.
    """
    cols = names(columns)
    sums = [F.sum(c).alias(f"_s_{c}") for c in cols] + [F.count(c).alias(f"_n_{c}") for c in cols]
    out = with_group(df, by, *sums)
    others = []
    for c in cols:
        peers = F.col(f"_n_{c}") - 1
        others.append(
            F.when(F.col(c).isNotNull() & (peers > 0), (F.col(f"_s_{c}") - F.col(c)) / peers).alias(f"{c}_others")
        )
    return out.select(*[df_col for df_col in df.columns], *others)


def relative_ability(
    eligible: DataFrame, panel: DataFrame, prior: float | Column, strength: float = 6.0,
    rules: Sequence[tuple[str, str, int]] = RELATIVE_RULES,
) -> DataFrame:
    """Eligible rows with engineered features and their gap to the other starters.

    Peers come from the full field, eligible or not.
    """
    context = engineer_features(full_context(panel, eligible), prior, strength)
    sources = [src for src, _, _ in rules]
    field = loo_mean(context.select(CONTEST, SUBJECT, *sources), sources).select(
        CONTEST,
        SUBJECT,
        *[((F.col(src) - F.col(f"{src}_others")) * sign).alias(out) for src, out, sign in rules],
    )
    return engineer_features(eligible, prior, strength).join(field, [CONTEST, SUBJECT], "left")


def interactions(df: DataFrame) -> DataFrame:
    """Draw by front tendency, front tendency by field pressure, rest by age; NULL propagates."""
    front = 1 - F.col("recent4_early_pct")
    return df.select(
        "*",
        (F.col("draw_pct") * front).alias("draw_x_front"),
        (front * F.col("front_share")).alias("front_x_pressure"),
        (F.log1p("days_since_prev") * F.col("age")).alias("rest_x_age"),
    )


def surface_base(df: DataFrame, surface: str) -> DataFrame:
    """Rows of one surface; on dirt the same-surface history takes the turf slots.

    A row of another or of no surface fails the job: callers choose their rows, nothing is left out here.
    """
    if surface not in ("turf", "dirt"):
        raise ContractError(f"unsupported surface {surface!r}")
    one = F.col("surface").eqNullSafe(F.lit(surface))
    out = df.filter(F.assert_true(one, f"mixed surface: not all rows are {surface}").isNull())
    if surface == "dirt":
        out = out.withColumns(
            {"turf_starts": F.col("same_surface_starts"), "turf_top3": F.col("same_surface_top3")}
        )
    return out


def block_features(
    frame: DataFrame, context: DataFrame, prior: float | Column, blocks: Sequence[str] = BLOCKS,
    surface: str = "turf", strength: float = 6.0,
) -> DataFrame:
    """Relative features plus, per block, shrunk rate, log starts, zero and missing flags, field gap."""
    unknown = [b for b in blocks if b not in BLOCKS]
    if unknown:
        raise ContractError(f"unknown blocks {unknown}")
    base, field = surface_base(frame, surface), surface_base(context, surface)
    rates = [
        beta_shrink(f"{b}_top3", f"{b}_starts", prior, strength).alias(f"{b}_shrunk") for b in blocks
    ]
    scored = loo_mean(
        full_context(field, base).select(CONTEST, SUBJECT, *[f"{b}_starts" for b in blocks], *rates),
        [f"{b}_shrunk" for b in blocks],
    )
    cols: list[Column] = []
    for b in blocks:
        starts = F.col(f"{b}_starts")
        cols += [
            F.col(f"{b}_shrunk"),
            F.log1p(starts).alias(f"{b}_log_starts"),
            F.when(starts == 0, 1.0).otherwise(0.0).alias(f"{b}_zero"),
            F.when(starts.isNull(), 1.0).otherwise(0.0).alias(f"{b}_missing"),
            (F.col(f"{b}_shrunk") - F.col(f"{b}_shrunk_others")).alias(f"{b}_relative"),
        ]
    return relative_ability(base, field, prior, strength).join(
        scored.select(CONTEST, SUBJECT, *cols), [CONTEST, SUBJECT]
    )


def feature_coverage(
    context: DataFrame, eligible: DataFrame, pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """Per feature: context rows with a known source, context and eligible rows with a known value."""
    def facts(df: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
        wide = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in dict.fromkeys(columns)])
        return wide.unpivot(["rows"], list(dict.fromkeys(columns)), "column_name", value)

    known = facts(context, [c for pair in pairs for c in pair], "known")
    source_of = F.create_map(*[F.lit(x) for src, out in pairs for x in (out, src)])
    outputs = [out for _, out in pairs]
    base = known.filter(F.col("column_name").isin(outputs)).select(
        F.col("column_name").alias("feature"),
        source_of[F.col("column_name")].alias("source"),
        F.col("rows").alias("context_rows"),
        F.col("known").alias("output_non_null"),
    )
    sources = known.select(F.col("column_name").alias("source"), F.col("known").alias("source_non_null"))
    final = facts(eligible, outputs, "eligible_non_null").select(
        F.col("column_name").alias("feature"), F.col("rows").alias("eligible_rows"), "eligible_non_null"
    )
    return (
        base.join(sources, "source")
        .join(final, "feature")
        .withColumn("context_coverage", F.col("output_non_null") / F.col("context_rows"))
        .withColumn("eligible_coverage", F.col("eligible_non_null") / F.col("eligible_rows"))
    )
