"""Three forecasts of every entry in a contest with a complete market, side by side.

``market`` from prices, ``uniform`` from field size, ``form`` from the shrunk career rate
brought to three places per contest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldform import scale
from fieldform.functions.contest import temporal_split
from fieldform.functions.probability import beta_shrink, field_size_baseline
from fieldform.operators.market import logit_shift_to_sum, rebuild_market
from fieldform.operators.metrics import diagnostic_bands
from fieldform.plans.panels import panel
from fieldform.sources.testtables import entries

# Calendar years of the test tables by split.
SPLITS = {
    "warmup": (1995, 1996), "train": (1997, 1999), "validation": (2000, 2000), "test": (2001, 2001),
    "future": (2002, None),
}
CANDIDATES = ("market", "uniform", "form")
KEPT = (
    "contest_id", "contest_date", "subject_id", "entry_no", "field_size", "label", "contest_class", "venue",
    "surface", "distance_m", "year", "field_size_band", "rest_band", "starts_band", "career_starts",
)
_written: dict[tuple[str, str], DataFrame] = {}


def training_prior(rows: DataFrame):
    """Label rate of the warmup and train years, as a scalar."""
    first, last = SPLITS["warmup"][0], SPLITS["train"][1]
    return rows.filter(F.year("contest_date").between(first, last)).agg(F.avg("label")).scalar()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = scale.materialize(_build(spark, sf_dir), "predictions")
    return _written[key]


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forecasts are made of narrow rows and written, so the wide rows of the panel move once, to meet them."""
    rows, keys = panel(spark, sf_dir), ["contest_id", "subject_id"]
    market, _ = rebuild_market(entries(spark, sf_dir))
    form = beta_shrink("career_top3", "career_starts", training_prior(rows))
    priced = rows.select(*keys, form.alias("_form")).join(market.select(*keys, F.col("market_p_top3").alias("p_market")), keys)
    priced = scale.materialize(priced, "priced")
    shifted = logit_shift_to_sum(priced, "_form").select(*keys, "p_market", F.col("p_adjusted").alias("p_form"))
    shifted = scale.materialize(shifted, "forecasts")
    own = [c for c in KEPT if c in rows.columns]
    # The bands are texts and follow from what has moved.
    met = diagnostic_bands(rows.select(*own, "days_since_prev").join(shifted, keys))
    return met.withColumn("p_uniform", field_size_baseline("field_size")).select(
        *KEPT, "p_market", "p_uniform", "p_form", temporal_split("contest_date", SPLITS).alias("split")
    )


def long_predictions(wide: DataFrame, candidates=CANDIDATES) -> DataFrame:
    """(candidate, entry columns, p)."""
    ids = [c for c in wide.columns if not c.startswith("p_")]
    items = [F.struct(F.lit(c).alias("candidate"), F.col(f"p_{c}").alias("p")) for c in candidates]
    return wide.select(*ids, F.explode(F.array(*items)).alias("_i")).select("_i.*", *ids)
