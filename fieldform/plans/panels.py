"""The panel of a data folder, built once per session and read back by every later step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldform import scale
from fieldform.operators import history
from fieldform.sources.testtables import lean_entries, standard_starters, starters, with_subjects

# What the searches over stored predictions read of an entry, besides the block histories.
SEARCHED = (
    "contest_id", "contest_date", "subject_id", "label", "surface", "distance_m", "venue", "field_size", "turn_direction",
    "career_starts", "career_top3",
)
_written: dict[tuple[str, str], DataFrame] = {}


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = scale.materialize(_build(spark, sf_dir), "panel")
    return _written[key]


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the subjects join at the end, where the rows of a subject are together, and do not move before."""
    lean = lean_entries(spark, sf_dir)
    if lean is None:
        return history.build_panel(starters(spark, sf_dir))
    return with_subjects(spark, sf_dir, history.build_panel(standard_starters(lean).drop("win_odds"), by_contest=True))


def blocks_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with the block histories of every entry."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#blocks")
    if key not in _written:
        _written[key] = scale.materialize(history.strict_prior_blocks(panel(spark, sf_dir)), "blocks")
    return _written[key]


def search_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SEARCHED`` and the block histories of every entry; wide rows are neither moved nor written for it."""
    key, whole = [(spark.sparkContext.applicationId, f"{sf_dir}#{name}") for name in ("search", "blocks")]
    if whole in _written:
        wide = _written[whole]
        return wide.select(*SEARCHED, *[f"{b}_{kind}" for b in ("same_surface", *history.BLOCKS) for kind in ("starts", "top3")])
    if key not in _written:
        _written[key] = scale.materialize(history.strict_prior_blocks(panel(spark, sf_dir).select(*SEARCHED)), "search")
    return _written[key]
