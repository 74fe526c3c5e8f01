"""Eligible subsets, splits, routing and per-contest filters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldform.functions.contest import course_mask, temporal_split
from fieldform.scale import with_group

CONTEST = "contest_id"
ROUTING_LIMIT = 10_000  # rows of a routing table that may be broadcast


def select_cohort(
    panel: DataFrame, surface: str, min_field: int = 8, min_prior: int = 3,
    lo: int | None = None, hi: int | None = None, exclude_straight: bool = False,
) -> DataFrame:
    """Rows chosen by surface, field size, earlier starts and distance; outcomes are not consulted."""
    keep = (
        (F.lower("surface") == surface.lower())
        & (F.col("field_size") >= min_field)
        & (F.col("career_starts") >= min_prior)
    )
    if lo is not None:
        keep = keep & (F.col("distance_m") >= lo)
    if hi is not None:
        keep = keep & (F.col("distance_m") <= hi)
    if exclude_straight:
        keep = keep & ~course_mask("turn_direction")
    return panel.filter(keep)


def with_split(panel: DataFrame, bounds: Mapping[str, tuple[int, int | None]]) -> DataFrame:
    return panel.withColumn("split", temporal_split("contest_date", bounds))


def complete_contests(df: DataFrame, contest: str = CONTEST) -> DataFrame:
    """Contests whose rows here still make up the whole field."""
    out = with_group(
        df, contest,
        F.count("*").alias("_n"), F.min("field_size").alias("_min"), F.max("field_size").alias("_max"),
    )
    return out.filter((F.col("_min") == F.col("_max")) & (F.col("_n") == F.col("_max"))).select(*df.columns)


def assign_route(contests: DataFrame, routing: DataFrame, min_field: int = 8) -> DataFrame:
    """Model of each contest by surface and distance band; an exact-distance override wins.

    ``routing``: (surface, lo, hi, model_id, is_override), bands of one surface disjoint.
    Small fields, straight courses and unrouted conditions get no model.  The routing table
    joins on surface with the band as a residual; it is broadcast only when it is small.
    """
    bands = routing.filter(~F.col("is_override")).select("surface", "lo", "hi", F.col("model_id").alias("_band"))
    exact = routing.filter("is_override").select(
        "surface", F.col("lo").alias("distance_m"), F.col("model_id").alias("_exact")
    )
    if len(routing.select("surface").head(ROUTING_LIMIT + 1)) <= ROUTING_LIMIT:
        bands, exact = F.broadcast(bands), F.broadcast(exact)
    routed = contests.join(exact, ["surface", "distance_m"], "left").alias("c").join(
        bands.alias("b"),
        (F.col("c.surface") == F.col("b.surface")) & F.col("c.distance_m").between(F.col("b.lo"), F.col("b.hi")),
        "left",
    )
    open_route = (F.col("c.field_size") >= min_field) & ~course_mask("c.turn_direction")
    model = F.when(open_route, F.coalesce("_exact", "b._band"))
    return routed.select("c.*", model.alias("model_id")).drop("_exact")
