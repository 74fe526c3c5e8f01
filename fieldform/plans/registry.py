"""Production models: refitted from frozen routes, kept with what they were made of, and checked before they score.

``compile_routing`` turns the decisions of a search into a routing table and the few models that it names; nothing is
chosen any more.  ``refit`` fits each on its own rows up to a day and writes a version: the models, the routing table
and one registry row a model (rows, contests and fingerprint of the training rows, days, digest of the routing, and how
exactly the model that was read back agrees with the fitted one).  The pointer comes last, so a refit that stops
half way leaves the current version in use.  ``current`` reads a version back and refuses one that was changed, and
``score`` gives every entry of the contests a probability or the reason why it has none.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce
from typing import Any

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldform.contracts import ContractError, forbid_columns, require_columns
from fieldform.operators.cohorts import ROUTING_LIMIT, assign_route
from fieldform.plans import models
from fieldform.plans.models import Recipe
from fieldform.plans.search import BLOCKS, CONTEST, DAY, SUBJECT, Scope, pooled_rate, rate_columns
from fieldform.plans.store import AT_ONCE
from fieldform.scale import exists, materialize
from fieldform.sources.fingerprint import row_fingerprint
from fieldform.sources.snapshot import current_id

ROUTING = "surface string, lo int, hi int, model_id string, is_override boolean"
REGISTRY = (
    "model_id string, surface string, lo int, hi int, blocks string, kind string, routing_digest string, prior double, "
    "train_rows long, train_contests long, trained_from date, trained_through date, fingerprint string, folder string, "
    "parity_rows long, max_abs_error double"
)
# Blocks of the candidates of a search, and those that are trained on their own band.
CANDIDATES = {"G0": (), "G3": BLOCKS, "R3": BLOCKS}
BANDED = ("R3",)


@dataclass(frozen=True)
class ModelSpec:
    """What is refitted: the rows it learns from and the blocks it uses."""

    scope: Scope
    blocks: tuple[str, ...] = ()


# --- kinds of models ------------------------------------------------------------------


class RateFits:
    """Pooled shrunk rates; what is fitted and kept is the prior."""

    def __init__(self, strength: float = 6.0):
        self.strength, self.name = strength, f"rates {strength}"

    def fit(self, spec: ModelSpec, train: DataFrame, prior: float) -> float:
        return prior

    def save(self, spark: SparkSession, fitted: float, path: str) -> None:
        spark.createDataFrame([(fitted,)], "prior double").coalesce(1).write.parquet(path)

    def load(self, spark: SparkSession, path: str) -> float:
        return spark.read.parquet(path).first()["prior"]

    def needed(self, specs: Sequence[ModelSpec], context: DataFrame) -> list[str]:
        """Columns of the entries that predictions of these models read."""
        return [c for c in dict.fromkeys(c for spec in specs for pair in rate_columns(spec.blocks) for c in pair)]

    def predict(self, fitted: float, spec: ModelSpec, rows: DataFrame, context: DataFrame) -> DataFrame:
        return rows.withColumn("p", pooled_rate(spec.blocks, fitted, self.strength))


class RecipeFits:
    """A recipe of Spark ML with the blocks and the surface of each model; ``panel`` holds every starter."""

    def __init__(self, recipe: Recipe, panel: DataFrame):
        self.recipe, self.panel = recipe, panel
        self.name = json.dumps(asdict(recipe), sort_keys=True)

    def fit(self, spec: ModelSpec, train: DataFrame, prior: float) -> models.Fitted:
        own = replace(self.recipe, extras=(*self.recipe.extras, *spec.blocks), surface=spec.scope.surface)
        return models.fit(own, train, self.panel)

    def save(self, spark: SparkSession, fitted: models.Fitted, path: str) -> None:
        models.save(fitted, path)

    def load(self, spark: SparkSession, path: str) -> models.Fitted:
        return models.load(path)

    def needed(self, specs: Sequence[ModelSpec], context: DataFrame) -> list[str]:
        return context.columns

    def predict(self, fitted: models.Fitted, spec: ModelSpec, rows: DataFrame, context: DataFrame) -> DataFrame:
        out = models.transform(fitted, rows, context)
        return out.withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")


Kind = RateFits | RecipeFits


# --- routing --------------------------------------------------------------------------


def _routes(routing: DataFrame) -> list:
    rows = routing.select(*[c.split()[0] for c in ROUTING.split(", ")]).head(ROUTING_LIMIT + 1)
    if len(rows) > ROUTING_LIMIT:
        raise ContractError(f"a routing table holds at most {ROUTING_LIMIT} rows")
    return rows


def compile_routing(routes: DataFrame, held: Mapping[str, ModelSpec]) -> tuple[DataFrame, dict[str, ModelSpec]]:
    """Routing table and models of the routes that a search decided.

    ``held`` names what stands behind the override of each surface.  Candidates of all distances learn from the whole
    range of bands of their surface, banded ones from their band.
    """
    found = _routes(routes)
    specs, table = {}, []
    for r in sorted(found, key=lambda r: (r["surface"], r["is_override"], r["lo"])):
        bands = [b for b in found if b["surface"] == r["surface"] and not b["is_override"]]
        name = f"{r['surface']}_{r['model_id']}"
        if r["is_override"]:
            specs[name] = held[r["surface"]]
        elif r["model_id"] in BANDED:
            name = f"{name}_{r['lo']}_{r['hi']}"
            specs[name] = ModelSpec(Scope(r["surface"], r["lo"], r["hi"]), CANDIDATES[r["model_id"]])
        else:
            whole = Scope(r["surface"], min(b["lo"] for b in bands), max(b["hi"] for b in bands))
            specs[name] = ModelSpec(whole, CANDIDATES[r["model_id"]])
        table.append((r["surface"], r["lo"], r["hi"], name, r["is_override"]))
    return routes.sparkSession.createDataFrame(table, ROUTING), specs


def routing_faults(routing: DataFrame, specs: Mapping[str, ModelSpec]) -> list[str]:
    """What forbids the use of a routing table; empty when nothing does."""
    faults, last = [], {}
    known = [r for r in _routes(routing) if None not in (r["surface"], r["lo"], r["hi"], r["is_override"])]
    if len(known) < len(_routes(routing)):
        faults.append("a route without surface, distances or kind")
    for r in sorted(known, key=lambda r: (r["surface"], r["is_override"], r["lo"], r["hi"])):
        route = f"{r['surface']} {r['lo']}-{r['hi']}"
        group = (r["surface"], r["is_override"])
        if r["lo"] > r["hi"] or (r["is_override"] and r["lo"] != r["hi"]):
            faults.append(f"{route}: not a range of its kind")
        if r["lo"] <= last.get(group, r["lo"] - 1):
            faults.append(f"{route}: overlaps another route")
        last[group] = max(r["hi"], last.get(group, r["hi"]))
        spec = specs.get(r["model_id"])
        if spec is None:
            faults.append(f"{route}: unknown model {r['model_id']}")
        elif spec.scope.surface != r["surface"] or not spec.scope.lo <= r["lo"] <= r["hi"] <= spec.scope.hi:
            faults.append(f"{route}: {r['model_id']} does not learn from it")
    return faults


def routing_digest(routing: DataFrame) -> str:
    row = row_fingerprint(routing, [c.split()[0] for c in ROUTING.split(", ")]).first()
    return "0:" if row is None else f"{row['rows']}:{row['fingerprint']}"


# --- refit ----------------------------------------------------------------------------


def _training(panel: DataFrame, specs: Mapping[str, ModelSpec], through: str) -> dict[str, DataFrame]:
    learned = panel.filter(F.col(DAY) <= F.lit(through).cast("date"))
    return {name: spec.scope.rows(learned) for name, spec in specs.items()}


def training_facts(panel: DataFrame, specs: Mapping[str, ModelSpec], through: str) -> DataFrame:
    """One row a model about the rows it learns from; counts and fingerprints combine map-side."""
    rows = [df.withColumn("model_id", F.lit(name)) for name, df in _training(panel, specs, through).items()]
    tagged = reduce(DataFrame.unionByName, rows)
    facts = tagged.groupBy("model_id").agg(
        F.count("*").alias("train_rows"), F.countDistinct(CONTEST).alias("train_contests"), F.avg("label").alias("prior"),
        F.min(DAY).alias("trained_from"), F.max(DAY).alias("trained_through"),
        F.count_if(F.col("label").isNull()).alias("unknown"),
    )
    return facts.join(row_fingerprint(tagged, sorted(panel.columns), by=["model_id"]).drop("rows"), "model_id")


def refit(
    panel: DataFrame, routing: DataFrame, specs: Mapping[str, ModelSpec], kind: Kind, root: str, through: str
) -> DataFrame:
    """Fit all models on their rows up to ``through``, write a version and make it current; returns the registry.

    The version is named by routing, models and training rows, so the same request finds the models it made before.
    A model that predicts otherwise once it is read back, on any row of its last training day, stops the refit.
    """
    forbid_columns(panel)
    require_columns(panel, ["label", DAY, CONTEST, SUBJECT])
    if faults := routing_faults(routing, specs):
        raise ContractError("; ".join(faults))
    if not specs:
        raise ContractError("no model is routed")
    spark, root = panel.sparkSession, root.rstrip("/")
    facts = {r["model_id"]: r for r in training_facts(panel, specs, through).collect()}  # one row a model
    if poor := [name for name in specs if name not in facts or facts[name]["unknown"]]:
        raise ContractError(f"training rows need known labels: {', '.join(sorted(poor))}")
    digest = routing_digest(routing)
    named = {name: (asdict(spec.scope), spec.blocks, facts[name]["fingerprint"]) for name, spec in specs.items()}
    version = hashlib.sha256(json.dumps([digest, kind.name, named], sort_keys=True).encode()).hexdigest()[:16]
    folder = f"{root}/versions/{version}"
    if not exists(spark, f"{folder}/models/_SUCCESS"):
        training = _training(panel, specs, through)

        def make(name: str) -> tuple:
            spec, fact, path = specs[name], facts[name], f"{folder}/fits/{uuid.uuid4().hex}"
            fitted = kind.fit(spec, training[name], fact["prior"])
            kind.save(spark, fitted, path)
            same = _parity(kind, spec, fitted, kind.load(spark, path), training[name].filter(F.col(DAY) == F.lit(fact["trained_through"])), panel)
            if same["changed"]:
                raise ContractError(f"{name} predicts otherwise once it is read back")
            return (
                name, spec.scope.surface, spec.scope.lo, spec.scope.hi, ",".join(spec.blocks), kind.name, digest, fact["prior"],
                fact["train_rows"], fact["train_contests"], fact["trained_from"], fact["trained_through"], fact["fingerprint"], path,
                same["rows"], same["error"],
            )

        with ThreadPoolExecutor(AT_ONCE) as pool:
            entries = list(pool.map(make, specs))
        routing.select(*[c.split()[0] for c in ROUTING.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/routing")
        spark.createDataFrame(entries, REGISTRY).coalesce(1).write.mode("overwrite").parquet(f"{folder}/models")
    if current_id(spark, root) != version:
        pointer = spark.createDataFrame([(version,)], "snapshot_id string").withColumn("published_at", F.current_timestamp())
        pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return spark.read.schema(REGISTRY).parquet(f"{folder}/models")


def _parity(kind: Kind, spec: ModelSpec, fitted: Any, loaded: Any, rows: DataFrame, panel: DataFrame):
    """Both models on the same rows, in one pass."""
    context = panel.join(rows.select(CONTEST).distinct(), CONTEST, "left_semi")
    first = kind.predict(fitted, spec, rows, context).withColumnRenamed("p", "_fitted")
    both = kind.predict(loaded, spec, first, context)
    return both.agg(
        F.count("*").alias("rows"), F.count_if(~F.col("p").eqNullSafe(F.col("_fitted"))).alias("changed"),
        F.max(F.abs(F.col("p") - F.col("_fitted"))).alias("error"),
    ).first()


# --- use ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Production:
    """A version that passed its checks."""

    version: str
    models: DataFrame
    routing: DataFrame
    specs: Mapping[str, ModelSpec]
    fits: Mapping[str, Any]
    kind: Kind


def current(spark: SparkSession, root: str, kind: Kind, routing: DataFrame | None = None) -> Production:
    """The current version; refused when its routes, or those of the caller, are not the ones it was fitted for."""
    root = root.rstrip("/")
    version = current_id(spark, root)
    if version is None:
        raise ContractError(f"{root} holds no models")
    folder = f"{root}/versions/{version}"
    table = spark.read.schema(REGISTRY).parquet(f"{folder}/models")
    stored = spark.read.schema(ROUTING).parquet(f"{folder}/routing")
    entries = table.collect()  # one row a model
    specs = {
        r["model_id"]: ModelSpec(Scope(r["surface"], r["lo"], r["hi"]), tuple(b for b in r["blocks"].split(",") if b)) for r in entries
    }
    if {r["kind"] for r in entries} != {kind.name}:
        raise ContractError("the models are of another kind")
    for name, routes in (("stored", stored), ("given", routing)):
        if routes is not None and {routing_digest(routes)} != {r["routing_digest"] for r in entries}:
            raise ContractError(f"the {name} routes are not those of the models")
    if faults := routing_faults(stored, specs):
        raise ContractError("; ".join(faults))
    return Production(version, table, stored, specs, {r["model_id"]: kind.load(spark, r["folder"]) for r in entries}, kind)


# What decides on the model of a contest.
PLACED_BY = ("surface", "distance_m", "field_size", "turn_direction", DAY)


def place(production: Production, context: DataFrame, min_prior: int = 3) -> DataFrame:
    """``context`` with ``_model``, the model of its contest, and ``_reason``, why the entry gets no probability.

    One aggregate a contest decides, so a large contest never meets in one task.  Reasons in this order: the contest
    changes its conditions or day from row to row; rows of its field are missing; nothing is routed there (or it has no id);
    the model learned from its day or later; the entry has fewer than ``min_prior`` earlier starts.
    """
    facts = PLACED_BY
    same = reduce(lambda a, b: a & b, [F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count("*"))) for c in facts])
    heads = context.groupBy(CONTEST).agg(*[F.min(c).alias(c) for c in facts], F.count("*").alias("_n"), same.alias("_same"))
    days = production.models.select("model_id", F.col("trained_through").alias("_through"))
    routed = assign_route(heads, production.routing).join(days, "model_id", "left")
    reason = (
        F.when(~F.col("_same"), "mixed_contest")
        .when(~F.col("_n").eqNullSafe(F.col("field_size").cast("long")), "incomplete_field")
        .when(F.col("model_id").isNull(), "no_route")
        .when(F.coalesce(F.col("_through") >= F.col(DAY), F.lit(True)), "trained_too_late")
    )
    decided = routed.filter(F.col(CONTEST).isNotNull()).select(CONTEST, F.col("model_id").alias("_model"), reason.alias("_contest"))
    few = F.when(F.coalesce(F.col("career_starts") < min_prior, F.lit(True)), "too_few_starts")
    lost = F.when(F.col("_model").isNull(), "no_route")
    return context.join(decided, CONTEST, "left").withColumn("_reason", F.coalesce("_contest", lost, few)).drop("_contest")


REFUSED = ("mixed_contest", "incomplete_field", "trained_too_late")


def score(production: Production, context: DataFrame, min_prior: int = 3, refuse: bool = True) -> DataFrame:
    """Keys with ``p_nonmarket``, ``route``, ``model_id`` and ``reason`` for every entry of ``context``, repeated rows included.

    Each model transforms the entries that it may score; the others fall back to the market.  With ``refuse`` a contest
    that must not be scored (``REFUSED``) fails the job, otherwise its entries carry the reason.
    """
    forbid_columns(context)
    # Rows move to meet their contest and are written, so they keep what models and reasons read.
    read = production.kind.needed([*production.specs.values()], context)
    context = context.select(*dict.fromkeys([CONTEST, SUBJECT, *PLACED_BY, "career_starts", *read]))
    rows = place(production, context, min_prior)
    if refuse:
        failed = F.raise_error(F.concat(F.lit("a contest must not be scored: "), F.col("_reason"))).cast("string")
        rows = rows.withColumn("_reason", F.when(F.col("_reason").isin(*REFUSED), failed).otherwise(F.col("_reason")))
    rows = materialize(rows, "placed")
    open_: Column = F.col("_reason").isNull()
    parts = [
        production.kind.predict(fitted, production.specs[name], rows.filter(open_ & (F.col("_model") == name)), context)
        for name, fitted in production.fits.items()
    ]
    parts.append(rows.filter(~open_).withColumn("p", F.lit(None).cast("double")))
    return reduce(DataFrame.unionByName, [_scored(part) for part in parts])


def _scored(rows: DataFrame) -> DataFrame:
    own = F.col("_reason").isNull()
    return rows.select(
        CONTEST, SUBJECT, DAY, F.col("p").alias("p_nonmarket"),
        F.when(own, "nonmarket-shadow").otherwise("market-only").alias("route"),
        F.when(own, F.col("_model")).otherwise("").alias("model_id"), F.col("_reason").alias("reason"),
    )


def held_specs(found: Mapping[str, Any]) -> dict[str, ModelSpec]:
    """What the winners of scope searches (by surface) are refitted as."""
    return {surface: ModelSpec(search.scope, search.blocks) for surface, search in found.items()}


def reasons(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entries and contests by route, model and reason."""
    return scored.groupBy(*by, "route", "model_id", "reason").agg(F.count("*").alias("entries"), F.countDistinct(CONTEST).alias("contests"))
