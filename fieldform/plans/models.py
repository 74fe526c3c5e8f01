"""Feature stages, model fits and scoring on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldform.contracts import ContractError, forbid_columns, require_columns
from fieldform.operators import relative
from fieldform.operators.history import BLOCKS, TRENDS
from fieldform.operators.quantiles import exact_medians
from fieldform.operators.relative import INTERACTIONS, RELATIVE_RULES

# Fixed feature blocks.
NUMERIC_BLOCKS = {
    "entry": (
        "draw_pct", "age", "weight", "weight_change", "log_days_since_prev", "distance_change", "surface_changed",
    ),
    "history": (
        "career_shrunk", "log_career_starts", "turf_shrunk", "log_turf_starts", "same_distance_shrunk",
        "log_same_distance_starts", "same_course_shrunk", "log_same_course_starts",
    ),
    "recent": (
        "recent3_finish_pct", "recent3_top3", "recent3_open_plus", "recent3_graded", "recent3_rel_time",
        "recent4_early_pct",
    ),
    "context": ("front_share", "field_size", "distance_m"),
}
CATEGORICAL_BLOCKS = {"entry": ("grp",), "context": ("venue", "contest_class")}
EXTRAS = {
    "relative": tuple(out for _, out, _ in RELATIVE_RULES),
    "trend": tuple(TRENDS),
    "interaction": INTERACTIONS,
    **{b: tuple(f"{b}_{s}" for s in ("shrunk", "log_starts", "zero", "missing", "relative")) for b in BLOCKS},
}
RARE, UNSEEN = "<rare>", "<unseen>"

# Configurations by family in order of complexity, under the names of Spark's
# parameters; ``unsupported`` holds the values that Spark's trees have no parameter for.
CONFIGS = {
    "random_forest": {
        "RF01": {"maxDepth": 5, "minInstancesPerNode": 50, "featureSubsetStrategy": "sqrt"},
        "RF02": {"maxDepth": 5, "minInstancesPerNode": 20, "featureSubsetStrategy": "sqrt"},
        "RF03": {"maxDepth": 8, "minInstancesPerNode": 50, "featureSubsetStrategy": "sqrt"},
        "RF04": {"maxDepth": 8, "minInstancesPerNode": 20, "featureSubsetStrategy": "sqrt"},
        "RF05": {"maxDepth": 8, "minInstancesPerNode": 20, "featureSubsetStrategy": "0.7"},
        "RF06": {"maxDepth": None, "minInstancesPerNode": 30, "featureSubsetStrategy": "0.7"},
    },
    "hist_gradient_boosting": {
        "HGB01": {"stepSize": 0.03, "minInstancesPerNode": 50, "unsupported": {"max_leaf_nodes": 15, "l2_regularization": 2.0}},
        "HGB02": {"stepSize": 0.03, "minInstancesPerNode": 50, "unsupported": {"max_leaf_nodes": 31, "l2_regularization": 2.0}},
        "HGB03": {"stepSize": 0.05, "minInstancesPerNode": 30, "unsupported": {"max_leaf_nodes": 15, "l2_regularization": 1.0}},
        "HGB04": {"stepSize": 0.05, "minInstancesPerNode": 30, "unsupported": {"max_leaf_nodes": 31, "l2_regularization": 1.0}},
        "HGB05": {"stepSize": 0.08, "minInstancesPerNode": 20, "unsupported": {"max_leaf_nodes": 31, "l2_regularization": 1.0}},
        "HGB06": {"stepSize": 0.08, "minInstancesPerNode": 20, "unsupported": {"max_leaf_nodes": 63, "l2_regularization": 0.0}},
    },
    "xgboost": {
        "XGB01": {"stepSize": 0.03, "maxDepth": 3, "unsupported": {"min_child_weight": 20, "reg_lambda": 5.0}},
        "XGB02": {"stepSize": 0.03, "maxDepth": 4, "unsupported": {"min_child_weight": 10, "reg_lambda": 5.0}},
        "XGB03": {"stepSize": 0.05, "maxDepth": 3, "unsupported": {"min_child_weight": 10, "reg_lambda": 2.0}},
        "XGB04": {"stepSize": 0.05, "maxDepth": 5, "unsupported": {"min_child_weight": 10, "reg_lambda": 2.0}},
        "XGB05": {"stepSize": 0.08, "maxDepth": 4, "unsupported": {"min_child_weight": 5, "reg_lambda": 1.0}},
        "XGB06": {"stepSize": 0.08, "maxDepth": 6, "unsupported": {"min_child_weight": 5, "reg_lambda": 1.0}},
    },
}
# Settings that all configurations of a family share.
SHARED = {
    "random_forest": {"impurity": "entropy"},
    "hist_gradient_boosting": {},
    "xgboost": {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
}
ROUNDS = {"linear": 0, "random_forest": 500, "hist_gradient_boosting": 300, "xgboost": 500}
C_GRID = (0.01, 0.03, 0.1, 0.3, 1.0)
SEED = 20261003
# Stands for no limit: the deepest trees that Spark grows.
DEEPEST = 30


@dataclass(frozen=True)
class Recipe:
    """What is fitted: model family and settings, and the feature blocks it sees."""

    name: str
    family: str = "linear"
    config: Mapping[str, object] = field(default_factory=lambda: {"C": 0.1})
    rounds: int | None = None
    extras: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    surface: str | None = None

    def columns(self) -> tuple[list[str], list[str]]:
        unknown = [b for b in self.dropped if b not in NUMERIC_BLOCKS] + [e for e in self.extras if e not in EXTRAS]
        if unknown:
            raise ContractError(f"unknown feature blocks {unknown}")
        numeric = [c for b, cols in NUMERIC_BLOCKS.items() if b not in self.dropped for c in cols]
        numeric += [c for e in self.extras for c in EXTRAS[e]]
        categorical = [c for b, cols in CATEGORICAL_BLOCKS.items() if b not in self.dropped for c in cols]
        return numeric, categorical


@dataclass(frozen=True)
class Fitted:
    recipe: Recipe
    prior: float
    trained_through: str
    model: PipelineModel


def features(rows: DataFrame, panel: DataFrame, prior: float, recipe: Recipe) -> DataFrame:
    """Engineered features of ``rows``; field comparisons use every starter of the panel."""
    blocks = [e for e in recipe.extras if e in BLOCKS]
    if blocks:
        missing = [b for b in blocks if f"{b}_starts" not in panel.columns]
        if missing:
            raise ContractError(f"the panel lacks the block histories {missing}")
        surface = recipe.surface or "turf"
        out = relative.block_features(rows, panel.filter(F.col("surface") == surface), prior, blocks, surface)
    elif "relative" in recipe.extras:
        out = relative.relative_ability(rows, panel, prior)
    else:
        out = relative.engineer_features(rows, prior)
    return relative.interactions(out) if "interaction" in recipe.extras else out


# --- feature stages -------------------------------------------------------------------


@dataclass(frozen=True)
class Known:
    """What feature stages take from their rows: medians of numeric columns, counts by level of the others."""

    medians: Mapping[str, float | None]
    levels: Mapping[str, Mapping[str, int]]


def _levels(df: DataFrame, column: str) -> dict[str, int]:
    """Rows by level.  A one-hot model lists every level it knows, so they are its size."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("UNKNOWN")).alias("v")
    return {r["v"]: r["count"] for r in df.groupBy(value).count().collect()}


def _quoted(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def feature_stages(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], min_frequency: int = 5, scale: bool = False,
    known: Known | None = None,
) -> Pipeline:
    """Exact median imputation with missing flags, rare-level collapse, one-hot; scaling when asked.

    Columns without any known value are left out.  Unseen levels become all zeros.  ``known`` holds the medians and
    levels of ``df`` where they have been found already.
    """
    known = known or Known(exact_medians(df, numeric), {c: _levels(df, c) for c in categorical})
    medians = known.medians
    used = [c for c in numeric if medians[c] is not None]
    select = [
        f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), CAST('{medians[c]!r}' AS DOUBLE)) AS `{c}__i`, CAST(isnull(`{c}`) AS DOUBLE) AS `{c}__na`"
        for c in used
    ]
    for c in categorical:
        counts = known.levels[c]
        frequent, rare = sorted(v for v in counts if counts[v] >= min_frequency), sorted(v for v in counts if counts[v] < min_frequency)
        text = f"coalesce(CAST(`{c}` AS STRING), 'UNKNOWN')"
        cases = f"WHEN {text} IN ({_quoted(frequent)}) THEN {text} " if frequent else ""
        cases += f"WHEN {text} IN ({_quoted(rare)}) THEN '{RARE}' " if rare else ""
        select.append(f"CASE {cases}ELSE '{UNSEEN}' END AS `{c}__c`")
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(select)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}__i" for c in used] + [f"{c}__na" for c in used], outputCol="numeric"),
    ]
    final = "numeric"
    if scale:
        stages.append(StandardScaler(inputCol="numeric", outputCol="scaled", withMean=True, withStd=True))
        final = "scaled"
    if categorical:
        ins, mid, outs = ([f"{c}{s}" for c in categorical] for s in ("__c", "__x", "__h"))
        stages.append(StringIndexer(inputCols=ins, outputCols=mid, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=mid, outputCols=outs, handleInvalid="keep"))
        stages.append(VectorAssembler(inputCols=[final, *outs], outputCol="features"))
    else:
        stages.append(VectorAssembler(inputCols=[final], outputCol="features"))
    return Pipeline(stages=stages)


# --- fits -----------------------------------------------------------------------------


def _estimator(recipe: Recipe, rows: int):
    cfg = dict(recipe.config)
    common = {"featuresCol": "features", "labelCol": "y"}
    if recipe.family == "linear":
        # The penalty 1/(C n) on the mean loss equals C on the summed loss.
        return LogisticRegression(
            **common, regParam=1.0 / (float(cfg["C"]) * rows), elasticNetParam=0.0, standardization=False, maxIter=100,
            tol=1e-7,
        )
    cfg = {**SHARED[recipe.family], **{k: v for k, v in cfg.items() if k != "unsupported"}}
    rounds = ROUNDS[recipe.family] if recipe.rounds is None else recipe.rounds
    if recipe.family == "random_forest":
        return RandomForestClassifier(**common, **{**cfg, "maxDepth": cfg["maxDepth"] or DEEPEST}, numTrees=rounds, seed=SEED)
    leaves = recipe.config.get("unsupported", {}).get("max_leaf_nodes")
    if leaves:
        # Levels that hold so many leaves; Spark grows trees by level and not by best leaf.
        cfg["maxDepth"] = (int(leaves) + 1).bit_length() - 1
    return GBTClassifier(**common, **cfg, maxIter=rounds, seed=SEED)


def fit(recipe: Recipe, train: DataFrame, panel: DataFrame) -> Fitted:
    """Fit on ``train``; the shrinkage prior is the label rate of these rows alone."""
    return fit_all([recipe], train, panel)[0]


def fit_all(recipes: Sequence[Recipe], train: DataFrame, panel: DataFrame) -> list[Fitted]:
    """Fits of several recipes on the same rows, in their order.

    Recipes with the same extras and surface share their features, medians and levels, which are found once for all their columns.
    """
    forbid_columns(train)
    require_columns(train, ["label", "contest_date", "contest_id", "subject_id"])
    facts = train.agg(
        F.count("*").alias("n"), F.avg("label").alias("m"), F.max("contest_date").alias("d"),
        F.count_if(F.col("label").isNull()).alias("unknown"),
    ).first()
    if not facts["n"] or facts["unknown"]:
        raise ContractError("training rows need known labels")
    alike: dict[tuple, list[int]] = {}
    for i, recipe in enumerate(recipes):
        alike.setdefault((recipe.extras, recipe.surface), []).append(i)
    fitted: dict[int, Fitted] = {}
    for group in alike.values():
        columns = [recipes[i].columns() for i in group]
        numeric, categorical = (list(dict.fromkeys(c for pair in columns for c in pair[k])) for k in (0, 1))
        data = features(train, panel, facts["m"], recipes[group[0]]).withColumn("y", F.col("label").cast("double"))
        data = data.select("contest_id", "subject_id", "y", *numeric, *categorical)
        if any(recipes[i].family != "linear" for i in group):
            # Trees send the counts of all nodes from every task at every level, so there are no more tasks than run at once.
            data = data.coalesce(train.sparkSession.sparkContext.defaultParallelism)
        data = data.persist()
        try:
            known = Known(exact_medians(data, numeric), {c: _levels(data, c) for c in categorical})
            for i, (own, levels) in zip(group, columns):
                stages = feature_stages(data, own, levels, scale=recipes[i].family == "linear", known=known).getStages()
                model = Pipeline(stages=[*stages, _estimator(recipes[i], facts["n"])]).fit(data)
                fitted[i] = Fitted(recipes[i], float(facts["m"]), str(facts["d"]), model)
        finally:
            data.unpersist()
    return [fitted[i] for i in range(len(recipes))]


def fit_linear(train: DataFrame, panel: DataFrame, C: float = 0.1, **kw) -> Fitted:
    return fit(Recipe(name=f"linear_C{C}", config={"C": C}, **kw), train, panel)


def fit_trees(train: DataFrame, panel: DataFrame, family: str, config: str, rounds: int | None = None, **kw) -> Fitted:
    return fit(Recipe(name=config, family=family, config=CONFIGS[family][config], rounds=rounds, **kw), train, panel)


def transform(fitted: Fitted, rows: DataFrame, panel: DataFrame) -> DataFrame:
    return fitted.model.transform(features(rows, panel, fitted.prior, fitted.recipe))


def score(fitted: Fitted, rows: DataFrame, panel: DataFrame) -> DataFrame:
    """``rows`` with ``p``; scoring a row on or before the last training day fails the job."""
    out = transform(fitted, rows, panel)
    late = F.col("contest_date") <= F.lit(fitted.trained_through).cast("date")
    failed = F.raise_error(F.lit("model was trained on or after the scored date")).cast("double")
    p = F.when(late, failed).otherwise(vector_to_array("probability")[1])
    return out.withColumn("p", p).select(*rows.columns, "p")


def save(fitted: Fitted, path: str) -> None:
    spark = SparkSession.active()
    fitted.model.write().overwrite().save(f"{path}/model")
    meta = {"recipe": asdict(fitted.recipe), "prior": fitted.prior, "trained_through": fitted.trained_through}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(path: str) -> Fitted:
    meta = json.loads(SparkSession.active().read.parquet(f"{path}/meta").first()["meta"])
    recipe = meta["recipe"]
    recipe = Recipe(**{**recipe, "extras": tuple(recipe["extras"]), "dropped": tuple(recipe["dropped"])})
    return Fitted(recipe, meta["prior"], meta["trained_through"], PipelineModel.load(f"{path}/model"))


# --- terms of a linear model ----------------------------------------------------------


def _terms(fitted: Fitted, scored: DataFrame) -> list[tuple[str, str, float]]:
    """(vector slot name, source feature, coefficient) in slot order."""
    attrs = scored.schema["features"].metadata["ml_attr"]["attrs"]
    slots = {a["idx"]: a.get("name", f"slot_{a['idx']}") for group in attrs.values() for a in group}
    numeric, categorical = fitted.recipe.columns()
    used = [c for c in numeric if f"{c}__i" in scored.columns]
    coefs = fitted.model.stages[-1].coefficients.toArray()
    out = []
    for i, c in enumerate(coefs):
        if i < 2 * len(used):
            source = used[i % len(used)]
            name = source if i < len(used) else f"{source} missing"
        else:
            name = slots.get(i, f"slot_{i}")
            source = next((x for x in categorical if name.startswith(f"{x}__h_")), name)
            name = name.replace("__h_", "=")
        out.append((name, source, float(c)))
    return out


def top_coefficients(fitted: Fitted, scored: DataFrame, k: int = 12) -> DataFrame:
    """The k most positive and k most negative terms of a linear model."""
    terms = scored.sparkSession.createDataFrame(_terms(fitted, scored), "term string, source string, coefficient double")
    most = terms.filter("coefficient > 0").orderBy(F.desc("coefficient"), "term").limit(k)
    least = terms.filter("coefficient < 0").orderBy("coefficient", "term").limit(k)
    return most.unionByName(least)


def linear_contributions(fitted: Fitted, rows: DataFrame, panel: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long (keep..., feature, contribution): coefficient times value, summed per source feature.

    Slots of one source are added inside the row, so the rows unfold by source features and
    not by vector slots.
    """
    scored = transform(fitted, rows, panel)
    x = vector_to_array("features")
    by_source: dict[str, list] = {}
    for slot, (_, source, coefficient) in enumerate(_terms(fitted, scored)):
        by_source.setdefault(source, []).append(F.get(F.col("_x"), F.lit(slot)) * coefficient)
    items = [
        F.struct(F.lit(source).alias("feature"), sum(terms[1:], terms[0]).alias("contribution"))
        for source, terms in by_source.items()
    ]
    return scored.select(*keep, x.alias("_x")).select(*keep, F.explode(F.array(*items)).alias("_i")).select(*keep, "_i.*")


def with_dropped(recipe: Recipe, block: str) -> Recipe:
    return replace(recipe, name=f"{recipe.name}-{block}", dropped=(*recipe.dropped, block))


def with_extra(recipe: Recipe, extra: str) -> Recipe:
    return replace(recipe, name=f"{recipe.name}+{extra}", extras=(*recipe.extras, extra))

