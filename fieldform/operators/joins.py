"""Joins that state their cardinality, and reconciliations of two views of the same facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldform.contracts import ContractError
from fieldform.scale import names

CONTEST = "contest_id"


def repeated_keys(df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.groupBy(*names(on)).count().filter("count > 1")


def checked_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left",
    cardinality: str = "1:1", complete: bool = False,
) -> DataFrame:
    """Equi join that fails when a side meant to be unique is not, or a row finds no partner.

    ``cardinality`` is 1:1, m:1 or 1:m; ``complete`` also demands a match for every left row.
    """
    keys = names(on)
    if cardinality not in ("1:1", "m:1", "1:m"):
        raise ValueError(f"unknown cardinality {cardinality!r}")
    unique = {"1:1": (left, right), "m:1": (right,), "1:m": (left,)}[cardinality]
    for side in unique:
        if repeated_keys(side, keys).head(1):
            raise ContractError(f"join on {keys} is not {cardinality}")
    if complete and left.join(right, keys, "left_anti").head(1):
        raise ContractError(f"join on {keys} leaves rows without a partner")
    return left.join(right, keys, how)


def reconcile_outer(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Full outer join with ``presence`` both / left / right."""
    keys = names(on)
    a = left.withColumn("_l", F.lit(True))
    b = right.withColumn("_r", F.lit(True))
    presence = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return a.join(b, keys, "full_outer").withColumn("presence", presence).drop("_l", "_r")


def reconcile_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts of common, missing and unexpected keys, in total or by some of the key columns."""
    e = expected.select(*keys).distinct()
    a = actual.select(*keys).distinct()
    both = reconcile_outer(e, a, keys)
    p = F.col("presence")
    return both.groupBy(*by).agg(
        F.count_if(p != "right").alias("expected"),
        F.count_if(p != "left").alias("actual"),
        F.count_if(p == "left").alias("missing"),
        F.count_if(p == "right").alias("unexpected"),
    )


def disjoint_check(a: DataFrame, b: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row with the number of keys that appear on both sides."""
    cols = names(keys)
    common = a.select(*cols).distinct().join(b.select(*cols), cols, "left_semi")
    return common.agg(F.count("*").alias("overlap"))


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def key_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi")


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def dedupe_keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order, chosen by a map-side combined minimum."""
    keys = names(key)
    lead = [c for c in order if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in lead]
    row = F.min(F.struct(*lead, *rest)).alias("_row") if lead else F.first(F.struct(*rest)).alias("_row")
    out = df.groupBy(*keys).agg(row)
    return out.select(*keys, "_row.*").select(*df.columns)


NON_STARTERS = ("scratched", "excluded")
FINISHERS = ("finished", "dnf", "disqualified")


def verify_two_views(results: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result rows against the declared roster.

    ``results``: contest_id, entry_no, subject_id, name, finish_status, is_starter.
    ``roster``: contest_id, entry_no, subject_id, name, entry_status.  The roster rules
    identities, the results rule outcomes; a non-starter may be missing from the results.
    Returns the violations with a code, and the counts of every contest.
    """
    keys = [CONTEST, "entry_no", "subject_id", "name"]
    both = reconcile_outer(roster.select(*keys, "entry_status"), results.select(*keys, "finish_status", "is_starter"), keys)
    entry, finish, ran = F.col("entry_status"), F.col("finish_status"), F.col("is_starter")
    out_of_roster = F.col("presence") == "right"
    absent = F.col("presence") == "left"
    code = (
        F.when(out_of_roster, "not_in_roster")
        .when(absent & ~entry.isin(*NON_STARTERS), "active_entry_without_result")
        .when(absent, None)
        .when(finish.isin(*NON_STARTERS) & ran, "non_starter_flagged_as_starter")
        .when(finish.isin(*NON_STARTERS) & entry.isin(*NON_STARTERS) & (entry != finish), "kinds_of_withdrawal_differ")
        .when(finish.isin(*NON_STARTERS), None)
        .when(~finish.isin(*FINISHERS), "unsupported_status")
        .when(~ran, "starter_flagged_as_non_starter")
        .when(entry.isin(*NON_STARTERS), "starter_withdrawn_in_roster")
    )
    final = F.coalesce(finish, entry)
    counts = both.groupBy(CONTEST).agg(
        F.count_if(~out_of_roster).alias("declared_entries"),
        F.count_if(ran).alias("actual_starters"),
        *[F.count_if(final == s).alias(s) for s in ("scratched", "excluded", "dnf", "disqualified")],
        F.count_if(code.isNotNull()).alias("violations"),
    )
    return both.withColumn("violation", code).filter("violation is not null"), counts


NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")


def _gap(x: Column, y: Column, kind: str) -> Column | None:
    """Distance of two values of one type: numbers as they are, dates in days, times in seconds; None for others."""
    if kind in NUMBERS or kind.startswith("decimal"):
        return F.abs(x.cast("double") - y.cast("double"))
    if kind == "date":
        return F.abs(F.datediff(x, y)).cast("double")
    if kind.startswith("timestamp"):
        return F.abs(x.cast("timestamp").cast("double") - y.cast("timestamp").cast("double"))
    return None


def table_diff(
    a: DataFrame, b: DataFrame, keys: str | Sequence[str], tol: float = 1e-10, allowed: Sequence[str] = ()
) -> DataFrame:
    """Per column: rows whose NULLs differ, largest absolute error, values off by more than ``tol``.

    Keys found on one side only are reported as column ``<keys>``.  A column that one side lacks, or
    that has no comparable type there, differs in every common row.  Columns in ``allowed`` may differ.
    """
    on = names(keys)
    sides = [dict(a.dtypes), dict(b.dtypes)]
    cols = [c for c in dict.fromkeys([*a.columns, *b.columns]) if c not in on]

    def comparable(c: str) -> bool:
        kinds = [side.get(c) for side in sides]
        return None not in kinds and (kinds[0] == kinds[1] or all(k in NUMBERS or k.startswith("decimal") for k in kinds))

    def side(df: DataFrame, name: str) -> DataFrame:
        held = [F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(cols) if comparable(c)]
        key = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(on)]
        return df.select(F.struct(*key).alias("key"), F.struct(F.lit(True).alias("here"), *held).alias(name))

    joined = side(a, "left_row").join(side(b, "right_row"), "key", "full_outer")
    both = F.col("left_row").isNotNull() & F.col("right_row").isNotNull()

    def facts(i: int, c: str) -> Column:
        none = F.lit(None).cast("double")
        if not comparable(c):
            return F.struct(F.lit(c).alias("column_name"), F.count_if(both).alias("null_mismatches"), none.alias("max_abs_error"),
                            F.lit(0).cast("long").alias("value_mismatches"))
        x, y = F.col(f"left_row.v{i}"), F.col(f"right_row.v{i}")
        gap = _gap(x, y, sides[0][c])
        worst = none if gap is None else F.coalesce(F.max(F.when(both, gap)), F.lit(0.0))
        off = F.count_if(both & (x != y)) if gap is None else F.count_if(both & (gap > tol))
        return F.struct(F.lit(c).alias("column_name"), F.count_if(both & (x.isNull() != y.isNull())).alias("null_mismatches"),
                        worst.alias("max_abs_error"), off.alias("value_mismatches"))

    lone = F.struct(F.lit("<keys>").alias("column_name"), F.count_if(~both).alias("null_mismatches"),
                    F.lit(None).cast("double").alias("max_abs_error"), F.lit(0).cast("long").alias("value_mismatches"))
    items = F.array(lone, *[facts(i, c) for i, c in enumerate(cols)])
    wide = joined.agg(F.count_if(both).alias("rows"), items.alias("items"))
    out = wide.select("rows", F.explode("items").alias("_i")).select("rows", "_i.*")
    bad = (F.col("null_mismatches") > 0) | (F.col("value_mismatches") > 0)
    if [c for c in cols if not comparable(c)]:
        bad = bad | F.col("column_name").isin(*[c for c in cols if not comparable(c)])
    verdict = F.when(~bad, "equal").when(F.col("column_name").isin(*allowed), "allowed").otherwise("different")
    return out.withColumn("verdict", verdict if allowed else F.when(bad, "different").otherwise("equal"))


def resolve_entities(
    new: DataFrame, known: DataFrame, name: str = "name", id_col: str = "subject_id",
    official: str = "official_id", prefix: str = "new:",
) -> DataFrame:
    """Map names of a new source to known ids.

    One known id for the name: that id.  None: a prefixed new id.  Several: the official id
    if it is among them, otherwise the row is ``unresolved`` with no id.
    """
    ids = known.select(F.col(name), F.col(id_col).cast("string").alias("_id")).distinct()
    per_name = ids.groupBy(name).agg(F.count("*").alias("_n"), F.min("_id").alias("_only"))
    hits = ids.withColumnRenamed("_id", "_official").withColumn("_hit", F.lit(True))
    rows = new.withColumn("_official", F.col(official).cast("string"))
    out = rows.join(per_name, name, "left").join(hits, [name, "_official"], "left")
    n = F.coalesce("_n", F.lit(0))
    how = (
        F.when(n == 1, "mapped").when(n == 0, "new").when(F.col("_hit"), "official").otherwise("unresolved")
    )
    resolved = (
        F.when(n == 1, F.col("_only")).when(n == 0, F.concat(F.lit(prefix), "_official")).when(F.col("_hit"), F.col("_official"))
    )
    return out.withColumn("resolved_id", resolved).withColumn("resolution", how).drop("_n", "_only", "_official", "_hit")


def attach_predictions(outcome: DataFrame, *tables: DataFrame, on: Sequence[str]) -> DataFrame:
    """Outcome rows with every prediction table joined 1:1; each must cover exactly the same keys."""
    out = outcome
    for frame in tables:
        if key_difference(frame, outcome, on).head(1):
            raise ContractError("a prediction table has keys that the outcome lacks")
        out = checked_join(out, frame, on, "inner", "1:1", complete=True)
    return out


def stale_contests(ledger: DataFrame, current: DataFrame, through: str, recheck_days: int = 14) -> DataFrame:
    """Expected contests that are new or fall into the recheck window that ends at ``through``."""
    known = current.select(CONTEST).distinct().withColumn("_known", F.lit(True))
    first = F.date_sub(F.lit(through).cast("date"), max(recheck_days - 1, 0))
    recent = (F.col("contest_date") >= first) if recheck_days > 0 else F.lit(False)
    return ledger.join(known, CONTEST, "left").filter(F.col("_known").isNull() | recent).drop("_known")


def upsert_contests(current: DataFrame, fresh: DataFrame, ledger: DataFrame) -> DataFrame:
    """Replace whole contests by fresh ones and drop contests that left the ledger."""
    ids = fresh.select(CONTEST).distinct()
    kept = current.join(ids, CONTEST, "left_anti").unionByName(fresh, allowMissingColumns=True)
    return kept.join(ledger.select(CONTEST).distinct(), CONTEST, "left_semi")
