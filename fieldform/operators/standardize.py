"""Raw contest and entry tables to the standard form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldform.operators.joins import checked_join
from fieldform.scale import with_group

CONTEST = "contest_id"
# Fixed layout of a composite contest key: name -> (first character, length).
KEY_LAYOUT = {"key_year": (1, 4), "key_venue": (5, 2), "key_meeting": (7, 2), "key_day": (9, 2), "key_no": (11, 2)}


def decompose_key(df: DataFrame, key: str, layout: Mapping[str, tuple[int, int]] = KEY_LAYOUT) -> DataFrame:
    """Slice a fixed-width key into integer parts; a malformed key gives NULL parts."""
    width = max(start + length - 1 for start, length in layout.values())
    sound = F.col(key).rlike(rf"^\d{{{width}}}$")
    return df.withColumns(
        {name: F.when(sound, F.substring(key, s, n)).cast("int") for name, (s, n) in layout.items()}
    )


def conflict_counts(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(rule, conflicts): rows where both values are known and differ."""
    wide = df.agg(*[F.count_if(F.col(a) != F.col(b)).alias(rule) for rule, (a, b) in pairs.items()])
    return wide.unpivot([], list(pairs), "rule", "conflicts")


def regex_flags(df: DataFrame, name_col: str, patterns: Mapping[str, str]) -> DataFrame:
    """One flag per pattern; an unknown name gives NULL, not 0."""
    return df.withColumns({flag: F.col(name_col).rlike(p).cast("int") for flag, p in patterns.items()})


def merge_authoritative(
    df: DataFrame, pairs: Mapping[str, tuple[str, str]], key: str = CONTEST
) -> tuple[DataFrame, DataFrame]:
    """Fill each output from its first source, else its second; list the rows where they disagree."""
    merged = df.withColumns({out: F.coalesce(a, b) for out, (a, b) in pairs.items()})
    facts = [
        F.struct(
            F.lit(out).alias("column_name"), F.col(a).cast("string").alias("kept"),
            F.col(b).cast("string").alias("rejected"), (F.col(a) != F.col(b)).alias("differs"),
        )
        for out, (a, b) in pairs.items()
    ]
    conflicts = df.select(key, F.explode(F.array(*facts)).alias("f")).select(key, "f.*").filter("differs")
    return merged, conflicts.drop("differs")


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Recorded corrections win over computed values; ``<column>_source`` tells which was used.

    Two corrections of one key are refused, since either would change the number of rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    right = overrides.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    out = checked_join(df, right, keys, "left", "m:1")
    changes: dict[str, Column] = {}
    for c in columns:
        changes[c] = F.coalesce(f"_o_{c}", c)
        changes[f"{c}_source"] = F.when(F.col(f"_o_{c}").isNotNull(), "override").otherwise("computed")
    return out.withColumns(changes).drop(*[f"_o_{c}" for c in columns])


def recover_metadata(
    entries: DataFrame, unknown: str, values: Mapping[str, Column], max_winner_time: float = 60.0
) -> DataFrame:
    """Fill course fields of contests where ``unknown`` is NULL and the winner ran under the limit."""
    winner = F.min(F.when(F.col("finish_position") == 1, F.col("time_s"))).alias("_best")
    out = with_group(entries, CONTEST, winner)
    hit = F.col(unknown).isNull() & (F.col("_best") < max_winner_time)
    hit = F.coalesce(hit, F.lit(False))
    return out.withColumns(
        {**{c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}, "recovered": hit}
    ).drop("_best")


def classify_contests(
    df: DataFrame, official: str, obstacle: str, surface: str = "surface", distance: str = "distance_m"
) -> tuple[DataFrame, DataFrame]:
    """flat / obstacle by official kind, then by title, then by known course; the rest is quarantined.

    An official flat contest with an obstacle title is a contradiction and fails the job.
    """
    kind = F.col(official)
    named = F.coalesce(F.col(obstacle).cast("boolean"), F.lit(False))
    failed = F.raise_error(F.lit("official flat contest carries an obstacle title")).cast("string")
    final = (
        F.when((kind == "flat") & named, failed)
        .when(kind.isin("flat", "obstacle"), kind)
        .when(named, "obstacle")
        .when(F.col(surface).isNotNull() & F.col(distance).isNotNull(), "flat")
        .otherwise("unknown")
    )
    out = df.withColumn("kind", final)
    return out.filter(F.col("kind") != "unknown"), out.filter(F.col("kind") == "unknown")


def exclusion_reasons(
    df: DataFrame, rules: Mapping[str, Column], by: str = "year", included: str = "included"
) -> tuple[DataFrame, DataFrame]:
    """First matching reason of each contest, and counts of every reason by ``by``."""
    reason = F.when(F.lit(False), F.lit(""))
    for name, rule in rules.items():
        reason = reason.when(rule, F.lit(name))
    marked = df.withColumn("reason", reason.otherwise(F.lit(included)))
    counts = marked.groupBy(by).agg(
        F.count("*").alias("contests"),
        *[F.count_if(F.col("reason") == name).alias(name) for name in (*rules, included)],
    )
    return marked.filter(F.col("reason") != included), counts
