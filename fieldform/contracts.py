"""Contracts on columns, checked while the plan is built, at no job cost."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens of market data and names of outcome columns.
MARKET_TOKENS = ("odds", "popularity", "payout", "market")
OUTCOME_COLUMNS = ("finish_position", "time_s", "early_position", "label", "finish_pct", "early_pct")


class ContractError(ValueError):
    """A DataFrame does not satisfy the contract of an operator."""


def forbidden_columns(columns: Iterable[str], tokens: Iterable[str] = MARKET_TOKENS) -> list[str]:
    tokens = tuple(tokens)
    return [c for c in columns if any(t in c.lower() for t in tokens)]


def forbid_columns(df: DataFrame, tokens: Iterable[str] = MARKET_TOKENS) -> DataFrame:
    bad = forbidden_columns(df.columns, tokens)
    if bad:
        raise ContractError(f"columns not allowed here: {bad}")
    return df


def forbid_outcomes(df: DataFrame) -> DataFrame:
    bad = [c for c in df.columns if c in OUTCOME_COLUMNS]
    if bad:
        raise ContractError(f"outcome columns not allowed here: {bad}")
    return df


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def allowlist_export(df: DataFrame, allow: Iterable[str]) -> DataFrame:
    allow = list(allow)
    return require_columns(df, allow).select(*allow)


def column_report(df: DataFrame, required: Iterable[str], tokens: Iterable[str] = MARKET_TOKENS) -> DataFrame:
    """One row per column of the frame or of the contract, with its verdict and non-null count."""
    required = list(required)
    bad = set(forbidden_columns(df.columns, tokens))
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    present = counts.unpivot([], list(df.columns), "column_name", "non_null")
    verdict = F.when(F.col("column_name").isin(*bad), "forbidden") if bad else F.when(F.lit(False), "")
    verdict = verdict.when(F.col("column_name").isin(*required), "required").otherwise("extra")
    return present.withColumn("verdict", verdict)
