"""Typed reads of panels, entry files and raw lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldform.contracts import MARKET_TOKENS, forbid_columns, require_columns


def read_panel(
    spark: SparkSession, path: str, schema: T.StructType, forbid: Sequence[str] = MARKET_TOKENS
) -> DataFrame:
    """Parquet panel with the columns and types of ``schema``; market columns are refused.

    Only the named columns are read.  Splits written as partitions are pruned by filters.
    """
    df = spark.read.parquet(path)
    forbid_columns(df, forbid)
    require_columns(df, schema.names)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_entries_csv(
    spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None
) -> DataFrame:
    """CSV with header (byte order mark allowed) and declared types; ids stay text when declared so."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df if columns is None else df.select(*columns)


CORRUPT = "_corrupt"


def quarantine_malformed(
    lines: DataFrame, schema: T.StructType, line: str = "value", scope=None, sep: str = ","
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split delimited lines into parsed rows and lines of the wrong width or type.

    Returns good rows, bad lines and one row of counts (all lines, malformed, malformed in
    ``scope``, a condition on the line text).
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "sep": sep}
    parsed = lines.select(F.col(line), F.from_csv(F.col(line), full.simpleString()[7:-1].replace(":", " "), options).alias("_r"))
    broken = F.col(f"_r.{CORRUPT}").isNotNull()
    good = parsed.filter(~broken).select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema])
    bad = parsed.filter(broken).select(line)
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    counts = parsed.agg(
        F.count("*").alias("lines"),
        F.count_if(broken).alias("malformed"),
        F.count_if(broken & inside).alias("malformed_in_scope"),
    )
    return good, bad, counts
