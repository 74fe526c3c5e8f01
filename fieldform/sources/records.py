"""JSON records bound to a schema, with the broken ones kept aside, and the way back to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldform.contracts import ContractError, require_columns

CORRUPT = "_corrupt"
# Checked in this order; a line has the first that holds.
REASONS = ("empty", "not_an_object", "wrong_type", "missing_field", "unknown_field")


def read_records(
    lines: DataFrame, schema: T.StructType, required: Sequence[str] = (), strict: bool = True, line: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Records of one JSON object a line, and the lines that break the schema with their reason.

    ``empty``: NULL or white space only.  ``not_an_object``: broken JSON, or another value than
    an object.  ``wrong_type``: a field does not fit its type.  ``missing_field``: a ``required``
    field is absent or null.  ``unknown_field``: a top-level key outside the schema (``strict``).
    ``field`` names the first such field in schema order, or the first unknown key.  Every line is
    in exactly one of the two results; other columns of ``lines`` stay with both.
    """
    require_columns(lines, [line])
    others = [c for c in lines.columns if c != line]
    clash = sorted({c.lower() for c in others} & {c.lower() for c in schema.names})
    if clash or CORRUPT in schema.names:
        raise ContractError(f"columns {clash or [CORRUPT]} stand for both a field and a column of the lines")
    absent = [c for c in required if c not in schema.names]
    if absent:
        raise ContractError(f"required fields {absent} are not in the schema")
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    keys = F.json_object_keys(line)
    # Lines that are no object are read as an empty one: a NULL record fails when it is written again.
    text = F.when(keys.isNull(), F.lit("{}")).otherwise(F.col(line))
    parsed = lines.select(
        "*", F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_r"), keys.alias("_k")
    )
    missing = _first([F.when(F.col("_r").getField(c).isNull(), F.lit(c)) for c in schema.names if c in required])
    extra = F.get(F.array_except("_k", F.array(*[F.lit(c) for c in schema.names])), F.lit(0)) if strict else F.lit(None).cast("string")
    reason = (
        F.when(F.col(line).isNull() | F.col(line).rlike(r"^\s*$"), REASONS[0])
        .when(F.col("_k").isNull(), REASONS[1])
        .when(F.col(f"_r.{CORRUPT}").isNotNull(), REASONS[2])
        .when(missing.isNotNull(), REASONS[3])
        .when(extra.isNotNull(), REASONS[4])
    )
    field = F.when(F.col("reason") == REASONS[3], missing).when(F.col("reason") == REASONS[4], extra)
    judged = parsed.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").select(*others, *[F.col("_r").getField(c).alias(c) for c in schema.names])
    bad = judged.filter("reason IS NOT NULL").select(*others, line, "reason", field.alias("field"))
    return good, bad


def _first(found: Sequence[Column]) -> Column:
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def write_records(df: DataFrame, columns: Sequence[str] | None = None, line: str = "value") -> DataFrame:
    """One JSON object a row, in the order of ``columns``; NULL fields are written as null."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias(line))
