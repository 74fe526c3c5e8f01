"""Content-named versions of history, entry audit and ledger, with an append-only pointer.

A version is named by the fingerprints of its tables.  Tables are written first, the
manifest after them and the pointer last, so a failed publish leaves the previous
version current.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldform.contracts import ContractError
from fieldform.operators.joins import key_difference, repeated_keys, table_diff
from fieldform.operators.quality import complete_through
from fieldform.scale import exists as _exists
from fieldform.scale import materialize
from fieldform.sources.fingerprint import row_fingerprint

CONTEST, SUBJECT = "contest_id", "subject_id"
TABLES = ("history", "audit", "ledger")


def _digest(df: DataFrame) -> tuple[int, str]:
    row = row_fingerprint(df, sorted(df.columns)).first()
    return (int(row["rows"]), str(row["fingerprint"]))


def publish_snapshot(history: DataFrame, audit: DataFrame, ledger: DataFrame, root: str, through: str) -> DataFrame:
    """Check, write and make current; publishing the same content again changes nothing."""
    spark = history.sparkSession
    root = root.rstrip("/")
    for name, df in (("history", history), ("audit", audit)):
        if repeated_keys(df, [CONTEST, SUBJECT]).head(1):
            raise ContractError(f"{name} repeats a subject in a contest")
    if key_difference(history, ledger, [CONTEST]).head(1):
        raise ContractError("history holds contests that the ledger does not expect")
    tables = dict(zip(TABLES, (history, audit, ledger), strict=True))
    digests = {name: _digest(df) for name, df in tables.items()}
    text = "|".join(f"{n}:{rows}:{fp}" for n, (rows, fp) in sorted(digests.items())) + f"|{through}"
    snapshot_id = hashlib.sha256(text.encode()).hexdigest()[:16]
    folder = f"{root}/snapshots/{snapshot_id}"
    if not _exists(spark, f"{folder}/manifest/_SUCCESS"):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        state = complete_through(ledger, history, through).first()
        rows = [
            (snapshot_id, name, n, fp, through, str(state["complete_through"]), int(state["missing"]))
            for name, (n, fp) in digests.items()
        ]
        schema = (
            "snapshot_id string, table_name string, rows long, fingerprint string, through string, "
            "complete_through string, missing_contests long"
        )
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    current = current_id(spark, root)
    if current != snapshot_id:
        pointer = spark.createDataFrame([(snapshot_id,)], "snapshot_id string").withColumn(
            "published_at", F.current_timestamp()
        )
        pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return spark.read.parquet(f"{folder}/manifest")


def current_id(spark: SparkSession, root: str) -> str | None:
    path = f"{root.rstrip('/')}/pointer"
    if not _exists(spark, path):
        return None
    return spark.read.parquet(path).agg(F.max_by("snapshot_id", "published_at")).first()[0]


def read_current(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """History, audit and ledger of the current version after checking their fingerprints."""
    snapshot_id = current_id(spark, root)
    if snapshot_id is None:
        return None
    folder = f"{root.rstrip('/')}/snapshots/{snapshot_id}"
    recorded = {r["table_name"]: (r["rows"], r["fingerprint"]) for r in spark.read.parquet(f"{folder}/manifest").collect()}
    out = []
    for name in TABLES:
        df = spark.read.parquet(f"{folder}/{name}")
        if _digest(df) != recorded[name]:
            raise ContractError(f"stored table {name} does not match its fingerprint")
        out.append(df)
    return tuple(out)


def merge_shards(shards: list[DataFrame], ledger: DataFrame, published: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Union of dated shards with the violations that forbid publishing it.

    Counted: repeated subjects or numbers, contests missing from or unknown to the ledger,
    and values that differ from rows already published.
    """
    merged = materialize(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards), "shards")

    def count(df: DataFrame, rule: str) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    report = [
        count(repeated_keys(merged, [CONTEST, SUBJECT]), "repeated_subject"),
        count(repeated_keys(merged, [CONTEST, "entry_no"]), "repeated_number"),
        count(key_difference(ledger, merged, [CONTEST]), "missing_contest"),
        count(key_difference(merged, ledger, [CONTEST]), "unknown_contest"),
    ]
    if published is not None:
        seen = merged.join(published.select(CONTEST).distinct(), CONTEST, "left_semi")
        changes = table_diff(published, seen, [CONTEST, SUBJECT])
        changed = changes.agg(F.sum(F.col("null_mismatches") + F.col("value_mismatches")).alias("violations"))
        report.append(changed.select(F.lit("published_fact_changed").alias("rule"), "violations"))
    return merged, reduce(DataFrame.unionByName, report)
