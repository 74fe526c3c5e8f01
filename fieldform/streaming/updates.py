"""Incremental updates: dated shards arrive as files, each batch replaces whole contests.

The stream keeps its own record of files seen; a batch is applied by the same operators
as a one-off update and published as a new snapshot version, so a failed batch leaves
the previous version current and is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fieldform.operators.joins import FINISHERS, upsert_contests
from fieldform.sources.parts import apply_parts
from fieldform.sources.snapshot import publish_snapshot, read_current


def apply_update(spark: SparkSession, fresh: DataFrame, ledger: DataFrame, root: str, through: str) -> DataFrame:
    """Replace the contests of ``fresh`` (declared entries) in the current version and publish."""
    state = read_current(spark, root)
    audit = fresh if state is None else upsert_contests(state[1], fresh, ledger)
    history = audit.filter(F.col("status").isin(*FINISHERS))
    return publish_snapshot(history, audit, ledger, root, through)


def follow_shards(
    spark: SparkSession, path: str, schema: T.StructType, ledger: DataFrame, root: str, through: str,
    checkpoint: str, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process every shard file under ``path`` that was not seen before, then stop."""

    def publish(batch: DataFrame, _: int) -> None:
        apply_update(batch.sparkSession, batch, ledger, root, through)

    shards = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return (
        shards.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def follow_parts(
    spark: SparkSession, path: str, schema: T.StructType, ledger: DataFrame, root: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """As ``follow_shards`` over a snapshot of parts: a batch rewrites the months that it touches, not the tables."""

    def publish(batch: DataFrame, _: int) -> None:
        apply_parts(batch.sparkSession, batch, ledger, root)

    shards = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return (
        shards.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
