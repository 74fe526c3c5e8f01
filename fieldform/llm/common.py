"""General helpers of the operators: tables, totals along an order, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldform.scale import materialize, names

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_total(df: DataFrame, by: str | Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Attach the sum of ``value`` over the rows of the same ``by`` up to each row in ``order``.

    Rows are range-sorted over all tasks by key and order, so a key with a third of all rows is
    split; each piece is summed where it lies and starts from the total of the pieces before it.
    ``order`` must be unique within a key.  The sorted rows are written first, so that a retried
    task meets the bounds that were counted.
    """
    keys = names(by)
    sort = [F.col(k) for k in keys] + list(order)
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "running").withColumn("_piece", F.shiftright("_at", 33))
    pieces = placed.groupBy("_piece", *keys).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and piece: pieces are as many as tasks, keys as many as sources.
    pieces = pieces.select("_piece", *keys, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_piece", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_own", F.sum(value).over(own)).join(pieces, ["_piece", *keys])
    return out.withColumn(name, F.col("_own") + F.col("_before")).drop("_at", "_piece", "_own", "_before")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of the graph of ``links(a, b)``: the smallest node reachable, for each node but that one.

    Alternating large-star and small-star steps; each is a combined minimum and a join whose
    heavy side can be split, and the links are written after each round.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, seen = materialize(edges, "links"), None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialize(small.union(low).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
