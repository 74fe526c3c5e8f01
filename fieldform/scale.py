"""Building blocks that keep group work safe when one key holds much of the data.

* ``with_group``      attach per-group aggregates by partial aggregation and a join,
                      so no task ever holds a whole group (a window would).
* ``rank_rows``       exact row numbers; groups past ``GROUP_ROWS`` are range-sorted
                      over all tasks instead of being sorted in one.
* ``materialize``     cut lineage with a Parquet table in the shared checkpoint folder.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldform.contracts import ContractError

# The largest group that a single task is asked to sort or to hold as an array.
GROUP_ROWS = 1_000_000
ARRAY_ROWS = 4_096


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Without one, a session whose executors are the driver itself gets a temporary folder that
    ends with the process; any other is refused, since its executors could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ContractError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (configured or _local_dir()).rstrip("/")


@cache
def _local_dir() -> str:
    folder = tempfile.mkdtemp(prefix="fieldform-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system of ``path`` has it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop))


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write once, read back: later readers share the result and survive lost executors.

    The shuffles of the write are of no use after it, so Spark drops their files when it ends; those
    of one step never add to those of the next.  With ``by``, the rows lie in as many buckets of that key as there are
    shuffle partitions, so what is grouped or joined by it need not move again; no key may hold much of the data.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    usual = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        if by is None:
            df.write.parquet(path)
        else:
            kept, buckets = f"fieldform_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.bucketBy(buckets, by).option("path", path).saveAsTable(kept, format="parquet")
    finally:
        spark.conf.unset(RELEASE) if usual is None else spark.conf.set(RELEASE, usual)
    return spark.read.schema(df.schema).parquet(path) if by is None else spark.table(kept)


def names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def with_group(df: DataFrame, by: str | Sequence[str], *aggs: Column) -> DataFrame:
    """Attach group aggregates to every row; a row with a NULL key is of no group and gets NULL.

    The aggregate side is combined map-side and has one row per key, so adaptive
    execution can broadcast it when small and split a hot key on the row side.
    """
    keys = names(by)
    return df.join(df.groupBy(*keys).agg(*aggs), keys, "left")


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the biggest group: a narrow, fully combinable scan that returns one number."""
    row = df.groupBy(*by).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def rank_rows(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[Column],
    name: str,
    *,
    largest: int | None = None,
) -> DataFrame:
    """``row_number()`` of each row in its group.  ``order`` must end in a unique key.

    ``largest`` is a known upper bound on group size; without it one narrow count decides
    between a window per group and the range-sorted path.
    """
    keys = names(by)
    if keys:
        bound = largest_group(df, keys) if largest is None else largest
        if bound <= GROUP_ROWS:
            window = Window.partitionBy(*keys).orderBy(*order)
            return df.withColumn(name, F.row_number().over(window).cast("long"))
    return _rank_by_range(df, keys, order, name)


def _rank_by_range(df: DataFrame, keys: list[str], order: Sequence[Column], name: str) -> DataFrame:
    """Range-partition by the sort key, number rows inside partitions, then add offsets.

    The numbered rows are written before offsets are read from them, so a retried task
    cannot see other range bounds than the ones that were counted.
    """
    sort = [F.col(k) for k in keys] + list(order)
    placed = materialize(
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    # One row per range partition, so the broadcast side is bounded by the task count.
    located = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("_pos", F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    if keys:
        located = with_group(located, keys, F.min("_pos").alias("_first"))
        located = located.withColumn(name, F.col("_pos") - F.col("_first") + 1)
    else:
        located = located.withColumn(name, F.col("_pos") + 1)
    return located.drop("_at", "_part", "_offset", "_pos", "_first")
