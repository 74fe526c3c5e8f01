"""Snapshots made of parts: one part per table and month, of which an update rewrites those that it touches.

A version is a manifest: for each table and part its rows, its fingerprint and the folder that holds it.  Fingerprints
are sums over rows, so that of a table is the sum of its parts' and a version is named without reading what did not
change.  Parts are written first, the manifest after them and the pointer last: a failed publish leaves the version
before current, and old versions stay readable, since a part is never changed in place.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldform.contracts import ContractError
from fieldform.operators.joins import FINISHERS, key_difference, repeated_keys, upsert_contests
from fieldform.scale import exists, materialize
from fieldform.sources.fingerprint import row_fingerprint

CONTEST, SUBJECT, DAY = "contest_id", "subject_id", "contest_date"
TABLES = ("audit", "history", "ledger")
MANIFEST = "table_name string, part string, rows long, fingerprint string, folder string, layout string"


def part_of(day: str | Column = DAY) -> Column:
    """The month of a day; rows without a day have a part of their own."""
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("undated"))


def current_version(spark: SparkSession, root: str) -> str | None:
    path = f"{root.rstrip('/')}/pointer"
    if not exists(spark, path):
        return None
    return spark.read.parquet(path).agg(F.max_by("version", "published_at")).first()[0]


def read_manifest(spark: SparkSession, root: str, version: str | None = None) -> DataFrame | None:
    """Parts of a version, by default of the current one."""
    version = version or current_version(spark, root)
    if version is None:
        return None
    return spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifests/{version}")


def read_part_table(manifest: DataFrame, name: str, parts: Sequence[str] | None = None, verify: bool = False) -> DataFrame:
    """A table of a version, or only some of its parts; ``verify`` refuses parts that do not match their fingerprints."""
    spark = manifest.sparkSession
    rows = manifest.filter(F.col("table_name") == name)
    listed = rows.filter(F.col("part").isin(list(parts))) if parts is not None else rows
    found = listed.collect()  # one row a month
    layout = T.StructType.fromJson(json.loads((found or rows.head(1))[0]["layout"]))
    if not found:
        return spark.createDataFrame([], layout)
    out = spark.read.schema(layout).parquet(*[f"{r['folder']}/part={r['part']}" for r in found])
    if verify:
        held = {r["part"]: (r["rows"], r["fingerprint"]) for r in _prints(out).collect()}
        if held != {r["part"]: (r["rows"], r["fingerprint"]) for r in found}:
            raise ContractError(f"stored parts of {name} do not match their fingerprints")
    return out


def _prints(df: DataFrame) -> DataFrame:
    return row_fingerprint(df.withColumn("part", part_of()), sorted(df.columns), ["part"])


def table_fingerprint(manifest: DataFrame, name: str) -> tuple[int, str]:
    """Rows and fingerprint of a whole table, added up from its parts."""
    rows = manifest.filter(F.col("table_name") == name).select("rows", "fingerprint").collect()
    words = [sum(int(r["fingerprint"].split("-")[k]) for r in rows) for k in range(4)]
    return sum(r["rows"] for r in rows), "-".join(map(str, words))


def _write(df: DataFrame, name: str, root: str, gathered: bool = False) -> tuple[DataFrame, list[tuple]]:
    """Write the parts of ``df`` side by side; a month too large for one task is split into several files.

    Rows that are ``gathered``, as they come from written parts, stay in their tasks: each makes a file a part it reads.
    """
    folder = f"{root}/data/{name}-{uuid.uuid4().hex}"
    rows = df.withColumn("part", part_of())
    (rows if gathered else rows.hint("rebalance", "part")).write.partitionBy("part").parquet(folder)
    layout = json.dumps(df.schema.jsonValue())
    written = df.sparkSession.read.schema(df.schema).parquet(folder).select(df.columns)
    return written, [(name, r["part"], r["rows"], r["fingerprint"], folder, layout) for r in _prints(written).collect()]


def _publish(spark: SparkSession, root: str, rows: list[tuple]) -> DataFrame:
    text = "|".join(f"{t}:{p}:{n}:{fp}" for t, p, n, fp, *_ in sorted(rows))
    version = hashlib.sha256(text.encode()).hexdigest()[:16]
    path = f"{root}/manifests/{version}"
    if not exists(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame(sorted(rows), MANIFEST).coalesce(1).write.mode("overwrite").parquet(path)
    if current_version(spark, root) != version:
        pointer = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
        pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return read_manifest(spark, root, version)


def apply_parts(spark: SparkSession, fresh: DataFrame, ledger: DataFrame, root: str) -> DataFrame:
    """Replace the contests of ``fresh`` (declared entries) in the current version, drop contests that left the ledger.

    Only months that lose or gain rows are read and written; a contest that moved to another month touches both.
    Returns the manifest of the new version; content that is already current changes nothing.
    """
    root = root.rstrip("/")
    before = read_manifest(spark, root)
    old = {} if before is None else {(r["table_name"], r["part"]): tuple(r) for r in before.collect()}
    ledger = materialize(ledger, "parts-ledger")  # two columns that every step below reads
    if key_difference(fresh, ledger, [CONTEST]).head(1):
        raise ContractError("the update holds contests that the ledger does not expect")
    touched = {r[0] for r in fresh.select(part_of()).distinct().collect()}
    audit = fresh
    if old:
        # Two narrow columns of the whole table say where contests lie.
        placed = read_part_table(before, "audit").select(CONTEST, part_of().alias("part")).distinct()
        moved = placed.join(fresh.select(CONTEST).distinct(), CONTEST, "left_semi")
        gone = placed.join(ledger.select(CONTEST).distinct(), CONTEST, "left_anti")
        touched |= {r[0] for r in moved.unionByName(gone).select("part").distinct().collect()}
        audit = upsert_contests(read_part_table(before, "audit", sorted(touched)), fresh, ledger)
    if repeated_keys(audit, [CONTEST, SUBJECT]).head(1):
        raise ContractError("audit repeats a subject in a contest")
    expected = {("ledger", r["part"]): (r["rows"], r["fingerprint"]) for r in _prints(ledger).collect()}
    changed = [p for (_, p), seen in expected.items() if ("ledger", p) not in old or old["ledger", p][2:4] != seen]
    written, made = _write(audit, "audit", root)
    made += _write(written.filter(F.col("status").isin(*FINISHERS)), "history", root, gathered=True)[1]
    if changed:
        made += _write(ledger.filter(part_of().isin(changed)), "ledger", root)[1]
    kept = {k: r for k, r in old.items() if (k[0] == "ledger" and k in expected) or (k[0] != "ledger" and k[1] not in touched)}
    for r in made:
        own = old.get(r[:2])
        # A part with the same content stays the one that is there.
        kept[r[:2]] = own if own is not None and own[2:4] == r[2:4] else r
    return _publish(spark, root, [*kept.values()])


def changed_parts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Parts of ``after`` with their rows, and whether they are new, by reference, or gone."""
    a = before.select("table_name", "part", F.col("rows").alias("_rows"), F.col("folder").alias("_folder"))
    both = after.join(a, ["table_name", "part"], "full")
    state = F.when(F.col("folder").isNull(), "gone").when(F.col("folder").eqNullSafe(F.col("_folder")), "kept").otherwise("written")
    return both.select("table_name", "part", F.coalesce("rows", F.lit(0)).alias("rows"), state.alias("state"))


def read_parts(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame] | None:
    """All tables of a version after checking their fingerprints."""
    manifest = read_manifest(spark, root, version)
    return None if manifest is None else {name: read_part_table(manifest, name, verify=True) for name in TABLES}
