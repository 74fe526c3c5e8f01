"""Entry table derived from the order tables, used by the registered queries and tests.

Four consecutive orders make a contest, each part in them one entry; the order with the
lowest key gives the contest its header.  Result places follow price, early places follow
quantity, and odds come from quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldform import scale
from fieldform.functions.contest import draw_pct, is_label, position_pct

_written: dict[tuple[str, str], DataFrame] = {}
_whole: dict[tuple[str, str], DataFrame] = {}
_lean: dict[tuple[str, str], DataFrame | None] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _contest(key: str) -> Column:
    return F.floor(F.col(key) / 4).cast("long").alias("contest_id")


def _slot(key: str) -> Column:
    """Place of an order among the four that share a contest, in the order of their keys."""
    return F.expr(f"CAST(pmod({key}, 4) AS INT)")


def _bit(slot: Column) -> Column:
    """One bit for each of the four orders."""
    return F.call_function("shiftleft", F.lit(1), slot)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a subject, one row each."""
    part = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("subject_id"))
    return part.agg(F.min(F.struct("p_brand", "p_size")).alias("_s")).select(
        "subject_id", F.col("_s.p_brand").alias("grp"), F.col("_s.p_size").alias("age")
    )


def _subjects_known_once(spark: SparkSession, sf_dir: str) -> bool:
    """Whether every part of a line has one row in ``part``, so that a join with it neither drops nor repeats a line."""
    ran = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject_id")).distinct()
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("subject_id")).agg(F.count("*").alias("_rows"))
    odd = F.count_if(F.coalesce("_rows", F.lit(0)) != 1).alias("odd")
    return not ran.join(rows, "subject_id", "left").agg(odd).first()["odd"]


def with_subjects(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of their subjects; Spark leaves the join out where these are not used."""
    out = rows.join(_subjects(spark, sf_dir), "subject_id", "left")
    at = rows.columns.index("turn_direction") + 1
    return out.select(*rows.columns[:at], "grp", "age", *rows.columns[at:])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({"contest_id": _contest("l_orderkey"), "_slot": _slot("l_orderkey")})


def build_entries(spark: SparkSession, sf_dir: str, subjects: bool = True, largest: int | None = None) -> DataFrame:
    """Declared entries; without ``subjects``, columns and existence of the subjects are left aside.

    ``largest`` is a known upper bound on the lines of a contest.
    """
    orders = table(spark, sf_dir, "orders").select(
        _contest("o_orderkey"),
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.to_date("o_orderdate").alias("d"),
    )
    head = orders.groupBy("contest_id").agg(
        F.min_by(F.struct("d", "o_orderstatus", "o_orderpriority", "o_custkey"), "o_orderkey").alias("h")
    )
    # The four orders of a contest as bits, so that lines meet their orders by contest and are shuffled only once.
    known = orders.groupBy("contest_id").agg(F.bit_or(_bit(_slot("o_orderkey"))).alias("_orders"))
    lines = _lines(spark, sf_dir)
    largest = scale.largest_group(lines, ["contest_id"]) if largest is None else largest
    # First line of each (contest, part): a minimum over the row, up to the last column that is used.
    first = F.min(
        F.struct(
            "_slot", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity",
            "l_discount", "l_tax", "l_shipdate", "l_returnflag",
        )
    )
    lines = (
        lines.join(known, "contest_id")
        .filter(F.col("_orders").bitwiseAND(_bit(F.col("_slot"))) != 0)
        .groupBy("contest_id", F.col("l_partkey").alias("subject_id"))
        .agg(first.alias("r"))
    )
    flag, disc, tax = F.col("r.l_returnflag"), F.col("r.l_discount"), F.col("r.l_tax")
    status = (
        F.when((flag == "N") & (disc >= 0.095), "scratched")
        .when((flag == "R") & (tax >= 0.075), "dnf")
        .otherwise("finished")
    )
    rows = lines.select(
        "contest_id",
        "subject_id",
        status.alias("status"),
        F.col("r.l_extendedprice").alias("price"),
        F.col("r.l_quantity").alias("qty"),
        tax.alias("tax"),
        disc.alias("disc"),
    )
    sizes = {"declared_size": F.count("*"), "field_size": F.count_if(F.col("status") != "scratched")}
    if largest <= scale.GROUP_ROWS:
        # No contest is large, so its sizes are taken where its lines already are.
        field = Window.partitionBy("contest_id")
        rows = rows.withColumns({name: size.over(field) for name, size in sizes.items()})
    else:
        rows = scale.with_group(rows, "contest_id", *[size.alias(name) for name, size in sizes.items()])
        rows = scale.materialize(rows, "entry-rows")
    rows = rows.withColumn("_fin", F.col("status") == "finished").withColumn(
        "_ran", F.col("status") != "scratched"
    )
    tie = F.col("subject_id")
    rows = scale.rank_rows(rows, "contest_id", [tie], "entry_no", largest=largest)
    rows = scale.rank_rows(rows, ["contest_id", "_fin"], [F.desc("price"), tie], "_place", largest=largest)
    rows = scale.rank_rows(rows, ["contest_id", "_ran"], [F.desc("qty"), tie], "_early", largest=largest)
    ck = F.col("h.o_custkey")
    rows, of_subject = rows.join(head, "contest_id"), []
    if subjects:
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject_id"), "p_brand", "p_size")
        rows, of_subject = rows.join(part, "subject_id"), [F.col("p_brand").alias("grp"), F.col("p_size").alias("age")]
    return (
        rows.select(
            "contest_id",
            F.col("h.d").alias("contest_date"),
            "subject_id",
            "entry_no",
            "status",
            F.when(F.col("h.o_orderstatus") == "F", "turf")
            .when(F.col("h.o_orderstatus") == "O", "dirt")
            .otherwise("synthetic")
            .alias("surface"),
            (ck % 10).cast("int").alias("venue"),
            (1000 + 200 * (ck % 9)).cast("int").alias("distance_m"),
            F.col("h.o_orderpriority").alias("contest_class"),
            F.when(ck % 20 == 0, "straight").when(ck % 2 == 0, "right").otherwise("left").alias("turn_direction"),
            *of_subject,
            (48 + F.round(F.col("tax") * 100).cast("int")).alias("weight"),
            "declared_size",
            "field_size",
            F.when(F.col("_fin"), F.col("_place")).alias("finish_position"),
            F.when(F.col("_fin"), F.round(60 + (105000 - F.col("price")) / 1000, 1)).alias("time_s"),
            F.when(F.col("_ran"), F.col("_early")).alias("early_position"),
            F.when((F.col("disc") < 0.005) & (F.col("tax") < 0.005), F.lit(None))
            .otherwise(1.2 + F.col("qty"))
            .cast("double")
            .alias("win_odds"),
        )
    )


def lean_entries(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The written entries without the columns of their subjects; None if lines and subjects do not match one to one.

    They lie by contest, unless a contest is too large for one task.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lean:
        _lean[key] = None
        if _subjects_known_once(spark, sf_dir):
            largest = scale.largest_group(_lines(spark, sf_dir), ["contest_id"])
            by = "contest_id" if largest <= scale.GROUP_ROWS else None
            rows = build_entries(spark, sf_dir, subjects=False, largest=largest)
            _lean[key] = scale.materialize(rows, "entries", by=by)
    return _lean[key]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared entries; derived once per session and folder, then read from Parquet.

    Columns of the subjects are joined by those who use them, as the entries would all have to move for it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        lean = lean_entries(spark, sf_dir)
        full = scale.materialize(build_entries(spark, sf_dir), "entries") if lean is None else with_subjects(spark, sf_dir, lean)
        _written[key] = full
    return _written[key]


def whole_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the columns of the subjects written, for those who read all columns more than once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _whole:
        rows = entries(spark, sf_dir)
        _whole[key] = rows if lean_entries(spark, sf_dir) is None else scale.materialize(rows, "whole-entries")
    return _whole[key]


def starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual starters in standard form: label, percentages and class flags, no prices."""
    return standard_starters(whole_entries(spark, sf_dir)).drop("win_odds")


def light_starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for those who use no columns of the subjects, or few others: these join when asked for."""
    return standard_starters(entries(spark, sf_dir)).drop("win_odds")


def standard_starters(declared: DataFrame) -> DataFrame:
    return declared.filter(F.col("status") != "scratched").select(
        "*",
        is_label("finish_position").alias("label"),
        position_pct("finish_position", "field_size").alias("finish_pct"),
        position_pct("early_position", "field_size").alias("early_pct"),
        draw_pct("entry_no", "declared_size").alias("draw_pct"),
        F.when(F.col("contest_class").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("is_open_plus"),
        F.when(F.col("contest_class") == "1-URGENT", 1).otherwise(0).alias("is_graded"),
    )
