"""Completeness, coverage, consensus and audit reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldform.contracts import ContractError, forbid_columns, forbid_outcomes
from fieldform.functions.contest import draw_pct, month_end
from fieldform.operators.joins import FINISHERS, key_difference, reconcile_keys, reconcile_outer, repeated_keys
from fieldform.scale import names, with_group

CONTEST, SUBJECT, DAY = "contest_id", "subject_id", "contest_date"


def field_completeness(df: DataFrame) -> DataFrame:
    """Contests with repeated subjects, a field size that varies, or the wrong number of rows."""
    # (contest, subject) is combined first, so counting repeats never holds a whole contest.
    per_subject = df.groupBy(CONTEST, SUBJECT).agg(
        F.count("*").alias("n"), F.min("field_size").alias("lo"), F.max("field_size").alias("hi")
    )
    facts = per_subject.groupBy(CONTEST).agg(
        F.sum("n").alias("observed"),
        F.min("lo").alias("field_size"),
        F.max("hi").alias("_hi"),
        F.sum(F.col("n") - 1).alias("repeated_subjects"),
    )
    varies = F.col("field_size") != F.col("_hi")
    wrong = F.col("observed") != F.col("field_size")
    return facts.withColumn("size_varies", varies).withColumn("size_wrong", wrong).filter(
        varies | wrong | (F.col("repeated_subjects") > 0)
    ).drop("_hi")


def field_totals(df: DataFrame) -> DataFrame:
    """How many contests pass and fail each completeness rule."""
    bad = field_completeness(df).agg(
        F.count_if(F.col("repeated_subjects") > 0).alias("repeated_subject"),
        F.count_if("size_varies").alias("size_varies"),
        F.count_if("size_wrong").alias("size_wrong"),
    )
    return bad.unpivot([], ["repeated_subject", "size_varies", "size_wrong"], "rule", "contests")


def cube_counts(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows, contests and dates by several key sets in one pass over contest totals.

    Keys must be constant in a contest; a key outside the set is NULL and ``grain`` names the set.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    contests = df.groupBy(CONTEST, DAY, *keys).agg(F.count("*").alias("_rows"))
    grain = F.concat_ws("*", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys]).alias("grain")
    return contests.groupingSets([list(s) for s in sets], *keys).agg(
        grain,
        F.sum("_rows").alias("rows"),
        F.count("*").alias("contests"),
        F.countDistinct(DAY).alias("dates"),
    )


def missingness(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """NULL count and rate per column, in total or by group, in one aggregation."""
    wide = df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = wide.unpivot([*by, "rows"], list(columns), "feature", "nulls")
    return long.withColumn("null_rate", F.col("nulls") / F.col("rows"))


def panel_summary(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, contests, subjects and label rate, from totals per contest and per subject."""
    sizes = panel.groupBy(*by, CONTEST).agg(F.count("*").alias("n"), F.sum("label").alias("s"))
    contests = sizes.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.count("*").alias("contests"), (F.sum("s") / F.sum("n")).alias("prevalence"),
        F.min("n").alias("min_field"), F.max("n").alias("max_field"),
    )
    subjects = panel.select(*by, SUBJECT).distinct().groupBy(*by).agg(F.count("*").alias("subjects"))
    if not by:
        return contests.withColumn("subjects", subjects.agg(F.sum("subjects")).scalar())
    return contests.join(subjects, list(by))


def field_distribution(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sizes = panel.groupBy(*by, CONTEST).agg(F.count("*").alias("field"))
    return sizes.groupBy(*by, "field").agg(F.count("*").alias("contests"))


def value_profile(df: DataFrame, columns: Sequence[str], k: int = 40) -> DataFrame:
    """The k most frequent values of each column, with width; ties in order of the value.

    Values are counted map-side and the rank limit is applied before the shuffle too.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = text.unpivot([], list(columns), "column_name", "value").groupBy("column_name", "value").count()
    order = Window.partitionBy("column_name").orderBy(F.desc("count"), F.col("value").asc_nulls_first())
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("width", F.length("value"))


def yearly_rollup(panel: DataFrame, kind: Column, benchmark: DataFrame | None = None) -> DataFrame:
    """Days, contests by kind and rows per year, optionally next to benchmark contest counts."""
    contests = panel.groupBy(F.year(DAY).alias("year"), DAY, CONTEST).agg(
        F.count("*").alias("n"), F.min(kind).alias("kind")
    )
    out = contests.groupBy("year").agg(
        F.countDistinct(DAY).alias("days"),
        F.count("*").alias("contests"),
        F.count_if(F.col("kind") == "flat").alias("flat"),
        F.count_if(F.col("kind") == "obstacle").alias("obstacle"),
        F.sum("n").alias("rows"),
    )
    if benchmark is not None:
        out = out.join(benchmark, "year", "left").withColumn("difference", F.col("contests") - F.col("benchmark"))
    return out


def card_slots(contests: DataFrame, card: Sequence[str], number: str, slots: int = 12) -> DataFrame:
    """Numbers present on each card and unfilled slots of 1..slots.

    Numbers are deduplicated first; a card holds at most as many as there are valid numbers.
    """
    seen = contests.select(*card, number).distinct()
    inside = F.col(number).between(1, slots)
    out = seen.groupBy(*card).agg(
        F.count("*").alias("numbers"),
        F.count_if(~inside).alias("outside"),
        F.sort_array(F.collect_set(F.when(inside, F.col(number)))).alias("_present"),
    )
    missing = F.array_except(F.sequence(F.lit(1), F.lit(slots)), F.col("_present"))
    return out.select(
        *card, "numbers", "outside",
        F.array_join("_present", ";").alias("present"),
        F.array_join(missing, ";").alias("unfilled"),
        (F.size(missing) == 0).alias("complete"),
    )


def consensus_map(
    facts: DataFrame, key: str, value: str, priority: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """One value per key and the keys whose sources disagree.

    Distinct (key, value) pairs are formed first.  With ``priority`` the value with the
    lowest priority number is used; evidence counts sources per key.
    """
    rank = F.min(priority) if priority else F.lit(0)
    pairs = facts.groupBy(key, value).agg(F.count("*").alias("n"), rank.alias("p"))
    out = pairs.groupBy(key).agg(
        F.min_by(value, F.struct("p", value)).alias("value"),
        F.count("*").alias("n_values"),
        F.sum("n").alias("evidence"),
    )
    return out, out.filter(F.col("n_values") > 1)


def latest_statements(facts: DataFrame, key: str, value: str, source: str, order: Sequence[str]) -> DataFrame:
    """The last statement of each source on each key, by ``order`` and then by value."""
    last = F.max_by(F.struct(value, *order), F.struct(*order, value))
    return facts.filter(F.col(key).isNotNull()).groupBy(key, source).agg(last.alias("_s")).select(key, source, "_s.*")


def source_agreement(stated: DataFrame, key: str, value: str, source: str) -> DataFrame:
    """For each pair of sources: keys that both state, keys on which they agree, and the share.

    ``stated`` has one row per key and source (``latest_statements``), so a key meets itself once per pair of sources
    that state it.  A NULL value is a value of its own.
    """
    a = stated.select(key, F.col(source).alias("source_a"), F.col(value).alias("_a"))
    b = stated.select(key, F.col(source).alias("source_b"), F.col(value).alias("_b"))
    both = a.join(b, key).filter(F.col("source_a") < F.col("source_b"))
    out = both.groupBy("source_a", "source_b").agg(F.count("*").alias("shared"), F.count_if(F.col("_a").eqNullSafe(F.col("_b"))).alias("agreeing"))
    return out.withColumn("share", F.col("agreeing") / F.col("shared"))


def preferred_statement(stated: DataFrame, precedence: DataFrame, key: str, value: str, source: str, day: str) -> DataFrame:
    """One statement per key, of the source that comes first in the year of its day.

    ``precedence`` has (source, first_year, last_year, priority); a source outside its years states nothing.  Among
    equal priorities the later day counts, then the source.
    """
    ranked = stated.join(precedence, source).filter(F.year(day).between(F.col("first_year"), F.col("last_year")))
    order = F.struct("priority", -F.datediff(day, F.lit("1970-01-01").cast("date")), source)
    chosen = ranked.groupBy(key).agg(F.min_by(F.struct(value, source, day, "priority"), order).alias("_s"))
    return chosen.select(key, "_s.*")


def anchor_report(mapped: DataFrame, anchors: DataFrame, key: str, value: str) -> DataFrame:
    """Anchors ``(key, expected)`` against a map with one value per key: ``ok``, ``wrong`` or ``missing``."""
    found = mapped.select(key, F.col(value).alias("found"), F.lit(True).alias("_there"))
    verdict = F.when(F.col("_there").isNull(), "missing").when(F.col("found").eqNullSafe(F.col("expected")), "ok").otherwise("wrong")
    return anchors.join(found, key, "left").withColumn("verdict", verdict).drop("_there")


def refuse_disagreement(agreement: DataFrame, anchors: DataFrame | None = None) -> None:
    """Fail where sources disagree or where a stated anchor is wrong; a missing anchor is no failure."""
    bad = [f"{r['source_a']}/{r['source_b']}: {r['shared'] - r['agreeing']}" for r in agreement.filter("agreeing < shared").collect()]
    bad += [f"anchor {r[0]}" for r in anchors.filter("verdict = 'wrong'").collect()] if anchors is not None else []
    if bad:
        raise ContractError("sources disagree: " + "; ".join(bad))


def inventory_evidence(source: DataFrame, evidence: DataFrame, overrides: DataFrame, card: str = "card") -> DataFrame:
    """Accept a card when its source count equals any independent count, else by recorded override.

    ``source``: (card, n).  ``evidence``: (card, method, n).  ``overrides``: (card, n).
    """
    hits = source.join(evidence.withColumnRenamed("n", "_e"), card).groupBy(card).agg(
        F.count_if((F.col("n") == F.col("_e")) & (F.col("_e") >= 1)).alias("agreeing"),
        F.count("*").alias("methods"),
    )
    out = source.join(hits, card, "left").join(overrides.withColumnRenamed("n", "_o"), card, "left")
    verdict = (
        F.when(F.col("agreeing") > 0, "count_evidence")
        .when(F.col("_o") == F.col("n"), "override")
        .otherwise("rejected")
    )
    zero = F.lit(0)
    return out.select(
        card, "n", F.coalesce("agreeing", zero).alias("agreeing"), F.coalesce("methods", zero).alias("methods"),
        verdict.alias("verdict"),
    )


# --- ledger ---------------------------------------------------------------------------


def build_ledger(facts: DataFrame) -> DataFrame:
    """Expected contests: one row per contest with its date; repeats and conflicts fail the job."""
    per = facts.groupBy(CONTEST).agg(F.min(DAY).alias(DAY), F.max(DAY).alias("_last"), F.count("*").alias("_n"))
    failed = F.raise_error(F.lit("contest listed twice or with two dates")).cast("date")
    sound = (F.col("_n") == 1) & (F.col(DAY) == F.col("_last"))
    return per.withColumn(DAY, F.when(sound, F.col(DAY)).otherwise(failed)).drop("_last", "_n")


def apply_events(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Mark verified abandonments; an event with another status, no source or another date fails."""
    e = events.select(
        CONTEST, F.col(DAY).alias("_d"), F.col("status").alias("_s"), F.col("url").alias("_u"), F.col("reason").alias("_r")
    )
    out = ledger.join(e, CONTEST, "left")
    has = F.col("_s").isNotNull()
    sound = (F.col("_s") == "abandoned") & F.col("_u").startswith("https://") & (F.col("_d") == F.col(DAY))
    failed = F.raise_error(F.lit("event is not a verified abandonment of this contest")).cast("string")
    status = F.when(~has, "expected_result").when(sound, "abandoned").otherwise(failed)
    return out.withColumn("contest_status", status).withColumn(
        "status_reason", F.coalesce("_r", F.lit(""))
    ).drop("_d", "_s", "_u", "_r")


def expected_results(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("contest_status") == "expected_result")


def complete_through(ledger: DataFrame, history: DataFrame, through: str) -> DataFrame:
    """The day before the earliest expected contest without rows, else ``through``."""
    end = F.lit(through).cast("date")
    due = ledger.filter(F.col(DAY) <= end)
    missing = due.join(history.select(CONTEST), CONTEST, "left_anti")
    return missing.agg(
        F.count("*").alias("missing"), F.coalesce(F.date_sub(F.min(DAY), 1), end).alias("complete_through")
    )


def month_checkpoints(ledger: DataFrame, history: DataFrame, start: str, through: str) -> DataFrame:
    """State after each month from ``start`` to ``through``, the last one cut there: what is due, confirmed and missing.

    Contests are totalled a month first; only months, also those without any contest, are then added up in order.
    """
    first, last = F.lit(start).cast("date"), F.lit(through).cast("date")
    due = ledger.filter(F.col(DAY).between(first, last)).select(CONTEST, DAY).distinct()
    rows = history.groupBy(CONTEST).agg(F.count("*").alias("_rows"))
    by_month = due.join(rows, CONTEST, "left").groupBy(month_end(DAY, last).alias("cutoff")).agg(
        F.count("*").alias("_due"), F.count("_rows").alias("_there"), F.sum("_rows").alias("_rows"),
        F.min(F.when(F.col("_rows").isNull(), F.col(DAY))).alias("_gap"), F.max(F.when(F.col("_rows").isNotNull(), F.col(DAY))).alias("_latest"),
    )
    each = F.explode(F.sequence(F.trunc(first, "month"), F.greatest(first, last), F.expr("INTERVAL 1 MONTH")))
    months = ledger.sparkSession.range(1, numPartitions=1).select(each.alias("_m")).filter(first <= last)
    months = months.select(F.greatest("_m", first).alias("first_day"), month_end("_m", last).alias("cutoff"))
    so_far = Window.orderBy("cutoff").rowsBetween(Window.unboundedPreceding, 0)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name).over(so_far), F.lit(0))

    return months.join(by_month, "cutoff", "left").select(
        "first_day", "cutoff", total("_due").alias("expected"), total("_there").alias("confirmed"),
        (total("_due") - total("_there")).alias("missing"), total("_rows").alias("rows"),
        F.max("_latest").over(so_far).alias("latest"),
        F.coalesce(F.date_sub(F.min("_gap").over(so_far), 1), F.col("cutoff")).alias("complete_through"),
    )


def qa_gate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) of row rules, in one aggregation; every count must be 0."""
    wide = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return wide.unpivot([], list(rules), "rule", "violations")


def gate_passes(report: DataFrame) -> DataFrame:
    return report.agg((F.max("violations") == 0).alias("passed"), F.sum("violations").alias("violations"))


def audit_snapshot(history: DataFrame, audit: DataFrame, ledger: DataFrame, cutoff: str) -> DataFrame:
    """Rule counts over a snapshot: identities, dates, statuses, sizes, conditions and times.

    ``history`` holds starters, ``audit`` all declared entries, ``ledger`` the expected
    contests with date, venue, surface and distance.
    """
    end = F.lit(cutoff).cast("date")

    def count(df: DataFrame, name: str, rule: Column | None = None) -> DataFrame:
        n = F.count("*") if rule is None else F.count_if(rule)
        return df.agg(n.alias("violations")).select(F.lit(name).alias("rule"), "violations")

    reports = []
    for label, df in (("history", history), ("audit", audit)):
        reports += [
            count(repeated_keys(df, [CONTEST, SUBJECT]), f"{label}_repeated_subject"),
            count(repeated_keys(df, [CONTEST, "entry_no"]), f"{label}_repeated_number"),
            count(df, f"{label}_after_cutoff", F.col(DAY) > end),
            count(
                reconcile_keys(ledger, df, [CONTEST]).filter("missing + unexpected > 0"), f"{label}_contest_set"
            ),
        ]
    statuses = (*FINISHERS, "scratched", "excluded")
    tenths = F.col("time_s") * 10
    done = F.col("status") == "finished"
    rows = qa_gate(
        history,
        {
            "history_non_starter": ~F.col("status").isin(*FINISHERS),
            "time_missing_or_not_positive": done & ~F.coalesce(F.col("time_s") > 0, F.lit(False)),
            "time_finer_than_tenths": done & (F.abs(tenths - F.round(tenths)) > 1e-6),
        },
    )
    reports += [rows, qa_gate(audit, {"audit_unknown_status": ~F.col("status").isin(*statuses)})]
    starters = audit.filter(F.col("status").isin(*FINISHERS))
    keys = [CONTEST, SUBJECT, "entry_no"]
    reports += [
        count(key_difference(history, starters, keys), "starter_not_declared"),
        count(key_difference(starters, history, keys), "declared_starter_without_result"),
    ]
    per_contest = history.groupBy(CONTEST).agg(
        F.count("*").alias("n"),
        F.min("field_size").alias("fs"),
        F.max("field_size").alias("fx"),
        F.min("declared_size").alias("ds"),
        F.count_if(F.col("finish_position") == 1).alias("winners"),
    )
    declared = audit.groupBy(CONTEST).agg(F.count("*").alias("dn"))
    sizes = per_contest.join(declared, CONTEST, "left")
    reports.append(
        qa_gate(
            sizes,
            {
                "field_size_wrong": (F.col("n") != F.col("fs")) | (F.col("fs") != F.col("fx")),
                "declared_size_wrong": F.coalesce(F.col("dn") != F.col("ds"), F.lit(True)),
                "no_winner": F.col("winners") == 0,
            },
        )
    )
    official = ledger.select(CONTEST, *[F.col(c).alias(f"_{c}") for c in (DAY, "venue", "surface", "distance_m")])
    conditions = history.join(official, CONTEST)
    reports.append(
        qa_gate(
            conditions,
            {f"condition_{c}": ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (DAY, "venue", "surface", "distance_m")},
        )
    )
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def subject_coverage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected against present earlier starts of every subject."""
    keys = [SUBJECT, CONTEST]
    both = reconcile_outer(expected.select(*keys).distinct(), actual.select(*keys).distinct(), keys)
    p = F.col("presence")
    return both.groupBy(SUBJECT).agg(
        F.count_if(p != "right").alias("expected"), F.count_if(p != "left").alias("actual"),
        F.count_if(p == "left").alias("missing"), F.count_if(p == "right").alias("extra"),
    )


CONSTANT = (DAY, "surface", "distance_m", "declared_size", "venue", "contest_class", "turn_direction")


def validate_roster(roster: DataFrame) -> DataFrame:
    """Violations per contest of a target roster; outcome or market columns are refused outright."""
    forbid_columns(roster)
    forbid_outcomes(roster)
    no = F.col("entry_no").cast("double")
    per_number = roster.groupBy(CONTEST, "entry_no").agg(
        F.count("*").alias("n"),
        F.count_if(F.col(SUBJECT).isNull()).alias("nameless"),
        F.count_if(no.isNull() | (no != F.floor(no)) | (no < 1) | (no > F.col("declared_size"))).alias("bad_no"),
        F.min("field_size").alias("f_lo"), F.max("field_size").alias("f_hi"),
        *[F.min(c).alias(f"lo_{c}") for c in CONSTANT], *[F.max(c).alias(f"hi_{c}") for c in CONSTANT],
        *[F.count(c).alias(f"k_{c}") for c in CONSTANT],
    )
    n = F.sum("n")
    varies = [
        F.when((F.min(f"lo_{c}") != F.max(f"hi_{c}")) | (F.sum(f"k_{c}") < n), 1).otherwise(0) for c in CONSTANT
    ]
    facts = per_number.groupBy(CONTEST).agg(
        n.alias("rows"),
        sum(varies[1:], varies[0]).alias("varying_fields"),
        F.sum("nameless").alias("missing_subject"),
        F.sum("bad_no").alias("invalid_number"),
        F.sum(F.col("n") - 1).alias("repeated_number"),
        F.when((F.min("f_lo") != n) | (F.max("f_hi") != n), 1).otherwise(0).alias("field_size_wrong"),
        F.when(F.max("hi_declared_size") < n, 1).otherwise(0).alias("declared_too_small"),
    )
    rules = ["varying_fields", "missing_subject", "invalid_number", "repeated_number", "field_size_wrong", "declared_too_small"]
    return facts.unpivot([CONTEST, "rows"], rules, "rule", "violations").filter("violations > 0")


def with_draw(roster: DataFrame) -> DataFrame:
    return roster.withColumn("draw_pct", draw_pct("entry_no", "declared_size"))


# --- collection window ----------------------------------------------------------------


def first_qualifying_window(df: DataFrame, contests: int, dates: int, days: int) -> DataFrame:
    """First full day with enough contests, dates and elapsed days, or ``collecting`` and counts only.

    Works on one row per calendar day; the running totals never see entries.
    """
    daily = df.select(CONTEST, DAY).distinct().groupBy(DAY).agg(F.count("*").alias("n"))
    upto = Window.orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    running = daily.select(
        DAY,
        F.sum("n").over(upto).alias("contests"),
        F.count("*").over(upto).alias("dates"),
        F.datediff(DAY, F.min(DAY).over(upto)).alias("elapsed_days"),
    )
    ready = (F.col("contests") >= contests) & (F.col("dates") >= dates) & (F.col("elapsed_days") >= days)
    state = F.struct("contests", "dates", "elapsed_days")
    out = running.agg(
        F.min(F.when(ready, F.col(DAY))).alias("window_end"),
        F.min_by(F.when(ready, state), F.when(ready, F.col(DAY))).alias("_hit"),
        F.max_by(state, DAY).alias("_all"),
    )
    chosen = F.coalesce("_hit", "_all")
    return out.select(
        F.when(F.col("window_end").isNull(), "collecting").otherwise("review_ready").alias("status"),
        "window_end",
        *[chosen[c].alias(c) for c in ("contests", "dates", "elapsed_days")],
    )


def lock_review_join(locks: DataFrame, outcomes: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locked rows with labels, and the excluded contests with their reason.

    A contest is excluded when it was cancelled after the lock or when any of its rows or
    labels is missing on either side.
    """
    late = events.select(CONTEST, "reason").groupBy(CONTEST).agg(F.min("reason").alias("reason"))
    open_locks = locks.join(late, CONTEST, "left_anti")
    cancelled = locks.select(CONTEST).distinct().join(late, CONTEST)
    keys = [CONTEST, SUBJECT]
    official = outcomes.join(open_locks.select(CONTEST).distinct(), CONTEST, "left_semi").select(*keys, "label")
    both = reconcile_outer(open_locks, official, keys)
    gap = (F.col("presence") != "both") | F.col("label").isNull()
    lacking = both.groupBy(CONTEST).agg(F.count_if(gap).alias("_gaps")).filter("_gaps > 0").select(
        CONTEST, F.lit("missing_official_outcomes").alias("reason")
    )
    review = both.join(lacking, CONTEST, "left_anti").drop("presence")
    return review, cancelled.unionByName(lacking)


def lock_conflicts(locks: DataFrame) -> DataFrame:
    """Counts that abort a review: repeated versions of a contest and more than one model."""
    versions = locks.groupBy(CONTEST).agg(F.countDistinct("lock_id").alias("v"))
    wide = versions.agg(F.count_if(F.col("v") > 1).alias("repeated_versions")).withColumn(
        "changed_models", F.greatest(locks.agg(F.countDistinct("model_hash") - 1).scalar(), F.lit(0))
    )
    return wide.unpivot([], ["repeated_versions", "changed_models"], "rule", "violations")


def group_sizes(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    return with_group(df, names(by), F.count("*").alias("group_size"))
