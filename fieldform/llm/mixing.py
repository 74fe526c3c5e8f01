"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order that depends on their ids only.  A
document's virtual finish time is its source's words up to its own end, divided by the source's
target; all copies are range-sorted by it and taken until the budget is spent.  Every source has
then been served for about the same virtual time, so each comes within a document of its target.

Nulls: a null text has no words; a null source is a source of its own, ordered last.  Rows that
repeat an id are documents of their own.  Documents without words are never taken.
A text of any length is counted whole and is taken or left whole.  An empty table gives no rows; without any
word, targets are 0 and nothing is taken.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldform.llm.common import WORD, running_total
from fieldform.scale import materialize, rank_rows


def source_targets(sources: DataFrame, weights: Sequence[int], share: float, repeats: int) -> tuple[DataFrame, float]:
    """Add ``weight`` and ``target`` to ``sources(none, source, source_size)``; also the budget in words.

    Sources in code point order, null last, take the weights in turn.  They share ``share`` times
    all words; a target stops at ``repeats`` times its source's words and the rest is shared again
    by weight until none is above.  Each round is an aggregate over the sources.
    """
    ranked = rank_rows(sources, [], [F.col("none"), F.col("source")], "place")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = materialize(ranked.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int"))), "sources")
    limit = F.col("source_size") * repeats
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, held, level = share * total, None, 0.0
    while True:
        full = F.lit(False) if held is None else limit <= F.col("weight") * level
        row = ranked.agg(F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if held == tuple(row) or not row[1]:
            break
        held = tuple(row)
        level = (budget - held[0]) / held[1]
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target), budget


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, repeats: int = 2, *,
    id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` counts the words that the mix takes from the document, once per copy; a
    document has at most ``repeats`` copies, and its next copy queues behind all of its source.
    """
    slim = docs.select(
        F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("label"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    slim = slim.select(
        "doc_id", F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("source"), "size",
        F.monotonically_increasing_id().alias("row"),
    )
    slim = materialize(slim, "sizes")
    sources, budget = source_targets(slim.groupBy("none", "source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    rows = materialize(slim.join(sources.select("none", "source", "source_size", "target"), ["none", "source"]), "sizes")
    copies = F.least(F.ceil(F.col("target") / F.col("source_size")), F.lit(repeats)).cast("int")
    queue = rows.where("size > 0 and target > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))))
    queue = queue.withColumn("draw", F.md5(F.concat_ws(":", "copy", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    queue = running_total(queue, ["none", "source"], [F.col("copy"), F.col("draw"), F.col("row")], "size", "served")
    queue = queue.select("row", "copy", "size", "draw", (F.col("served") / F.col("target")).alias("finish"))
    queue = running_total(queue, [], [F.col("finish"), F.col("draw"), F.col("row"), F.col("copy")], "size", "spent")
    taken = queue.where(F.col("spent") <= F.lit(float(budget))).groupBy("row").agg(F.sum("size").alias("taken"))
    label = F.when(~F.col("none"), F.col("source")).alias("source")
    return rows.join(taken, "row", "left").select("doc_id", label, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
