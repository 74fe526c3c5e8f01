"""Hard negatives by exact inner products, scored with subset-sum tables and bit planes.

Vectors become whole numbers.  Components are taken in groups of eight.  Of an anchor, a table holds for each
group the sums of all 256 subsets of its components.  Of a candidate, each binary digit (two's complement, the
top one negative) of a group's components is one byte; a table answers that byte with the group's share at that digit,
so a score is a sum of answers, doubled from digit to digit.  Answers for ``ANCHORS`` anchors lie side by side,
so one look-up serves them all.

Candidates are cut into blocks of about ``BLOCK`` rows whatever their label or value, and rows of a block lie
sorted by label: a label with a third of all rows, or thousands of equal vectors, is spread over all blocks.  Anchors
visit the blocks twice: first only rows of their own label, for their nearest positives; then, with these, the rows of
other labels.  A block answers with at most ``k`` rows for each anchor and positive, so nothing of the size of all
pairs is ever moved.

Rows with a null label, a null vector or a null or non-finite component take no part, nor do rows without an id.
Vectors of different length are not compared.  Ids that repeat are rows of their own: an anchor excludes its own row
only.  Ties go to the smaller id.  Empty vectors score 0 with each other.  No anchors or no rows give no result.
Components must lie within ``LARGEST`` after scaling; beyond it the job fails, as scores would not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldform.scale import materialize

BLOCK, ANCHORS, TOGETHER = 8192, 512, 128
LARGEST, EMPTY = float(1 << 30), 1 << 62
TASKS = 1 << 14

BLOCKS = "dim int, block int, digits int, rows binary, ids binary, labels binary, planes binary"
ASKED = "dim int, asked int, rows binary, ids binary, labels binary, vectors binary, lows binary, highs binary"
FOUND = "anchor_row long, anchor_id long, place int, row long, id long, score long"


def planes(vectors: np.ndarray, digits: int) -> np.ndarray:
    """Bytes (rows x digits x groups): the binary digits of eight components each, the lowest digit first."""
    rows, dim = vectors.shape
    if dim == 0:
        return np.zeros((rows, digits, 0), np.uint8)
    wide = np.zeros((rows, -(-dim // 8) * 8), np.int64)
    wide[:, :dim] = vectors
    bits = np.stack([(wide >> k) & 1 for k in range(digits)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little")


def digits_of(vectors: np.ndarray) -> int:
    """Binary digits that hold every component in two's complement."""
    most = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)) - 1)
    return most.bit_length() + 1


def subset_sums(anchors: np.ndarray, kind) -> np.ndarray:
    """Tables (groups x 256 x anchors): the sum of each subset of a group's eight components."""
    count, dim = anchors.shape
    groups = -(-dim // 8)
    wide = np.zeros((count, groups * 8), kind)
    wide[:, :dim] = anchors
    tables = np.zeros((groups, 256, count), kind)
    for j in range(8):
        # Subsets that hold component j are those without it, plus that component.
        tables[:, 1 << j : 2 << j] = tables[:, : 1 << j] + wide[:, j::8].T[:, None, :]
    return tables


def scores(tables: np.ndarray, bytes_of: np.ndarray) -> np.ndarray:
    """Inner products (candidates x anchors): look-ups from the highest digit down, doubled in between."""
    rows, digits, groups = bytes_of.shape
    total = np.zeros((rows, tables.shape[2]), tables.dtype)
    for k in range(digits - 1, -1, -1):
        share = np.zeros_like(total)
        for g in range(groups):
            share += tables[g].take(bytes_of[:, k, g], axis=0)
        if k == digits - 1:
            total -= share
        else:
            total <<= 1
            total += share
    return total


def narrowest(anchors: np.ndarray, digits: int):
    """The integer type that holds every score and every partial sum."""
    most = int(np.abs(anchors).sum(axis=1, dtype=np.int64).max(initial=0)) << digits
    return np.int32 if most < 1 << 31 else np.int64


def _whole(group: pa.Table, dim: int) -> np.ndarray:
    flat = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).astype(np.int64).reshape(group.num_rows, dim)


def _column(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).to_numpy().astype(np.int64)


def _pack_block(group: pa.Table) -> pa.Table:
    dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
    rows, ids, labels = (_column(group, c) for c in ("row", "id", "label"))
    order = np.lexsort((rows, ids, labels))
    vectors = _whole(group, dim)[order]
    digits = digits_of(vectors)
    values = [[dim], [block], [digits], *([x[order].tobytes()] for x in (rows, ids, labels)), [planes(vectors, digits).tobytes()]]
    return _table(values, BLOCKS)


def _pack_asked(group: pa.Table) -> pa.Table:
    dim, asked = group.column("dim")[0].as_py(), group.column("asked")[0].as_py()
    rows, ids, labels = (_column(group, c) for c in ("row", "id", "label"))
    bounds = []
    for name, nothing in (("low", EMPTY), ("high", -EMPTY)):
        lists = group.column(name).to_pylist()
        width = max(map(len, lists))
        # An anchor with fewer positives has bounds that nothing fits.
        bounds.append(np.array([x + [nothing] * (width - len(x)) for x in lists], np.int64).reshape(len(rows), width))
    return _table([[dim], [asked], *([x.tobytes()] for x in (rows, ids, labels, _whole(group, dim).astype(np.int32), *bounds))], ASKED)


def _table(values: list, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [c.split() for c in schema.split(", ")]
    return pa.table({n: pa.array(v, kinds[k]) for v, (n, k) in zip(values, named, strict=True)})


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, the earlier place first among equals."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        over, equal = np.flatnonzero(score > least), np.flatnonzero(score == least)
        keep = np.sort(np.concatenate([over, equal[: k - len(over)]]))
    else:
        keep = np.arange(len(score))
    return keep[np.argsort(-score[keep], kind="stable")]


def _nearest(k: int) -> Callable:
    """The ``k`` best rows of an anchor's own label in a block."""

    def search(block, asked):
        rows, ids, labels, data = block
        for label in np.unique(asked["labels"]).tolist():
            first, last = (int(np.searchsorted(labels, label, side)) for side in ("left", "right"))
            own = np.flatnonzero(asked["labels"] == label)
            if first == last:
                continue
            for at in range(0, len(own), TOGETHER):
                some = own[at : at + TOGETHER]
                table = scores(_tables(asked["vectors"][some], data), data[first:last])
                for c, a in enumerate(some.tolist()):
                    score = table[:, c].astype(np.int64)
                    keep = best(score, k + 1) + first
                    keep = keep[rows[keep] != asked["rows"][a]][:k]
                    for p in keep.tolist():
                        yield a, 0, p, int(score[p - first])

    return search


def _below(k: int) -> Callable:
    """For each of an anchor's positives, the ``k`` best rows of other labels whose scores lie within its bounds."""

    def search(block, asked):
        rows, ids, labels, data = block
        order = np.lexsort((rows, ids))
        ids, labels, data = ids[order], labels[order], data[order]
        for at in range(0, len(asked["rows"]), TOGETHER):
            some = slice(at, at + TOGETHER)
            table = scores(_tables(asked["vectors"][some], data), data).T
            for c, score in enumerate(table):
                a = at + c
                low, high = asked["lows"][a], asked["highs"][a]
                fit = np.flatnonzero((score >= low.min()) & (score <= high.max()) & (labels != asked["labels"][a]))
                if not len(fit):
                    continue
                score = score[fit].astype(np.int64)
                for place, (lo, hi) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                    inside = np.flatnonzero((score >= lo) & (score <= hi))
                    for p in inside[best(score[inside], k)].tolist():
                        yield a, place, int(order[fit[p]]), int(score[p])

    return search


def _tables(anchors: np.ndarray, data: np.ndarray) -> np.ndarray:
    return subset_sums(anchors, narrowest(anchors, data.shape[1]))


def _over_blocks(search: Callable) -> Callable:
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                asked = {c: np.frombuffer(r[f"a_{c}"], np.int64) for c in ("rows", "ids", "labels")}
                count = len(asked["rows"])
                bounds = {c: np.frombuffer(r[f"a_{c}"], np.int64) for c in ("lows", "highs")}
                asked |= {c: x.reshape(count, len(x) // count) for c, x in bounds.items()}
                asked["vectors"] = np.frombuffer(r["a_vectors"], np.int32).reshape(count, r["dim"])
                rows, ids, labels = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "labels"))
                data = np.frombuffer(r["planes"], np.uint8).reshape(len(rows), r["digits"], -(-r["dim"] // 8))
                found = list(search((rows, ids, labels, data), asked))
                if found:
                    a, place, p, score = (np.array(x, np.int64) for x in zip(*found, strict=True))
                    columns = [asked["rows"][a], asked["ids"][a], place.astype(np.int32), rows[p], ids[p], score]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _visit(asked: DataFrame, blocks: DataFrame, packs: int, spread: int, search: Callable) -> DataFrame:
    """Let each of ``packs`` packs of anchors meet each of ``spread`` blocks of the same length, one pair a row."""
    key, tasks = ["dim", "block", "asked"], min(TASKS, packs * spread)
    renamed = [F.col(c).alias(f"a_{c}") for c in ("rows", "ids", "labels", "vectors", "lows", "highs")]
    many = asked.groupBy("dim", "asked").applyInArrow(_pack_asked, ASKED)
    many = many.select("dim", "asked", *renamed, F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("block"))
    each = blocks.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    pairs = many.repartition(tasks, *key).join(each.repartition(tasks, *key), key)
    return pairs.mapInArrow(_over_blocks(search), FOUND)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    scale: float = 256.0, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    The positives of an anchor (a row that ``is_anchor``, a condition on ``id``, holds for) are its best rows of its
    label.  For each, the best rows of other labels with ``low * positive <= 100 * negative <= high * positive`` follow.
    ``low`` and ``high`` are whole percentages.
    """
    real = F.col(vector).cast("array<double>")
    fit = F.col(vector).isNotNull() & F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(real, lambda x: F.floor(x * F.lit(scale)).cast("double"))
    own = F.col(label) if isinstance(label, str) else label
    rows = vectors.where(fit & F.col(id).isNotNull() & own.isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), own.cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), whole.alias("vector"),
    )
    large = F.exists("vector", lambda x: F.abs(x) > F.lit(LARGEST))
    rows = rows.withColumn("vector", F.when(large, F.raise_error(F.lit("a component is too large for whole scores"))).otherwise(F.col("vector")))
    rows = materialize(rows.withColumn("dim", F.size("vector")), "vectors")
    total, anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    spread, packs = max(1, -(-total // BLOCK)), max(1, -(-anchors // ANCHORS))
    cut = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    blocks = materialize(rows.withColumn("block", cut(spread)).groupBy("dim", "block").applyInArrow(_pack_block, BLOCKS), "blocks")
    asked = rows.where("anchor").withColumn("asked", cut(packs)).select("dim", "asked", "row", "id", "label", "vector")

    none = F.array().cast("array<long>")
    first = _visit(asked.withColumns({"low": none, "high": none}), blocks, packs, spread, _nearest(positives))
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    near = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    near = materialize(near, "positives")
    # The bounds of one anchor's few positives, in order; no positive, no search.
    bounds = near.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("p"))
    # Rounded up and down to whole scores.
    lows = F.expr(f"transform(p, x -> (x.score * {low} + pmod(-x.score * {low}, 100)) div 100)")
    highs = F.expr(f"transform(p, x -> (x.score * {high} - pmod(x.score * {high}, 100)) div 100)")
    bounded = asked.join(bounds.select(F.col("anchor_row").alias("row"), lows.alias("low"), highs.alias("high")), "row")
    second = _visit(bounded, blocks, packs, spread, _below(negatives))
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "id", "row")
    far = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    far = far.select("anchor_row", (F.col("place") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("anchor_row", "anchor_id", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(far, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
