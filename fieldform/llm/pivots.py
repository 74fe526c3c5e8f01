"""Exact top-k by inner product, with candidates ruled out by a table of distances to pivots.

Vectors become whole numbers, so scores are exact.  For a pivot p, ``|d(q,p) - d(c,p)|`` is a lower bound of
``d(q,c)``; the largest over all pivots bounds the inner product from above through ``(|q|^2 + |c|^2 - d^2) / 2``
(with the origin among the pivots never above ``|q||c|``).  The candidates of a block lie in cells of near
distances to their nearest pivot, and a cell keeps the range of its distances to every pivot, so one bound serves all
its candidates.  Cells are scored in the order of their bounds, and a query is done with a block as soon as no
bound left reaches its k-th best score.  That score starts as the k-th best of the query's exact scores with the pivot
sample, whose vectors are candidates themselves, so weak cells fall without being scored at all.

The pivots are fitted on a bounded sample (``PIVOT_SAMPLE`` vectors of each length, farthest first; about as many as
the root of the number of vectors, ``MOST_PIVOTS`` at most); every vector is in the table and every query meets every
block.  Blocks hold about ``BLOCK`` vectors whatever their values, so repeated vectors do not pile up in one task.
Vectors that are null or hold a null or non-finite component take no part; vectors of different length are not
compared.  Rows that repeat an id or a vector are vectors of their own: a query leaves out its own row only, and two query
rows of one id have a list each.  Null ids take no part.  Ties go to the smaller id.  An empty table, or one without
queries, gives no rows; other columns are ignored.  Scores are exact below 2**53.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldform.scale import materialize

PIVOT_SAMPLE, MOST_PIVOTS = 2048, 256
BLOCK, QUERIES, TOGETHER = 16384, 512, 128
CELL, FIRST_CELLS = 64, 8
SLACK = 1e-6
TASKS = 1 << 14

BLOCKS = "dim int, block int, kind string, rows binary, ids binary, vectors binary, starts binary, near binary, far binary, norms binary"
ASKED = "dim int, asked int, kind string, rows binary, ids binary, vectors binary, least binary"


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """The origin, and farthest-first pivots from the vector farthest from the mean on."""
    origin = np.zeros((1, sample.shape[1]))
    if len(sample) == 0:
        return origin
    gap = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(gap.argmax())]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return np.concatenate([origin, sample[chosen]])


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances (vectors x pivots) of whole-number vectors."""
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def cells_of(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of the vectors by cells, and of each cell its start, nearest and farthest distances and largest square norm."""
    table = distances(vectors, pivots)
    home = table[:, 1:].argmin(axis=1) if table.shape[1] > 1 else np.zeros(len(table), np.int64)
    reach = table[np.arange(len(table)), home + (table.shape[1] > 1)]
    order = np.lexsort((reach, home))
    first = np.flatnonzero(np.append(True, np.diff(home[order]) != 0))
    starts = np.concatenate([np.arange(a, b, CELL) for a, b in zip(first, np.append(first[1:], len(order)), strict=True)])
    table = table[order].astype(np.float32)
    norms = np.maximum.reduceat((vectors[order] ** 2).sum(axis=1), starts)
    return order, starts, np.minimum.reduceat(table, starts), np.maximum.reduceat(table, starts), norms


def bounds_of(table: np.ndarray, q_norms: np.ndarray, near: np.ndarray, far: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Upper bounds (queries x cells) of the inner products of each query with all vectors of a cell."""
    gap = np.zeros((len(table), len(near)), np.float32)
    for p in range(table.shape[1]):
        own = table[:, p, None]
        np.maximum(gap, near[None, :, p] - own, out=gap)
        np.maximum(gap, own - far[None, :, p], out=gap)
    # Rounding of distances may raise a gap a little above the truth; the slack undoes it.
    low = np.maximum(gap.astype(np.float64) * (1 - SLACK) - SLACK * (1 + table.max(axis=1, initial=0)[:, None] + far.max(initial=0)), 0)
    return (q_norms[:, None] + norms[None, :] - low**2) / 2 + 0.5


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest of each row, or -inf."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def best_of_block(rows, ids, vectors, starts, near, far, norms, q_rows, q_vectors, q_table, least, k) -> tuple[list[np.ndarray], int]:
    """For each query the places of its best candidates with their scores, and the number of pairs that were scored."""
    out, scored = [], 0
    ends = np.append(starts[1:], len(rows))
    by_row = np.argsort(rows)
    for at in range(0, len(q_rows), TOGETHER):
        some = slice(at, at + TOGETHER)
        queries, enough = q_vectors[some], least[some].copy()
        bounds = bounds_of(q_table[some], (queries**2).sum(axis=1), near, far, norms)
        place = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1)
        scores = np.full((len(queries), len(rows)), -np.inf)
        own = np.minimum(np.searchsorted(rows, q_rows[some], sorter=by_row), len(rows) - 1)
        held = rows[by_row[own]] == q_rows[some]
        for low, high in ((0, FIRST_CELLS), (FIRST_CELLS, len(starts))):
            open_ = (place >= low) & (place < high) & (bounds >= enough[:, None])
            for cell in np.flatnonzero(open_.any(axis=0)).tolist():
                who = np.flatnonzero(open_[:, cell])
                a, b = starts[cell], ends[cell]
                scores[who, a:b] = queries[who] @ vectors[a:b].T
                scored += len(who) * int(b - a)
            scores[np.flatnonzero(held), by_row[own[held]]] = -np.inf
            enough = np.maximum(enough, kth_best(scores, k))
        for q in range(len(queries)):
            keep = np.flatnonzero(scores[q] >= max(enough[q], -1e300))
            order = np.lexsort((rows[keep], ids[keep], -scores[q, keep]))[:k]
            out.append((keep[order], scores[q, keep[order]]))
    return out, scored


def _vectors(group: pa.Table, dim: int) -> np.ndarray:
    return np.array(group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(group.num_rows, dim)


def _narrow(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(initial=0)
    return vectors.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def _table(values: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    named = [c.split() for c in schema.split(", ")]
    return pa.table({n: pa.array([v], kinds[t]) for v, (n, t) in zip(values, named, strict=True)})


def _ids(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(group.column(c).to_numpy().astype(np.int64) for c in ("row", "vec_id"))


def _pack_block(fitted: dict):
    def pack(group: pa.Table) -> pa.Table:
        dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
        (rows, ids), vectors = _ids(group), _vectors(group, dim)
        order, starts, near, far, norms = cells_of(vectors, fitted[dim][1])
        own = _narrow(vectors[order])
        parts = (rows[order], ids[order], own, starts.astype(np.int64), near, far, norms)
        return _table([dim, block, own.dtype.str, *(x.tobytes() for x in parts)], BLOCKS)

    return pack


def _pack_asked(fitted: dict, k: int):
    def pack(group: pa.Table) -> pa.Table:
        dim, asked = group.column("dim")[0].as_py(), group.column("asked")[0].as_py()
        (rows, ids), vectors = _ids(group), _vectors(group, dim)
        sample_rows, _, sample = fitted[dim]
        scores = vectors @ sample.T
        scores[rows[:, None] == sample_rows[None, :]] = -np.inf
        own = _narrow(vectors)
        return _table([dim, asked, own.dtype.str, *(x.tobytes() for x in (rows, ids, own, kth_best(scores, k)))], ASKED)

    return pack


def _search(k: int, pivots: dict[int, np.ndarray]):
    def vectors(raw, kind, count, dim):
        return np.frombuffer(raw, kind).reshape(count, dim).astype(np.float64)

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, ids, starts = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "starts"))
                near, far = (np.frombuffer(r[c], np.float32).reshape(len(starts), -1) for c in ("near", "far"))
                q_rows, q_ids = (np.frombuffer(r[c], np.int64) for c in ("a_rows", "a_ids"))
                asked = vectors(r["a_vectors"], r["a_kind"], len(q_rows), r["dim"])
                table = distances(asked, pivots[r["dim"]]).astype(np.float32)
                own = vectors(r["vectors"], r["kind"], len(rows), r["dim"])
                found, _ = best_of_block(rows, ids, own, starts, near, far, np.frombuffer(r["norms"]), q_rows, asked, table, np.frombuffer(r["a_least"]), k)
                at = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
                places = np.concatenate([p for p, _ in found])
                scores = np.concatenate([s for _, s in found]).astype(np.int64)
                columns = (q_rows[at], q_ids[at], rows[places], ids[places], scores)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "query_id", "row", "vec_id", "score"])

    return search


def exact_top_k(
    vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, *, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products of each query.

    ``is_query`` is a condition on ``vec_id``; candidates are all rows but the query's own.
    """
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(scale)).cast("double"))
    fit = F.col(vector).isNotNull() & F.forall(
        F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    rows = vectors.where(fit & F.col(id).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("vec_id"), whole.alias("vector")
    )
    rows = materialize(rows.withColumn("dim", F.size("vector")), "vectors")
    asked = rows.where(is_query)
    total, queries = rows.count(), asked.count()
    spread, packs = max(1, -(-total // BLOCK)), max(1, -(-queries // QUERIES))

    drawn = Window.partitionBy("dim").orderBy(F.xxhash64("row", F.lit(3)), "row")
    sample = rows.withColumn("_n", F.row_number().over(drawn)).where(F.col("_n") <= PIVOT_SAMPLE).select("dim", "row", "vector")
    found = defaultdict(list)
    for r in sample.collect():  # at most PIVOT_SAMPLE vectors of each length
        found[r["dim"]].append((r["row"], r["vector"]))
    fitted, count = {}, min(MOST_PIVOTS, int(total**0.5) + 1)
    for dim, some in found.items():
        own = np.array([v for _, v in some], np.float64).reshape(len(some), dim)
        fitted[dim] = np.array([r for r, _ in some], np.int64), choose_pivots(own, count), own

    cut = lambda n: F.pmod(F.xxhash64("row", F.lit(7)), F.lit(n)).cast("int")
    blocks = rows.withColumn("block", cut(spread)).groupBy("dim", "block").applyInArrow(_pack_block(fitted), BLOCKS)
    many = asked.withColumn("asked", cut(packs)).groupBy("dim", "asked").applyInArrow(_pack_asked(fitted, k), ASKED)
    many = many.select("dim", "asked", *[F.col(c).alias(f"a_{c}") for c in ("kind", "rows", "ids", "vectors", "least")], F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("block"))
    each = blocks.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    # Each pack of queries meets each block of candidates of its length, one pair a row.
    key, tasks = ["dim", "block", "asked"], min(TASKS, packs * spread)
    pairs = many.repartition(tasks, *key).join(each.repartition(tasks, *key), key)
    schema = "query_row long, query_id long, row long, vec_id long, score long"
    best = pairs.mapInArrow(_search(k, {d: pivots for d, (_, pivots, _) in fitted.items()}), schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    # At most k rows per query and block reach the ranking.
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
