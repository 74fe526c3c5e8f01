"""Graded toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are its distinct lower-cased words and the distinct 4-byte grams inside them,
hashed to 2**20 buckets.  One weight vector serves all grades; grade j or more has probability
``sigmoid(w x - cut_j)`` with rising cuts, and the expected severity is the sum of these.

The model is fitted in one task on a bounded sample of labelled rows: the ``PER_GRADE`` rows of each
grade that come first in a hash order of their ids.  It is a fixed 4 MB, sent to every task; all
rows are scored where they are read, in whole texts.

Nulls: a null text has no features and its severity is that of the cuts alone; labels without a
grade or a document are skipped; without any labels the severity is 0 and nothing is rejected.
Rows that repeat are scored alike; for the fit, each pair of document and label counts.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldform.llm.bytesets import BYTE_VALUE, IS_SPACE, LOWER, _hash_words, mix, slices, text_buffers
from fieldform.scale import materialize

BITS, GRAM = 20, 4
PER_GRADE = 4000
ROUNDS, RIDGE, EVIDENCE, LIFT = 100, 0.5, 12.0, 5.0

SCORES = "doc_id long, severity double, grade int, chances array<double>"


def features(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, distinct feature buckets of each row, counts)`` slice by slice."""
    data, offsets = text_buffers(column)
    for first, last in slices(offsets):
        own = offsets[first : last + 1] - offsets[first]
        low = LOWER[data[offsets[first] : offsets[last]]]
        words, ends = _hash_words(low, own)
        rows = [np.repeat(np.arange(last - first), np.diff(np.concatenate([np.zeros(1, np.int64), ends])))]
        found = [words]
        if len(low) >= GRAM:
            gram, space = np.zeros(len(low) - GRAM + 1, np.uint64), np.zeros(len(low) - GRAM + 1, bool)
            for k in range(GRAM):
                part = slice(k, k + len(gram))
                gram = gram * np.uint64(0x9E3779B97F4A7C15) + BYTE_VALUE[low[part]]
                space |= IS_SPACE[low[part]]
            row = np.searchsorted(own, np.arange(len(gram)), "right") - 1
            keep = ~space & (np.arange(len(gram)) + GRAM <= own[row + 1])
            rows.append(row[keep])
            found.append(mix(gram[keep]))
        key = (np.concatenate(rows).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(found) >> np.uint64(64 - BITS))
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        counts = np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=last - first)
        yield first, last, (key & np.uint64((1 << BITS) - 1)).astype(np.uint32), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def telling(column: np.ndarray, rows: np.ndarray, grades: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood ratio of each feature against being graded at all, and how many times as frequent it is in graded rows."""
    total = np.maximum(np.array([(grades == 0).sum(), (grades > 0).sum()], np.float64), 1)[:, None]
    held = np.stack([np.bincount(column[(grades[rows] > 0) == side], minlength=width) for side in (False, True)])
    expected = held.sum(axis=0) * total / total.sum()
    ratio = 2 * np.where(held > 0, held * np.log(np.maximum(held, 1) / np.maximum(expected, 1e-12)), 0).sum(axis=0)
    return ratio, (held[1] / total[1]) / np.maximum((held[0] + 0.5) / total[0], 1e-12)


def fit_ordinal(buckets: np.ndarray, counts: np.ndarray, grades: np.ndarray, levels: int, rounds: int = ROUNDS, evidence: float = EVIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising cuts by gradient descent on the ordinal likelihood with a ridge penalty.

    Features have weights if their likelihood ratio reaches ``evidence`` and they are ``LIFT`` times as frequent in
    graded rows; the model is sparse and long texts do not add up weak evidence.  Grades weigh alike, however
    many rows they have.  A round that does not gain is taken back and the step halved.
    """
    used, column = np.unique(buckets, return_inverse=True)
    rows = np.repeat(np.arange(len(counts)), counts)
    ratio, lift = telling(column, rows, grades, len(used))
    many = (ratio >= evidence) & (lift >= LIFT)
    keep = many[column]
    column, rows = np.cumsum(many)[column[keep]] - 1, rows[keep]
    used, n = used[many], len(counts)
    present = np.bincount(grades, minlength=levels)
    weight = (n / np.maximum(present, 1) / (present > 0).sum())[grades]
    w, cuts = np.zeros(len(used)), np.linspace(0, 1, levels - 1)
    hard = np.array([-np.inf, *[0.0] * (levels - 1), np.inf])

    def loss(w, cuts):
        x = np.bincount(rows, w[column], minlength=n)
        hard[1:-1] = cuts
        above, below = _sigmoid(hard[grades + 1] - x), _sigmoid(hard[grades] - x)
        chance = np.maximum(above - below, 1e-12)
        return -(weight * np.log(chance)).sum() + RIDGE / 2 * (w**2).sum(), above * (1 - above) / chance, below * (1 - below) / chance

    size, (now, up, down) = 1.0, loss(w, cuts)
    curve = np.bincount(column, weight[rows], minlength=len(used)) / 4 + RIDGE
    for _ in range(rounds):
        gradient = np.bincount(column, (weight * (up - down))[rows], minlength=len(used)) + RIDGE * w
        turn = np.array([(weight * down)[grades == j + 1].sum() - (weight * up)[grades == j].sum() for j in range(levels - 1)])
        while size > 1e-6:
            tried = w - size * gradient / curve, np.maximum.accumulate(cuts - size * turn * 4 / weight.sum())
            then = loss(*tried)
            if then[0] <= now:
                (w, cuts), (now, up, down), size = tried, then, size * 1.5
                break
            size /= 2
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w
    return full, cuts


def spread_grades(buckets: np.ndarray, counts: np.ndarray, toxic: np.ndarray, levels: int) -> np.ndarray:
    """Grades of rows of which only toxic or not is known.

    A feature is marked if it is at least 20 times as frequent in toxic rows as in others (one
    row added to each side).  Toxic rows are cut into ``levels - 1`` grades of about equal size by how many
    marked features they hold.
    """
    rows = np.repeat(np.arange(len(counts)), counts)
    sides = [np.bincount(buckets[toxic[rows] == t], minlength=1 << BITS) for t in (False, True)]
    odds = (sides[1] + 1) / max(int(toxic.sum()), 1) / ((sides[0] + 1) / max(int((~toxic).sum()), 1))
    held = np.bincount(rows, (odds >= 20)[buckets], minlength=len(counts))
    if not toxic.any():
        return np.zeros(len(counts), np.int64)
    steps = np.quantile(held[toxic], np.arange(1, levels - 1) / (levels - 1))
    return np.where(toxic, 1 + np.searchsorted(steps, held, "left"), 0)


def _fit(levels: int, spread: bool):
    def run(table: pa.Table) -> pa.Table:
        parts = [x for _, _, *x in features(table.column("text"))]
        grades = table.column("grade").to_numpy().astype(np.int64)
        buckets, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if spread:
            grades = spread_grades(buckets, counts, grades > 0, levels)
        weights, cuts = fit_ordinal(buckets, counts, grades, levels)
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64()))})

    return run


def fit_severity(docs: DataFrame, graded: DataFrame, levels: int, *, per_grade: int = PER_GRADE, spread: bool = False, id: str = "doc_id", text: str = "text"):
    """Fit on ``graded(doc_id, grade)`` with grades 0 to ``levels - 1``; returns weights and cuts, or None without rows.

    With ``spread``, the grades are only 0 or 1 and the fit grades the latter itself (``spread_grades``).  At most ``levels * per_grade`` rows are gathered, and as many ids are broadcast.
    """
    chosen = None
    known = graded.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1))
    for grade in range(levels):
        part = known.where(F.col("grade") == grade).select("doc_id", "grade").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        chosen = part if chosen is None else chosen.union(part)
    chosen = materialize(chosen.select(F.col("doc_id").alias("wanted"), F.col("grade").cast("int").alias("grade")), "graded")
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sample = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("wanted")).select(F.lit(0).alias("all"), "text", "grade")
    row = sample.groupBy("all").applyInArrow(_fit(levels, spread), "weights binary, cuts array<double>").first()
    return row and (np.frombuffer(row["weights"], np.float32), np.array(row["cuts"]))


def _score(model, levels: int):
    def run(batches):
        weights, cuts = model.value
        for batch in batches:
            for first, last, buckets, counts in features(batch.column(1)):
                x = _row_sums(weights[buckets], counts)
                chances = _sigmoid(x[:, None] - cuts[None, :])
                flat = pa.ListArray.from_arrays(np.arange(0, chances.size + 1, levels - 1, dtype=np.int32), chances.ravel())
                arrays = [batch.column(0).slice(first, last - first), pa.array(chances.sum(axis=1)), pa.array((chances >= 0.5).sum(axis=1), pa.int32()), flat]
                names = ["doc_id", "severity", "grade", "chances", *batch.schema.names[2:]]
                yield pa.RecordBatch.from_arrays([*arrays, *[c.slice(first, last - first) for c in batch.columns[2:]]], names=names)

    return run


def severity(docs: DataFrame, graded: DataFrame, levels: int = 3, *, per_grade: int = PER_GRADE, spread: bool = False, id: str = "doc_id",
             text: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, severity, grade, chances``, and with ``digest`` the ``text_sha256`` (null text: empty).

    ``severity`` is the expected grade, ``chances`` the probabilities of each grade from 1 or more,
    ``grade`` the highest grade that is as likely as not.
    """
    model = fit_severity(docs, graded, levels, per_grade=per_grade, spread=spread, id=id, text=text)
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if digest:
        slim = slim.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    extra = slim.columns[2:]
    if model is None:
        none = F.array(*[F.lit(0.0)] * (levels - 1))
        return slim.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), none.alias("chances"), *extra)
    schema = ", ".join([SCORES, *[f"{c} string" for c in extra]])
    return slim.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), levels), schema)
