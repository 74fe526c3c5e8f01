"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so, so equal stretches are cut
alike.  Chunks are deduplicated to identifiers: a 64-bit hash and length, told apart by a
256-bit digest where those two agree.  Texts are then compared as ordered lists of identifiers;
the texts themselves are read once and never move between tasks.

Nulls: a null text is empty; empty texts equal each other.  A null id is smaller than any other.
Rows that repeat an id and a text count each, and one of them is kept.  Texts of any length are compared
whole, as longer recipes; an empty table gives no rows.  Columns besides id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldform.llm.bytesets import BYTE_VALUE, LOWER, slices, text_buffers
from fieldform.scale import materialize

LEAST, MASK, MOST = 1024, 2047, 16384
_STEP = 0x9E3779B97F4A7C15

RECIPES = "doc_id long, text_sha256 string, keys array<long>, lengths array<int>, digests array<binary>"


def _cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which content asks for a cut; each depends on the 32 bytes up to it."""
    h, step, span = BYTE_VALUE[data], _STEP, 1
    while span < 32:
        h[span:] += h[:-span] * np.uint64(step)
        step, span = step * step % 2**64, span * 2
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def chunk_ends(size: int, cuts: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, given its cut points; each but the last has ``LEAST`` to ``MOST`` bytes."""
    ends, at, k = [], 0, 0
    while size - at > LEAST:
        k = int(np.searchsorted(cuts, at + LEAST))
        end = min(int(cuts[k]) if k < len(cuts) else size, at + MOST, size)
        ends.append(end)
        at = end
    if at < size:
        ends.append(size)
    return ends


def _recipes(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for first, last in slices(offsets):
            low = LOWER[data[offsets[first] : offsets[last]]]
            cuts, raw, base = _cut_points(low), low.tobytes(), int(offsets[first])
            shas, keys, lengths, digests = [], [], [], []
            for row in range(first, last):
                a, b = int(offsets[row]) - base, int(offsets[row + 1]) - base
                shas.append(hashlib.sha256(memoryview(raw)[a:b]).hexdigest())
                k, s, d, at = [], [], [], a
                own = cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, b)] - a if b - a > LEAST else cuts[:0]
                for end in chunk_ends(b - a, own):
                    piece = raw[at : a + end]
                    k.append(xxhash.xxh3_64_intdigest(piece) - (1 << 63))
                    s.append(len(piece))
                    d.append(hashlib.blake2b(piece, digest_size=32).digest())
                    at = a + end
                keys.append(k)
                lengths.append(s)
                digests.append(d)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first).cast(pa.int64()), pa.array(shas, pa.string()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32())),
                    pa.array(digests, pa.list_(pa.binary())),
                ],
                names=["doc_id", "text_sha256", "keys", "lengths", "digests"],
            )


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are identical after lower-casing A-Z; the largest id of equal texts
    stays.  ``text_sha256`` is that of the lower-cased text.
    """
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    recipes = materialize(slim.mapInArrow(_recipes, RECIPES).withColumn("row", F.monotonically_increasing_id()), "recipes")
    parts = recipes.select("row", F.posexplode(F.arrays_zip("keys", "lengths", "digests")).alias("place", "chunk")).select(
        "row", "place", F.col("chunk.keys").alias("key"), F.col("chunk.lengths").alias("length"), F.col("chunk.digests").alias("digest")
    )
    # Distinct digests of one key and length are a hash collision: practically always one.
    alike = Window.partitionBy("key", "length").orderBy("digest")
    known = parts.select("key", "length", "digest").distinct().withColumn("variant", F.row_number().over(alike))
    listed = (
        parts.join(known, ["key", "length", "digest"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("place", "key", "length", "variant"))).alias("list"))
        .select("row", F.transform("list", lambda c: F.struct(c["key"], c["length"], c["variant"])).alias("recipe"))
    )
    empty = F.array().cast("array<struct<key:bigint,length:int,variant:int>>")
    rows = recipes.select("row", "doc_id", "text_sha256").join(listed, "row", "left").withColumn("recipe", F.coalesce("recipe", empty))
    rows = materialize(rows, "recipes")
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count("*").alias("group_size"))
    # Written, so that both sides of the join are plain shuffles and a large group can be split.
    groups = materialize(groups, "groups")
    return rows.join(groups, "recipe").select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256"
    )
