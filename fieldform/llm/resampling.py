"""Importance resampling towards a target distribution of hashed n-grams.

Each document is normalised once (lower case, words joined by one space) and scanned once, keeping the running
CRC-32 at the end of each word.  A CRC is linear over GF(2): with the CRC of a prefix moved on by the length of what
follows, ``crc(AB) = move(crc(A), |B|) xor crc(B)``.  So the CRC of any run of words is that of the prefix up to its end,
xor that of the prefix up to its start moved on by the run's length.  No n-gram is ever built.

Buckets of all documents and of the target are counted in every task and summed; the number of buckets is a parameter,
so counts and gains are bounded whatever the corpus.  A document's weight is the floored mean of its features' gains, the
draw adds Gumbel noise from a digest of its id, and the best scores are ranked over range-sorted tasks.

Null and empty texts, and texts without words, have no features and weight 0.  A null id is drawn as an empty one; it and ids
that repeat are rows of their own, equal ones in any order.  Without any target, gains favour buckets that the documents
lack.  An empty table gives no rows; other columns are ignored.  Very long texts are scanned whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldform.llm.bytesets import slices, text_buffers
from fieldform.scale import materialize, rank_rows

BUCKETS, WORDS = 10_000, 2
POLYNOMIAL = 0xEDB88320  # of CRC-32, lowest power first
SHORT = 256

# A-Z become a-z, other letters of words stay, everything else separates.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb" [^ ]+")


def _one_byte(crc: np.ndarray) -> np.ndarray:
    """CRCs moved on by one zero byte."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (crc & np.uint32(1)))
    return crc


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of CRCs, given as its answers to each value of each of the four bytes."""
    out = table[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _bytes_of_map(images: np.ndarray) -> np.ndarray:
    """The table of a linear map from the images of the 32 single bits."""
    table = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        k, b = divmod(bit, 8)
        table[k, 1 << b : 2 << b] = table[k, : 1 << b] ^ images[bit]
    return table


@cache
def _moves() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps that move a CRC on by 0 to ``SHORT - 1`` bytes, and by ``SHORT`` times each power of two."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    short, images = [], bits
    for _ in range(SHORT):
        short.append(_bytes_of_map(images))
        images = _one_byte(images)
    long = [_bytes_of_map(images)]
    while len(long) < 32:
        images = _apply(long[-1], images)
        long.append(_bytes_of_map(images))
    return np.stack(short), long


def move(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved on by ``length`` bytes each."""
    short, long = _moves()
    low = length % SHORT
    out = short[low, 0, crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ short[low, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    high = length // SHORT
    for power in range(int(high.max(initial=0)).bit_length()):
        with_it = np.flatnonzero(high >> power & 1)
        out[with_it] = _apply(long[power], out[with_it])
    return out


def scan(text: bytes) -> tuple[list[int], list[int]]:
    """Running CRCs at the end of each word of a text's normalised form (a space before each word), and word lengths."""
    crc, ends, lengths = 0, [], []
    for word in _WORD.findall(b" " + b" ".join(text.translate(_NORMAL).split())):
        crc = zlib.crc32(word, crc)
        ends.append(crc)
        lengths.append(len(word) - 1)
    return ends, lengths


def runs_of_words(texts: list[bytes], words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size from 1 to ``words``: the CRC of each run of so many words of a text, and the text's row."""
    ends, lengths, counts = [], [], []
    for text in texts:
        e, n = scan(text)
        ends += e
        lengths += n
        counts.append(len(e))
    end, length = np.array(ends, np.uint32), np.array(lengths, np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    # The prefix up to a word's start: that up to the end of the word before, and the space between.
    first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    before = np.where(first, np.uint32(0), np.roll(end, 1)) if len(row) else end
    start = move(before, np.ones(len(row), np.int64)) ^ np.uint32(zlib.crc32(b" "))
    whole = length.copy()
    for size in range(1, words + 1):
        n = len(row) - size + 1
        if n <= 0:
            return
        if size > 1:
            whole = whole[:n] + 1 + length[size - 1 :]
        inside = np.flatnonzero(row[:n] == row[size - 1 :])
        yield end[inside + size - 1] ^ move(start[inside], whole[inside]), row[inside]


def _texts(batch) -> Iterator[tuple[int, int, list[bytes]]]:
    data, offsets = text_buffers(batch.column(batch.num_columns - 1))
    for first, last in slices(offsets):
        yield first, last, [bytes(data[offsets[r] : offsets[r + 1]]) for r in range(first, last)]


def _count(words: int, buckets: int) -> Callable:
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, texts in _texts(batch):
                for crc, _ in runs_of_words(texts, words):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return count


def bucket_counts(docs: DataFrame, *, words: int = WORDS, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """``bucket, n``: how often all texts hold features of each bucket (those that occur)."""
    slim = docs.select(F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_count(words, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of both counts, each with one added to every bucket; one whole number a bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, df in ((s, source), (t, target)):
        for r in df.collect():  # at most one row for each of the buckets
            counts[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(gains: np.ndarray, words: int) -> Callable:
    def weigh(batches):
        for batch in batches:
            sums, features = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            size = np.zeros(batch.num_rows, np.int64)
            for first, last, texts in _texts(batch):
                for k, (crc, row) in enumerate(runs_of_words(texts, words)):
                    n = np.bincount(row, minlength=last - first)
                    features[first:last] += n
                    if k == 0:
                        size[first:last] = n
                    gain = np.concatenate([np.zeros(1, np.int64), np.cumsum(gains[crc % np.uint32(len(gains))])])
                    to = np.cumsum(n)
                    sums[first:last] += gain[to] - gain[to - n]
            weight = sums // np.maximum(features, 1)
            columns = [batch.column(0), *map(pa.array, (size, features, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def document_weights(docs: DataFrame, gains: np.ndarray, *, words: int = WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document."""
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_weigh(gains, words), "doc_id long, n_words long, n_features long, weight long")


def gumbel(id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, floored, from a digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 25, at_least: int = 20, seed: int = 7, words: int = WORDS, buckets: int = BUCKETS,
    id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` only of those drawn.

    Of the documents with ``at_least`` words, ``percent`` in a hundred (rounded down) with the highest scores are drawn.
    """
    gains = bucket_gains(
        bucket_counts(docs, words=words, buckets=buckets, text=text), bucket_counts(target, words=words, buckets=buckets, text=target_text), buckets
    )
    scored = document_weights(docs, gains, words=words, id=id, text=text)
    scored = materialize(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    fit = scored.where(F.col("n_words") >= at_least)
    drawn = fit.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranked = rank_rows(fit, [], order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < at_least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)
