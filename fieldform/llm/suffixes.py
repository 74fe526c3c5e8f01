"""Repeated passages by a distributed sort of suffixes.

A byte goes if it lies in a ``LENGTH``-byte string that also starts earlier: in a document with a
smaller id, or earlier in the same one.  Only suffixes at anchors are sorted: of any ``LENGTH``
bytes, the ``GRAM``-byte gram with the smallest hash is an anchor, so equal strings have anchors
at equal places (about one byte in 35 is one).

1. Anchors whose gram occurs nowhere else are settled (``shared``); so are equal documents.
2. The other suffixes, with the bytes around them that decide, are range-partitioned by their
   leading ``GRAM`` bytes with splitters from a bounded sample of documents.
3. A bucket is sorted by multikey quicksort, eight bytes at a time, ties only.  Of equal
   neighbourhoods all but the first are repeats; the rest compare every string around the anchor.
4. A bucket that is too large for one task (one gram everywhere) is not gathered: its strings are
   compared across the pieces by the smallest start of each, combined before the shuffle.

Nulls: a null text is empty; a null id comes after all others.  Documents with one id are ordered by
a digest of their text; rows that repeat both are judged as one document.  Texts of any length are judged whole; an empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldform.llm.bytesets import BYTE_VALUE, mix, slices, text_buffers
from fieldform.llm.jaccard import _bit, document_map
from fieldform.llm.shared import SENT, chunk_ids, ranges_and_bits, send, shared_owners
from fieldform.scale import materialize

LENGTH, GRAM = 100, 32
#: Suffixes in a bucket on average, and the most that one task gathers.
BUCKET, GATHER = 1 << 15, 1 << 18
#: Bytes of text looked at together, anchors sent together, suffixes packed together.
SLICE, CHUNK, PACK = 1 << 18, 1 << 18, 1 << 16
SPLITTER_DOCUMENTS = 2000
LAST_ID = (1 << 63) - 1
_STEP = 0x9E3779B97F4A7C15

PROFILE = "doc_id long, tie long, mark string, n_bytes long, anchors binary, shared long"
CONTEXTS = "bucket int, n long, docs binary, at binary, room binary, around binary"
SPANS = "doc_id long, tie long, spans binary"


def _sliding(x: np.ndarray, width: int, op, fill) -> np.ndarray:
    """``op`` over each ``width`` elements from each place on, from running results inside blocks."""
    n = len(x)
    size = -(-(n + width) // width) * width
    block = np.full(size, fill, x.dtype)
    block[:n] = x
    block = np.ascontiguousarray(block.reshape(-1, width).T)
    ahead, back = block.copy(), block
    for k in range(1, width):
        op(ahead[k], ahead[k - 1], out=ahead[k])
    for k in range(width - 2, -1, -1):
        op(back[k], back[k + 1], out=back[k])
    ahead, back = ahead.T.ravel(), back.T.ravel()
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on (a power of two); the last places have none."""
    h, step, span = BYTE_VALUE[data], _STEP, 1
    while span < gram:
        h = h[:-span] * np.uint64(step) + h[span:]
        step, span = step * step % 2**64, span * 2
    return np.maximum(mix(h), np.uint64(1))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all texts laid end to end."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = length - gram + 1
    h = gram_hashes(data, gram)
    least = _sliding(h, width, np.minimum, np.uint64(2**64 - 1))
    # Strings that do not end inside their text choose nothing.
    inside = np.zeros(len(data) + 1, np.int32)
    size = np.diff(offsets)
    full = size >= length
    np.add.at(inside, offsets[:-1][full], 1)
    np.add.at(inside, offsets[1:][full] - length + 1, -1)
    least[np.cumsum(inside[:-1])[: len(h)] == 0] = 0
    chosen = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), least]), width, np.maximum, np.uint64(0))[: len(h)]
    at = np.flatnonzero(h == chosen)
    return at, h[at]


def _send_anchors(ranges: int, bits: int, length: int, gram: int):
    def run(batches):
        names, held, about, count = chunk_ids(), [], [], 0

        def flush():
            tokens, rows = np.concatenate([h for h, _ in held]), [n for _, n in held]
            table = pa.Table.from_batches(about).append_column("n", pa.array(np.concatenate(rows)))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return send(next(names), tokens, np.arange(len(tokens), dtype=np.uint32), sink.getvalue().to_pybytes(), ranges, bits)

        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for first, last in slices(offsets, SLICE):
                own = offsets[first : last + 1] - offsets[first]
                at, hashes = anchors(data[offsets[first] : offsets[last]], own, length, gram)
                held.append((hashes, np.diff(np.searchsorted(at, own))))
                lead = batch.slice(first, last - first).select([0, 1, 2])
                about.append(pa.RecordBatch.from_arrays([*lead.columns, pa.array(np.diff(own))], names=["doc_id", "tie", "mark", "n_bytes"]))
                count += len(at)
                if count >= CHUNK:
                    yield flush()
                    held, about, count = [], [], 0
        if held:
            yield flush()

    return run


def _profile(about: bytes, owners: np.ndarray) -> pa.Table:
    """Each document with the numbers of its shared anchors."""
    table = pa.ipc.open_stream(about).read_all()
    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(table.column("n").to_numpy())])
    owners = np.unique(owners).astype(np.int64)
    cut = np.searchsorted(owners, edges)
    lists = [(owners[a:b] - e).astype(np.uint32) for a, b, e in zip(cut, cut[1:], edges, strict=False)]
    return table.drop_columns(["n"]).append_column("anchors", pa.array([x.tobytes() for x in lists], pa.binary())).append_column(
        "shared", pa.array([len(x) for x in lists], pa.int64())
    )


def _around(data: np.ndarray, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """The bytes around each place, as a matrix; places outside the data are zero."""
    padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(after, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, before + after)[at]


def _first_of_equal(around: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each row the row of smallest ``order`` with the same bytes: multikey quicksort, eight bytes at a time.

    Rows still tied after a word are sorted by the next one; the others are done.
    """
    n, wide = around.shape
    words = np.zeros((n, -(-wide // 8) * 8), np.uint8)
    words[:, :wide] = around
    words = words.view(">u8")
    rows = np.argsort(order, kind="stable")
    group = np.zeros(n, np.int64)
    first = np.arange(n)
    for k in range(words.shape[1]):
        key = words[rows, k].astype(np.uint64)
        by = np.lexsort((key, group))
        rows, key, group = rows[by], key[by], group[by]
        new = np.ones(len(rows), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        rows, group = rows[tied], group[tied]
        if len(rows) == 0:
            return first
    # lexsort is stable, so the first row of a group is its first in order.
    new = np.ones(len(rows), bool)
    new[1:] = group[1:] != group[:-1]
    first[rows] = rows[new][np.cumsum(new) - 1]
    return first


def _strings(around: np.ndarray, length: int, reach: int):
    """For each distance before the anchor the hash of the string that starts there."""
    value, step = lambda k: BYTE_VALUE[around[:, k]], _STEP
    inverse, top = pow(step, -1, 2**64), pow(step, length - 1, 2**64)
    h = np.zeros(len(around), np.uint64)
    for k in range(reach, reach + length):
        h = h * np.uint64(step) + value(k)
    yield h
    for back in range(1, reach + 1):
        h = (h - value(reach + length - back)) * np.uint64(inverse) + value(reach - back) * np.uint64(top)
        yield h


def repeats(around: np.ndarray, room: np.ndarray, order: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance before each anchor at which a repeated string starts; least > greatest if none.

    ``room`` has the bytes of the document before and after each anchor, as far as they count.  Two
    strings around one anchor overlap, so those between them make one stretch.
    """
    n = len(around)
    low, high = np.full(n, reach + 1, np.int64), np.full(n, -1, np.int64)
    first = _first_of_equal(np.concatenate([around, room], axis=1), order)
    same = first != np.arange(n)
    low[same], high[same] = np.maximum(length - room[same, 1].astype(np.int64), 0), np.minimum(room[same, 0], reach)
    rest = np.flatnonzero(~same)
    rest = rest[np.argsort(order[rest], kind="stable")]
    bytes_, left, right = around[rest], room[rest, 0], room[rest, 1]
    for back, h in enumerate(_strings(bytes_, length, reach)):
        fit = np.flatnonzero((left >= back) & (right >= length - back))
        if len(fit) < 2:
            continue
        _, at, which = np.unique(h[fit], return_index=True, return_inverse=True)
        source = at[which]
        hit = np.flatnonzero(source != np.arange(len(fit)))
        if len(hit):
            a, b = fit[hit], fit[source[hit]]
            cut = slice(reach - back, reach - back + length)
            hit = a[(bytes_[a, cut] == bytes_[b, cut]).all(axis=1)]
            low[rest[hit]] = np.minimum(low[rest[hit]], back)
            high[rest[hit]] = np.maximum(high[rest[hit]], back)
    return low, high


#: The bucket of rows that hold stretches found inside a pack, and no suffixes.
SETTLED_HERE = -1


def _known_spans(batches):
    for batch in batches:
        for row in batch.select(["docs", "at"]).to_pylist():
            docs, ties = np.frombuffer(row["docs"], np.int64).reshape(2, -1)
            begin, end = np.frombuffer(row["at"], np.int64).reshape(2, -1)
            yield from _spans(docs, ties, begin, end).to_batches()


def _context_rows(splitters: np.ndarray, length: int, gram: int):
    reach = length - gram

    def rows(parts):
        docs, ties, at, room, around = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Of equal neighbourhoods in a pack only the first travels; the others repeat it wherever that one ends up.
        rank = np.empty(len(docs), np.int64)
        rank[np.lexsort((at, ties, docs))] = np.arange(len(docs))
        first = _first_of_equal(np.concatenate([around, room], axis=1), rank) == np.arange(len(docs))
        low, high = np.maximum(length - room[:, 1].astype(np.int64), 0), np.minimum(room[:, 0], reach).astype(np.int64)
        done = ~first & (low <= high)
        known = (docs[done], ties[done], (at - high)[done], (at - low + length)[done])
        docs, ties, at, room, around = (x[first] for x in (docs, ties, at, room, around))
        lead = np.ascontiguousarray(around[:, reach : reach + gram]).view(f"S{gram}").ravel()
        bucket = np.searchsorted(splitters, lead, "right") if len(splitters) else np.zeros(len(lead), np.int64)
        # Neighbours in a pack share their leading bytes and squeeze well together.
        order = np.lexsort((lead, bucket))
        edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0))
        out, packer = [[], [], [], [], [], []], zstandard.ZstdCompressor(level=1)
        if done.any():
            for column, value in zip(out, (SETTLED_HERE, 0, np.stack(known[:2]).tobytes(), np.stack(known[2:]).tobytes(), None, None), strict=True):
                column.append(value)
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            take = order[a:b]
            values = (
                int(bucket[take[0]]), len(take), np.stack([docs[take], ties[take]]).tobytes(), at[take].tobytes(),
                np.ascontiguousarray(room[take]).tobytes(), packer.compress(np.ascontiguousarray(around[take]).tobytes()),
            )
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in CONTEXTS.split(", ")])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            docs, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = text_buffers(batch.column(2))
            for first, last in slices(offsets, SLICE):
                own = offsets[first : last + 1] - offsets[first]
                piece = data[offsets[first] : offsets[last]]
                at, _ = anchors(piece, own, length, gram)
                starts = np.searchsorted(at, own)
                wanted = [np.frombuffer(batch.column(3)[first + k].as_py(), np.uint32).astype(np.int64) + starts[k] for k in range(last - first)]
                index = np.repeat(np.arange(last - first), [len(w) for w in wanted])
                at = at[np.concatenate(wanted)] if wanted else at[:0]
                if len(at) == 0:
                    continue
                begin, end = own[index], own[index + 1]
                room = np.stack([np.minimum(at - begin, reach), np.minimum(end - at, length)], axis=1).astype(np.uint8)
                around = _around(piece, at, reach, length)
                # Bytes of the neighbours are none of this document's.
                column = np.arange(reach + length)
                around = np.where((column >= reach - room[:, :1]) & (column < reach + room[:, 1:].astype(np.int64)), around, 0).astype(np.uint8)
                parts.append((docs[first + index], ties[first + index], at - begin, room, around))
                held += len(at)
                if held >= PACK:
                    yield rows(parts)
                    parts, held = [], 0
        if parts:
            yield rows(parts)

    return run


def _unpack(row: dict, length: int, reach: int):
    docs, ties = np.frombuffer(row["docs"], np.int64).reshape(2, -1)
    at = np.frombuffer(row["at"], np.int64)
    room = np.frombuffer(row["room"], np.uint8).reshape(-1, 2)
    around = zstandard.ZstdDecompressor().decompress(row["around"])
    return docs, ties, at, room, np.frombuffer(around, np.uint8).reshape(-1, reach + length)


def _spans(docs, ties, begin, end) -> pa.Table:
    """Rows of ``SPANS``: the stretches of each document."""
    order = np.lexsort((begin, ties, docs))
    docs, ties, pairs = docs[order], ties[order], np.stack([begin[order], end[order]], axis=1)
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (ties[1:] != ties[:-1])
    new = np.flatnonzero(new)
    # Anchors may meet without a repeated string among them, which leaves no document.
    raw = [pairs[a:b].astype(np.int64).tobytes() for a, b in zip(new, np.append(new, len(docs))[1:], strict=True)]
    return pa.table({"doc_id": pa.array(docs[new], pa.int64()), "tie": pa.array(ties[new], pa.int64()), "spans": pa.array(raw, pa.binary())})


def _resolve(length: int, reach: int):
    def run(group: pa.Table) -> pa.Table:
        parts = [_unpack(r, length, reach) for r in group.to_pylist()]
        docs, ties, at, room, around = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.empty(len(docs), np.int64)
        order[np.lexsort((at, ties, docs))] = np.arange(len(docs))
        low, high = repeats(around, room, order, length, reach)
        hit = low <= high
        return _spans(docs[hit], ties[hit], (at - high)[hit], (at - low + length)[hit])

    return run


STRINGS = "one long, two long, doc_id long, tie long, start long"


def _all_strings(length: int, reach: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                docs, ties, at, room, around = _unpack(row, length, reach)
                other = np.bitwise_xor(around, 0xA5)
                for back, (h, g) in enumerate(zip(_strings(around, length, reach), _strings(other, length, reach), strict=True)):
                    fit = (room[:, 0] >= back) & (room[:, 1] >= length - back)
                    if fit.any():
                        arrays = [h[fit].view(np.int64), g[fit].view(np.int64), docs[fit], ties[fit], (at - back)[fit]]
                        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["one", "two", "doc_id", "tie", "start"])

    return run


def _only(wanted):
    """Rows of documents that the map holds; a few others may pass."""

    def run(batches):
        for batch in batches:
            hit = np.flatnonzero(wanted.value[_bit(batch.column(0).to_numpy())])
            if len(hit):
                yield batch.take(pa.array(hit))

    return run


SETTLED = "key long, tie long, doc_id long, text string, n_bytes long, whole_sha256 string"


def _settle(wanted):
    """Size and digest of each text; the text itself goes on only for documents that the map holds."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            open_ = wanted.value[_bit(batch.column(0).to_numpy())]
            shas = [None if o else hashlib.sha256(data[a:b].tobytes()).hexdigest() for o, a, b in zip(open_.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            texts = pa.compute.if_else(pa.array(open_), batch.column(3), pa.scalar(None, pa.string()))
            arrays = [*batch.columns[:3], texts, pa.array(np.diff(offsets)), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SETTLED.split(", ")])

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            out = []
            names = ("whole", "lists", "n_bytes", "whole_sha256")
            for k, (whole, lists, size, sha) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if whole and size >= length:
                    out.append((size, size, 1, hashlib.sha256(b"").hexdigest(), [0, size]))
                    continue
                if sha is not None:
                    out.append((size, 0, 0, sha, []))
                    continue
                text = data[offsets[k] : offsets[k + 1]]
                gone = np.zeros(len(text) + 1, np.int32)
                for raw in lists or []:
                    begin, end = np.frombuffer(raw, np.int64).reshape(-1, 2).T
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, end, -1)
                gone = np.cumsum(gone[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).astype(np.int64)
                kept = text[~gone].tobytes()
                out.append((len(text), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.tolist()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def repeated_passages(
    docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, gather: int = GATHER, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed``.

    ``removed`` has the starts and ends of the removed stretches, in bytes, in turn.  ``gram`` is a
    power of two and at most ``length``, which is at most 255.
    """
    reach = length - gram
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    mark = F.md5(F.col("text").cast("binary"))
    key = F.coalesce("doc_id", F.lit(LAST_ID)).alias("key")
    slim = slim.select(key, F.conv(F.substring(mark, 1, 15), 16, 10).cast("long").alias("tie"), mark.alias("mark"), "text", "doc_id")
    # Four small ranges for each of the usual size: contexts need the memory later on.
    ranges, bits = ranges_and_bits(slim, "text", 0.12)
    spark = docs.sparkSession
    sent = slim.select("key", "tie", "mark", "text").mapInArrow(_send_anchors(ranges, bits, length, gram), SENT)
    profile = materialize(shared_owners(sent, _profile, PROFILE), "profile").withColumnRenamed("doc_id", "key")

    # Equal documents: all but those of the smallest id repeat it as a whole.
    firsts = profile.groupBy("mark").agg(F.min("key").alias("holder"), F.max("key").alias("most")).where("holder < most").select("mark", "holder")
    copies = materialize(profile.join(firsts, "mark").where("key > holder").select("key", "tie").distinct(), "copies")
    open_docs = profile.where("shared > 0").join(copies, ["key", "tie"], "left_anti").select("key", "tie", "anchors").dropDuplicates(["key", "tie"])
    open_docs = materialize(open_docs, "open")

    total = profile.agg(F.sum("shared")).first()[0] or 0
    buckets = max(1, round(total / BUCKET))
    sample = slim.where(F.length("text") >= length).select("text", F.xxhash64("key", "tie").alias("draw")).orderBy("draw").limit(SPLITTER_DOCUMENTS)
    leads = []
    for row in sample.select("text").toLocalIterator() if buckets > 1 else []:
        data = np.frombuffer(row[0].encode(), np.uint8)
        at, _ = anchors(data, np.array([0, len(data)], np.int64), length, gram)
        leads.append(np.ascontiguousarray(_around(data, at, 0, gram)).view(f"S{gram}").ravel())
    leads = np.sort(np.concatenate(leads)) if leads else np.zeros(0, f"S{gram}")
    splitters = np.unique(leads[np.linspace(0, len(leads), buckets, endpoint=False).astype(int)[1:]]) if len(leads) else leads

    # Documents without open anchors stay where they are: a bit map of fixed size lets the others through.
    wanted = spark.sparkContext.broadcast(document_map(open_docs.select("key")))
    texts = slim.select("key", "tie", "text").mapInArrow(_only(wanted), "key long, tie long, text string").join(open_docs, ["key", "tie"]).select("key", "tie", "text", "anchors")
    contexts = materialize(texts.mapInArrow(_context_rows(splitters, length, gram), CONTEXTS), "contexts")
    settled_here = contexts.where(F.col("bucket") == SETTLED_HERE).mapInArrow(_known_spans, SPANS)
    contexts = contexts.where(F.col("bucket") != SETTLED_HERE)
    sizes = contexts.groupBy("bucket").agg(F.sum("n").alias("size"))
    contexts = contexts.join(sizes.where(F.col("size") > gather).select(F.col("bucket").alias("bucket"), F.lit(True).alias("large")), "bucket", "left")
    names = [c.split()[0] for c in CONTEXTS.split(", ")]
    found = contexts.where("large is null").select(*names).groupBy("bucket").applyInArrow(_resolve(length, reach), SPANS)

    strings = contexts.where("large").select(*names).mapInArrow(_all_strings(length, reach), STRINGS)
    start = F.struct("doc_id", "tie", "start")
    earliest = strings.groupBy("one", "two").agg(F.min(start).alias("first"), F.count("*").alias("n")).where("n > 1").select("one", "two", "first")
    late = strings.join(earliest, ["one", "two"]).where(start > F.col("first")).select("doc_id", "tie", "start").distinct()
    pair = lambda table: _spans(*(table.column(c).to_numpy() for c in ("doc_id", "tie", "start")), table.column("start").to_numpy() + length)
    found = found.union(late.groupBy("doc_id", "tie").applyInArrow(pair, SPANS)).union(settled_here)

    lists = materialize(found.groupBy(F.col("doc_id").alias("key"), "tie").agg(F.collect_list("spans").alias("lists")), "spans")
    cut = spark.sparkContext.broadcast(document_map(lists.select("key")))
    marks = lists.join(copies.withColumn("whole", F.lit(True)), ["key", "tie"], "full")
    settled = slim.select("key", "tie", "doc_id", "text").mapInArrow(_settle(cut), SETTLED)
    out = settled.join(marks, ["key", "tie"], "left").select("doc_id", "text", "n_bytes", "whole_sha256", "whole", "lists")
    return out.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>")
