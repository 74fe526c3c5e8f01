"""Which features of a document occur anywhere else, and how often, without moving a row per feature.

Every task hashes the features of its documents in chunks of about ``CHUNK`` and sends each
sorted chunk as differences, cut by ranges of the hash; the task of a range merges what all
chunks send and answers with the owners of the features that more than one of them holds.  A
feature travels at most once per chunk however many documents hold it, and ranges are as many as
the corpus asks for, so neither a common feature nor a large corpus fills a task.

Keys keep enough leading bits of the hash that a chance agreement is rare at any corpus size.
One makes a feature look shared that is not; it never hides one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20
RANGE = 1 << 21
REPEATED = np.uint32(0xFFFFFFFF)

SENT = "chunk long, range int, keys binary, owners binary, about binary"
ANSWER = "chunk long, owners binary, about binary"


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal significance side by side, which the shuffle's codec packs well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def ranges_and_bits(docs: DataFrame, text: str, per_byte: float) -> tuple[int, int]:
    """Number of hash ranges and of key bits for about ``per_byte`` features a byte of text."""
    features = (docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0) * per_byte
    return max(1, min(1 << 20, round(features / RANGE))), int(min(60, max(40, np.ceil(np.log2(features + 2)) + 14)))


def _rows(columns: list[list], schema: str, table: bool = False) -> pa.RecordBatch | pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [c.split() for c in schema.split(", ")]
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)]
    return (pa.Table if table else pa.RecordBatch).from_arrays(arrays, names=[n for n, _ in named])


def _cuts(keys: np.ndarray, ranges: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """The ranges that sorted keys fall into: ``(range, first, last)``; none without keys."""
    if len(keys) == 0:
        return
    spot = ((keys >> np.uint64(bits - 20)) * np.uint64(ranges)) >> np.uint64(20)
    edges = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(keys)).tolist(), strict=True):
        yield int(spot[a]), a, b


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their first and the differences, in the narrower of two widths."""
    steps = np.diff(keys)
    narrow = int(steps.max(initial=0)) < 1 << 32
    return bytes([4 if narrow else 8]) + keys[:1].tobytes() + (planes(steps.astype(np.uint32)) if narrow else planes(steps))


def send(chunk: int, tokens: np.ndarray, owners: np.ndarray, about: bytes, ranges: int, bits: int) -> pa.RecordBatch:
    """Rows of one chunk: its keys by range, and the owners of those that it holds more than once."""
    keys = tokens >> np.uint64(64 - bits)
    order = np.argsort(keys)
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(keys))) > 1
    inside = owners[np.repeat(many, np.diff(np.append(at, len(keys))))] if len(at) else owners[:0]
    keys, owners = keys[at], np.where(many, REPEATED, owners[at]).astype(np.uint32)
    out = [[chunk], [int(chunk % ranges)], [None], [planes(inside.astype(np.uint32))], [about]]
    for spot, a, b in _cuts(keys, ranges, bits):
        for column, value in zip(out, (chunk, spot, _packed(keys[a:b]), planes(owners[a:b]), None), strict=True):
            column.append(value)
    return _rows(out, SENT)


def _keys(raw: bytes) -> np.ndarray:
    first, rest = np.frombuffer(raw[1:9], np.uint64), raw[9:]
    steps = unplanes(rest, np.uint32 if raw[0] == 4 else np.uint64).astype(np.uint64) if rest else np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([first, steps]))


def _merge(group: pa.Table) -> pa.Table:
    """Answers of one range: each chunk's owners of keys that another chunk holds, or that it holds more than once."""
    rows = group.select(["chunk", "keys", "owners", "about"]).to_pylist()
    sent = [r for r in rows if r["keys"] is not None]
    out = [(r["chunk"], r["owners"], r["about"]) for r in rows if r["keys"] is None]
    if sent:
        parts = [_keys(r["keys"]) for r in sent]
        owners = np.concatenate([unplanes(r["owners"], np.uint32) for r in sent])
        keys, edges = np.concatenate(parts), np.cumsum([len(p) for p in parts])[:-1]
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(keys)))
        common = np.zeros(len(keys), bool)
        common[order] = np.repeat((size > 1) | np.logical_or.reduceat(owners[order] == REPEATED, at), size)
        for r, own, hit in zip(sent, np.split(owners, edges), np.split(common, edges), strict=True):
            found = own[hit & (own != REPEATED)]
            if len(found):
                out.append((r["chunk"], planes(found), None))
    return _rows([list(c) for c in zip(*out, strict=True)] or [[], [], []], ANSWER, table=True)


def shared_owners(sent: DataFrame, finish: Callable[[bytes, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Merge the rows of ``send`` and hand each chunk's shared owners to ``finish(about, owners)``.

    An owner comes once for each of its features that is shared.
    """

    def per_chunk(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        about = next(r["about"] for r in rows if r["about"] is not None)
        return finish(about, np.concatenate([unplanes(r["owners"], np.uint32) for r in rows]))

    return sent.groupBy("range").applyInArrow(_merge, ANSWER).groupBy("chunk").applyInArrow(per_chunk, schema)


def chunk_ids() -> Iterator[int]:
    """Ids of a task's chunks; the same again if the task is repeated."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


# --- how often ------------------------------------------------------------------------

COUNT_SENT = "chunk long, range int, keys binary, owners binary, counts binary, about binary"
COUNT_ANSWER = "chunk long, owners binary, levels binary, about binary"


def send_counts(chunk: int, tokens: np.ndarray, about: bytes, ranges: int, bits: int) -> pa.RecordBatch:
    """As ``send``; the owner of a key is the first place of its token in the chunk, and its count goes along."""
    keys = tokens >> np.uint64(64 - bits)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(keys))).astype(np.uint32)
    keys, owners = keys[at], order[at].astype(np.uint32)
    out = [[chunk], [int(chunk % ranges)], [None], [None], [None], [about]]
    for spot, a, b in _cuts(keys, ranges, bits):
        for column, value in zip(out, (chunk, spot, _packed(keys[a:b]), planes(owners[a:b]), planes(counts[a:b]), None), strict=True):
            column.append(value)
    return _rows(out, COUNT_SENT)


def _merge_counts(group: pa.Table) -> pa.Table:
    """Answers of one range: the owners of keys that occur more than once, and the binary logarithm of their counts."""
    rows = group.select(["chunk", "keys", "owners", "counts", "about"]).to_pylist()
    sent = [r for r in rows if r["keys"] is not None]
    out = [(r["chunk"], None, None, r["about"]) for r in rows if r["keys"] is None]
    if sent:
        parts = [_keys(r["keys"]) for r in sent]
        keys, edges = np.concatenate(parts), np.cumsum([len(p) for p in parts])[:-1]
        counts = np.concatenate([unplanes(r["counts"], np.uint32) for r in sent]).astype(np.int64)
        owners = np.concatenate([unplanes(r["owners"], np.uint32) for r in sent])
        order = np.argsort(keys)
        at = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], at), np.diff(np.append(at, len(keys))))
        level = np.log2(total).astype(np.uint8)
        for r, own, lev, many in zip(sent, np.split(owners, edges), np.split(level, edges), np.split(total > 1, edges), strict=True):
            if many.any():
                out.append((r["chunk"], planes(own[many]), lev[many].tobytes(), None))
    return _rows([list(c) for c in zip(*out, strict=True)] or [[], [], [], []], COUNT_ANSWER, table=True)


def counted_tokens(sent: DataFrame, finish: Callable[[bytes, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Merge the rows of ``send_counts`` and hand each chunk ``finish(about, owners, levels)``.

    Owners are first places of the chunk's tokens that occur more than once anywhere; a level is the
    binary logarithm of the count.
    """

    def per_chunk(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        about = next(r["about"] for r in rows if r["about"] is not None)
        rows = [r for r in rows if r["owners"] is not None]
        owners = np.concatenate([np.zeros(0, np.uint32), *[unplanes(r["owners"], np.uint32) for r in rows]])
        return finish(about, owners, np.frombuffer(b"".join(r["levels"] for r in rows), np.uint8))

    return sent.groupBy("range").applyInArrow(_merge_counts, COUNT_ANSWER).groupBy("chunk").applyInArrow(per_chunk, schema)
