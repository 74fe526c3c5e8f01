"""Order-preserving packing of documents into token sequences.

The documents of a stretch of the input form one token stream, in the order of the table; a
sequence is a window of it.  Cuts may fall at document ends, at sentence ends, or at spaced points
inside sentences, with rising penalties.  Dynamic programming chooses the cuts that minimise padding
plus penalties; the best predecessor inside a window is the head of a monotone queue, so the
work is linear in the number of possible cuts.  The last window of a stretch is cut at powers
of two where that costs less than padding it.

Texts never move: each task packs what it has read, stretch by stretch, in bounded memory.
Nulls: a null text is empty and has only the closing id.  A null document id is kept, repeated
rows are documents of their own, an empty table gives no pieces, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldform.llm.bytesets import slices, text_buffers
from fieldform.llm.words import WordEncoder, added_tokens, byte_level, character_runs, kind_table, load, read_spec

WINDOW = 2048
# Tokens of padding that a cut is worth: at a document's end, at a sentence's end, inside a sentence.
AT_DOCUMENT, AT_SENTENCE, INSIDE = 0, 4, 40
SPACED = 128
STRETCH = 1 << 21

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, tuple] = {}


def word_encoder(path: str, runs) -> tuple:
    """The tokenizer of a file, its added strings, and an encoder that gives it each distinct word once.

    ``runs`` are the tokenizer's kinds of characters, or None if it does not split by the byte-level pattern:
    then there is no such encoder, and whole texts are encoded.
    """
    if path not in _encoders:
        tokenizer = load(path)

        def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes

        added = [*added_tokens(read_spec(path))]
        _encoders[path] = tokenizer, added, WordEncoder(kind_table(runs), encode_words) if runs else None
    return _encoders[path]


def choose_cuts(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indexes of the cuts that minimise padding plus penalties; the first and last place are always cuts.

    No two neighbouring places are more than ``window`` apart.
    """
    at, cost = places.tolist(), penalties.tolist()
    n = len(at)
    best, back = [0] * n, [0] * n
    queue, value, head = [0], [at[0]], 0
    for j in range(1, n):
        here = at[j]
        least = here - window
        while at[queue[head]] < least:
            head += 1
        total = value[head] + window - here + cost[j]
        best[j], back[j] = total, queue[head]
        total += here
        while len(queue) > head and value[-1] >= total:
            queue.pop()
            value.pop()
        queue.append(j)
        value.append(total)
        if head > 4096:
            del queue[:head], value[:head]
            head = 0
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return np.array(cuts[::-1])


def window_ends(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ends of the sequences of one stream, given where its documents and sentences end."""
    total = int(doc_ends[-1])
    places = np.unique(np.concatenate([np.zeros(1, np.int64), doc_ends, sentence_ends]))
    step = min(SPACED, window)
    gaps = (np.diff(places) - 1) // step
    wide = np.flatnonzero(gaps > 0)
    if len(wide):
        extra = np.repeat(places[wide], gaps[wide]) + step * (np.arange(int(gaps[wide].sum())) - np.repeat(np.cumsum(gaps[wide]) - gaps[wide], gaps[wide]) + 1)
        inside = np.concatenate([np.zeros(len(places), bool), np.ones(len(extra), bool)])
        places = np.concatenate([places, extra])
        order = np.argsort(places, kind="stable")
        places, inside = places[order], inside[order]
    else:
        inside = np.zeros(len(places), bool)
    penalties = np.where(inside, INSIDE, np.where(np.isin(places, doc_ends), AT_DOCUMENT, AT_SENTENCE))
    ends = places[choose_cuts(places, penalties, window)][1:].tolist()
    begin = ends[-2] if len(ends) > 1 else 0
    rest = total - begin
    if INSIDE * (rest.bit_count() - 1) < window - rest:
        ends.pop()
        for power in range(rest.bit_length() - 1, -1, -1):
            if rest >> power & 1:
                begin += 1 << power
                ends.append(begin)
    return np.array(ends, np.int64)


def _pack(path: str, window: int, closing: int, runs):
    def stretch(ids, doc_ids, doc_ends, sentence_ends, first_sequence):
        ends = window_ends(doc_ends, sentence_ends, window)
        stops = np.union1d(ends, doc_ends)
        starts = np.concatenate([np.zeros(1, np.int64), stops[:-1]])
        doc, sequence = np.searchsorted(doc_ends, starts, "right"), np.searchsorted(ends, starts, "right")
        doc_starts = np.concatenate([np.zeros(1, np.int64), doc_ends[:-1]])
        seq_starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        raw = memoryview(ids.astype("<u4").tobytes())
        pieces = [bytes(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids).take(pa.array(doc)), pa.array(starts - doc_starts[doc]), pa.array(stops - starts), pa.array(pieces, pa.binary()),
                pa.array((doc_ends - doc_starts)[doc]), pa.array(sequence + first_sequence), pa.array(starts - seq_starts[sequence]),
            ],
            names=[c.split()[0] for c in PIECES.split(", ")],
        )
        return batch, len(ends)

    def pack(batches):
        tokenizer, added, encoder = word_encoder(path, runs)
        sequence = TaskContext.get().partitionId() << 40
        ids, keys, ends, breaks, total = [], [], [], [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            doc_ids = batch.column(0).cast(pa.int64())
            for first, last in slices(offsets):
                texts = [bytes(data[offsets[r] : offsets[r + 1]]).decode() for r in range(first, last)]
                whole = "".join(texts)
                if encoder is None or any(t in whole for t in added):
                    got = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                    up_to = np.cumsum([len(g) for g in got])
                    flat, marks = np.array([i for g in got for i in g], np.uint32), np.zeros(0, np.int64)
                else:
                    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in texts])])
                    flat, up_to, marks = encoder.encode(whole, edges)
                rows = np.arange(1, last - first + 1)
                # The closing id follows each text.
                ids.append(np.insert(flat, up_to, np.uint32(closing)))
                breaks.append(total + marks + np.searchsorted(up_to, marks, "left"))
                ends.append(total + up_to + rows)
                keys += doc_ids.slice(first, last - first).to_pylist()
                total = int(ends[-1][-1])
                if total >= STRETCH:
                    out, used = stretch(np.concatenate(ids), pa.array(keys, pa.int64()), np.concatenate(ends), np.concatenate(breaks), sequence)
                    sequence += used
                    ids, keys, ends, breaks, total = [], [], [], [], 0
                    yield out
        if total:
            yield stretch(np.concatenate(ids), pa.array(keys, pa.int64()), np.concatenate(ends), np.concatenate(breaks), sequence)[0]

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, closing: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of the packed sequences: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizer file; one that does not split by the byte-level pattern encodes whole
    texts and has no cuts at sentence ends.  ``ids`` are little-endian unsigned 32-bit token ids.  ``start`` counts the document's ids before the piece,
    ``offset`` the ids before it in its sequence, ``doc_tokens`` all ids of the document with the closing one.
    """
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    runs = character_runs(tokenizer) if byte_level(read_spec(tokenizer)) else None
    return slim.mapInArrow(_pack(tokenizer, window, closing, runs), PIECES)
