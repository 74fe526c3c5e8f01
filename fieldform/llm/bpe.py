"""Byte-pair encoding by an index of pair occurrences, and decoding.

The distinct words of some megabytes of text lie end to end as linked symbols.  An index maps each
mergeable pair, by its rank, to all places where it stands.  Active ranks are applied in ascending order:
all places of the pair merge at once (of overlapping ones every second, from the left), and only the pairs
that touch a merged place are looked up and filed under their ranks.  A merge makes a symbol that stands only
in pairs of later ranks (checked when the vocabulary is read), so no applied rank becomes active again and the
result is that of merging each word by itself, lowest rank and leftmost place first.

Texts never move and are encoded whole; each worker remembers the words that it has met.  Null and empty texts
have no ids; null document ids are kept; repeated rows are rows of their own; an empty table gives no rows; other
columns are ignored.  A very long text is split as a whole and needs memory in proportion to its length.
Strings of added tokens (such as ``<|endoftext|>``) stand for their ids wherever they occur.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldform.llm.bytesets import slices, text_buffers
from fieldform.llm.words import Split, WordEncoder, added_tokens, byte_level, character_runs, kind_table, read_spec

#: Bytes of text whose new words are merged together.
TOGETHER = 1 << 23

ENCODED = "doc_id long, ids array<int>"
_vocabularies: dict[str, Vocabulary] = {}
_encoders: dict[str, WordEncoder] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merges and token bytes of a byte-level file; any other kind of file is refused."""

    def __init__(self, path: str):
        spec = read_spec(path)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or not byte_level(spec) or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is no plain byte-level BPE file {odd}")
        vocab, letters = model["vocab"], byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = dict(zip(self.made.tolist(), range(len(pairs)), strict=True))
        if len(born) < len(pairs) or any(max(born.get(a, -1), born.get(b, -1)) >= r for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))):
            raise ValueError(f"{path} merges a symbol before it is made")
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)
        self.order = np.append(self.order, -1)
        self.added = added_tokens(spec)
        value = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [b""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            known = all(c in value for c in token)
            self.tokens[i] = bytes(value[c] for c in token) if known else token.encode()
        # The longest of the added strings that start at a place counts.
        parts = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.special = re.compile("|".join(parts)) if parts else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for those that never merge."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply the merges to words laid end to end; the ids that stay and the places where they stand."""
        n = len(symbols)
        end = n  # a place that holds no symbol, before and after each word
        symbol = np.append(symbols, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[np.append(starts[1:], n) - 1] = end
        before[starts] = end
        after[end] = before[end] = end
        merged = np.zeros(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(places: np.ndarray) -> None:
            rank = self.rank(symbol[places], symbol[after[places]])
            known = rank >= 0
            rank, places = rank[known], places[known]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            edges = [0, *cut.tolist(), len(rank)]
            for k, r in enumerate(rank[edges[:-1]].tolist()):
                if r in index:
                    index[r].append(places[edges[k] : edges[k + 1]])
                else:
                    index[r] = [places[edges[k] : edges[k + 1]]]
                    heapq.heappush(active, r)

        file(np.flatnonzero(after[:n] != end))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b and len(at) > 1:
                at = np.sort(at)
                fresh = np.append(True, at[1:] != after[at[:-1]])
                run = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone] = self.made[r], -1
            after[at], before[beyond] = beyond, at
            before[end] = end
            merged[at] = True
            ahead = before[at]
            ahead = ahead[(ahead != end) & ~merged[ahead]]
            merged[at] = False
            file(np.concatenate([ahead, at[beyond != end]]))
        left = np.flatnonzero(symbol[:n] >= 0)
        return symbol[left], left

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words and their number for each word."""
        raw = [w.encode() for w in words]
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(w) for w in raw])])
        ids, places = self.merge(self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)], starts[:-1])
        return ids, np.diff(np.searchsorted(places, starts))


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _pieces(texts: list[str], special: re.Pattern | None, added: dict[str, int]) -> tuple[str, np.ndarray, list[int], list[tuple[int, int]]]:
    """Texts without added tokens: joined, their edges, the row of each piece, and (pieces before, id) of each added token."""
    parts, rows, marks = [], [], []
    for row, text in enumerate(texts):
        at = 0
        for m in special.finditer(text) if special else ():
            parts.append(text[at : m.start()])
            rows.append(row)
            marks.append((len(parts), added[m.group()]))
            at = m.end()
        parts.append(text[at:] if at else text)
        rows.append(row)
    return "".join(parts), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in parts])]), rows, marks


def _encode(path: str, runs) -> Callable:
    def flush(encoder: WordEncoder, held: list) -> Iterator[pa.RecordBatch]:
        encoder.learn([split for split, *_ in held])
        for split, rows, marks, keys in held:
            ids, up_to, _ = encoder.gather(split)
            if marks:
                places = [int(up_to[k - 1]) for k, _ in marks]
                ids = np.insert(ids, places, [i for _, i in marks])
                up_to = up_to + np.searchsorted([k for k, _ in marks], np.arange(1, len(up_to) + 1), "left")
            last = np.flatnonzero(np.append(np.diff(rows) > 0, True))
            offsets = np.concatenate([np.zeros(1, np.int64), up_to[last]])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys, lists], names=["doc_id", "ids"])

    def encode(batches):
        vocab = vocabulary(path)
        if path not in _encoders:
            _encoders[path] = WordEncoder(kind_table(runs), vocab.encode_words)
        encoder, held, total = _encoders[path], [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            keys = batch.column(0).cast(pa.int64())
            for first, last in slices(offsets):
                texts = [bytes(data[offsets[r] : offsets[r + 1]]).decode() for r in range(first, last)]
                text, edges, rows, marks = _pieces(texts, vocab.special, vocab.added)
                held.append((Split(text, edges, encoder.kinds), np.array(rows), marks, keys.slice(first, last - first)))
                total += int(offsets[last] - offsets[first])
                if total >= TOGETHER:
                    yield from flush(encoder, held)
                    held, total = [], 0
        if held:
            yield from flush(encoder, held)

    return encode


def encode_documents(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` of every document; ``tokenizer`` is the path of a byte-level BPE file."""
    vocabulary(tokenizer)
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_encode(tokenizer, character_runs(tokenizer)), ENCODED)


def decode_ids(encoded: DataFrame, tokenizer: str, *, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Attach the text of an id list: the bytes of its tokens, where bytes that are no UTF-8 become U+FFFD.

    A null list stays null; null ids and ids outside the vocabulary stand for nothing.
    """

    def decode(batches):
        tokens = vocabulary(tokenizer).tokens
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            if flat.dtype.kind != "i" or (len(flat) and (flat.min() < 0 or flat.max() >= len(tokens))):
                flat = np.where((flat >= 0) & (flat < len(tokens)), flat, len(tokens))
                tokens = [*tokens, b""]
            valid = lists.is_valid().to_pylist()
            texts = []
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                texts.append(b"".join([tokens[i] for i in flat[a:b].astype(np.int64).tolist()]).decode("utf-8", "replace") if valid[row] else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    vocabulary(tokenizer)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(decode, f"{out}, `{name}` string")
