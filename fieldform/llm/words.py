"""Words of a byte-level tokenizer: where its pattern starts them, and their ids, each distinct word encoded once.

The pattern's letters, numbers and white space are asked of the tokenizer itself, so they are those of the
Unicode version that it was built with.  ``byte_level`` says whether a tokenizer file is of the kind that this
module can split; any other must encode whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np

from fieldform.llm.bytesets import POWER, mix

KNOWN_WORDS = 1 << 21
POINTS, BLOCK = 0x110000, 256

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
# A character of each kind, and one of another kind to stand between two questions.
_PROBES = ((_LETTER, "a", "!"), (_NUMBER, "1", "!"), (_OTHER, "!", "a"))
_runs: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def load(path: str):
    """The tokenizer of a file, for whole texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def byte_level(spec: dict) -> bool:
    """Whether a tokenizer file splits by the byte-level pattern and by nothing else."""
    split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    own = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    return own and plain and spec.get("normalizer") is None


def added_tokens(spec: dict) -> dict[str, int]:
    """Strings that stand for an id wherever a text holds them."""
    return {t["content"]: t["id"] for t in spec.get("added_tokens") or [] if t["content"]}


def character_runs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point as runs (first code points, kinds), from how the tokenizer splits probes."""
    if path in _runs:
        return _runs[path]
    split = load(path).pre_tokenizer.pre_tokenize_str
    table = np.full(POINTS, _SPACE, np.uint8)
    for first in range(0, POINTS, BLOCK):
        if 0xD800 <= first < 0xE000:
            table[first : first + BLOCK] = _OTHER
            continue
        chars = [chr(c) for c in range(first, first + BLOCK)]
        whole = next((kind for kind, mark, _ in _PROBES if len(split(mark + "".join(chars))) == 1), None)
        if whole is not None:
            table[first : first + BLOCK] = whole
            continue
        for kind, mark, between in _PROBES:
            starts = {a for _, (a, _) in split("".join(mark + c + between for c in chars))}
            joined = [k for k in range(BLOCK) if 3 * k + 1 not in starts]
            table[first + np.array(joined, np.int64)] = kind
    at = np.flatnonzero(np.append(True, table[1:] != table[:-1]))
    _runs[path] = at.astype(np.int32), table[at]
    return _runs[path]


def kind_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at, kinds = runs
    return np.repeat(kinds, np.diff(np.append(at, POINTS)))


def word_starts(points: np.ndarray, edges: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the tokenizer's word pattern starts a word, for all texts laid end to end.

    ``points`` are code points, ``edges`` the starts of the texts and the total length, ``kinds`` the kind of
    each code point.
    """
    n = len(points)
    kind = kinds[points]
    space = kind == _SPACE
    first = np.zeros(n + 1, bool)
    first[edges] = True
    same = np.zeros(n, bool)  # the character before is of the same text
    same[1:] = True
    same &= ~first[:n]
    before_kind, before_blank = np.zeros(n, np.uint8), np.zeros(n, bool)
    before_kind[1:], before_blank[1:] = kind[:-1], points[:-1] == 32
    after_word = np.zeros(n, bool)  # the next character is of the same text and no white space
    after_word[:-1] = ~space[1:] & same[1:]
    begin = np.where(space, ~same | (before_kind != _SPACE) | after_word, ~same | ((before_kind != kind) & ~before_blank))
    # 's 't 'm 'd 're 've 'll are words of their own where a word starts with the apostrophe.
    marks = np.flatnonzero(begin & (points == 39))
    if len(marks):
        ahead = np.zeros((len(marks), 3), np.int64)
        for k in (1, 2, 3):
            at = np.minimum(marks + k, n - 1)
            inside = marks + k < n
            ahead[:, k - 1] = np.where(inside & same[at], points[at], 0)
        ahead[:, 1] *= ahead[:, 0] > 0
        one = np.isin(ahead[:, 0], [ord(c) for c in "stmd"])
        two = np.zeros(len(marks), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (ahead[:, 0] == ord(a)) & (ahead[:, 1] == ord(b))
        size = np.where(one, 1, np.where(two, 2, 0))
        for mark, length in zip(marks[size > 0].tolist(), size[size > 0].tolist(), strict=True):
            begin[mark + 1 : mark + 1 + length] = False
            after = mark + 1 + length
            if after < n and same[after] and not space[after]:
                begin[after] = True
    return np.flatnonzero(begin)


class Split:
    """The words of some texts: distinct ones by hash, which of them each word is, and words up to each text's end."""

    def __init__(self, text: str, edges: np.ndarray, kinds: np.ndarray):
        self.text = text
        if not text:
            self.distinct, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.back, self.up_to = np.zeros(0, np.int32), np.zeros(len(edges) - 1, np.int64)
            return
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        start = word_starts(points, edges, kinds)
        length = np.diff(np.append(start, len(points)))
        place = np.arange(len(points)) - np.repeat(start, length)
        value = (points.astype(np.uint64) + np.uint64(1)) * POWER[place % len(POWER)]
        if int(length.max()) > len(POWER):
            value *= POWER[place // len(POWER) + 1]
        hashes = mix(np.add.reduceat(value, start) + length.astype(np.uint64))
        self.distinct, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
        self.start, self.length, self.back = start[sample], length[sample], back.astype(np.int32)
        self.up_to = np.searchsorted(start, edges[1:], "left")

    def words(self, wanted: np.ndarray) -> list[str]:
        spots = zip(self.start[wanted].tolist(), self.length[wanted].tolist(), strict=True)
        return [self.text[a : a + n] for a, n in spots]


class WordEncoder:
    """Token ids of texts; ``encode_words`` turns distinct words into flat ids and their number per word.

    At most about ``KNOWN_WORDS`` words are remembered; then all are forgotten.
    """

    def __init__(self, kinds: np.ndarray, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.kinds, self.encode_words = kinds, encode_words
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.ids, self.ends_sentence = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool)

    def _unknown(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(distinct), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)] != distinct

    def learn(self, splits: list[Split]) -> None:
        """Encode the words of the texts that are not yet known, all at once."""
        if len(self.hashes) + sum(int(self._unknown(s.distinct).sum()) for s in splits) > KNOWN_WORDS:
            self._forget()
        hashes, words = [np.zeros(0, np.uint64)], []
        for s in splits:
            new = self._unknown(s.distinct)
            hashes.append(s.distinct[new])
            words += s.words(new)
        found, at = np.unique(np.concatenate(hashes), return_index=True)
        if not len(found):
            return
        words = [words[k] for k in at.tolist()]
        ids, sizes = self.encode_words(words)
        rows = np.arange(len(words)) + len(self.starts) - 1
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        ends = np.fromiter((w[-1] in ".!?…。！？" or "\n" in w for w in words), bool, len(words))
        self.ends_sentence = np.concatenate([self.ends_sentence, ends])
        at = np.searchsorted(self.hashes, found)
        self.hashes, self.rows = np.insert(self.hashes, at, found), np.insert(self.rows, at, rows)

    def gather(self, split: Split) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, the id count up to each text's end, and the sentence ends as id counts."""
        if not len(split.back):
            return np.zeros(0, np.uint32), np.zeros(len(split.up_to), np.int64), np.zeros(0, np.int64)
        row = self.rows[np.searchsorted(self.hashes, split.distinct)][split.back]
        sizes = self.starts[row + 1] - self.starts[row]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[row] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        return ids, np.concatenate([np.zeros(1, np.int64), ends])[split.up_to], ends[self.ends_sentence[row]]

    def encode(self, text: str, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``gather`` of texts joined, ``edges`` their starts in code points and the total."""
        split = Split(text, edges, self.kinds)
        self.learn([split])
        return self.gather(split)
