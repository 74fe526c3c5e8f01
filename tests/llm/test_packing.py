"""Packing: the ids are the tokenizer's, every id is in one piece, and cuts are optimal."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from fieldform.llm.packing import AT_DOCUMENT, AT_SENTENCE, INSIDE, choose_cuts, pack_documents, window_ends, word_encoder
from fieldform.llm.queries import tokenizer_path
from fieldform.llm.words import byte_level, character_runs, kind_table, read_spec, word_starts
from tests.llm.helpers import awkward_texts, prose, with_extras

tokenizers = pytest.importorskip("tokenizers")
SPECIAL = "<|endoftext|>"
TRICKY = [
    "don't we'll I'm 'sx ''s  'tis  it's\n\n  x  y \n", "", " a", "a ", " \u3000 x  \t\n z", "1a2 b3.4  !!?? …  they'd've 'll 're", "x\r\n\r\ny   ", "漢字かな 12٣４ ² ½ é é 👍🏽",
    "'", "''", " '", " 's", " 'restless x'rex 'veve", "a" * 70_000 + " b", "'r", "x'", "'l l", "\x85\xa0\u2003y",
]


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_words_are_those_of_the_tokenizer(tokenizer):
    draw = random.Random(5)
    signs = "ab 's\n\t.'lrevd1é 漢\u3000—"
    texts = TRICKY + ["".join(draw.choice(signs) for _ in range(draw.randint(1, 30))) for _ in range(3000)]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ids, up_to, _ = word_encoder(tokenizer_path(), character_runs(tokenizer_path()))[2].encode("".join(texts), edges)
    got = [x.tolist() for x in np.split(ids, up_to[:-1])]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_of_every_code_point(tokenizer):
    kinds, split = kind_table(character_runs(tokenizer_path())), tokenizer.pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50_000):
        text = "".join(f"a{c}1{c}{c} {c}'s{c}.{c}\n" for c in map(chr, points[k : k + 50_000]))
        got = word_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)]), kinds)
        assert got.tolist() == [a for _, (a, _) in split(text)]


def test_other_tokenizers_encode_whole_texts(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert not byte_level(read_spec(path)) and byte_level(read_spec(tokenizer_path()))
    rows = [(k, prose(k, 40 * k)) for k in range(6)]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path).orderBy("doc_id", "start").collect()
    other = tokenizers.Tokenizer.from_file(path)
    for i, text in rows:
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in out if r.doc_id == i), "<u4").tolist()
        assert ids == [*other.encode(text, add_special_tokens=False).ids, 1]


def test_cuts_are_the_cheapest():
    draw = random.Random(1)
    for _ in range(200):
        places = np.array([0, *np.cumsum([draw.randint(1, 8) for _ in range(draw.randint(1, 9))])])
        penalties = np.array([0, *[draw.choice([0, 4, 40]) for _ in places[1:]]])

        def price(cuts, places=places, penalties=penalties):
            gaps = np.diff(places[list(cuts)])
            return np.inf if (gaps > 12).any() else sum(12 - gaps) + penalties[list(cuts[1:])].sum()

        inner = range(1, len(places) - 1)
        best = min(price((0, *c, len(places) - 1)) for k in range(len(places)) for c in itertools.combinations(inner, k))
        assert price(tuple(choose_cuts(places, penalties, 12))) == best


def test_windows_cover_the_stream():
    draw = random.Random(2)
    for _ in range(100):
        docs = np.cumsum([draw.choice([1, 5, 300, 5000]) for _ in range(draw.randint(1, 12))])
        ends = window_ends(docs, np.array(sorted(draw.sample(range(1, int(docs[-1]) + 1), min(9, int(docs[-1]))))))
        sizes = np.diff(np.concatenate([[0], ends]))
        assert ends[-1] == docs[-1] and sizes.min() > 0 and sizes.max() <= 2048
    assert AT_DOCUMENT < AT_SENTENCE < INSIDE


@pytest.mark.parametrize("window", [2048, 64])
def test_pieces_give_the_documents_back(spark, tokenizer, window):
    rows = awkward_texts() + [(50, f"before {SPECIAL} after"), (51, SPECIAL)] + [(60 + k, prose(k, 700)) for k in range(8)]
    docs = with_extras(spark, rows, "doc_id long, text string").coalesce(3)
    out = pack_documents(docs, tokenizer_path(), window=window).collect()
    sequences, streams = {}, {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
        streams.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert len(r.ids) == 4 * r.length > 0
    padding = total = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= window
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else window - at)
    assert padding <= 0.05 * total
    want = {}
    for (i, _), e in zip(rows, tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        want.setdefault((i, len(e.ids) + 1), []).append([*e.ids, 1])
    assert set(want) == set(streams)
    for key, texts in want.items():
        pieces = sorted(streams[key], key=lambda r: (r.start, r.ids))
        if len(texts) == 1:
            assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
            assert np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist() == texts[0]
        else:
            assert sum(r.length for r in pieces) == sum(map(len, texts))


def test_no_documents(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
