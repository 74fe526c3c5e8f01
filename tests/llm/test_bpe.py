"""Byte-pair encoding: ids and decoded texts are the tokenizer's."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest

from fieldform.llm import bpe
from fieldform.llm.bpe import Vocabulary, decode_ids, encode_documents
from fieldform.llm.queries import op11_pair_index_bpe, tokenizer_path
from tests.llm.helpers import awkward_texts, prose, with_extras

tokenizers = pytest.importorskip("tokenizers")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(tokenizer_path())


def rows():
    draw = random.Random(3)
    signs = "aab 's\n\t.'lrevd1é漢　—ᲉꟋ\U000105c0"
    special = [f"{SPECIAL}", f"a{SPECIAL}{SPECIAL} b", f" {SPECIAL} <|endoftext| >{SPECIAL}", f"{SPECIAL[:-1]}{SPECIAL}"]
    texts = [t for _, t in awkward_texts()] + special + ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    return [*enumerate(texts), (None, "no id"), (3, "an id that repeats"), (3, "an id that repeats")]


def test_ids_and_texts_are_the_tokenizers(spark, tokenizer):
    table = with_extras(spark, rows(), "doc_id long, text string").repartition(3)
    out = decode_ids(encode_documents(table, tokenizer_path()), tokenizer_path()).collect()
    want = [(i, e.ids) for (i, _), e in zip(rows(), tokenizer.encode_batch([t or "" for _, t in rows()], add_special_tokens=False), strict=True)]
    assert sorted(((r.doc_id, r.ids) for r in out), key=repr) == sorted(want, key=repr)
    assert sorted(r.decoded for r in out) == sorted(tokenizer.decode(ids, skip_special_tokens=False) for _, ids in want)


def test_words_merge_as_one_by_one(tokenizer, vocab):
    """Runs of one symbol, overlapping pairs and words of a single byte, thousands together."""
    draw = random.Random(9)
    words = sorted({"".join(draw.choice("aeinrst") for _ in range(draw.randint(1, 24))) for _ in range(4000)} | {c * n for c in "a=!-" for n in range(1, 70)})
    ids, sizes = vocab.encode_words(words)
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    want = [[vocab_ids for vocab_ids in e.ids] for e in tokenizer.encode_batch(words, add_special_tokens=False)]
    assert got == want


def test_words_forgotten_and_chunks_cut(spark, tokenizer, monkeypatch):
    monkeypatch.setattr("fieldform.llm.words.KNOWN_WORDS", 50)
    encoder = bpe.WordEncoder(bpe.kind_table(bpe.character_runs(tokenizer_path())), Vocabulary(tokenizer_path()).encode_words)
    for k in range(6):
        text = prose(k, 60)
        assert encoder.encode(text, np.array([0, len(text)]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_broken_ids_decode_like_the_tokenizer(spark, tokenizer):
    draw = random.Random(4)
    lists = [[draw.randrange(50257) for _ in range(draw.randint(0, 12))] for _ in range(400)] + [[draw.randrange(256) for _ in range(9)] for _ in range(200)]
    frame = spark.createDataFrame([(k, ids) for k, ids in enumerate(lists)] + [(-1, None), (-2, [None, 50256, 99_999_999, -5])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in decode_ids(frame, tokenizer_path()).collect()}
    assert got.pop(-1) is None and got.pop(-2) == SPECIAL
    assert got == {k: tokenizer.decode(ids, skip_special_tokens=False) for k, ids in enumerate(lists)}


def test_query_digests_and_empty_table(spark, tokenizer, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in op11_pair_index_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    encoded = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs]
    assert got == {(i, len(x), sha(",".join(map(str, x))), sha(tokenizer.decode(x, skip_special_tokens=False))) for i, x in encoded}
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.loads(open(tokenizer_path()).read())
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "backwards.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        Vocabulary(str(path))
