"""Importance resampling: counts, weights and the draw in plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from fieldform.llm.resampling import SHORT, move, resample, runs_of_words
from tests.llm.helpers import LOW, awkward_texts, prose, with_extras

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, words=2):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [" ".join(w[k : k + n]) for n in range(1, words + 1) for k in range(len(w) - n + 1)]


def brute(docs, target, words=2, buckets=10_000, percent=25, at_least=20, seed=7):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (collections.Counter(bucket(g) for x in texts for g in grams(x, words)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, features = grams(text, words)
        weight = sum(gain[bucket(g)] for g in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in out if r[1] >= at_least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = len(fit) * percent // 100
    ranked = [(*r, k if k <= drawn else None) for k, r in enumerate(fit, 1)]
    return sorted(ranked + [(*r, None) for r in out if r[1] < at_least], key=repr)


def test_moved_crcs_and_substrings():
    draw = random.Random(1)
    for size in (0, 1, 2, 31, SHORT - 1, SHORT, SHORT + 1, 5 * SHORT + 7, 70_000):
        a, b = draw.randbytes(draw.randint(0, 40)), draw.randbytes(size)
        got = move(np.array([zlib.crc32(a)], np.uint32), np.array([size]))[0] ^ np.uint32(zlib.crc32(b))
        assert got == zlib.crc32(a + b)


@pytest.mark.parametrize("words", [1, 2, 4])
def test_every_run_of_words(words):
    texts = [t or "" for _, t in awkward_texts()] + ["A", "a b", "1-2--3", "Zürich", "é" * 400 + " x"]
    got = [collections.Counter() for _ in texts]
    for crc, row in runs_of_words([t.encode() for t in texts], words):
        for c, r in zip(crc.tolist(), row.tolist(), strict=True):
            got[r][c] += 1
    assert got == [collections.Counter(zlib.crc32(g.encode()) for g in grams(t, words)[1]) for t in texts]


def test_equal_to_brute_force(spark):
    docs = awkward_texts() + [(100 + k, prose(k % 40, 10 + 7 * (k % 40))) for k in range(120)]
    target = [prose(k, 60) for k in range(10)] + [None, ""]
    goal = with_extras(spark, [(k, t) for k, t in enumerate(target)], "item_id long, text string")
    table = with_extras(spark, docs, "doc_id long, text string").repartition(5)
    got = resample(table, goal).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, target)
    got = resample(table, goal, percent=60, at_least=3, seed=11, words=3, buckets=512).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, target, 3, 512, 60, 3, 11)


def test_tables_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = [(k, prose(k, 30)) for k in range(8)]
    assert resample(none, none).collect() == []
    some = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in resample(some, none).collect()), key=repr) == brute(docs, [])
    assert resample(none, some).collect() == []
