"""Hard negatives: all pairs in plain arithmetic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldform.llm import negatives
from fieldform.llm.negatives import best, digits_of, hard_negatives, narrowest, planes, scores, subset_sums
from tests.llm.helpers import with_extras

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, positives=5, below=5, low=80, high=100, scale=256):
    whole = [(k, i, y, [math.floor(scale * float(x)) for x in v]) for k, (i, v, y) in enumerate(rows)
             if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, y, v in whole:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, n, z) for n, j, z, w in whole if n != k and len(w) == len(v))
        for p, j, _, _ in [s for s in scored if s[3] == y][:positives]:
            fit = [s for s in scored if s[3] != y and low * -p <= 100 * -s[0] <= high * -p][:below]
            out += [(i, j, rank, s[1], -p, -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out)


def table(seed, count, dim=19, labels=4, spread=1.0):
    draw = random.Random(seed)
    single = lambda x: float(np.float32(x))
    return [(k, [single(draw.gauss(0.2, spread)) for _ in range(dim)], draw.randrange(labels)) for k in range(count)]


def found(spark, rows, every, **options):
    out = hard_negatives(with_extras(spark, rows, SCHEMA), F.col("vec_id") % every == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def test_scores_are_inner_products():
    draw = np.random.default_rng(1)
    for dim, most in ((1, 3), (8, 200), (13, 1 << 12), (64, 1 << 20)):
        a, c = draw.integers(-most, most, (5, dim)), draw.integers(-most, most, (40, dim))
        digits = digits_of(c)
        assert (scores(subset_sums(a, narrowest(a, digits)), planes(c, digits)) == c @ a.T).all()
    assert digits_of(np.array([[-8, 7]])) == 4 and digits_of(np.array([[-9]])) == 5


def test_best_takes_earlier_places_among_equals():
    draw = random.Random(2)
    for _ in range(200):
        score = np.array([draw.randrange(4) for _ in range(draw.randint(0, 12))])
        assert best(score, 3).tolist() == sorted(range(len(score)), key=lambda k: (-score[k], k))[:3]


@pytest.mark.parametrize("block", [8192, 16])
def test_equal_to_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "TOGETHER", 3)
    rows = table(5, 150, spread=0.5)
    same = rows[20][1]
    # A third of all rows are one vector, in several labels; ids and whole rows repeat; a label with one row; one anchor without peers.
    rows += [(200 + k, same, k % 3) for k in range(80)] + [(40, rows[3][1], 1), (40, rows[3][1], 1), (40, rows[3][1], 2), (300, rows[7][1], 9)]
    assert found(spark, rows, 20) == brute(rows, 20)
    assert found(spark, rows, 20, low=33, high=99, positives=2, negatives=3) == brute(rows, 20, 2, 3, 33, 99)


def test_rows_that_take_no_part(spark):
    rows = table(6, 60, dim=4)
    rows += [(None, rows[0][1], 1), (100, None, 1), (120, rows[1][1], None), (140, [1.0, None, 2.0, 0.0], 0), (160, [1.0, math.nan, 0.0, 0.0], 0),
             (180, [math.inf, 0.0, 0.0, 0.0], 1), (200, [0.5, 0.25], 0), (201, [0.5, 0.5], 0), (202, [0.5, 0.2], 1), (220, [], 0), (221, [], 0), (222, [], 1)]
    assert found(spark, rows, 20) == brute(rows, 20)


def test_no_rows_no_anchors_negative_scores(spark):
    assert found(spark, [], 2) == []
    assert found(spark, [(1, [0.5], 0), (3, [0.5], 1)], 2) == []
    rows = [(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.9], 1), (3, [0.0], 1)]
    assert found(spark, rows, 10) == brute(rows, 10) == []


def test_components_beyond_whole_scores_fail(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark, [(0, [1e30], 0), (1, [1.0], 0)], 2)
