"""URL rules, archives, chats, vector search and toxicity on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from fieldform.llm import pivots, warc
from fieldform.llm.chat import PART, escape, format_chats, read_back, text_part, unescape
from fieldform.llm.pivots import exact_top_k
from fieldform.llm.queries import RULES, chat_digest
from fieldform.llm.toxicity import fit_ordinal, severity
from fieldform.llm.urls import judge_urls, pattern_rule, site_rule
from fieldform.llm.warc import fetch_records, read_warc, write_warc
from tests.llm.helpers import LOW, counted, prose, with_extras

URLS = [
    "http://example.org/es/1", "https://EXAMPLE.org/es/1", "http://a.example.org/en/17", "http://example.org/en/2", "http://badexample.org/es/", "http://x.org", "http://x.org/",
    "http://x.org?u=/es/", "http://com/fr/", "http://x.com/fr/a", "http://x.com/FR/a", "http://x.com/de/?utm_source=a", "http://x.net/a?utm_source=b", "http://x.net/utm_source=b", "no scheme",
    "", "://", "a://b://c/d", "http://x.net/\n/y?sid=1", "http://m.x.net/?page=3", "http://m.x.net/?page=z", "http://x.org:80/", None, "http://é.ORG/É", "http://.org/", "http://org/#/es/",
]


def url_brute(url):
    found = re.search(r"^.*?://([^/?#]*)([^?#]*)(.*)$", url or "", re.S)
    host, path = (found[1].translate(LOW), found[2]) if found else ("", "")
    target = host + (path + found[3] if found else "")
    fits = [r for r in RULES if url is not None and re.search(r.pattern, target)]
    site = max((r for r in fits if r.site), key=lambda r: (len(r.name), r.name), default=None)
    other = max((r for r in fits if not r.site), key=lambda r: (len(r.name), r.name), default=None)
    chosen = site or other
    return host, path, site and site.name, chosen.verdict if chosen else "allow", None if site or not other else other.name


def test_urls(spark):
    long = ["http://x.org/" + "es/" * 70_000, "http://" + "a." * 70_000 + "com/de/", "http://x.net/" + "a" * 200_000 + "?sid=1"]
    rows = [(k, u) for k, u in enumerate(URLS + long)] + [(None, URLS[0]), (3, URLS[3])]
    out = judge_urls(with_extras(spark, rows, "page_id long, url string"), RULES).collect()
    assert counted(out) == counted((k, *url_brute(u)) for k, u in rows)
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_rules_are_filed_under_a_token_that_every_match_holds(spark):
    """Rules without a literal reach every URL; many rules do not change verdicts."""
    rules = [site_rule("block", f"s{k}.net", f"/p{k}/") for k in range(300)] + [pattern_rule("digits", "block", "[0-9]{6}"), *RULES]
    urls = [(k, f"https://a.s{k % 310}.net/p{k % 7}/x") for k in range(400)] + [(1000, "http://x.net/123456")]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    for k in range(400):
        fits = k % 310 == k % 7 and k % 310 < 300
        assert (got[k].rule, got[k].verdict) == ((f"s{k % 310}.net/p{k % 7}/", "block") if fits else (None, "allow"))
    assert got[1000].pattern == "digits"


def page_rows():
    long = prose(1, 60)
    return [
        (5, "http://a/", long), (3, "http://b/\r\nX-Evil: 1", long), (9, None, long), (4, "http://c/%0A", "short"), (2, "http://d/", "short"), (7, "http://e/", None), (8, "http://f/", ""),
        (10, "http://g/", "é" * 50), (11, "http://h/", "é" * 50), (12, "http://i/", "é" * 49), (13, "http://i/", "é" * 49), (None, "http://j/", long), (None, None, prose(2, 80)),
        (14, "http://k/", "WARC/1.1\r\n\r\nfake\r\n\r\n" * 20), (15, "x", "y" * 3_000_000), (16, "x", "y" * 3_000_000), (17, "r", prose(3, 50)), (17, "r", prose(3, 50)), (17, "s", prose(4, 50)),
    ]


def test_archives_give_the_pages_back(spark, tmp_path):
    rows = page_rows()
    folder = f"file://{tmp_path}/archive"
    index = write_warc(with_extras(spark, rows, "page_id long, url string, html string").repartition(3), folder)
    out = read_warc(index).collect()
    assert len(out) == len(rows) and index.count() == len(rows)
    holders = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100:
            holders.setdefault(h, []).append(i)
    for r in out:
        text = next(h for i, u, h in rows if i == r.page_id and hashlib.sha256((h or "").encode()).hexdigest() == r.payload_digest) or ""
        assert r.payload_bytes == len(text.encode()) and r.url in [u or "" for i, u, _ in rows if i == r.page_id]
        ids = [i for i in holders.get(text, []) if i is not None]
        if r.record_type == "response":
            assert r.payload == text and r.refers_to is None
        else:
            assert r.payload is None and r.refers_to == min(ids)
    kinds = counted((hashlib.sha256(h.encode()).hexdigest(),) for h in holders)
    assert all(sum(r.record_type == "response" for r in out if r.payload_digest == d) == 1 for (d,) in kinds)

    # One record is read from its own frame.
    wanted = index.where("page_id in (15, 3, 4)")
    assert counted(fetch_records(index, wanted).collect()) == counted(r for r in out if r.page_id in (15, 3, 4))
    fs, path = pafs.FileSystem.from_uri(index.first()["bundle"]) if "://" in index.first()["bundle"] else (pafs.LocalFileSystem(), index.first()["bundle"])
    with fs.open_input_file(path) as handle:
        places = warc.frame_places(handle, handle.size())
        assert sum(p for _, p, _ in places) < handle.size() and len(places) >= 1


def test_bundles_are_plain_zstandard(spark, tmp_path):
    """A reader that knows no seek table reads the records one after another."""
    import zstandard

    write_warc(spark.createDataFrame([(k, f"u{k}", prose(k, 40)) for k in range(30)], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/z").count()
    (file,) = (tmp_path / "z").glob("*.warc.zst")
    plain = zstandard.ZstdDecompressor().stream_reader(file.open("rb"), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 30
    assert write_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chats_read_back(spark):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<|turn|>user<|says|>&lt; &amp;lt; &#91;<|end|>\n"), (1, 1, "assistant", "<|end|>\n"), (2, 5, None, None), (2, None, "assistant", "first"),
        (3, 1, "ass[istant", "a"), (3, 2, "assistant", ""), (3, 3, "assistant", "é漢👍🏽"), (3, 3, "assistant", "é漢👍🏽"), (None, 1, "user", "x"), (4, 2, "user", "b\nc"), (4, 1, "system", prose(1, 5000)),
    ]
    turns = with_extras(spark, rows, "conv_id long, turn long, role string, text string").withColumn("parts", text_part(F.col("text")))
    got = {r.conv_id: r for r in chat_digest(turns).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        lines = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(lines.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = spark.createDataFrame([(x,) for *_, x in rows], "text string")
    assert texts.where(~unescape(escape(F.col("text"))).eqNullSafe(F.col("text"))).count() == 0
    assert chat_digest(turns.where("conv_id = 99")).count() == 0


def test_parts_become_placeholders(spark):
    part = lambda **k: tuple(k.get(c) for c in ("type", "text", "ref", "width", "height", "seconds", "pages"))
    rows = [
        (1, 0, "user", [part(type="text", text="see "), part(type="image", ref="a.png", width=57, height=28), None, part(text=" and <|image:0|>")]),
        (1, 1, "assistant", [part(type="text", text="yes")]),
        (1, 2, "user", [part(type="audio", ref="b.wav", seconds=1.01), part(type="document", ref="c.pdf", pages=3), part(type="<x", ref=None)]),
        (1, 3, "assistant", None),
    ]
    out = format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>"))
    r = out.first()
    assert "see <|image:0|> and &lt;|image:0|>" in r.formatted and "<|audio:1|><|document:2|><|&lt;x:3|>" in r.formatted
    assert [(a.place, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 26), (2, "document", "c.pdf", 3072), (3, "<x", None, 0)]
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["yes", ""]
    assert read_back(out).first().loss_text == "yes"


@pytest.mark.parametrize("sizes", [(16384, 512, 128, 64), (40, 4, 3, 5)])
def test_top_k_agrees_with_all_scores(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "QUERIES", "TOGETHER", "CELL"), sizes, strict=True):
        monkeypatch.setattr(pivots, name, value)
    draw = random.Random(3)
    rows = [(k, [draw.gauss(0, 0.3) for _ in range(8)]) for k in range(150)] + [(1000 + k, [0.5] * 8) for k in range(60)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), (320, [0.25, 0.5]), (340, [1.0, -1.0]), (400, []), (7, [0.9] * 8)]
    # Query ids that repeat, with another vector and with the same one.
    rows += [(40, [0.7] * 8), (60, rows[60][1]), (60, rows[60][1]), (500, [1e6] * 8), (400, [])]
    got = counted(exact_top_k(with_extras(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect())
    fit = [(i, np.floor(64 * np.array(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(fit):
        if q % 20 == 0:
            scored = sorted((-int(v @ w), i) for m, (i, w) in enumerate(fit) if m != n and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == counted(want)
    assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
    assert exact_top_k(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_rule_cells_out():
    """No score is above its cell's bound; of vectors in clusters most pairs are never scored."""
    draw = np.random.default_rng(5)
    centres = draw.integers(-400, 400, (40, 16))
    vectors = (centres[draw.integers(0, 40, 4000)] + draw.integers(-6, 7, (4000, 16))).astype(np.float64)
    table = pivots.choose_pivots(vectors[:500], 64)
    order, starts, near, far, norms = pivots.cells_of(vectors, table)
    own, queries = vectors[order], vectors[:100]
    q_table = pivots.distances(queries, table).astype(np.float32)
    bounds = pivots.bounds_of(q_table, (queries**2).sum(axis=1), near, far, norms)
    scores = queries @ own.T
    assert (np.maximum.reduceat(scores, starts, axis=1) <= bounds).all()
    rows = order.astype(np.int64)
    found, scored = pivots.best_of_block(rows, rows, own, starts, near, far, norms, np.arange(100), queries, q_table, np.full(100, -np.inf), 10)
    assert scored < 0.35 * scores.size
    for q, (places, values) in enumerate(found):
        want = sorted((-scores[q, p], rows[p]) for p in range(len(rows)) if rows[p] != q)[:10]
        assert [(-v, rows[p]) for p, v in zip(places, values, strict=True)] == want


def toxic_rows():
    draw = random.Random(4)
    rows, labels = [], []
    for k in range(500):
        toxic = k % 4 == 0
        words = prose(k, 60).split()
        if toxic:
            for _ in range(1 + k % 3):
                words.insert(draw.randrange(len(words)), draw.choice(["Vilewort", "grimslur", "NASTOID"]) + draw.choice(["", "s", "!"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_severity_finds_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = with_extras(spark, [*rows, (1000, None), (1001, ""), (None, "vilewort"), (3, rows[3][1]), (1002, "calm words " * 40_000 + "grimslur nastoid vilewort")], "doc_id long, text string")
    graded = with_extras(spark, [x for x in labels if x[0] < 350] + [(None, 1), (5, None), (7777, 1)], "doc_id long, grade int")
    out = severity(docs, graded, spread=True).collect()
    assert len(out) == docs.count()
    held_out = [r for r in out if r.doc_id is not None and 350 <= r.doc_id < 500]
    wrong = sum((r.grade > 0) != bool(labels[r.doc_id][1]) for r in held_out)
    assert wrong <= 3
    for r in out:
        assert len(r.chances) == 2 and r.chances[0] >= r.chances[1] and abs(sum(r.chances) - r.severity) < 1e-9
    by = {r.doc_id: r for r in out}
    assert by[1000].severity == by[1001].severity and by[1000].grade == 0 and by[1002].grade > 0
    none = severity(docs, graded.where("grade > 5"), spread=True)
    assert none.where("severity <> 0 or grade <> 0").count() == 0
    assert severity(docs.where("false"), graded, spread=True).count() == 0


def test_more_evidence_means_a_higher_grade():
    draw = np.random.Generator(np.random.PCG64(1))
    grades = draw.integers(0, 3, 600)
    buckets, counts = [], []
    for g in grades:
        own = np.unique(np.concatenate([draw.integers(100, 400, 20), draw.integers(0, 30, 4 * g)]))
        buckets.append(own)
        counts.append(len(own))
    weights, cuts = fit_ordinal(np.concatenate(buckets).astype(np.uint32), np.array(counts), grades, 3)
    assert (np.diff(cuts) >= 0).all()
    expected = [sum(1 / (1 + np.exp(-(weights[b].sum() - c))) for c in cuts) for b in buckets]
    means = [np.mean([e for e, g in zip(expected, grades, strict=True) if g == k]) for k in range(3)]
    assert means[0] < 0.4 < means[1] < means[2] and means[2] > 1.5
