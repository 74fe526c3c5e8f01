"""Operators on documents against brute force: awkward rows, hot groups, ties and empty tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from fieldform.llm import jaccard, shared, suffixes
from fieldform.llm.common import components, running_total
from fieldform.llm.exact import chunk_ends, exact_duplicates
from fieldform.llm.jaccard import jaccard_components
from fieldform.llm.mixing import mix_sources
from fieldform.llm.suffixes import repeated_passages
from tests.llm.helpers import LOW, awkward_texts, counted, jaccard_brute, passages_brute, prose, with_extras, word_list


@pytest.fixture(scope="module")
def awkward(spark):
    return with_extras(spark, awkward_texts(), "doc_id long, text string").repartition(5).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_jaccard_agrees_with_all_pairs(awkward):
    got = sorted((tuple(r) for r in jaccard_components(awkward).collect()), key=repr)
    assert got == jaccard_brute(awkward_texts())


def test_jaccard_on_a_family_whose_members_meet_only_through_the_original(spark):
    """Copies with five of 300 words changed: each links to the original, most not to each other."""
    base = prose(50, 150).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        words = list(base)
        for j in range(3):
            words[(k * 7 + j * 45) % 150] = f"word{k}x{j}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, f"{prose(60 + k, 40)} {' '.join(base[:40])}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in jaccard_components(docs).collect()), key=repr) == jaccard_brute(rows)


def test_jaccard_links_members_of_two_clusters(spark):
    """Two families whose centres are too far apart, joined by one pair of members."""
    base = prose(70, 200).split()
    other = base[:150] + prose(71, 50).split()
    rows = []
    for k in range(8):
        rows.append((k, " ".join(base[: 200 - k])))
        rows.append((20 + k, " ".join(other[: 200 - k])))
    rows.append((40, " ".join(base[:150] + prose(71, 50).split()[:12] + base[170:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard_components(docs).collect()), key=repr) == jaccard_brute(rows)


@pytest.mark.parametrize("percent", [40, 60, 90])
def test_jaccard_thresholds_on_random_overlaps(spark, percent):
    rows = []
    for k in range(60):
        words = prose(80 + k % 6, 80).split()
        cut = (k * 13) % 70
        rows.append((k, " ".join(words[:cut] + prose(200 + k, 1 + k % 9).split() + words[cut + k % 11 :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in jaccard_components(docs, percent=percent).collect()), key=repr)
    assert got == jaccard_brute(rows, percent)


def test_set_hashes_do_not_depend_on_slices(monkeypatch, spark):
    from fieldform.llm import bytesets

    rows = [(k, prose(k, 30 + 40 * k)) for k in range(20)] + [(30, prose(3, 150) + "  " + "y" * 70_000 + " " + prose(4, 90))]
    whole = [r[1] for r in rows]
    import pyarrow as pa

    sizes = [n for *_, z in bytesets.shingle_sets(pa.array(whole)) for n in z]
    monkeypatch.setattr(bytesets, "SLICE", 64)
    again = [n for *_, z in bytesets.shingle_sets(pa.array(whole)) for n in z]
    assert sizes == again


@pytest.mark.parametrize("gather", [suffixes.GATHER, 0, 40])
def test_passages_agree_with_every_string(awkward, gather):
    """Also with buckets that no task may gather."""
    want = passages_brute(awkward_texts())
    rows = repeated_passages(awkward, gather=gather).collect()
    assert counted(r[:5] for r in rows) == counted((i, *want[(i, t or "")]) for i, t in awkward_texts())
    for r in rows:
        edges = r["removed"]
        assert sum(edges[1::2]) - sum(edges[::2]) == r["n_removed"] and len(edges) == 2 * r["n_spans"] and edges == sorted(set(edges))


def test_passages_with_other_lengths_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 8)
    passage = prose(9, 20)
    rows = [(k, f"{prose(20 + k, k % 5 * 4)} {passage[k % 7:]} {prose(40 + k % 3, 10)}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for length, gram in ((50, 16), (24, 8)):
        want = passages_brute(rows, length)
        got = {r[0]: tuple(r[1:5]) for r in repeated_passages(docs, length=length, gram=gram).collect()}
        assert got == {i: want[(i, t)] for i, t in rows}


def test_exact_duplicates(awkward):
    groups = {}
    for i, t in awkward_texts():
        groups.setdefault((t or "").translate(LOW), []).append(i)
    rows = exact_duplicates(awkward).collect()
    want = []
    for low, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(low.encode()).hexdigest()) for i in ids]
    assert counted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == counted(want)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_equal_chunks_are_not_equal_texts(spark):
    """The same chunks in another order, or one of them twice, are other texts."""
    a, b = prose(1, 3000), prose(2, 3000)
    rows = [(1, a + b), (2, b + a), (3, a + b + b), (4, (a + b).upper()), (5, a + b[:-1])]
    got = {r.doc_id: r.keep_id for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 4, 2: 2, 3: 3, 4: 4, 5: 5}


def test_chunks_cover_the_text():
    import numpy as np

    for size in (0, 1, 1024, 1025, 5000, 100_000):
        ends = chunk_ends(size, np.arange(700, size, 900))
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == size


def test_mix_meets_its_targets(spark):
    rows = [(k, prose(k, 5 + k * 7 % 90), ["b", None, "a", "c", ""][k % 5] if k % 3 else "hot") for k in range(600)]
    rows += [(900, None, "a"), (901, "", "empty"), (902, None, None)]
    docs = with_extras(spark, rows, "doc_id long, text string, source string").repartition(6)
    out = mix_sources(docs).collect()
    size = {i: len(word_list(t)) for i, t, _ in rows}
    by = {}
    for r in out:
        assert r.size == size[r.doc_id] and r.taken in (0, r.size, 2 * r.size)
        by.setdefault(r.source, []).append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    budget = 1.5 * sum(size.values())
    assert abs(sum(r.target for s in by for r in by[s][:1]) - budget) < 1e-6 * budget
    levels = set()
    for k, s in enumerate(names):
        total, target = sum(r.size for r in by[s]), by[s][0].target
        assert all((r.source_size, r.target) == (total, target) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= max(r.size for r in by[s])
        if target < 2 * total:
            levels.add(round(target / (5, 2, 1)[k % 3], 6))
    assert len(levels) == 1
    assert counted(out) == counted(mix_sources(docs.repartition(2)).collect())


def test_mix_takes_awkward_rows(spark):
    """Null and repeated ids, texts without words and very long ones: rows are documents of their own."""
    rows = [(i, t, ["b", None, ""][k % 3]) for k, (i, t) in enumerate(awkward_texts())]
    docs = with_extras(spark, rows, "doc_id long, text string, source string").repartition(5)
    out = mix_sources(docs).collect()
    words = [(i, s, len(word_list(t))) for i, t, s in rows]
    assert counted((r.doc_id, r.source, r.size) for r in out) == counted(words)
    for source in ("b", None, ""):
        own = [r for r in out if r.source == source]
        total = sum(n for _, s, n in words if s == source)
        assert {r.source_size for r in own} == {total} and all(r.taken in (0, r.size, 2 * r.size) for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert max(r.size for r in out) > 60_000 and sum(r.doc_id is None for r in out) == 2
    silent = mix_sources(spark.createDataFrame([(1, None, "a"), (None, "", None), (1, " ", "a")], "doc_id long, text string, source string")).collect()
    assert counted((r.doc_id, r.source, r.size, r.target, r.taken) for r in silent) == counted([(1, "a", 0, 0.0, 0), (None, None, 0, 0.0, 0), (1, "a", 0, 0.0, 0)])


def test_empty_documents(nothing):
    assert jaccard_components(nothing).count() == 0
    assert repeated_passages(nothing).count() == 0
    assert exact_duplicates(nothing).count() == 0
    assert mix_sources(nothing).count() == 0


@pytest.mark.parametrize("text", [None, "", " \t\n", "two words", prose(3, 60)[:99]])
@pytest.mark.parametrize("among", [False, True])
def test_splits_without_any_feature_to_look_up(spark, text, among):
    """Splits that hold only such texts send no key; their documents keep their rows, alone or beside other splits."""
    rows = [(k, text) for k in range(8)]
    docs = spark.createDataFrame(rows, schema := "doc_id long, text string").repartition(4)
    if among:
        more = [(20, prose(1, 300)), (21, prose(1, 300)), (22, prose(2, 50))]
        rows, docs = rows + more, docs.unionByName(spark.createDataFrame(more, schema).repartition(2))
    assert sorted((tuple(r) for r in jaccard_components(docs).collect()), key=repr) == jaccard_brute(rows)
    want = passages_brute(rows)
    got = repeated_passages(docs).collect()
    assert counted(r[:5] for r in got) == counted((i, *want[(i, t or "")]) for i, t in rows)


@pytest.mark.parametrize("ranges", [1, 7])
def test_chunks_without_keys_still_say_what_they_are_about(ranges):
    none, owners = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    for rows in (shared.send(3, none, owners, b"about", ranges, 40), shared.send_counts(3, none, b"about", ranges, 40)):
        assert [(r["chunk"], r["keys"], r["about"]) for r in rows.to_pylist()] == [(3, None, b"about")]


def test_components_of_paths_stars_and_cycles(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and all(got[k] == 100 for k in range(101, 140)) and got[202] == got[201] == 200
    assert not {0, 100, 200, 300} & set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_total_of_a_hot_key(spark):
    rows = [(k, "hot" if k % 3 else f"s{k}", k % 17) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, s string, v long").repartition(5)
    total, want = {}, {}
    for i, s, v in sorted(rows):
        total[s] = want[i] = total.get(s, 0) + v
    assert {r.id: r.t for r in running_total(df, "s", [df.id], "v", "t").collect()} == want


def test_the_document_map_has_one_size_and_misses_nobody(spark):
    for many in (0, 10, 100_000):
        found = jaccard.document_map(spark.range(many).select("id"))
        assert found.shape == (1 << jaccard.MAP_BITS,) and found.sum() <= many
        import numpy as np

        assert found[jaccard._bit(np.arange(many))].all()
