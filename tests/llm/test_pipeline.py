"""The stages on planted rows, and the registered names."""

from __future__ import annotations

import re

import __spark_entry__ as entry
import corpus_pipeline
from fieldform.llm.queries import ORACLES, QUERIES
from fieldform.scale import materialize
from tests.llm.helpers import awkward_texts


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, sf)
        assert out.columns == docs.columns
        out = out.persist()
        seen[name] = {r.doc_id: r for r in out.collect()}
        assert set(seen[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
        before = out
    text = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in QUERIES["op4_ordinal_toxicity"](spark, sf).where("toxic").collect()}
    assert set(seen["toxicity"]) == set(text) - toxic
    lows = [text[i].lower() for i in seen["exact_dedup"]]
    assert len(set(lows)) == len(lows) == len({text[i].lower() for i in seen["toxicity"]})
    assert len(seen["ngram_jaccard"]) < len(seen["exact_dedup"])
    assert all(r.text == text[i] for i, r in seen["source_mix"].items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == set(seen["source_mix"])


def test_copies_in_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: r.taken // r.size for r in QUERIES["op2_source_mix"](spark, sf).collect() if r.size}
    copies = {r.doc_id: r["count"] for r in corpus_pipeline.mix(spark, docs, sf).groupBy("doc_id").count().collect()}
    assert copies == {i: n for i, n in taken.items() if n}


def test_rejected_rows_go_and_no_others(spark, sf):
    """Null and repeated ids: rows go by id and text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in QUERIES["op4_ordinal_toxicity"](spark, sf).where("toxic").collect()}
    bad, clean = sorted(toxic), sorted(set(rows) - toxic)
    free = next((i for i in bad if i not in labelled), None)
    kinds = docs.schema
    more = [rows[bad[0]].asDict() | {"doc_id": None}, rows[clean[0]].asDict() | {"doc_id": None}, rows[clean[1]].asDict() | {"doc_id": None, "text": None}]
    if free is not None:
        more.append(rows[clean[2]].asDict() | {"doc_id": free})
    out = corpus_pipeline.drop_toxic(spark, docs.unionByName(spark.createDataFrame(more, kinds)), sf).collect()
    kept = [(r.doc_id, r.text) for r in out]
    assert (None, rows[bad[0]].text) not in kept
    assert (None, rows[clean[0]].text) in kept and (None, None) in kept
    assert free is None or (free, rows[clean[2]].text) in kept
    assert {i for i, _ in kept if i is not None and i != free} == set(clean)


def test_stages_take_awkward_rows(spark, sf):
    """Null ids and texts, repeated rows, very long texts; and a table without rows."""
    columns = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(10_000_000 + i if i is not None else None, t, "en", None if k % 5 == 0 else f"s{k % 3}", None) for k, (i, t) in enumerate(awkward_texts())]
    rows += rows[:1] * 2
    for table in (rows, []):
        docs = spark.createDataFrame(table, columns)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, docs, sf))
            assert out.columns == columns.names and out.count() <= 2 * docs.count()
            docs = out
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert (pieces.count() > 0) == bool(table)


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5
