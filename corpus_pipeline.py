"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; all but the
last return the columns of ``documents``.  ``run`` writes each stage to the shared folder and reads it back,
so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldform.llm.common import LOWER, UPPER, WORD, table
from fieldform.llm.exact import exact_duplicates
from fieldform.llm.jaccard import jaccard_components
from fieldform.llm.mixing import mix_sources
from fieldform.llm.packing import pack_documents
from fieldform.llm.queries import tokenizer_path, toxic_documents
from fieldform.scale import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the ordinal model grades above none.

    A row goes by its id and the digest of its text, nulls included, so other rows of its id stay; a null text is empty.
    """
    rejected = toxic_documents(spark, docs, sf_dir, digest=True).where("toxic").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rejected, sha = materialize(rejected, "rejected"), F.sha2(F.coalesce("text", F.lit("")), 256)
    gone = F.col("doc_id").eqNullSafe(F.col("_id")) & (sha == F.col("_sha"))
    return docs.join(rejected, gone, "left_anti").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""
    kept = materialize(exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")), "kept")
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), 256)
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("_sha") == F.col("kept_sha"))
    staying = docs.withColumn("_sha", sha).join(kept, same, "left_semi")
    # Rows that repeat an id and a text are one document.
    repeat = Window.partitionBy("doc_id", "_sha").orderBy("source", "lang", "n_chars")
    return staying.withColumn("_n", F.row_number().over(repeat)).where("_n = 1").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle links connect: that with the smallest id."""
    gone = jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(materialize(gone, "near"), "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once per copy; empty and null texts have no words to take and go."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # Rows of one id are told apart by their source and size, then in any order: the mix treats those alike.
    among = Window.partitionBy("doc_id").orderBy("source", "size")
    taken = mix_sources(docs).withColumn("_n", F.row_number().over(among)).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("_n").alias("_of"), (F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    rows = docs.withColumn("size", size).withColumn("_n", F.row_number().over(among))
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_n") - F.col("_of") == 0))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences with their token ids; a null text is empty, null ids are kept, no rows give no pieces."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mix", mix),
    ("packing", pack),
]

#: SQL can express neither the fitted model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
