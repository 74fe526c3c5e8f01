"""Registered queries of the operators over their whole tables, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldform.llm.bpe import decode_ids, encode_documents
from fieldform.llm.chat import BREAK, CLOSE, OPEN, format_chats, read_back, text_part
from fieldform.llm.common import LOWER, UPPER, table
from fieldform.llm.exact import exact_duplicates
from fieldform.llm.jaccard import jaccard_components
from fieldform.llm.mixing import mix_sources
from fieldform.llm.negatives import hard_negatives
from fieldform.llm.packing import pack_documents
from fieldform.llm.pivots import exact_top_k
from fieldform.llm.resampling import resample
from fieldform.llm.suffixes import repeated_passages
from fieldform.llm.toxicity import severity
from fieldform.llm.urls import judge_urls, pattern_rule, site_rule
from fieldform.llm.warc import read_warc, write_warc

RULES = (
    site_rule("allow", "org", "/"), site_rule("block", "example.org", "/es/"), site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"), site_rule("block", "com", "/de/"),
    pattern_rule("session-parameter", "block", r"[?&](?:sid|sessionid|phpsessid)="),
    pattern_rule("campaign-parameter", "block", r"[?&]utm_source=", "utm", "source"),
    pattern_rule("mobile-paging", "block", r"^m\..*[?&]page=[0-9]+", "m", "page"),
)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, 2.0 * source_size / weight AS ratio, 1.5 * SUM(source_size) OVER () AS budget FROM w),
l AS (SELECT *, (budget - COALESCE((SELECT SUM(2 * b.source_size) FROM r b WHERE b.ratio < a.ratio), 0))
             / (SELECT SUM(b.weight) FROM r b WHERE b.ratio >= a.ratio) AS level FROM r a),
t AS (SELECT source, source_size, LEAST(CAST(2 * source_size AS DOUBLE), weight * (SELECT arg_min(CAST(level AS DOUBLE), ratio) FROM l WHERE level <= ratio)) AS target,
             CAST(budget AS DOUBLE) AS budget FROM r),
q AS (SELECT d.doc_id, d.source, d.size, t.target, t.budget, c.copy, md5(c.copy || ':' || COALESCE(CAST(d.doc_id AS VARCHAR), '')) AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN (VALUES (1), (2)) c(copy)
        ON c.copy <= GREATEST(1, LEAST(2, ceil(t.target / t.source_size))) WHERE d.size > 0 AND t.target > 0),
f AS (SELECT *, CAST(SUM(size) OVER (PARTITION BY source ORDER BY copy, draw, doc_id) AS DOUBLE) / target AS finish FROM q),
g AS (SELECT *, SUM(size) OVER (ORDER BY finish, draw, doc_id, copy) AS spent FROM f),
x AS (SELECT doc_id, SUM(size) AS taken FROM g WHERE spent <= budget GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(COALESCE(x.taken, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON d.doc_id = x.doc_id
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document; ``toxic`` says that some grade above none is as likely as not."""
    return toxic_documents(spark, table(spark, sf_dir, "documents"), sf_dir)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, digest: bool = False) -> DataFrame:
    """``doc_id, severity, grade, toxic`` of ``docs`` (and ``text_sha256``), by a model fitted on those that ``labels`` names."""
    graded = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    out = severity(docs, graded, spread=True, digest=digest)
    return out.select("doc_id", "severity", "grade", (F.col("grade") > 0).alias("toxic"), *(["text_sha256"] if digest else []))


def op5_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 20
"""


def op6_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


EXACT_SQL = f"""
WITH t AS (SELECT doc_id, translate(COALESCE(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
g AS (SELECT low, MAX(doc_id) AS keep_id, COUNT(*) AS group_size FROM t GROUP BY low)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.low) AS text_sha256 FROM t JOIN g ON t.low = g.low
"""


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


URL_SQL = f"""
WITH u AS (SELECT page_id, url, translate(COALESCE(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
                  COALESCE(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT page_id, url, host, path, h || p AS rule, verdict FROM u LEFT JOIN r
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) = 1),
m AS (SELECT *, CASE WHEN rule IS NULL AND regexp_matches(url, '[?&](sid|sessionid|phpsessid)=') THEN 'session-parameter'
                     WHEN rule IS NULL AND regexp_matches(url, '[?&]utm_source=') THEN 'campaign-parameter'
                     WHEN rule IS NULL AND starts_with(host, 'm.') AND regexp_matches(url, '[?&]page=[0-9]+') THEN 'mobile-paging' END AS pattern FROM f)
SELECT page_id, host, path, rule, COALESCE(verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       pattern FROM m
"""


def op8_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(table(spark, sf_dir, "pages"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(COALESCE(html, ''))) AS BIGINT) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, MIN(page_id) AS holder FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN m.holder IS NULL OR m.holder = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.holder <> p.page_id THEN m.holder END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes >= 100
"""


def tokenizer_path() -> str:
    """The vocabulary file of the packing query; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def chat_digest(turns: DataFrame) -> DataFrame:
    """The digest columns of formatted ``turns(conv_id, turn, role, parts)``, all read back from the output."""
    back = read_back(format_chats(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_digest(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))


def _escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"


CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, COUNT(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
             COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
             SUM({len(OPEN) + len(BREAK) + len(CLOSE)} + length({_escaped('role')}) + length({_escaped('text')})) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


def op11_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode_ids(encoded, tokenizer_path()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _features(source: str, key: str) -> str:
    """``id, feature, n``: the words and pairs of neighbouring words of a table's texts."""
    words = f"regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""(SELECT id, feature, count(*) AS n FROM (
        SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature
        FROM (SELECT {key} AS id, {words} AS w FROM {source})) GROUP BY id, feature)"""


#: The CRC of each distinct feature is folded bit by bit; 3988292384 is the reversed polynomial.
RESAMPLE_SQL = f"""
WITH d AS MATERIALIZED {_features("documents", "doc_id")},
b AS MATERIALIZED {_features("benchmark", "item_id")},
x AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM d UNION SELECT feature FROM b)),
c AS MATERIALIZED (SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len(h) // 2),
        lambda i: list_transform(range(0, 8), lambda k: ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) >> k & 1)))),
        lambda a, bit: xor(a >> 1, (xor(a, bit) & 1) * 3988292384))) % 10000 AS bucket FROM x),
s AS (SELECT bucket, SUM(n) AS n FROM d JOIN c USING (feature) GROUP BY bucket),
t AS (SELECT bucket, SUM(n) AS n FROM b JOIN c USING (feature) GROUP BY bucket),
g AS (SELECT k.bucket, CAST(floor(1000 * ln((COALESCE(t.n, 0) + 1)::DOUBLE * ((SELECT COALESCE(SUM(n), 0) FROM s) + 10000)::DOUBLE
          / ((COALESCE(s.n, 0) + 1)::DOUBLE * ((SELECT COALESCE(SUM(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM (SELECT unnest(range(0, 10000)) AS bucket) k LEFT JOIN s ON s.bucket = k.bucket LEFT JOIN t ON t.bucket = k.bucket),
w AS (SELECT id, CAST(SUM(n) AS BIGINT) AS n_features, CAST(floor(SUM(n * gain)::DOUBLE / SUM(n)) AS BIGINT) AS weight
      FROM d JOIN c USING (feature) JOIN g USING (bucket) GROUP BY id),
o AS (SELECT doc_id, COALESCE(n_features, 0) AS n_features, COALESCE(weight, 0) AS weight,
             COALESCE(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM documents LEFT JOIN w ON w.id = doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 39
      QUALIFY rank <= (SELECT 25 * count(*) // 100 FROM o WHERE n_features >= 39))
SELECT o.*, r.rank FROM o LEFT JOIN r USING (doc_id)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_source_mix, op3_suffix_dedup, op4_ordinal_toxicity, op5_pivot_top_k, op6_chunk_recipes, op7_url_rules, op8_seekable_warc, op9_order_preserving_packing, op10_chat_parts, op11_pair_index_bpe, op12_hard_negatives, op13_importance_resampling, pipeline)}

ORACLES = {
    "op2_source_mix": MIX_SQL, "op5_pivot_top_k": TOP_K_SQL, "op6_chunk_recipes": EXACT_SQL, "op7_url_rules": URL_SQL,
    "op8_seekable_warc": WARC_SQL, "op10_chat_parts": CHAT_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_importance_resampling": RESAMPLE_SQL,
}
