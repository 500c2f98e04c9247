"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat as X1
from . import exact_dedup as X7
from . import hard_negatives as X13
from . import mixing as X3
from . import hmm as X6
from . import near_dedup as X8
from . import packing as X4
from . import quality_classifier as X9
from . import quality_rules as X2
from . import secret_scan as X11
from . import substring_dedup as X5
from . import vector_codes as X12
from . import warc as X10
from .common import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return wrap


@register("op7_exact_dedup", """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS c,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS kept,
       sha256(t) AS text_sha256
FROM d
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = X7.exact_dedup(read_table(spark, sf_dir, "documents"))
    return x.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op10_warc", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (
  SELECT page_id, octet_length(encode(t)) AS b, sha256(t) AS d, min(page_id) OVER (PARTITION BY t) AS f FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 100 AND f <> page_id THEN f END AS refers_to
FROM q
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = X10.write_warc(read_table(spark, sf_dir, "pages"))
    return X10.read_warc(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# formatted_chars: markers, role, text and one backslash per control string inside role or text
_CONTROL_SQL = r"[<\[]\\*(\|im_start\|>|\|im_end\|>|\|im_sep\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|SYS>>|/SYS>>)"
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@register("op1_chat_format", f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}'
  UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + 1 + 10 + 1 + length(role) + length(text)
           + len(regexp_extract_all(role, '{_CONTROL_SQL}')) + len(regexp_extract_all(text, '{_CONTROL_SQL}')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    pieces = X1.format_trees(X1.linear_trees(c.unionByName(extra)), top=1)
    return X1.read_back(pieces).select(F.col("tree_id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@register("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _ = X2.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return x.select("doc_id", *X2.BASE, "base_failed", "kept", "rule")


@register("op3_poisson_mix", """
WITH RECURSIVE
d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, text FROM documents),
m AS (SELECT source, sum(length(t))::DOUBLE AS mass FROM d GROUP BY source),
r AS (SELECT source, mass, CASE WHEN mass > 0 THEN
        (1.0 / (SELECT count(*) FROM m WHERE mass > 0)) * (SELECT sum(mass) FROM m) / mass ELSE 0.0 END AS rate FROM m),
p AS (  -- probabilities from the closed form, summed up to far beyond the mean
  SELECT source, rate, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1.0)) END AS q
  FROM r, range(0, (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 41)::BIGINT FROM r)) AS g(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)),
c AS (SELECT source, rate, k, sum(q) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p WHERE rate > 0),
u AS (SELECT *, md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(t)) AS ident FROM d),
v AS (SELECT *, ('0x' || substr(md5('u' || ident), 1, 13))::BIGINT / 4503599627370496.0 AS x FROM u),
n AS (SELECT v.doc_id, v.source, v.text, v.ident, count(*) FILTER (c.cdf <= v.x) AS copies
      FROM v JOIN c ON v.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, text, copies, g.copy,
       ('0x' || substr(md5('order|' || ident || '|' || g.copy), 1, 13))::BIGINT AS mix_key
FROM n, LATERAL (SELECT unnest(range(0, copies)) AS copy) AS g
""")
def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = X3.replicate(read_table(spark, sf_dir, "documents"))
    return x.select("doc_id", "source", "text", F.col("_mix.copies").alias("copies"), F.col("_mix.copy").alias("copy"), F.col("_mix.key").alias("mix_key"))


@register("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X9.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X4.packed_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


@register("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = X8.near_duplicates(read_table(spark, sf_dir, "documents"), size=2).rows
    return x.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@register("op6_hmm_score")
def op6_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X6.scored(read_table(spark, sf_dir, "documents"))


@register("op5_substring_dedup", """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
m AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
r AS (
  SELECT DISTINCT doc_id, i + o AS p
  FROM s JOIN m USING (g), range(0, 50) AS t(o) WHERE m.first < s.doc_id),
k AS (
  SELECT x.doc_id, x.word, x.p, r.p IS NULL AS keep
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) AS x
  LEFT JOIN r ON r.doc_id = x.doc_id AND r.p = x.p)
SELECT d.doc_id, len(d.w) AS n_words, count(k.p) FILTER (NOT k.keep) AS n_removed,
       sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.p) FILTER (k.keep), '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id, d.w
""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X5.without_repeats(read_table(spark, sf_dir, "documents")).drop("kept_text")


@register("op11_secret_scan", X11.oracle_sql())
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X11.report(X11.scan_secrets(read_table(spark, sf_dir, "documents")))


@register("op12_vector_codes", X12.oracle_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X12.code_report(read_table(spark, sf_dir, "embeddings"))


@register("op13_hard_negatives", X13.oracle_sql())
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 is an anchor; a seventh of the labels is moved first."""
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return X13.hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=moved)
