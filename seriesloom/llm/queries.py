"""The queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.bpe import bpe
from seriesloom.llm.chat import chat_digests, format_chats, with_control_case
from seriesloom.llm.exact_dedup import exact_dedup
from seriesloom.llm.fingerprints import edited_fingerprints
from seriesloom.llm.html_extract import extract_pages
from seriesloom.llm.language_id import language_id
from seriesloom.llm.mixing import ALPHA, SEED, mix
from seriesloom.llm.ngram_join import similarity_classes
from seriesloom.llm.toxicity import toxicity
from seriesloom.llm.word_pieces import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"), width=4, num=85, den=100, lower=True)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(format_chats(with_control_case(spark, table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_html_extract, op3_bpe, op4_toxicity, op5_mixing, op6_exact_dedup, op7_language_id, op8_fingerprints, op9_token_counts, op10_chat_format)}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLE = {
    "op5_mixing": f"""
WITH sizes AS (SELECT source, count(*) AS n_docs, pow(count(*)::DOUBLE, {ALPHA}) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / sum(w) OVER () * sum(n_docs) OVER () / n_docs AS rate FROM sizes),
terms AS (SELECT source, rate, k, -rate + k * ln(rate) - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END AS log_p
          FROM rates, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k)),
cdf AS (SELECT source, rate, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS below FROM terms),
draws AS (SELECT d.*, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(2, 52) AS u FROM documents d),
counts AS (SELECT d.doc_id, d.source, c.rate, count(*) FILTER (WHERE c.below <= d.u) AS n
           FROM draws d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL),
copies AS (SELECT doc_id, source, rate, unnest(range(0, n)) AS copy FROM counts)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, round(c.rate, 9) AS rate, c.copy,
       md5('{SEED}+:' || coalesce(d.doc_id::VARCHAR, '') || ':' || c.copy::VARCHAR) AS mix_key
FROM copies c JOIN documents d ON d.doc_id = c.doc_id""",
    "op6_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_NORM} AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)""",
}
