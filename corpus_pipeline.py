"""A training-data pipeline of the corpus operators. Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next; all but the last return the columns of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.tables import swept
from seriesloom.llm.bpe import bpe
from seriesloom.llm.common import checkpoint
from seriesloom.llm.exact_dedup import drop_copies
from seriesloom.llm.mixing import mix
from seriesloom.llm.ngram_join import drop_near_copies
from seriesloom.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the smallest id stays."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more on five-word shingles, the smallest id stays."""
    return drop_near_copies(docs, width=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat to the target weights of their sources, in a random order; copies carry the same doc_id."""
    return mix(docs).select(*docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (packed little-endian), n_tokens, ids_sha256, decoded_sha256."""
    rows = bpe(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"))
    return rows.select("doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("bpe", bpe_encode)]

#: Toxicity and BPE can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Between stages rows are written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    place = f"{folder}/pipeline-{uuid.uuid4()}" if folder else None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            if place:
                with swept(spark):
                    docs.write.parquet(f"{place}/{k}-{name}")
                docs = spark.read.parquet(f"{place}/{k}-{name}")
            else:
                docs = checkpoint(docs)
    return docs
