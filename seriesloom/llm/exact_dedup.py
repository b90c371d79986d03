"""Exact deduplication by skew-safe combining.

Every stage groups by digest and full content, so that two texts with one digest never merge:
1. within each input partition (map-side combining), 2. by digest, content and salt, 3. the salt winners globally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import SPACE, by_ids, checkpoint, unused

#: Salts over which a group of copies is merged before the global stage.
SALTS = 32


def normalised(docs: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    return docs.select("doc_id", text.alias("norm")).withColumn("digest", F.unhex(F.sha2(F.col("norm"), 256)))


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, norm, keep_id, group_size): one row for each distinct normalised text."""
    rows = normalised(docs).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = rows.groupBy("digest", "norm", "salt").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space. Null and empty texts are one group; a
    text of white space only is another. The smallest doc_id of a group stays; null ids lose to any other, and where a group has
    only null ids they stay. Rows that repeat an id and a text count in group_size and are all kept alike. An empty table gives no rows.
    Other columns are ignored."""
    full = winners(docs, salts)
    found = checkpoint(full.select("digest", "keep_id", "group_size"))
    shared = found.groupBy("digest").count().filter("count > 1")
    rows = normalised(docs)
    if shared.isEmpty():  # each digest stands for one content, as compared above
        joined = rows.select("doc_id", "digest").join(found.hint("merge"), "digest")
    else:
        joined = rows.join(full.hint("merge"), ["digest", "norm"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """docs without the rows that exact_dedup drops, columns unchanged; rows that repeat an id and a text become one."""
    decided = checkpoint(exact_dedup(docs, salts))
    repeated = decided.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    dropped = decided.filter(~F.col("kept")).select("doc_id")
    if repeated.isEmpty() and decided.filter("doc_id IS NULL").isEmpty():
        return by_ids(docs, dropped, "doc_id", "left_anti")
    # ids that repeat: decide by id and text
    own, sha, digest = unused(docs.columns, "own", "sha", "digest")
    kept = decided.filter("kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)).distinct()
    rows = docs.withColumn(digest, F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " "), 256))
    rows = rows.join(kept, F.col(own).eqNullSafe(F.col("doc_id")) & (F.col(sha) == F.col(digest)), "left_semi")
    return rows.dropDuplicates(["doc_id", digest]).select(*docs.columns)
