"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpoint, is_small, salted_lookup, unused

#: Exponent of the default targets: a source's weight is its share of documents to this power, so that small sources gain.
ALPHA = 0.5
SEED = 17


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the md5 of the seed and columns: 52 bits."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, targets: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, n_docs, weight, rate, cdf): the mean repetition of a source's documents and its Poisson distribution.

    rate = weight * all documents / documents of the source, weights scaled to sum 1. targets(source, weight) gives the weights;
    sources that it lacks weigh 0. Without it they are proportional to documents ** alpha. A null source is a source.
    The distribution is summed in logarithms up to rate + 12 sqrt(rate) + 40, where less than 2**-53 is left."""
    sizes = docs.select("source").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if targets is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(alpha)))
    else:
        given = targets.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("w"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("w", F.coalesce("w", F.lit(0.0)))
    sizes = checkpoint(sizes)
    all_w, all_docs = sizes.agg(F.sum("w"), F.sum("n_docs")).first()  # one row of totals
    rates = sizes.withColumn("weight", F.col("w") / F.lit(all_w) if all_w else F.lit(0.0))
    rates = rates.withColumn("rate", F.col("weight") * F.lit(float(all_docs or 0)) / F.col("n_docs"))
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")

    def add(acc: Column, k: Column) -> Column:
        """acc: logarithm of the last term, its sum, the sums so far."""
        log = F.when(k == 0, -F.col("rate")).otherwise(acc["log"] + F.ln("rate") - F.ln(k.cast("double")))
        run = acc["run"] + F.exp(log)
        return F.struct(log.alias("log"), run.alias("run"), F.concat(acc["cdf"], F.array(run)).alias("cdf"))

    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("cdf"))
    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(0), top), start, add)["cdf"])
    return rates.select("source", "n_docs", "weight", "rate", cdf.alias("cdf"))


def mix(docs: DataFrame, targets: DataFrame | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs, each repeated a Poisson number of times with mean the rate of its source, in a random order.

    The count inverts the distribution at a number hashed from the seed and doc_id, so it never depends on partitions or retries.
    Adds copy (0-based), rate and mix_key, the hashed place in the order: rows are dealt by mix_key and sorted by it within each
    partition. Rows that repeat an id get equal counts; null ids are hashed as empty text; a source of weight 0 gives no rows; null
    sources are one source; an empty table stays empty. Columns named copy, rate or mix_key are replaced."""
    key, cdf, given, number, draw = unused([*docs.columns, "rate", "copy", "mix_key"], "key", "cdf", "given", "number", "draw")
    same = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rates = checkpoint(source_rates(docs, targets, alpha).select(same.alias(key), F.col("rate").alias(given), F.col("cdf").alias(cdf)))
    rows = docs.drop("copy", "rate", "mix_key").withColumn(key, same)
    rows = salted_lookup(rows, rates, key, is_small(rates, 50_000), spread=F.col("doc_id"))
    count = F.coalesce(F.aggregate(cdf, F.lit(0), lambda n, c: F.when(c <= F.col(draw), n + 1).otherwise(n)), F.lit(0))
    rows = rows.withColumn(draw, uniform(seed, F.col("doc_id"))).withColumn(number, count).filter(F.col(number) > 0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(number).cast("long") - 1))).withColumnRenamed(given, "rate")
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}+"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary")))
    return rows.drop(key, cdf, draw, number).repartition("mix_key").sortWithinPartitions("mix_key")
