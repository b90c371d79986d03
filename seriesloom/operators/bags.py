"""Bags of words: counts of words and word pairs by series, class weights, feature selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.functions.series import pack
from seriesloom.functions.tables import settled


def packed_words(words: DataFrame, bits: int) -> DataFrame:
    """words becomes array<bigint>."""
    return words.withColumn("words", F.transform("words", lambda w: pack(w, bits)))


def reduced(words: Column) -> Column:
    """Numerosity reduction: a word equal to the one before it isn't counted."""
    return F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1)))


def bag(words: DataFrame, reduce: bool = True) -> DataFrame:
    """series_id, label, word, cnt. words: series_id, label, words (packed)."""
    kept = reduced(F.col("words")) if reduce else F.col("words")
    return words.select("series_id", "label", F.explode(kept).alias("word")).groupBy("series_id", "label", "word").agg(F.count(F.lit(1)).alias("cnt"))


def bigram_bag(words: DataFrame, width: int, skip_zero: bool = True) -> DataFrame:
    """series_id, label, prev, word, cnt: every word with prev -1, and pairs with the word `width` offsets before; with skip_zero not if that
    word is 0."""
    ws = F.col("words")
    pairs = F.transform(ws, lambda w, i: F.struct(F.coalesce(F.get(ws, F.when(i >= width, i - width)), F.lit(-1).cast("long")).alias("prev"), w.alias("word")))
    pairs = F.filter(pairs, lambda p: (p["prev"] > 0) if skip_zero else (p["prev"] >= 0))
    single = F.transform(ws, lambda w: F.struct(F.lit(-1).cast("long").alias("prev"), w.alias("word")))
    rows = words.select("series_id", "label", F.explode(F.concat(single, pairs)).alias("p"))
    return rows.groupBy("series_id", "label", F.col("p.prev").alias("prev"), F.col("p.word").alias("word")).agg(F.count(F.lit(1)).alias("cnt"))


def empty_classes(matrix: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """E5: the matrix with a row of null word and weight 0 for each label of labels(keys, label) that it lacks, so that every label is scored."""
    missing = labels.select(*keys, "label").distinct().join(matrix.select(*keys, "label").distinct(), [*keys, "label"], "left_anti")
    return matrix.unionByName(missing.select(*keys, "label", F.lit(None).cast("long").alias("word"), F.lit(0.0).alias("weight")))


def tfidf(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keys, label, word, weight: (1 + log10 tf) divided by log10(1 + C / df), C labels; 0 for words of all labels; each label's vector of
    length 1. keys tell apart matrices that are built together (folds, word lengths)."""
    tf = counts.groupBy(*keys, "label", "word").agg(F.sum("cnt").cast("double").alias("tf"))
    df = tf.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("df"))
    classes = counts.select(*keys, "label").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("classes"))  # one row a matrix
    rows = tf.join(df, [*keys, "word"])
    rows = rows.join(F.broadcast(classes), list(keys)) if keys else rows.join(F.broadcast(classes), F.lit(True))
    raw = F.when(F.col("df") == F.col("classes"), F.lit(0.0)).otherwise((1 + F.log10("tf")) / F.log10(1 + F.col("classes") / F.col("df")))
    rows = rows.select(*keys, "label", "word", raw.alias("raw"))
    norm = rows.groupBy(*keys, "label").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))  # one row a label
    return rows.join(norm, [*keys, "label"]).select(*keys, "label", "word", F.when(F.col("norm") > 0, F.col("raw") / F.col("norm")).otherwise(F.lit(0.0)).alias("weight"))


def chi_squared(counts: DataFrame, features: list[str], limit: float = 2.0, cap: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """The features and chi, the largest over labels of (observed - expected)^2 / expected by documents; kept if chi >= limit, with a cap the
    largest (ties by feature) of all, or of each value of the `within` expressions (window length, single words or pairs)."""
    seen = counts.select("series_id", "label", *features).distinct()
    priors = counts.select("series_id", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    total = priors.agg(F.sum("of_label").alias("docs"))
    observed = seen.groupBy(*features, "label").agg(F.count(F.lit(1)).alias("obs"))
    feature = observed.groupBy(*features).agg(F.sum("obs").alias("all"))
    by_label = F.broadcast(priors.join(F.broadcast(total), F.lit(True)))  # one row a label
    rows = feature.join(by_label, F.lit(True)).join(observed, [*features, "label"], "left")
    expected = F.col("all") * F.col("of_label") / F.col("docs")
    rows = rows.withColumn("chi", F.pow(F.coalesce("obs", F.lit(0)) - expected, F.lit(2.0)) / expected)
    out = rows.groupBy(*features).agg(F.max("chi").alias("chi")).filter(F.col("chi") >= limit)
    if cap is None:
        return out
    if not within:
        return out.orderBy(F.desc("chi"), *features).limit(cap)
    rank = F.row_number().over(Window.partitionBy(*[F.expr(e) for e in within]).orderBy(F.desc("chi"), *features))
    return out.withColumn("_rank", rank).filter(F.col("_rank") <= cap).drop("_rank")


def chi_squared_tail(x: float, freedom: int) -> float:
    """1 - CDF of the chi-squared distribution, by series or continued fraction of the incomplete gamma function."""
    if x <= 0 or freedom < 1:
        return 1.0
    a, z = freedom / 2, x / 2
    head = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - head * total)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def chi_squared_by_p(counts: DataFrame, features: list[str], p_limit: float = 0.05) -> DataFrame:
    """Features and chi, summed over labels, with 1 - CDF(chi; labels - 1) <= p_limit. The limit on chi is found once, by bisection."""
    seen = counts.select("series_id", "label", *features).distinct()
    priors = counts.select("series_id", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    classes, docs = priors.agg(F.count(F.lit(1)), F.sum("of_label")).first()
    lo, hi = 0.0, 1e4
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_squared_tail(mid, classes - 1) > p_limit else (lo, mid)
    observed = seen.groupBy(*features, "label").agg(F.count(F.lit(1)).alias("obs"))
    feature = observed.groupBy(*features).agg(F.sum("obs").alias("all"))
    rows = feature.join(F.broadcast(priors), F.lit(True)).join(observed, [*features, "label"], "left")
    expected = F.col("all") * F.col("of_label") / F.lit(docs or 1)
    rows = rows.withColumn("chi", F.pow(F.coalesce("obs", F.lit(0)) - expected, F.lit(2.0)) / expected)
    return rows.groupBy(*features).agg(F.sum("chi").alias("chi")).filter(F.col("chi") >= hi)


def dictionary(counts: DataFrame, features: list[str]) -> DataFrame:
    """Features and feature_id, dense from 1 in the order of the features.

    Ids come from ranks within ranges of the features and the sizes of the ranges before, so no task ranks all of them."""
    known = settled(counts.select(*features).distinct().repartitionByRange(*features).withColumn("_part", F.spark_partition_id()))
    sizes = known.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("n")).alias("before"))  # one row a range
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy("_part").orderBy(*features)))
    return ranked.join(F.broadcast(before), "_part").select(*features, (F.col("rank") + F.col("before")).cast("long").alias("feature_id"))


def class_scores(counts: DataFrame, matrix: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keys, series_id, label, score = sum of cnt * (weight + 1) over a series' words, for each label of the matrix."""
    labels = matrix.select(*keys, "label").distinct()  # one row a label
    size = counts.groupBy(*keys, "series_id").agg(F.sum("cnt").cast("double").alias("all"))
    hits = counts.drop("label").join(matrix, [*keys, "word"]).groupBy(*keys, "series_id", "label").agg(F.sum(F.col("cnt") * F.col("weight")).alias("hit"))
    rows = size.join(F.broadcast(labels), list(keys)) if keys else size.join(F.broadcast(labels), F.lit(True))
    return rows.join(hits, [*keys, "series_id", "label"], "left").select(*keys, "series_id", "label", (F.col("all") + F.coalesce("hit", F.lit(0.0))).alias("score"))


def best_label(scores: DataFrame, score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """The label with the largest score above 0; ties go to the smaller label."""
    top = F.max_by("label", F.struct(F.col(score), -F.col("label")))
    return scores.filter(F.col(score) > 0).groupBy(*keys, "series_id").agg(top.alias("predicted"))
