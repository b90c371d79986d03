"""Classifiers over series, their ensembles and their evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.functions.tables import settled
from seriesloom.operators.bags import chi_squared, dictionary
from seriesloom.operators.blocks import nearest_bags, nearest_by_setting


def bag_nearest(test: DataFrame, train: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keys, series_id, train_id, predicted, distance. Sum over the query's words of (q - t)^2; distance 0 and pairs without a common word don't
    count, so words of one of the two only never matter, and a series never finds itself. Ties go to the smaller train id; a series without a match isn't
    returned. keys tell apart runs that are done together (window and word lengths). Blocks of train are broadcast."""
    found = nearest_bags(test, train, keys)
    best = found.groupBy(*keys, "series_id").agg(F.min(F.struct("distance", "train_id", "train_label")).alias("b"))
    return best.select(*keys, "series_id", F.col("b.train_id").alias("train_id"), F.col("b.train_label").alias("predicted"), F.col("b.distance").alias("distance"))


def window_distances(test: DataFrame, train: DataFrame, width: int, same: bool = False, with_mean: bool = True, block: int = 256) -> DataFrame:
    """G1: series_id, train_id, train_label, distance: the sum over the query's disjoint windows of the least squared distance to any window of the
    train series. With `same`, a series isn't compared with itself. A query shorter than the width is one window of its own length.

    Queries and train series meet in pairs of blocks of `block` series; a task holds one pair."""
    counts = [max(1, -(-d.count() // block)) for d in (test, train)]
    left = test.withColumn("h", F.xxhash64("series_id")).select(F.lit(0).alias("side"), F.col("series_id").alias("id"), F.lit(0.0).alias("label"), "values", F.pmod("h", F.lit(counts[0])).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))).alias("j"))
    right = train.select(F.lit(1).alias("side"), F.col("series_id").alias("id"), F.col("label").cast("double").alias("label"), "values", F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1))).alias("i"), F.pmod(F.xxhash64("series_id"), F.lit(counts[1])).alias("j"))
    left, right = (d.withColumn("i", F.col("i").cast("int")).withColumn("j", F.col("j").cast("int")) for d in (left, right))

    def windows(x: np.ndarray, w: int, step: int) -> np.ndarray:
        v = np.lib.stride_tricks.sliding_window_view(x, w)[::step]
        mean = v.mean(1, keepdims=True)
        std = np.sqrt(np.maximum((v * v).mean(1, keepdims=True) - mean * mean, 0))
        return (v - mean * with_mean) / np.where(std > 0, std, 1)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        queries, trains = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        by_width: dict[int, list] = {}
        for qid, x in zip(queries["id"], queries["values"]):
            if not len(x):
                continue
            w = min(width, len(x))
            qw = windows(np.asarray(x, float), w, w)
            if w not in by_width:
                by_width[w] = [(tid, lab, windows(np.asarray(t, float), w, 1)) for tid, lab, t in zip(trains["id"], trains["label"], trains["values"]) if len(t) >= w]
            for tid, lab, tw in by_width[w]:
                if same and tid == qid:
                    continue
                d = (qw * qw).sum(1)[:, None] + (tw * tw).sum(1)[None, :] - 2 * qw @ tw.T
                out.append((qid, tid, lab, float(np.maximum(d, 0).min(1).sum())))
        return pd.DataFrame(out, columns=["series_id", "train_id", "train_label", "distance"])

    return left.unionByName(right).groupBy("i", "j").applyInPandas(one, "series_id long, train_id long, train_label double, distance double")


def window_nearest(distances: DataFrame, digits: int = 9, by: tuple[str, ...] = ()) -> DataFrame:
    """G2 for one width, or for each of the settings in the columns `by`: by, series_id, train_id, predicted, distance; ties to the smaller train id."""
    best = distances.groupBy(*by, "series_id").agg(F.min(F.struct(F.round("distance", digits).alias("distance"), "train_id", "train_label")).alias("b"))
    return best.select(*by, "series_id", F.col("b.train_id").alias("train_id"), F.col("b.train_label").alias("predicted"), F.col("b.distance").alias("distance"))


def window_sweep(train: DataFrame, widths: list[int], factor: float = 0.92, norms: tuple[bool, ...] = (True, False)) -> DataFrame:
    """Width, with_mean, correct, score of leave-one-out runs, those within the factor of the best."""
    by = ("width", "with_mean")
    found = window_nearest(nearest_by_setting(train, train, [(w, m) for m in norms for w in widths], same=True), by=by).join(train.select("series_id", "label"), "series_id")
    runs = found.groupBy(*by).agg(F.sum((F.col("predicted") == F.col("label")).cast("int")).alias("correct"), F.count(F.lit(1)).alias("n"))
    runs = train.sparkSession.createDataFrame([(w, m) for m in norms for w in widths], "width int, with_mean boolean").join(F.broadcast(runs), list(by), "left").fillna(0, ["n"])
    scored = settled(runs.withColumn("score", F.coalesce(F.col("correct") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))))
    return ensemble_filter(scored, factor).select("width", "with_mean", "correct", "n", "score")


def window_vote(models: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """series_id, predicted: nearest neighbours of each kept width and norm vote with the models' scores; ties go to the larger label."""
    settings = [(m["width"], m["with_mean"]) for m in models.orderBy("with_mean", "width").collect()]  # one row a setting
    found = window_nearest(nearest_by_setting(test, train, settings), by=("width", "with_mean"))
    votes = found.join(F.broadcast(models.select("width", "with_mean", "score")), ["width", "with_mean"]).select("series_id", F.col("predicted").alias("label"), F.col("score").alias("weight"))
    return weighted_vote(votes)


# ---- evaluation and ensembles -------------------------------------------------------------------


def stratified_folds(rows: DataFrame, k: int) -> DataFrame:
    """H3: adds fold: rows of each label dealt round robin in the order of their ids."""
    return rows.withColumn("fold", ((F.row_number().over(Window.partitionBy("label").orderBy("series_id")) - 1) % k).cast("int"))


def ensemble_filter(models: DataFrame, factor: float) -> DataFrame:
    """H4: models with a score of at least factor times the best."""
    best = models.agg(F.max("score").alias("best"))
    return models.join(F.broadcast(best), F.lit(True)).filter(F.col("score") >= F.col("best") * factor).drop("best")


def weighted_vote(votes: DataFrame) -> DataFrame:
    """H5: series_id, predicted; ties go to the larger label."""
    sums = votes.groupBy("series_id", "label").agg(F.sum("weight").alias("w"))
    return sums.groupBy("series_id").agg(F.max_by("label", F.struct("w", "label")).alias("predicted"))


def accuracy(predictions: DataFrame) -> DataFrame:
    """H6, H7: n, correct, error (three decimals), accuracy; a missing prediction is wrong."""
    sums = predictions.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce((F.col("predicted") == F.col("label")).cast("int"), F.lit(0))).alias("correct"))
    error = F.floor(1000.0 * (F.col("n") - F.col("correct")) / F.col("n") + 0.5) / 1000.0
    return sums.select("n", "correct", error.alias("error"), (1 - error).alias("accuracy"))


def earliness(decisions: DataFrame) -> DataFrame:
    """H8: label, n, earliness: the mean of min(1, offset / length)."""
    return decisions.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.least(F.lit(1.0), F.col("offset") / F.col("length"))).alias("earliness"))


def harmonic(accuracy_: Column, earliness_: Column) -> Column:
    """H9."""
    return 2 * accuracy_ * (1 - earliness_) / (accuracy_ + (1 - earliness_))


# ---- linear models over bags --------------------------------------------------------------------


def vectors(counts: DataFrame, known: DataFrame, features: list[str], size: int) -> DataFrame:
    """series_id, label, features (a sparse vector of `size`, the feature ids being its indexes); words outside the dictionary are dropped, series without
    any known word have an empty vector."""
    ids = counts.select("series_id", "label").distinct()
    repeated = F.array_repeat(F.col("feature_id").cast("string"), F.col("cnt").cast("int"))
    rows = counts.join(known, features).groupBy("series_id").agg(F.flatten(F.collect_list(repeated)).alias("tokens"))
    rows = ids.join(rows, "series_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], inputCol="tokens", outputCol="features")
    return model.transform(rows).select("series_id", F.col("label").cast("double").alias("label"), "features")


def linear_weights(train: DataFrame, features: list[str], chi: float = 2.0, cap: int | None = 10_000, within: tuple[str, ...] = (), iterations: int = 25) -> DataFrame:
    """Features, label, weight: one-vs-rest logistic regression without intercept and with C = 1, over bags of train whose features
    are selected by chi-squared (at most `cap` for each value of the `within` expressions). Labels may be any numbers. A row of null features tells a
    label without any weight."""
    train = settled(train)  # read for the features, the labels and the vectors
    kept = chi_squared(train, features, chi, cap, within).select(*features)
    known = settled(dictionary(kept, features))
    size = known.count() + 1
    labels = sorted(r["label"] for r in train.select(F.col("label").cast("double").alias("label")).distinct().collect())  # one a class
    at = {label: float(i) for i, label in enumerate(labels)}
    spark = train.sparkSession
    schema = "feature_id long, label double, weight double"
    if len(labels) > 1:
        learn = vectors(train, known, features, size).persist()  # every class and step reads it
        n = learn.count()
        number = F.create_map(*[F.lit(x) for pair in at.items() for x in pair])
        base = LogisticRegression(fitIntercept=False, standardization=False, regParam=1.0 / max(1, n), maxIter=iterations)
        model = OneVsRest(classifier=base, parallelism=8).fit(learn.withColumn("label", number[F.col("label")]))
        learn.unpersist()
        found = [(int(i), label, float(w[i])) for label, w in zip(labels, (m.coefficients.toArray() for m in model.models)) for i in np.flatnonzero(w)]
    else:
        found = []
    rows = spark.createDataFrame(found, schema).join(known, "feature_id").select(*features, "label", "weight")
    bare = spark.createDataFrame([(label,) for label in labels], "label double").select(*[F.lit(None).cast(known.schema[f].dataType).alias(f) for f in features], "label", F.lit(0.0).alias("weight"))
    return settled(rows.unionByName(bare))


def linear_predict(weights: DataFrame, test: DataFrame, series: DataFrame, features: list[str]) -> DataFrame:
    """series_id, label, predicted, probabilities (by ascending label) for each row of series(series_id, label). The margin of a label is the
    sum of counts times weights; probabilities are sigmoids scaled to sum 1; ties go to the smaller label."""
    labels = F.broadcast(weights.select(F.col("label").alias("to")).distinct())  # one row a class
    hits = test.join(weights.withColumnRenamed("label", "to"), features).groupBy("series_id", "to").agg(F.sum(F.col("cnt") * F.col("weight")).alias("margin"))
    rows = series.select("series_id", "label").join(labels, F.lit(True)).join(hits, ["series_id", "to"], "left")
    rows = rows.withColumn("p", 1 / (1 + F.exp(-F.coalesce("margin", F.lit(0.0)))))
    by = rows.groupBy("series_id", "label").agg(F.max_by("to", F.struct("p", -F.col("to"))).alias("predicted"), F.sort_array(F.collect_list(F.struct("to", "p"))).alias("all"), F.sum("p").alias("sum"))
    return by.select("series_id", F.col("label").cast("double").alias("label"), "predicted", F.transform("all", lambda x: x["p"] / F.col("sum")).alias("probabilities"))


def linear_fit_predict(train: DataFrame, test: DataFrame, features: list[str], chi: float = 2.0, cap: int | None = 10_000, iterations: int = 25) -> DataFrame:
    """series_id, label, predicted, probabilities of the test bags by a linear model of the train bags."""
    return linear_predict(linear_weights(train, features, chi, cap, (), iterations), test, test.select("series_id", "label").distinct(), features)


def one_class_svm(x: np.ndarray, nu: float = 0.05, gamma: float = 1.0, eps: float = 1e-4, steps: int = 20_000) -> tuple[np.ndarray, float]:
    """Alpha and rho of a one-class machine with a radial kernel, by sequential minimal optimisation."""
    n = len(x)
    kernel = np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    alpha = np.zeros(n)
    full = int(nu * n)
    alpha[:full] = 1.0
    if full < n:
        alpha[full] = nu * n - full
    g = kernel @ alpha
    for _ in range(steps):
        up, low = alpha < 1, alpha > 0
        i = int(np.argmin(np.where(up, g, np.inf)))
        j = int(np.argmax(np.where(low, g, -np.inf)))
        if g[j] - g[i] < eps:
            break
        quad = max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        step = min((g[j] - g[i]) / quad, 1 - alpha[i], alpha[j])
        alpha[i] += step
        alpha[j] -= step
        g += step * (kernel[:, i] - kernel[:, j])
    free = (alpha > 1e-9) & (alpha < 1 - 1e-9)
    rho = float(g[free].mean()) if free.any() else float((g[alpha > 0].max() + g[alpha < 1].min()) / 2) if (alpha < 1).any() else float(g.max())
    return alpha, rho


def one_class_predict(x: np.ndarray, alpha: np.ndarray, rho: float, gamma: float, at: np.ndarray) -> np.ndarray:
    """1 inside, -1 outside."""
    kernel = np.exp(-gamma * ((at[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    return np.where(kernel @ alpha - rho >= 0, 1, -1)


def master_features(probabilities: Column) -> Column:
    """The probabilities and the gap between the best one and the next; 0 for a tie, 1 for a single class."""
    ranked = F.sort_array(probabilities, asc=False)
    gap = F.when(F.size(probabilities) < 2, F.lit(1.0)).otherwise(F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)))
    return F.concat(probabilities, F.array(gap))


def early_decisions(snapshots: DataFrame, threshold: int, last: int | Column) -> DataFrame:
    """series_id, s, predicted: the first snapshot at which `threshold` accepted labels in a row are equal, or the last one.

    snapshots: series_id, s, label_at, accepted. Rejected snapshots don't break a row; at snapshot `last` (a number, or a column: the series' own length) a
    label is always accepted."""
    w = Window.partitionBy("series_id").orderBy("s")
    last = F.lit(last) if isinstance(last, int) else last
    rows = snapshots.withColumn("_last", last).filter(F.col("accepted") | (F.col("s") >= F.col("_last")))
    rows = rows.withColumn("change", F.coalesce((F.col("label_at") != F.lag("label_at").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("change").over(w))
    rows = rows.withColumn("in_row", F.row_number().over(Window.partitionBy("series_id", "run").orderBy("s")))
    done = rows.filter((F.col("in_row") >= threshold) | (F.col("s") >= F.col("_last")))
    return done.groupBy("series_id").agg(F.min(F.struct("s", "label_at")).alias("d")).select("series_id", F.col("d.s").alias("s"), F.col("d.label_at").alias("predicted"))


def fit_masters(rows: DataFrame, gammas: tuple[float, ...] = (100, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1.5, 1), nu: float = 0.05, most: int = 2_000) -> DataFrame:
    """S, gamma, share for each snapshot of rows(s, master array<double>, right boolean): the first gamma with the largest share of
    held-out points inside, over ten folds of the rightly predicted ones. At most `most` points of a snapshot train a machine (a classifier's
    bounded sample, in hashed order)."""
    w = Window.partitionBy("s").orderBy(F.xxhash64("series_id"), "series_id")
    known = rows.filter("right").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["master"].map(np.asarray)) if len(pdf) else np.zeros((0, 1))
        best = (gammas[0], -1.0)
        for gamma in gammas:
            inside = 0
            for f in range(min(10, len(x))):
                at = np.arange(len(x)) % 10 == f
                if (~at).sum():
                    alpha, rho = one_class_svm(x[~at], nu, gamma)
                    inside += int((one_class_predict(x[~at], alpha, rho, gamma, x[at]) == 1).sum())
            if len(x) and inside / len(x) > best[1]:
                best = (gamma, inside / len(x))
        return pd.DataFrame({"s": [int(pdf["s"].iloc[0])], "gamma": [float(best[0])], "share": [best[1]]})

    return known.groupBy("s").applyInPandas(one, "s int, gamma double, share double")
