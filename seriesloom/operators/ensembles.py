"""Ensembles and tuned classifiers: sweeps over window lengths, word lengths, normalisation and folds are columns of one table where the stage is
relational, and a loop over settings only where a model is fitted."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.tables import discard, settled
from seriesloom.operators import bags as B
from seriesloom.operators import classify as C
from seriesloom.operators import quantise as Q
from seriesloom.operators.bag_rows import bag_rows, fold_votes

KEYS = ("width", "f")

#: Series up to which their folds are broadcast.
BROADCAST_SERIES = 1_000_000


def setting_edges(train: DataFrame, widths: Iterable[int], longest: int, alphabet: int = 4, with_mean: bool = True) -> DataFrame:
    """Width, coef, edges: equi-depth edges of every window length, for words of up to `longest` symbols."""
    out = None
    for width in widths:
        one = Q.equi_depth_edges(Q.fourier_values(train, width, min(longest, width - width % 2), with_mean), alphabet).withColumn("width", F.lit(width))
        out = one if out is None else out.unionByName(one)
    return settled(out)


def bags_by_setting(series: DataFrame, edges: DataFrame, lengths: Iterable[int], alphabet: int = 4, with_mean: bool = True, once: bool | None = None) -> DataFrame:
    """width, f, series_id, label, word, cnt: bags of every window length of edges(width, coef, edges) and every word length. Words are made once at the
    longest length; shorter ones are their prefixes. once: whether each series has one row, if known; rows of one are counted together."""
    known: dict[int, list] = {}
    for row in edges.orderBy("width", "coef").collect():  # a few rows a window length
        known.setdefault(row["width"], []).append(row["edges"])
    rows = bag_rows(series, known, lengths, max(1, alphabet.bit_length() - 1), with_mean)
    if once is None and repeats(series) or once is False:
        return rows.groupBy("series_id", "label", "f", "word", "width").agg(F.sum("cnt").alias("cnt"))
    return rows


def repeats(series: DataFrame) -> bool:
    """Whether series have several rows."""
    return not series.groupBy("series_id", "label").count().filter("count > 1").isEmpty()


def _scores(found: DataFrame, truth: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    n = truth.count()
    hits = found.join(truth.select("series_id", "label"), "series_id").groupBy(*keys).agg(F.sum((F.col("predicted") == F.col("label")).cast("int")).alias("correct"))
    return hits.withColumn("score", F.col("correct") / F.lit(max(1, n)))


def _best_lengths(scores: DataFrame) -> DataFrame:
    """The word length with the best score of each window length; ties go to the shorter."""
    best = scores.groupBy("width").agg(F.max(F.struct("score", -F.col("f"), "f")).alias("b"))
    return best.select("width", F.col("b.f").alias("f"), F.col("b.score").alias("score"))


@dataclass
class Ensemble:
    """models(width, f, score), the training bags of those settings, the edges by window length, and how the models vote."""

    models: DataFrame
    bags: DataFrame
    edges: DataFrame
    votes: str
    alphabet: int = 4


def bag_ensemble(train: DataFrame, widths: Iterable[int], lengths: tuple[int, ...] = (6, 8, 10, 12, 14, 16), factor: float = 0.92) -> Ensemble:
    """Nearest neighbours by bags over all window lengths; leave-one-out on the training series scores each, and those within the factor of the
    best stay."""
    edges = setting_edges(train, widths, max(lengths))
    return _kept(_scored(train, edges, lengths, lambda bags: C.bag_nearest(bags, bags, KEYS)), factor, train, edges, "nearest")


def _scored(train: DataFrame, edges: DataFrame, lengths: tuple[int, ...], found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """_best_lengths of what found(bags) predicts. The bags of one window length stand on disk at a time."""
    out, once = None, not repeats(train)
    for row in edges.select("width").distinct().orderBy("width").collect():  # one row a window length
        bags = settled(bags_by_setting(train, edges.filter(F.col("width") == row["width"]), lengths, once=once))
        best = settled(_best_lengths(_scores(found(bags), train, KEYS)))
        discard(bags)
        out = best if out is None else out.unionByName(best)
    return out


def _kept(scores: DataFrame, factor: float, train: DataFrame, edges: DataFrame, votes: str) -> Ensemble:
    models = settled(C.ensemble_filter(scores, factor))
    few = F.broadcast(models.drop("score"))  # one row a window length
    lengths = sorted(r["f"] for r in models.select("f").distinct().collect())
    edges = settled(edges.join(F.broadcast(models.select("width")), "width", "left_semi"))
    bags = bags_by_setting(train, edges, lengths).join(few, list(KEYS), "left_semi")
    return Ensemble(models, settled(bags), edges, votes)


def vector_space_ensemble(train: DataFrame, widths: Iterable[int], lengths: tuple[int, ...] = (4, 6, 8, 10, 12, 14, 16), factor: float = 0.95, folds: int = 10) -> Ensemble:
    """Class vectors over all window lengths, scored by stratified folds. A fold is a column: its matrix leaves its own series out; a label that
    only the left out series have has an empty vector."""
    edges = setting_edges(train, widths, max(lengths))
    fold = settled(C.stratified_folds(train.select("series_id", "label"), folds).select("series_id", "fold"))
    fold = F.broadcast(fold) if fold.count() <= BROADCAST_SERIES else fold
    return _kept(_scored(train, edges, lengths, lambda bags: fold_votes(bags, fold, folds)), factor, train, edges, "vector")


def ensemble_predict(model: Ensemble, test: DataFrame) -> DataFrame:
    """series_id, predicted: votes of the models, weighted by their scores; ties go to the larger label."""
    kept = F.broadcast(model.models)  # one row a window length
    lengths = [r["f"] for r in model.models.select("f").distinct().collect()]
    bags = settled(bags_by_setting(test, model.edges, lengths, model.alphabet).join(kept.drop("score"), list(KEYS), "left_semi"))  # read several times
    if model.votes == "nearest":
        votes = C.bag_nearest(bags, model.bags, KEYS)
    else:
        votes = B.best_label(B.class_scores(bags, settled(B.tfidf(model.bags, KEYS)), KEYS), keys=KEYS)
    return C.weighted_vote(votes.join(kept, list(KEYS)).select("series_id", F.col("predicted").alias("label"), F.col("score").alias("weight")))


def equidistant_widths(longest: int, least: int = 10) -> list[int]:
    """Window lengths of the vector-space ensemble: about sqrt(longest) of them, the step cut to whole points at each addition; a step of 0 or a
    longest below the least gives what there is without looping."""
    count = int(math.sqrt(longest))
    step = (longest - least) / count if count else 0
    if longest < least or step < 1:
        return [longest] if longest >= least else []
    out, at = [], float(least)
    while at <= longest:
        out.append(int(at))
        at = int(at + step)
    return out
