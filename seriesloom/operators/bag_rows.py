"""Bags of series and the votes of class vectors over folds, vectorised: what is counted within a series, or within the rows of a word, needs no shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesloom.operators.blocks import lists, spread

#: Numbers of windows that stand at once; rows of whole words at once, each of which may hold a number for every fold and label.
NUMBERS_AT_ONCE, ROWS_AT_ONCE = 1 << 20, 20_000


def fourier_windows(windows: np.ndarray, length: int, skip_mean: bool) -> np.ndarray:
    """series.window_fourier of windows (last axis), bit by bit: the same operations in the same order, from the last point to the first."""
    width, k = windows.shape[-1], 0
    total, square = np.zeros(windows.shape[:-1]), np.zeros(windows.shape[:-1])
    back = [np.ascontiguousarray(windows[..., j]) for j in reversed(range(width))]
    for x in back:
        total += x
        square += x * x
    mean = total / width
    spread_out = square / width - mean * mean
    divisor = np.where((spread_out > 0) | np.isnan(spread_out), np.sqrt(np.maximum(spread_out, 0)), 1.0)
    out = np.zeros((length, *windows.shape[:-1]))
    for i in range(length):
        k = i // 2 + skip_mean
        if not (2 * k >= width and k > 0):
            wave = (math.cos, math.sin)[i % 2]
            for x, j in zip(back, reversed(range(width))):
                out[i] += x * wave(2 * math.pi * k * j / width)
            out[i] /= math.sqrt(width)
        out[i] /= divisor
    return out


def packed(values: np.ndarray, edges: list[list[float | None]], bits: int) -> np.ndarray:
    """Words of Fourier values (first axis: coefficients), as quantise.symbols and bags.packed_words; NaN is beyond any edge."""
    out = np.zeros(values.shape[1:], np.int64)
    for i, (v, line) in enumerate(zip(values[: 60 // bits], edges)):
        symbol = np.zeros(v.shape, np.int64)
        for e in line:
            if e is not None:
                symbol += (v >= e) | np.isnan(v)
        out += symbol << (i * bits)
    return out


def bag_rows(series: DataFrame, edges: dict[int, list[list[float | None]]], lengths: Iterable[int], bits: int, with_mean: bool) -> DataFrame:
    """series_id, label, f, word, cnt, width: the bags of each row of series(series_id, label, values) for every window length of edges (the edges of its
    coefficients in order) and every word length; words are made once at the longest length."""
    rows = spread(series.select(F.col("series_id").cast("long").alias("series_id"), "label", F.col("values").cast("array<double>").alias("values")))
    fields = StructType().add("series_id", "long").add(rows.schema["label"]).add("f", "integer").add("word", "long").add("cnt", "long").add("width", "integer")
    lengths = sorted(lengths)

    def counted(width: int, points: np.ndarray, empty: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(f, row, word, count) of series of one length."""
        view = np.lib.stride_tricks.sliding_window_view
        words = packed(fourier_windows(view(points, width, 1), len(edges[width]), with_mean), edges[width], bits)
        if empty.any():  # a window with a missing point has no values, so no edge is below them
            words[view(empty, width, 1).any(-1)] = 0
        for f in lengths:
            if f <= len(edges[width]):
                cut = words & ((1 << bits * f) - 1)
                new = np.ones(cut.shape, bool)
                new[:, 1:] = cut[:, 1:] != cut[:, :-1]
                row, word = np.nonzero(new)[0], cut[new]
                order = np.lexsort((word, row))
                row, word = row[order], word[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])]))
                yield f, row[first], word[first], np.diff(np.append(first, len(row)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2)
            flat, line = values.flatten(), lists(values)
            empty = np.split(flat.is_null().to_numpy(zero_copy_only=False), np.cumsum([len(x) for x in line])[:-1])
            sizes = np.array([len(x) for x in line])
            for size in np.unique(sizes).tolist():
                for width in edges:
                    own = np.flatnonzero(sizes == size)
                    step = max(1, NUMBERS_AT_ONCE // max(1, size * width))
                    for at in range(0, len(own) if size >= width else 0, step):
                        part = own[at : at + step]
                        for f, row, word, count in counted(width, np.stack([line[i] for i in part]).astype(float), np.stack([empty[i] for i in part])):
                            of, n = pa.array(part[row]), len(row)
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array([f] * n, pa.int32()), pa.array(word), pa.array(count), pa.array([width] * n, pa.int32())], names=fields.names)

    return rows.mapInArrow(run, fields)


def fold_votes(bags: DataFrame, fold: DataFrame, folds: int) -> DataFrame:
    """width, f, series_id, predicted: the label that class vectors of all series but those of a series' own fold score best, for bags(width, f, series_id,
    label, word, cnt) and fold(series_id, fold). As bags.tfidf, empty_classes, class_scores and best_label of each fold's bags; a label that only the left out series have has an
    empty vector.

    Rows meet by word. A word's counts for a fold are those of all rows without the fold's own, so no row is copied for each fold."""
    dealt = bags.join(fold, "series_id").select("width", "f", "word", "series_id", F.col("label").cast("double").alias("label"), "cnt", "fold")
    seen = dealt.select("width", "f", "label", "fold").distinct().collect()  # one row a label and fold
    labels = np.array(sorted({r["label"] for r in seen if r["label"] is not None}))
    many = len(labels) + any(r["label"] is None for r in seen)  # series without a label are a class that nothing is predicted from
    place = {x: i for i, x in enumerate(labels.tolist())}
    held: dict[tuple[int, int], np.ndarray] = {}
    for r in seen:
        held.setdefault((r["width"], r["f"]), np.zeros((many, folds), bool))[place.get(r["label"], len(labels)), r["fold"]] = True
    classes = {k: ((h.sum(1)[:, None] - h) > 0).sum(0) for k, h in held.items()}  # labels of the series outside of a fold
    if not len(labels):
        return dealt.select("width", "f", "series_id", F.col("label").alias("predicted")).limit(0)

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Setting, and of its rows, whole words at a time: word number, series, label, count, fold, and which are the only row of their word."""
        kept: pa.Table | None = None

        def out(rows: pa.Table) -> Iterator[tuple]:
            width, f, word, series, label, count, fold = (c.to_numpy() for c in rows.columns)
            new = np.flatnonzero(np.concatenate([[True], (width[1:] != width[:-1]) | (f[1:] != f[:-1])]))
            for lo, hi in zip(new, [*new[1:], len(word)]):
                own = slice(lo, hi)
                at = np.cumsum(np.concatenate([[0], word[own][1:] != word[own][:-1]]))
                lab = np.where(np.isnan(label[own]), len(labels), np.searchsorted(labels, np.nan_to_num(label[own], nan=labels[-1])))
                yield (int(width[lo]), int(f[lo])), at, series[own], lab, count[own], fold[own], np.bincount(at)[at] == 1

        for batch in batches:
            kept = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if kept.num_rows >= ROWS_AT_ONCE:
                key = [kept[c].to_numpy() for c in ("width", "f", "word")]
                last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from out(kept.slice(0, cut))
                    kept = kept.slice(cut)
        if kept is not None and kept.num_rows:
            yield from out(kept)

    def weights(setting: tuple[int, int], at: np.ndarray, lab: np.ndarray, count: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Raw weights by word, label and fold."""
        shape = (int(at.max(initial=-1)) + 1, many, folds)
        tf = np.bincount((at * many + lab) * folds + fold, count, math.prod(shape)).reshape(shape)
        tf = tf.sum(2, keepdims=True) - tf
        df, c = (tf > 0).sum(1), classes[setting][None, :]
        rare = np.where((df > 0) & (df < c), 1 / np.log10(1 + c / np.maximum(df, 1)), 0.0)
        return np.where(tf > 0, 1 + np.log10(np.maximum(tf, 1)), 0.0) * rare[:, None, :]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for setting, at, _, lab, count, fold, lone in by_word(batches):
            some, c = np.flatnonzero(~lone), classes[setting][None, :]
            raw = weights(setting, np.unique(at[some], return_inverse=True)[1], lab[some], count[some], fold[some])
            alone = np.bincount(lab[lone] * folds + fold[lone], (1 + np.log10(count[lone])) ** 2, many * folds).reshape(many, folds)
            alone = np.where(c > 1, (alone.sum(1, keepdims=True) - alone) / np.log10(1 + np.maximum(c, 1)) ** 2, 0.0)  # the word is there for all folds but its own
            sums[setting] = sums.get(setting, 0.0) + (raw * raw).sum(0) + alone
        for (width, f), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([f], pa.int32()), pa.array([s.ravel().tolist()])], names=["width", "f", "squares"])

    together = dealt.repartition("width", "f", "word").sortWithinPartitions("width", "f", "word")
    norm: dict[tuple[int, int], np.ndarray] = {k: np.zeros((many, folds)) for k in held}
    for r in together.mapInArrow(squares, "width int, f int, squares array<double>").select("width", "f", F.posexplode("squares")).groupBy("width", "f", "pos").agg(F.sum("col").alias("s")).collect():  # one row a label and fold
        norm[r["width"], r["f"]].flat[r["pos"]] = math.sqrt(r["s"])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a row adds to each label; to the first one at least 0, with the row's count."""
        for (width, f), at, series, lab, count, fold, lone in by_word(batches):
            n, some = norm[width, f], np.flatnonzero(~lone)  # a lone row's word is in no other fold
            at = np.unique(at[some], return_inverse=True)[1]
            raw = weights((width, f), at, lab[some], count[some], fold[some])
            weight = np.divide(raw, n[None], out=np.zeros_like(raw), where=np.broadcast_to(n[None] > 0, raw.shape))[:, : len(labels)]
            hit = weight[at, :, fold[some]] * count[some, None]
            who, place = np.unique(series, return_inverse=True)
            sums = np.stack([np.bincount(place[some], h, len(who)) for h in hit.T]).astype(float)
            size = np.bincount(place, count, len(who))
            some = sums > 0
            some[0] = True
            lab, i = np.nonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array([width] * len(i), pa.int32()), pa.array([f] * len(i), pa.int32()), pa.array(who[i]), pa.array(labels[lab]), pa.array(sums[lab, i]), pa.array(np.where(lab == 0, size[i], 0.0))], names=["width", "f", "series_id", "label", "hit", "size"])

    found = together.mapInArrow(hits, "width int, f int, series_id long, label double, hit double, size double")
    found = found.groupBy("width", "f", "series_id", "label").agg(F.sum("hit").alias("hit"), F.sum("size").alias("size"))
    by = found.groupBy("width", "f", "series_id").agg(F.collect_list(F.struct("label", "hit")).alias("p"), F.sum("size").alias("size"))  # a few labels a series
    best = F.array_max(F.transform("p", lambda p: F.struct((F.col("size") + p["hit"]).alias("score"), (-p["label"]).alias("turned"), p["label"].alias("label"))))
    return by.select("width", "f", "series_id", best["label"].alias("predicted"))
