"""Similarity search over windows: exact k nearest and range answers for a table of queries, pruned by boxes and lower bounds, approximate search by word
prefix, and index tables that can be written, loaded, merged, checked and described.

The index is a table (series_id, offset, word, fourier, values) that can be written partitioned by a word prefix, so that a search reads only
the prefixes whose box can hold an answer. Queries are rows; the best k are kept for each of them inside the tasks first."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.functions.representations import squared
from seriesloom.functions.series import divisor, fourier, let, mean, raw_windows, znorm
from seriesloom.functions.tables import settled
from seriesloom.operators.blocks import lists, normalised, past_blocks, spread
from seriesloom.operators.quantise import symbols, with_edges


def whole_index(series: DataFrame, edges: DataFrame, width: int, length: int) -> DataFrame:
    """one row a series: series_id, offset 0, values (normalised), fourier, word."""
    rows = series.select("series_id", F.lit(0).alias("offset"), znorm(F.col("values")).alias("values"))
    rows = with_edges(rows.withColumn("fourier", fourier(F.col("values"), width, length)), edges)
    return rows.withColumn("word", symbols(F.col("fourier"), F.col("all_edges"))).drop("all_edges")


def window_index(series: DataFrame, edges: DataFrame, width: int, length: int) -> DataFrame:
    """one row a window of stride 1."""
    rows = series.filter(F.size("values") >= width).select("series_id", F.posexplode(raw_windows(F.col("values"), width)).alias("offset", "w"))
    rows = rows.withColumn("values", znorm(F.col("w"))).drop("w")
    rows = with_edges(rows.withColumn("fourier", fourier(F.col("values"), width, length)), edges)
    return rows.withColumn("word", symbols(F.col("fourier"), F.col("all_edges"))).drop("all_edges")


def prefix_of(word: Column, depth: int) -> Column:
    return F.array_join(F.slice(word, 1, depth).cast("array<string>"), "")


def write_index(index: DataFrame, path: str, depth: int = 2) -> None:
    """Parquet partitioned by the first symbols; a hot prefix is spread over tasks by the rebalance. The boxes of the prefixes are written beside."""
    rows = index.withColumn("prefix", prefix_of(F.col("word"), depth))
    rows.hint("rebalance", F.col("prefix")).write.partitionBy("prefix").parquet(f"{path}/windows")
    boxes(index, depth).write.parquet(f"{path}/boxes")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The windows (with their prefix) and the boxes of a written index."""
    windows = spark.read.option("basePath", f"{path}/windows").schema("series_id long, offset int, values array<double>, fourier array<double>, word array<int>, prefix string").parquet(f"{path}/windows")
    return windows, spark.read.parquet(f"{path}/boxes")


def merge_indexes(one: DataFrame, other: DataFrame) -> DataFrame:
    """an index of the windows of both, which must have the same edges."""
    return one.unionByName(other)


def merge_boxes(one: DataFrame, other: DataFrame) -> DataFrame:
    """the boxes of a merged index, without reading its windows."""
    rows = one.unionByName(other).select("prefix", "size", F.posexplode(F.arrays_zip("low", "high")).alias("i", "b"))
    ends = rows.groupBy("prefix", "i").agg(F.min("b.low").alias("lo"), F.max("b.high").alias("hi"), F.sum("size").alias("n"))
    return _as_boxes(ends)


def window_distance(window: Column, query: Column) -> Column:
    """squared distance of a query to a window that is normalised on the way."""
    return let(F.struct(mean(window).alias("m"), divisor(window).alias("s")), lambda p: squared(F.transform(window, lambda x: (x - p["m"]) / p["s"]), query))


def fourier_bound(a: Column, b: Column) -> Column:
    """Squared lower bound of the distance of two mean-removed windows."""
    return squared(a, b) * 2.0


def box_bound(fourier_: Column, low: Column, high: Column) -> Column:
    """squared lower bound of the distance to any window in a box."""
    gap = F.zip_with(F.zip_with(fourier_, low, lambda v, m: F.greatest(m - v, F.lit(0.0))), F.zip_with(fourier_, high, lambda v, m: F.greatest(v - m, F.lit(0.0))), lambda x, y: F.greatest(x, y))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + 2.0 * g * g)


def as_queries(rows: DataFrame) -> DataFrame:
    """Rows of an index as queries: query_id (series_id), q_values, q_fourier, q_word."""
    return rows.select(F.col("series_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in ("values", "fourier", "word")])


def first_rows(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; ties (of distances rounded to nine decimals) by series and offset."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "series_id", "offset"))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "series_id", "offset", squared(F.col("values"), F.col("q_values")).alias("distance"))


def approximate(index: DataFrame, queries: DataFrame, k: int, depth: int) -> DataFrame:
    """for each query the k nearest among the windows whose word begins as the query's. Queries meet windows by an equi-join on the prefix."""
    rows = index.withColumn("_p", prefix_of(F.col("word"), depth)).join(queries.withColumn("_p", prefix_of(F.col("q_word"), depth)), "_p")
    return first_rows(_found(rows), k)


def candidates(index: DataFrame, box: DataFrame, asked: DataFrame, depth: int) -> DataFrame:
    """windows with each query of asked(query_id, q_values, q_fourier, radius) whose radius reaches their prefix's box and, by the Fourier bound, them.
    A null radius reaches all. Of a written index only the reached prefixes are read."""
    reach = box_bound(F.col("q_fourier"), F.col("low"), F.col("high"))
    pairs = box.select("prefix", "low", "high").join(F.broadcast(asked), F.col("radius").isNull() | (reach <= F.col("radius") + 1e-9)).drop("low", "high")
    rows = index if "prefix" in index.columns else index.withColumn("prefix", prefix_of(F.col("word"), depth))
    return rows.join(pairs, "prefix").filter(F.col("radius").isNull() | (fourier_bound(F.col("fourier"), F.col("q_fourier")) <= F.col("radius") + 1e-9))


def nearest(index: DataFrame, queries: DataFrame, k: int, box: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """query_id, series_id, offset, distance: the k nearest windows of each query. Those under the query's own prefix give a radius; only
    prefixes whose box comes nearer are searched."""
    box = settled(boxes(index, depth)) if box is None else box
    seeds = approximate(index, queries, k, depth).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("radius"))
    asked = settled(queries.select("query_id", "q_values", "q_fourier").join(seeds, "query_id", "left"))
    return first_rows(_found(candidates(index, box, asked, depth)), k)


def within(index: DataFrame, queries: DataFrame, epsilon: float, box: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """F8: for each query the windows strictly nearer than epsilon (squared distance); overlapping windows all count."""
    box = settled(boxes(index, depth)) if box is None else box
    asked = queries.select("query_id", "q_values", "q_fourier").withColumn("radius", F.lit(float(epsilon)))
    return _found(candidates(index, box, asked, depth)).filter(F.col("distance") < epsilon)


def scanned(series: DataFrame, edges: DataFrame, width: int, length: int, queries: DataFrame, depth: int, k: int | None = None, epsilon: float | None = None, own_prefix: bool = False) -> DataFrame:
    """Searches an index that is never written: query_id, series_id, offset, distance of each query's k nearest windows (with own_prefix of those whose
    word begins as the query's: F7, else F9), or of all strictly nearer than epsilon (F8). The windows are those of window_index.

    Queries are broadcast by blocks. Windows are made, given words and grouped by prefix in the task that reads their series; a group meets
    only the queries whose radius (the k-th nearest so far in the task, or epsilon) reaches its box, by a matrix product. What may be near enough is
    worked out again in full precision."""
    scale = math.sqrt(width)
    turn = lambda i: (math.cos, math.sin)[i % 2]
    waves = np.array([[turn(i)(2 * math.pi * (i // 2 + 1) * j / width) / scale * (2 * (i // 2 + 1) < width) for i in range(length)] for j in range(width)])
    cuts = [np.array([np.inf if e is None else e for e in r["edges"]]) for r in edges.orderBy("coef").select("edges").collect()]  # one row a coefficient

    def make(block: pa.Table) -> tuple[np.ndarray, ...]:
        values, fourier_, word = (np.array(lists(block[f"q_{c}"])).reshape(block.num_rows, -1) for c in ("values", "fourier", "word"))
        return block["query_id"].to_numpy(), values, fourier_, word[:, :depth]

    def run(asked: tuple[np.ndarray, ...], rows: pa.Table, kept: dict) -> Iterator[pa.RecordBatch]:
        ids, q, qf, qw = asked
        values = lists(rows["values"])
        long = [i for i in range(len(values)) if len(values[i]) >= width]
        if not long or not len(ids):
            return
        cut = [np.lib.stride_tricks.sliding_window_view(values[i], width) for i in long]
        sizes = [len(c) for c in cut]
        v = normalised(np.concatenate(cut), True)
        series_id, offset = np.repeat(rows["series_id"].to_numpy()[long], sizes), np.concatenate([np.arange(n) for n in sizes])
        f = v @ waves
        word = np.stack([(f[:, [i]] >= cuts[i]).sum(1) for i in range(depth)], 1)
        prefixes, group = np.unique(word, axis=0, return_inverse=True)
        order = np.argsort(group.ravel(), kind="stable")
        v, f, series_id, offset = v[order], f[order], series_id[order], offset[order]
        ends = np.cumsum(np.bincount(group.ravel()))
        best = kept.setdefault("best", np.full((len(ids), k or 1), np.inf if epsilon is None else epsilon))
        radius, first = best[:, -1].copy(), not np.isfinite(best[:, -1]).all()
        square = (q * q).sum(1)
        left, found = np.concatenate([q * -2.0, np.ones((len(q), 1))], 1).astype(np.float32), []
        slack = 1e-5 * (square + width + 1)
        for g, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            low, high = f[lo:hi].min(0), f[lo:hi].max(0)
            gap = np.maximum(np.maximum(low - qf, qf - high), 0)
            near = (qw == prefixes[g]).all(1) if own_prefix else 2 * (gap * gap).sum(1) <= radius + 1e-6
            reached = np.flatnonzero(near)
            right = np.concatenate([v[lo:hi], (v[lo:hi] ** 2).sum(1, keepdims=True)], 1).astype(np.float32).T
            for at in range(0, len(reached), 256):
                own = reached[at : at + 256]
                d = left[own] @ right + square[own].astype(np.float32)[:, None]
                if k is not None and hi - lo >= k and first:
                    radius[own] = np.minimum(radius[own], np.partition(d, k - 1, axis=1)[:, k - 1] + slack[own])
                i, j = np.nonzero(d <= (radius[own] + slack[own]).astype(np.float32)[:, None])
                found.append((own[i], j + lo, d[i, j]))
        if not found:
            return
        i, j, d = (np.concatenate(x) for x in zip(*found))
        few = d <= radius[i] + 2 * slack[i]  # radii have shrunk since
        i, j = i[few], j[few]
        d = np.concatenate([((v[j[at : at + 100_000]] - q[i[at : at + 100_000]]) ** 2).sum(1) for at in range(0, len(i), 100_000)] or [np.zeros(0)])
        if epsilon is not None:
            some = np.flatnonzero(d < epsilon)
        else:
            some = np.lexsort((offset[j], series_id[j], np.round(d, 9), i))
            rank = np.arange(len(some)) - np.searchsorted(i[some], i[some])
            some, rank = some[rank < k], rank[rank < k]
            new = np.full(best.shape, np.inf)
            new[i[some], rank] = d[some]
            kept["best"] = np.sort(np.concatenate([best, new], 1), 1)[:, : best.shape[1]]
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[part]]), pa.array(series_id[j[part]]), pa.array(offset[j[part]].astype(np.int32)), pa.array(d[part])], names=["query_id", "series_id", "offset", "distance"])

    rows = spread(series.select(F.col("series_id").cast("long").alias("series_id"), F.col("values").cast("array<double>").alias("values")))
    out = past_blocks(rows, queries.withColumn("query_id", F.col("query_id").cast("long")), F.lit(width + 2 * length), "query_id", make, run, "query_id long, series_id long, offset int, distance double")
    return out if k is None else first_rows(out, k)


def boxes(index: DataFrame, depth: int) -> DataFrame:
    """prefix, size, low and high of each Fourier value under it."""
    rows = index.select(prefix_of(F.col("word"), depth).alias("prefix"), F.posexplode("fourier").alias("i", "v"))
    return _as_boxes(rows.groupBy("prefix", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")))


def _as_boxes(ends: DataFrame) -> DataFrame:
    return ends.groupBy("prefix").agg(F.max("n").alias("size"), F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("box")).select("prefix", "size", F.col("box.lo").alias("low"), F.col("box.hi").alias("high"))


def leaves(index: DataFrame, length: int, threshold: int, least: int = 1) -> DataFrame:
    """prefix, depth, size of the leaves of the trie: the shortest prefix of each word, of at least `least` symbols, under which at most `threshold`
    windows lie, or the whole word."""
    depths = range(least, length + 1)
    words = index.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("n", *[prefix_of(F.col("word"), d).alias(f"p{d}") for d in depths])
    words = settled(words)  # one row a word
    for d in depths:
        words = words.join(words.groupBy(f"p{d}").agg(F.sum("n").alias(f"n{d}")), f"p{d}")
    leaf = lambda d: F.struct(F.col(f"p{d}").alias("prefix"), F.lit(d).alias("depth"), F.col(f"n{d}").alias("size"))
    found = F.coalesce(*[F.when(F.col(f"n{d}") <= threshold, leaf(d)) for d in depths[:-1]], leaf(length))
    return words.select(found.alias("leaf")).select("leaf.*").distinct()


def compacted(found: DataFrame, threshold: int) -> DataFrame:
    """parent, first, last, leaves, size: neighbouring leaves of one parent together, from the left, as long as they hold at most `threshold` windows.
    A parent has as many children as the alphabet has symbols."""
    by = found.groupBy(F.expr("substring(prefix, 1, length(prefix) - 1)").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("prefix", F.col("size").cast("long").alias("size")))).alias("line"))

    def step(acc: Column, leaf: Column) -> Column:
        one = F.struct(leaf["prefix"].alias("first"), leaf["prefix"].alias("last"), F.lit(1).alias("leaves"), leaf["size"].alias("size"))
        top = F.element_at(acc, -1)
        joined = F.struct(top["first"].alias("first"), leaf["prefix"].alias("last"), (top["leaves"] + 1).alias("leaves"), (top["size"] + leaf["size"]).alias("size"))
        fits = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, top["size"]).otherwise(F.lit(0)) + leaf["size"] <= threshold)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(one)))

    kind = "array<struct<first: string, last: string, leaves: int, size: bigint>>"
    groups = F.aggregate("line", F.array().cast(kind), lambda acc, leaf: step(acc, leaf).cast(kind))
    return by.select("parent", F.explode(groups).alias("g")).select("parent", "g.*")


def statistics(found: DataFrame) -> DataFrame:
    """One row: windows, leaves, inner (nodes above the leaves, the root included), height, largest leaf."""
    inner = found.select(F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("d"), "prefix").select(F.expr("substring(prefix, 1, d)").alias("node")).distinct()
    counts = found.agg(F.sum("size").cast("long").alias("windows"), F.count(F.lit(1)).alias("leaves"), F.max("depth").cast("int").alias("height"), F.max("size").cast("long").alias("largest"))
    return counts.join(inner.agg(F.count(F.lit(1)).alias("inner")), F.lit(True))


def violations(index: DataFrame, box: DataFrame, depth: int) -> DataFrame:
    """rows of an index that break its rules: no box for their prefix, a value outside of it, or a box whose size isn't its number of windows."""
    rows = index.withColumn("prefix", prefix_of(F.col("word"), depth)).join(box, "prefix", "full")
    outside = F.col("low").isNull() | F.col("series_id").isNull() | (box_bound(F.col("fourier"), F.col("low"), F.col("high")) > 0)
    sizes = rows.groupBy("prefix").agg(F.count("series_id").alias("n"), F.max("size").alias("size")).filter("n <> size")
    return rows.filter(outside).select("prefix", "series_id", "offset").unionByName(sizes.select("prefix", F.lit(None).cast("long").alias("series_id"), F.lit(None).cast("int").alias("offset")))


def same_index(one: DataFrame, other: DataFrame) -> bool:
    """whether two indexes hold the same windows with the same words."""
    a, b = (d.groupBy("series_id", "offset", "word").count() for d in (one, other))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
