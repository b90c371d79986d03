"""Symbolic words: Fourier values of windows, cut into symbols by edges that are learned for each coefficient.

Models are small tables, one row a coefficient: (coef, edges). They are joined by broadcast, their size being the word length."""

from __future__ import annotations

import math
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.functions.series import disjoint_windows, fourier, java_round, symbol, window_fourier


def fourier_values(series: DataFrame, width: int, length: int, skip_mean: bool = True) -> DataFrame:
    """series_id, label, window, coef, value of the disjoint windows; D6: rounded to two decimals, half up."""
    rows = series.select("series_id", "label", F.posexplode(disjoint_windows(F.col("values"), width, skip_mean)).alias("window", "w"))
    rows = rows.select("series_id", "label", "window", F.posexplode(fourier(F.col("w"), width, length, skip_mean)).alias("coef", "value"))
    return rows.withColumn("value", java_round(F.col("value")))


def equi_width_edges(values: DataFrame, alphabet: int) -> DataFrame:
    """Coef, edges."""
    ends = values.groupBy("coef").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ends.select("coef", F.transform(F.sequence(F.lit(1), F.lit(alphabet - 1)), lambda c: F.col("lo") + c * (F.col("hi") - F.col("lo")) / alphabet).alias("edges"))


def equi_depth_edges(values: DataFrame, alphabet: int) -> DataFrame:
    """Coef, edges. Edge p is the first value whose position in the sorted values exceeds ceil(depth (p + 1)) and that differs from edge p - 1;
    edges that no value fills are null, beyond any value.

    Values are rounded, so distinct values with counts stand for the whole order: no task sorts a coefficient's values."""
    counts = values.groupBy("coef", "value").agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy("coef").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("line"), F.sum("n").alias("all"))

    def step(acc: Column, v: Column) -> Column:
        position = acc["position"] + v["n"]
        due = F.ceil(F.col("all") / F.lit(alphabet) * (F.size(acc["edges"]) + 1))
        more = (position > due) & (F.size(acc["edges"]) < alphabet - 1)
        return F.struct(position.alias("position"), F.when(more, F.concat(acc["edges"], F.array(v["value"]))).otherwise(acc["edges"]).alias("edges"))

    start = F.struct(F.lit(0).cast("long").alias("position"), F.array().cast("array<double>").alias("edges"))
    edges = F.aggregate("line", start, step)["edges"]
    return by.select("coef", F.concat(edges, F.array_repeat(F.lit(None).cast("double"), F.lit(alphabet - 1) - F.size(edges))).alias("edges"))


def entropy(counts: dict, total: float) -> float:
    """D10, base 2."""
    return -sum(n / total * math.log(n / total) / math.log(2.0) for n in counts.values() if n > 0)


def information_gain_splits(line: list[tuple[float, float, int]], alphabet: int) -> list[int]:
    """Split positions in the order of (value, label), given as runs of equal value and label with their counts.

    Kept as they are: only changes of the label are candidates, gains are rounded to three decimals and the last best one wins, the weight of the
    left side uses its absolute position, and a side that is too small for a split hands on the middle as an absolute position."""
    ends, position = [], 0
    for _, _, n in line:
        position += n
        ends.append(position)
    total_all = position

    def label_at(i: int) -> float:
        return line[bisect_right(ends, i)][1]

    def split(start: int, end: int, symbols: int, out: list[int]) -> None:
        out_counts: dict = {}
        first, last = bisect_right(ends, start), bisect_right(ends, end - 1)
        runs = []
        for r in range(first, last + 1):
            lo, hi = max(start, ends[r] - line[r][2]), min(end, ends[r])
            runs.append((lo, hi, line[r][1]))
            out_counts[line[r][1]] = out_counts.get(line[r][1], 0) + hi - lo
        total = end - start
        base = entropy(out_counts, total)
        inside: dict = {}
        best_gain, best = -1.0, -1
        before = None
        for lo, hi, label in runs:
            if before is not None and label != before and start + 1 <= lo < end - 1:
                inside[label] = inside.get(label, 0) + 1
                rest = {k: n - inside.get(k, 0) for k, n in out_counts.items()}
                size = lo + 1
                gain = base - size / total * entropy(inside, size)
                if total != size:
                    gain -= (total - size) / total * entropy(rest, total - size) if total > size else 0.0
                gain = math.floor(gain * 1000.0 + 0.5) / 1000.0
                if gain >= best_gain:
                    best_gain, best = gain, lo
                inside[label] -= 1
            inside[label] = inside.get(label, 0) + hi - lo
            before = label
        if best < 0:
            return
        out.append(best)
        symbols //= 2
        if symbols > 1:
            if best - start > 2 and end - best > 2:
                parts = [(start, best), (best, end)]
            elif end - best > 4:
                parts = [(best, (end - best) // 2), ((end - best) // 2, end)]
            elif best - start > 4:
                parts = [(start, (best - start) // 2), ((best - start) // 2, end)]
            else:
                parts = []
            for a, b in parts:
                if 0 <= a < b <= total_all:
                    split(a, b, symbols, out)

    found: list[int] = []
    if total_all:
        split(0, total_all, alphabet, found)
    return sorted(found)


def information_gain_edges(values: DataFrame, alphabet: int) -> DataFrame:
    """Coef, edges (null where there are fewer splits). Distinct (value, label) with counts reach the splitting, not the rows."""
    counts = values.groupBy("coef", "value", "label").agg(F.count(F.lit(1)).alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "label"])
        line = list(zip(pdf["value"], pdf["label"], pdf["n"].astype(int)))
        ends = pdf["n"].cumsum().tolist()
        edges = [float(line[min(bisect_right(ends, s + 1), len(line) - 1)][0]) for s in information_gain_splits(line, alphabet)][: alphabet - 1]
        return pd.DataFrame({"coef": [int(pdf["coef"].iloc[0])], "edges": [edges + [None] * (alphabet - 1 - len(edges))]})

    return counts.groupBy("coef").applyInPandas(one, "coef int, edges array<double>")


def edge_table(edges: DataFrame) -> DataFrame:
    """One row: edges of all coefficients in order, as array<array<double>>."""
    return edges.agg(F.transform(F.sort_array(F.collect_list(F.struct("coef", "edges"))), lambda r: r["edges"]).alias("all_edges"))


def with_edges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds all_edges; the model is one row of word length times alphabet numbers, so it is broadcast."""
    return rows.join(F.broadcast(edge_table(edges)), F.lit(True))


def symbols(values: Column, all_edges: Column) -> Column:
    """A word of Fourier values."""
    return F.zip_with(values, all_edges, lambda v, e: symbol(v, e))


def window_words(series: DataFrame, edges: DataFrame, width: int, length: int, skip_mean: bool = True) -> DataFrame:
    """The columns of series with words, an array of words (arrays of symbols) by offset; none if the series is shorter."""
    rows = with_edges(series.withColumn("_f", window_fourier(F.col("values"), width, length, skip_mean)), edges)
    return rows.withColumn("words", F.transform("_f", lambda w: symbols(w, F.col("all_edges")))).drop("_f", "all_edges")


def anova_f(values: DataFrame) -> DataFrame:
    """Coef, f, rank of the one-way analysis of variance by label; best first, ties by coef. Two sums, no rows gathered."""
    by_label = values.groupBy("coef", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    by = by_label.groupBy("coef").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("s") * F.col("s") / F.col("n") - between
    f = F.try_divide(between / F.nullif(F.col("classes") - 1, F.lit(0)), F.nullif(within / F.nullif(F.col("n") - F.col("classes"), F.lit(0)), F.lit(0.0)))
    out = by.select("coef", f.alias("f")).filter("f IS NOT NULL AND NOT isnan(f)")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f"), "coef")))  # one row a coefficient


def symbolic_distance(word: Column, query_word: Column, query: Column, all_edges: Column, mean_removed: bool = True) -> Column:
    """Squared lower bound of the distance of a word to a query's Fourier values."""
    parts = F.transform(F.arrays_zip(word.alias("t"), query_word.alias("q"), query.alias("v"), all_edges.alias("e")), lambda p, i: F.struct(p["t"].alias("t"), p["q"].alias("q"), p["v"].alias("v"), p["e"].alias("e"), i.alias("i")))
    gap = lambda p: F.when(p["t"] == p["q"], F.lit(0.0)).when(p["t"] > p["q"], F.get(p["e"], p["t"] - 1) - p["v"]).otherwise(p["v"] - F.get(p["e"], p["t"]))
    weight = lambda p: F.lit(2.0) if mean_removed else F.when(p["i"] == 0, F.lit(1.0)).when(p["i"] == 1, F.lit(0.0)).otherwise(F.lit(2.0))
    return F.aggregate(F.transform(parts, lambda p: weight(p) * gap(p) * gap(p)), F.lit(0.0), lambda s, x: s + x)


def supervised_words(series: DataFrame, width: int, length: int, alphabet: int) -> tuple[DataFrame, DataFrame]:
    """(words table as window_words, chosen(coef, edges, rank)): edges by information gain on all coefficients of the window, and the
    `length` coefficients with the largest F."""
    values = fourier_values(series, width, width - width % 2, True)
    best = anova_f(values).filter(F.col("rank") <= length)
    chosen = information_gain_edges(values, alphabet).join(F.broadcast(best), "coef").select("coef", "edges", "rank")
    picks = [r["coef"] for r in chosen.orderBy("rank").select("coef").collect()]  # at most `length` numbers
    if not picks:
        return series.withColumn("words", F.array().cast("array<array<int>>")), chosen
    full = series.withColumn("_f", window_fourier(F.col("values"), width, max(picks) + 1 + (max(picks) + 1) % 2, True))
    rows = with_edges(full, chosen.select(F.col("rank").alias("coef"), "edges"))
    picked = lambda w: F.array(*[w[p] for p in picks])
    return rows.withColumn("words", F.transform("_f", lambda w: symbols(picked(w), F.col("all_edges")))).drop("_f", "all_edges"), chosen
