"""Column functions over a series held as array<double>. All are narrow: no shuffle, no Python.

Quirks of the model that are kept: the standard deviation is the population's, sqrt(E[x^2] - mean^2), and 0 divides as 1; a window is
normalised on its own; a series shorter than a sliding window gives one zero-padded window."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def table(values: Iterable[float], kind: str = "double") -> Column:
    """An array literal: one folded constant, however long."""
    return F.split(F.lit(",".join(repr(float(v)) if kind == "double" else str(v) for v in values)), ",").cast(f"array<{kind}>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    """B1; null for an empty series."""
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def stddev(values: Column) -> Column:
    """B2: 0 where the difference of moments isn't positive."""
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(F.size(values) > 0, F.sqrt(F.greatest(square / F.size(values) - F.pow(mean(values), F.lit(2.0)), F.lit(0.0))))


def divisor(values: Column) -> Column:
    return let(stddev(values), lambda s: F.when(s > 0, s).otherwise(F.lit(1.0)))


def backward_divisor(values: Column) -> Column:
    """divisor of values that were turned round, with the operations of the SQL: avg(x * x) - avg(x) * avg(x)."""
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) / F.size(values)
    return let(let(mean(values), lambda m: square - m * m), lambda v: F.when(v > 0, F.sqrt(v)).otherwise(F.lit(1.0)))


def znorm(values: Column, with_mean: bool = True) -> Column:
    """B3."""
    shift = mean(values) if with_mean else F.lit(0.0)
    return let(F.struct(shift.alias("m"), divisor(values).alias("s")), lambda p: F.transform(values, lambda x: (x - p["m"]) / p["s"]))


def subsequence(values: Column, offset: int, width: int) -> Column:
    """Cut at the end of the series, then normalised again."""
    return let(F.slice(values, offset + 1, width), lambda v: znorm(v))


def same_series(a: Column, b: Column, a_normalised: Column, b_normalised: Column) -> Column:
    """Whether two series are equal point by point; an error if one is normalised and the other isn't."""
    return F.when(a_normalised == b_normalised, a.eqNullSafe(b)).otherwise(F.raise_error(F.lit("a normalised series can't be compared with one that isn't")).cast("boolean"))


def slice_dimensions(rows: DataFrame, offset: int, width: int) -> DataFrame:
    """A subsequence of every dimension of series_id, dim, label, values, each normalised again."""
    return rows.withColumn("values", subsequence(F.col("values"), offset, width))


def prefix(values: Column, width: Column) -> Column:
    """B11 for a test series: its first points, normalised again."""
    return let(F.slice(values, F.lit(1), width), lambda v: znorm(v))


def raw_windows(values: Column, width: int) -> Column:
    """All windows of stride 1, not normalised; one padded with zeros if the series is shorter."""
    padded = F.concat(values, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(values)))
    return F.when(F.size(values) >= width, F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - width, F.lit(0))), lambda i: F.slice(values, i + 1, width))).otherwise(F.array(padded))


def sliding_windows(values: Column, width: int, with_mean: bool = True) -> Column:
    """B5."""
    return F.transform(raw_windows(values, width), lambda w: znorm(w, with_mean))


def disjoint_windows(values: Column, width: int, with_mean: bool = True) -> Column:
    """floor(n / width) windows; the rest is dropped."""
    count = F.floor(F.size(values) / width).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: znorm(F.slice(values, i * width + 1, width), with_mean))).otherwise(F.array().cast("array<array<double>>"))


def window_stats(values: Column, width: int) -> Column:
    """Mean and stddev of each window; a shorter series has one window, divided by the width."""
    return F.transform(raw_windows(values, width), lambda w: F.struct(mean(w).alias("mean"), stddev(w).alias("std")))


def derivative(values: Column) -> Column:
    """|x[i] - x[i-1]| at i - 1; the last stays 0."""
    return F.transform(values, lambda x, i: F.coalesce(F.abs(F.get(values, i + 1) - x), F.lit(0.0)))


def next_power_of_two(n: int) -> int:
    """C18."""
    return 1 << max(0, n - 1).bit_length()


def window_lengths(least: int, most: int) -> list[int]:
    """Descending."""
    return list(range(most, least - 1, -1))


def java_round(value: Column, digits: int = 2) -> Column:
    """Half up, also for negative numbers."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def dot(values: Column, weights: Column) -> Column:
    return total(F.zip_with(values, weights, lambda x, c: x * c))


def fourier(values: Column, width: int, length: int, skip_mean: bool = True, scaled: bool = True) -> Column:
    """Real and imaginary parts alternating; the mean's pair is left out with skip_mean. Pairs from width / 2 on are 0."""
    return let(F.reverse(values), lambda back: _fourier(back, width, length, skip_mean, scaled))


def _fourier(back: Column, width: int, length: int, skip_mean: bool, scaled: bool = True) -> Column:
    """fourier of a series that was turned round. Products are summed from the last point to the first and then scaled, as DuckDB sums a group of its join:
    values that should be equal to an edge (0, above all) are off by the same last digit, and get the same symbol as in the SQL."""
    scale = math.sqrt(width) if scaled else 1.0
    out = []
    for i in range(length):
        k = i // 2 + skip_mean
        if 2 * k >= width and k > 0:
            out.append(F.lit(0.0))
        else:
            wave = (math.cos, math.sin)[i % 2]
            out.append(dot(back, table(wave(2 * math.pi * k * j / width) for j in reversed(range(width)))) / scale)
    return F.array(*out)


def window_fourier(values: Column, width: int, length: int, skip_mean: bool = True) -> Column:
    """Of each sliding window, divided by its standard deviation. Direct sums, so odd widths have no artefact in the top pair."""

    def one(w: Column) -> Column:
        return let(F.reverse(w), lambda back: let(backward_divisor(back), lambda s: F.transform(_fourier(back, width, length, skip_mean), lambda c: c / s)))

    return F.when(F.size(values) >= width, F.transform(raw_windows(values, width), one)).otherwise(F.array().cast("array<array<double>>"))


def symbol(value: Column, edges: Column) -> Column:
    """Leading edges that are <= value; null edges are beyond any value."""
    return F.size(F.filter(edges, lambda e: value >= e))


def pack(symbols: Column, bits: int) -> Column:
    """Symbol i at bit i * bits; at most 60 / bits symbols."""
    symbols = F.slice(symbols, 1, 60 // bits)
    return F.aggregate(F.transform(symbols, lambda s, i: s.cast("long") * F.pow(F.lit(2.0), (i * bits).cast("double")).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def bits_of(alphabet: int) -> int:
    """floor(log2)."""
    return alphabet.bit_length() - 1


def word_prefix(packed: Column, length: int, bits: int) -> Column:
    """D19."""
    return packed.bitwiseAND(F.lit((1 << bits * length) - 1))
