"""Numeric representations of a series (array<double> of a known length): transform, inverse and lower-bounding squared distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.series import fourier, next_power_of_two, table


def _up(i: int, n: int, parts: int) -> int:
    return -(-i * n // parts)


def paa(values: Column, n: int, frames: int) -> Column:
    """Means over [floor(i n / l), ceil((i + 1) n / l)); frames overlap where l doesn't divide n."""
    out = []
    for i in range(frames):
        a, b = i * n // frames, min(n, _up(i + 1, n, frames))
        out.append(F.aggregate(F.slice(values, a + 1, b - a), F.lit(0.0), lambda s, x: s + x) / (b - a))
    return F.array(*out)


def paa_inverse(means: Column, n: int, frames: int) -> Column:
    """Frame i covers [ceil(i n / l), ceil((i + 1) n / l))."""
    return F.concat(*[F.array_repeat(means[i], _up(i + 1, n, frames) - _up(i, n, frames)) for i in range(frames)])


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def paa_distance(a: Column, b: Column, n: int, frames: int) -> Column:
    """By whole points of a frame."""
    return squared(a, b) * float(n // frames)


def pla(values: Column, n: int, length: int) -> Column:
    """C4: least-squares lines a t + b, t from 1, over length / 2 frames; frames of one point have no line (NaN). The frame size in the closed
    form is the fraction n / (length / 2), also where frames are uneven."""
    out = []
    size = n / (length // 2)
    for i in range(length // 2):
        a, b = _up(i, n, length // 2), _up(i + 1, n, length // 2)
        part = F.slice(values, a + 1, b - a)
        if size == 1:
            out += [F.lit(float("nan"))] * 2
            continue
        slope = [12 * (t - (size + 1) / 2) / (size * (size + 1) * (size - 1)) for t in range(1, b - a + 1)]
        level = [6 * (t - (2 * size + 1) / 3) / (size * (1 - size)) for t in range(1, b - a + 1)]
        out += [F.aggregate(F.zip_with(part, table(w), lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x) for w in (slope, level)]
    return F.array(*out)


def pla_inverse(lines: Column, n: int, length: int) -> Column:
    """C5."""
    out = []
    for i in range(length // 2):
        m = _up(i + 1, n, length // 2) - _up(i, n, length // 2)
        out += [lines[2 * i] * float(t) + lines[2 * i + 1] for t in range(1, m + 1)]
    return F.array(*out)


def pla_distance(a: Column, b: Column, n: int, length: int) -> Column:
    """Sum over a frame of the squared difference of two lines, in closed form; frame size n // (l / 2)."""
    m = n // (length // 2)
    out = F.lit(0.0)
    for i in range(length // 2):
        da, db = a[2 * i] - b[2 * i], a[2 * i + 1] - b[2 * i + 1]
        out = out + da * da * (m * (m + 1) * (2 * m + 1) / 6.0) + da * db * float(m * (m + 1)) + db * db * float(m)
    return out


def haar(values: Column, n: int) -> list[Column]:
    """C7 in closed form: [mean, then for each level from coarse to fine the differences of half-block means], zero-padded to a power of two."""
    size = next_power_of_two(n)
    padded = F.concat(values, F.array_repeat(F.lit(0.0), size - n)) if size > n else values

    def block(a: int, m: int) -> Column:
        return F.aggregate(F.slice(padded, a + 1, m), F.lit(0.0), lambda s, x: s + x) / m

    out = [block(0, size)]
    m = size
    while m > 1:
        out += [block(a + m // 2, m // 2) - block(a, m // 2) for a in range(0, size, m)]
        m //= 2
    return out


def dwt(values: Column, n: int, length: int) -> Column:
    """The first coefficients; all but the mean are halved and negated."""
    return F.array(*[c * -0.5 for c in haar(values, n)[:length]])


def dwt_inverse(coefficients: Column, n: int, length: int) -> Column:
    """Index 0 isn't rescaled."""
    size = next_power_of_two(n)
    out = []
    for j in range(n):
        value, m, start = coefficients[0], size, 1
        blocks = 1
        while m > 1 and start < length:
            i = start + j // m
            if i < length:
                half = coefficients[i]  # stored halved and negated
                value = value + (-half if (j % m) >= m // 2 else half)
            start, m, blocks = start + blocks, m // 2, blocks * 2
        out.append(value)
    return F.array(*out)


def dwt_distance(a: Column, b: Column, length: int, n: int) -> Column:
    """S_i = 2 (S_(i-1) + squared differences of level i), the mean being level 0's start."""
    out = (a[0] - b[0]) * (a[0] - b[0])
    start, width = 1, 1
    while start < length:
        level = F.lit(0.0)
        for i in range(start, min(start + width, length)):
            level = level + (a[i] - b[i]) * (a[i] - b[i])
        out = (out + level) * 2.0
        start, width = start + width, width * 2
    return out


def dft(values: Column, n: int, length: int) -> Column:
    """Zero-padded to a power of two, without the mean; an odd length is refused."""
    if length % 2:
        raise ValueError("length must be even")
    size = next_power_of_two(n)
    padded = F.concat(values, F.array_repeat(F.lit(0.0), size - n)) if size > n else values
    return fourier(padded, size, min(length, size - 2))


def dft_inverse(coefficients: Column, n: int, length: int) -> Column:
    """The series of the kept coefficients, mean 0."""
    size = next_power_of_two(n)
    scale = 2 / math.sqrt(size)
    out = []
    for j in range(n):
        wave = [f(2 * math.pi * (i // 2 + 1) * j / size) * scale for i in range(min(length, size - 2)) for f in [(math.cos, math.sin)[i % 2]]]
        out.append(F.aggregate(F.zip_with(coefficients, table(wave), lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x))
    return F.array(*out)


def dft_distance(a: Column, b: Column) -> Column:
    """C17."""
    return squared(a, b) * 2.0


# ---- adaptive segments: the greedy merge is no relational plan ----------------------------------


def adaptive_segments(x: np.ndarray, length: int) -> list[tuple[float, int]]:
    """C11: (mean, end) of at most length / 2 segments, ends exclusive.

    The largest normalised Haar coefficients give a step function; its steps are the first borders; then the neighbours whose joint mean adds
    the least squared error merge until few enough are left."""
    n = len(x)
    if length > n:
        raise ValueError("more coefficients than points")
    size = next_power_of_two(n)
    padded = np.zeros(size)
    padded[:n] = x
    levels, mean, m = [], padded, size
    while m > 1:
        left, right = mean[0::2], mean[1::2]
        levels.append((right - left) / 2)
        mean, m = (left + right) / 2, m // 2
    levels = levels[::-1]  # coarse to fine
    flat = np.concatenate(levels) if levels else np.zeros(0)
    norm = np.concatenate([np.abs(v) / math.sqrt(2.0**i) for i, v in enumerate(levels)]) if levels else np.zeros(0)
    kept = np.zeros(len(flat))
    best = np.argsort(-norm[: n - 1], kind="stable")[:length]  # as many coefficients as points
    kept[best] = flat[best]
    step, at = mean.copy(), 0
    for v in levels:
        half = kept[at : at + len(v)]
        at += len(v)
        step = np.stack([step - half, step + half], 1).ravel()
    step = step[:n]
    ends = [*(np.flatnonzero(np.diff(step[1:])) + 2).tolist(), n]  # a step after the first point isn't seen
    total, square = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    error = lambda a, b: square[b] - square[a] - (total[b] - total[a]) ** 2 / (b - a)
    starts = [0, *ends[:-1]]
    while len(ends) > max(1, length // 2):
        cost = [error(starts[i], ends[i + 1]) - error(starts[i], ends[i]) - error(starts[i + 1], ends[i + 1]) for i in range(len(ends) - 1)]
        i = int(np.argmin(cost))
        ends[i : i + 2] = [ends[i + 1]]
        starts[i : i + 2] = [starts[i]]
    return [(float((total[b] - total[a]) / (b - a)), b) for a, b in zip(starts, ends)]


def apca(rows: DataFrame, length: int) -> DataFrame:
    """series_id, segments array<struct<value, stop>> of series_id, values; C11 and C12, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[{"value": v, "stop": e} for v, e in adaptive_segments(np.asarray(x, float), length)] for x in batch["values"]]
            yield pd.DataFrame({"series_id": batch["series_id"], "segments": found})

    return rows.select("series_id", "values").mapInPandas(run, "series_id long, segments array<struct<value: double, stop: int>>")


def apca_inverse(segments: Column) -> Column:
    """C13."""
    return F.flatten(F.transform(segments, lambda s, i: F.array_repeat(s["value"], s["stop"] - F.when(i == 0, F.lit(0)).otherwise(F.get(segments, i - 1)["stop"]))))


def apca_distance(a: Column, b: Column) -> Column:
    """C14, segment to segment: each point adds the squared difference of the two segments over it."""
    return squared(apca_inverse(a), apca_inverse(b))


def apca_query_distance(segments: Column, query: Column) -> Column:
    """C14, segment to raw query: squared difference to the query's mean in the segment, times its length."""

    def one(s: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(segments, i - 1)["stop"])
        size = s["stop"] - start
        gap = s["value"] - F.aggregate(F.slice(query, start + 1, size), F.lit(0.0), lambda t, x: t + x) / size
        return gap * gap * size

    return F.aggregate(F.transform(segments, one), F.lit(0.0), lambda t, x: t + x)
