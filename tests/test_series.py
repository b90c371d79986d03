from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.functions import representations as R
from seriesloom.functions import series as S
from seriesloom.operators import bag_rows as W
from seriesloom.operators import bags as B
from seriesloom.operators import blocks as K
from seriesloom.operators import classify as C
from seriesloom.operators import ensembles as E
from seriesloom.operators import models as M
from seriesloom.operators import quantise as Q
from seriesloom.operators import search as X
from seriesloom.sources import readers as I

rng = np.random.default_rng(4)
CASES = {0: [], 1: [2.0], 2: [5.0] * 9, 3: rng.normal(size=7).cumsum().tolist(), 4: rng.normal(size=40).cumsum().tolist(), 5: rng.normal(size=19).tolist()}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, float(k % 2), v) for k, v in CASES.items()], "series_id long, label double, values array<double>").cache()


def norm(x, mean=True):
    x = np.asarray(x, float)
    s = math.sqrt(max(0.0, (x * x).mean() - x.mean() ** 2)) if len(x) else 0
    return (x - (x.mean() if mean and len(x) else 0)) / (s or 1)


def values(df, column):
    return {r.series_id: r.v for r in df.select("series_id", column.alias("v")).collect()}


def test_windows(table):
    v = F.col("values")
    for w in (4, 5, 16):
        sliding, disjoint, four = values(table, S.sliding_windows(v, w)), values(table, S.disjoint_windows(v, w)), values(table, S.window_fourier(v, w, 4))
        for k, x in CASES.items():
            if len(x) >= w:
                assert len(sliding[k]) == len(x) - w + 1 and len(disjoint[k]) == len(x) // w
                for i, got in enumerate(sliding[k]):
                    np.testing.assert_allclose(got, norm(x[i : i + w]), atol=1e-6)
                    f = np.fft.fft(x[i : i + w]) / math.sqrt(w)
                    s = math.sqrt(max(0.0, np.var(x[i : i + w])))
                    want = [f[1].real, -f[1].imag, f[2].real, -f[2].imag] if w > 4 else [f[1].real, -f[1].imag, 0, 0]
                    np.testing.assert_allclose(four[k][i], np.array(want) / (s if s > 1e-9 else 1), atol=1e-5)
            else:
                assert len(sliding[k]) == 1 and len(sliding[k][0]) == w and disjoint[k] == [] and four[k] == []
    z = values(table, S.znorm(v))
    assert z[0] == [] and z[2] == [0.0] * 9
    np.testing.assert_allclose(z[4], norm(CASES[4]), atol=1e-9)
    assert values(table, S.derivative(v))[1] == [0.0] and values(table, S.mean(v))[0] is None


def test_window_fourier_rounds_as_the_sql(spark):
    """Bit for bit: a value that should be 0 is off by the same last digit as in the SQL, so it falls on the same side of an edge at 0."""
    x = np.array([(7 * i * i + 3 * i) % 11 / 100 for i in range(60)])
    rows = spark.createDataFrame([(0, x.tolist())], "series_id long, values array<double>")
    got = np.array(values(rows, S.window_fourier(F.col("values"), 8, 2))[0])
    for i, (a, b) in enumerate(got):
        sums = [0.0] * 4
        for j in reversed(range(8)):
            v = float(x[i + j])
            sums = [s + t for s, t in zip(sums, (v * math.cos(2 * math.pi * j / 8), v * math.sin(2 * math.pi * j / 8), v, v * v))]
        spread = sums[3] / 8 - sums[2] / 8 * (sums[2] / 8)
        std = math.sqrt(spread) if spread > 0 else 1.0
        assert (a, b) == (sums[0] / math.sqrt(8) / std, sums[1] / math.sqrt(8) / std)


def test_representations(spark):
    n, length = 24, 8
    data = [(i, rng.normal(size=n).cumsum().tolist()) for i in range(12)]
    rows = spark.createDataFrame(data, "series_id long, values array<double>").cache()
    other = rows.select((F.col("series_id") - 1).alias("series_id"), F.col("values").alias("y"))
    v, y = F.col("values"), F.col("y")
    true = {i: float(((np.array(data[i][1]) - np.array(data[i + 1][1])) ** 2).sum()) for i in range(11)}
    pairs = rows.join(other, "series_id").cache()
    for name, f, d in (("paa", lambda c: R.paa(c, n, length), lambda a, b: R.paa_distance(a, b, n, length)), ("dft", lambda c: R.dft(c, n, length), R.dft_distance)):
        for r in pairs.select("series_id", d(f(v), f(y)).alias("d")).collect():
            assert r.d <= true[r.series_id] + 1e-9, name
    full = rows.select("series_id", R.dwt_inverse(R.dwt(v, n, 32), n, 32).alias("x")).collect()
    for r in full:
        x = np.array(data[r.series_id][1])
        np.testing.assert_allclose(np.array(r.x) + 1.5 * np.append(x, np.zeros(8)).mean(), x, atol=1e-9)  # the mean isn't rescaled
    for r in rows.select("series_id", R.pla_inverse(R.pla(v, n, length), n, length).alias("x")).collect():
        x = np.array(data[r.series_id][1]).reshape(4, 6)
        want = [np.polyval(np.polyfit(np.arange(1, 7), p, 1), np.arange(1, 7)) for p in x]
        np.testing.assert_allclose(r.x, np.concatenate(want), atol=1e-9)
    with pytest.raises(ValueError):
        R.dft(v, n, 7)
    segments = {r.series_id: r.segments for r in R.apca(rows, length).collect()}
    for i, s in segments.items():
        assert len(s) <= length // 2 and s[-1].stop == n
        start = 0
        for one in s:
            assert one.value == pytest.approx(np.mean(data[i][1][start : one.stop]))
            start = one.stop
    with pytest.raises(ValueError):
        R.adaptive_segments(np.zeros(4), 8)
    assert R.adaptive_segments(np.array([1.0, 1, 1, 1, 5, 5, 5, 5]), 4) == [(1.0, 4), (5.0, 8)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 2)), min_size=1, max_size=40), st.sampled_from([2, 4, 8]))
def test_information_gain_over_runs_equals_rows(points, alphabet):
    line = sorted((v / 4, float(y)) for v, y in points)
    runs = []
    for p in line:
        if runs and runs[-1][:2] == p:
            runs[-1] = (*p, runs[-1][2] + 1)
        else:
            runs.append((*p, 1))
    single = [(*p, 1) for p in line]
    assert Q.information_gain_splits(runs, alphabet) == Q.information_gain_splits(single, alphabet)
    assert len(Q.information_gain_splits(runs, alphabet)) <= alphabet - 1


def test_information_gain_finds_the_change():
    assert Q.information_gain_splits([(float(i), float(i >= 10), 1) for i in range(20)], 2) == [10]
    assert Q.information_gain_splits([(0.0, 1.0, 50)], 4) == []


def test_equi_depth_with_ties(spark):
    for seed in range(6):
        r = np.random.default_rng(seed)
        x = sorted(np.round(r.integers(0, 5 + 8 * seed, 30) / 10, 2).tolist())
        rows = spark.createDataFrame([(0, v) for v in x], "coef int, value double")
        got = Q.equi_depth_edges(rows, 4).collect()[0].edges
        want, p = [], 0
        for i, v in enumerate(x, 1):
            if p < 3 and i > math.ceil(len(x) / 4 * (p + 1)) and (not want or want[-1] != v):
                want.append(v)
                p += 1
        assert got == want + [None] * (3 - len(want))


def test_words_bound_and_search(spark):
    data = [(i, float(i % 2), rng.normal(size=48).cumsum().tolist()) for i in range(20)]
    rows = spark.createDataFrame(data, "series_id long, label double, values array<double>")
    edges = Q.equi_width_edges(Q.fourier_values(rows, 16, 4), 8).cache()
    index = X.window_index(rows, edges, 16, 4).cache()
    assert index.count() == 20 * 33
    queries = X.as_queries(index.filter("series_id % 6 = 2 AND offset = 7")).cache()
    true = {}
    for k in (2, 8, 14):
        q = norm(data[k][2][7:23])
        true[k] = sorted((round(float(((norm(x[o : o + 16]) - q) ** 2).sum()), 9), i, o) for i, _, x in data for o in range(33))
    got = {(r.query_id, r.series_id, r.offset) for r in X.nearest(index, queries, 5).collect()}
    assert got == {(k, i, o) for k, t in true.items() for _, i, o in t[:5]}
    assert X.within(index, queries, 9.0).count() == sum(d < 9.0 for t in true.values() for d, *_ in t)
    near = index.crossJoin(queries).select(R.squared(F.col("values"), F.col("q_values")).alias("d"), X.fourier_bound(F.col("fourier"), F.col("q_fourier")).alias("lo"))
    assert near.filter("lo > d + 1e-6").count() == 0
    box = X.boxes(index, 1)
    joined = index.join(box, X.prefix_of(F.col("word"), 1) == F.col("prefix")).select(X.box_bound(F.col("fourier"), F.col("low"), F.col("high")).alias("b"))
    assert joined.filter("b > 0").count() == 0
    assert X.leaves(index, 4, 50).agg(F.sum("size")).first()[0] == index.count()


def test_index_is_written_merged_and_pruned(spark, tmp_path):
    data = [(i, float(i % 2), rng.normal(size=40).cumsum().tolist()) for i in range(24)]
    rows = spark.createDataFrame(data, "series_id long, label double, values array<double>")
    edges = Q.equi_width_edges(Q.fourier_values(rows, 16, 4), 4).cache()
    index = X.window_index(rows, edges, 16, 4).cache()
    X.write_index(index, f"{tmp_path}/i", 2)
    windows, box = X.load_index(spark, f"{tmp_path}/i")
    assert X.same_index(index, windows) and X.violations(windows, box, 2).isEmpty()
    assert not X.same_index(index, windows.filter("offset > 0")) and not X.violations(windows.filter("offset > 0"), box, 2).isEmpty()
    parts = [index.filter(f"series_id % 2 = {k}") for k in (0, 1)]
    assert X.same_index(X.merge_indexes(*parts), index)
    key = lambda df: {r.prefix: (r.size, r.low, r.high) for r in df.collect()}
    assert key(X.merge_boxes(*(X.boxes(p, 2) for p in parts))) == key(box)
    queries = X.as_queries(index.filter("series_id = 4 AND offset = 3"))
    want = X.nearest(index, queries, 3).collect()
    assert X.nearest(windows, queries, 3, box).select("series_id", "offset").collect() == [(r.series_id, r.offset) for r in want]
    asked = queries.withColumn("radius", F.lit(0.5))
    reached = X.candidates(windows, box, asked, 2).select("prefix").distinct().count()
    assert 0 < reached < box.count() and X.candidates(windows, box, asked, 2).count() < index.count() / 4
    assert X.within(windows, queries, 0.5, box).count() == X.within(index, queries, 0.5).count()


@pytest.mark.parametrize("numbers", [1 << 22, 50])
def test_scan_without_an_index_finds_the_same(spark, monkeypatch, numbers):
    """Searches that make the windows as they go, against those of a written index; equal windows tie by series and offset."""
    monkeypatch.setattr(K, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(K, "ROWS_AT_ONCE", 7)
    data = [(i, float(i % 2), rng.normal(size=int(n)).cumsum().tolist()) for i, n in enumerate(rng.integers(10, 60, 30))]
    data += [(30 + i, 0.0, data[2][2]) for i in range(6)] + [(40, 0.0, [1.0] * 30)]
    rows = spark.createDataFrame(data, "series_id long, label double, values array<double>")
    edges = Q.equi_width_edges(Q.fourier_values(rows, 16, 4), 4).cache()
    index = X.window_index(rows, edges, 16, 4).cache()
    queries = X.as_queries(index.filter("series_id % 5 = 2 AND offset = 1")).cache()
    key = lambda df: sorted((r.query_id, r.series_id, r.offset, round(r.distance, 7)) for r in df.collect())
    assert key(X.scanned(rows, edges, 16, 4, queries, 2, k=5)) == key(X.nearest(index, queries, 5))
    assert key(X.scanned(rows, edges, 16, 4, queries, 3, k=5, own_prefix=True)) == key(X.approximate(index, queries, 5, 3))
    assert key(X.scanned(rows, edges, 16, 4, queries, 2, epsilon=9.0)) == key(X.within(index, queries, 9.0))


def test_leaves_compact_and_count(spark):
    words = ["00", "00", "00", "01", "02", "10", "11", "11", "20"]
    index = spark.createDataFrame([(i, 0, [int(c) for c in w]) for i, w in enumerate(words)], "series_id long, offset int, word array<int>")
    found = X.leaves(index, 2, 3)
    assert {(r.prefix, r.depth, r["size"]) for r in found.collect()} == {("00", 2, 3), ("01", 2, 1), ("02", 2, 1), ("1", 1, 3), ("2", 1, 1)}
    assert {(r["first"], r["last"], r.leaves, r["size"]) for r in X.compacted(found, 3).collect()} == {("00", "00", 1, 3), ("01", "02", 2, 2), ("1", "1", 1, 3), ("2", "2", 1, 1)}
    assert X.statistics(found).first().asDict() == {"windows": 9, "leaves": 5, "height": 2, "largest": 3, "inner": 2}
    assert {r.prefix for r in X.leaves(index, 2, 9, least=2).collect()} == set(words)


def test_labels_may_be_any_numbers(spark):
    counts = [(i, (-1.0, 3.0, 7.0)[i % 3], f"w{i % 3}", 2) for i in range(30)] + [(i, (-1.0, 3.0, 7.0)[i % 3], "all", 1) for i in range(30)]
    bags = spark.createDataFrame(counts, "series_id long, label double, word string, cnt long")
    out = C.linear_fit_predict(bags.filter("series_id < 20"), bags.filter("series_id >= 20"), ["word"], 0.5).collect()
    assert len(out) == 10 and all(r.predicted == r.label and len(r.probabilities) == 3 for r in out)
    one = C.linear_fit_predict(bags.filter("label = 3"), bags, ["word"], 0.0).collect()
    assert {r.predicted for r in one} == {3.0}


def test_master_gaps(spark):
    rows = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.4, 0.4, 0.2],), ([1.0],)], "p array<double>")
    gaps = [r.m[-1] for r in rows.select(C.master_features(F.col("p")).alias("m")).collect()]
    assert gaps == pytest.approx([0.2, 0.0, 1.0])


def test_equal_and_sliced(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0], True, True), ([1.0], [2.0], False, False)], "a array<double>, b array<double>, m boolean, n boolean")
    same = lambda d: [r.s for r in d.select(S.same_series(F.col("a"), F.col("b"), F.col("m"), F.col("n")).alias("s")).collect()]
    assert same(rows) == [True, False]
    with pytest.raises(Exception, match="normalised"):
        same(rows.withColumn("n", ~F.col("n")))
    many = spark.createDataFrame([(1, d, 0.0, [float(x + d) ** 2 for x in range(9)]) for d in range(2)], "series_id long, dim int, label double, values array<double>")
    for r in S.slice_dimensions(many, 2, 4).collect():
        np.testing.assert_allclose(r["values"], norm([float(x + r.dim) ** 2 for x in range(2, 6)]), atol=1e-9)


def waves(spark, n, length=36, dims=None, labels=(0.0, 1.0)):
    r = np.random.default_rng(7)
    make = lambda i, d: (np.sin(np.arange(length) * (0.4 + 0.6 * (i % 2)) + d) + 0.15 * r.normal(size=length)).tolist()
    if dims is None:
        return spark.createDataFrame([(i, labels[i % 2], make(i, 0)) for i in range(n)], "series_id long, label double, values array<double>")
    return spark.createDataFrame([(i, d, labels[i % 2], make(i, d)) for i in range(n) for d in range(dims)], "series_id long, dim int, label double, values array<double>")


FITS = {
    "linear": lambda d: M.fit_linear(d, widths=[8, 12], lengths=(4,), norms=(True, False), folds=2),
    "bags": lambda d: M.fit_bags(d, widths=[10, 16], lengths=(6, 8)),
    "vectors": lambda d: M.fit_vector_space(d, widths=[10, 16], lengths=(4, 6), folds=3),
    "windows": lambda d: M.fit_windows(d, widths=[8, 12]),
    "one window": lambda d: M.fit_windows(d, widths=[8, 12], best_only=True),
    "early": lambda d: M.fit_early(d, lambda p: M.fit_linear(p, widths=[6, 8], lengths=(4,), norms=(True,)), snapshots=3),
}


@pytest.mark.parametrize("name", FITS)
def test_models_round_trip(spark, tmp_path, name):
    labels = (-1.0, 4.0)
    rows = waves(spark, 24, labels=labels)
    train, test = rows.filter("series_id < 14"), rows.filter("series_id >= 14")
    model = FITS[name](train)
    M.save(model, f"{tmp_path}/m")
    again = M.load(spark, f"{tmp_path}/m")
    got = {r.series_id: r.predicted for r in M.predict(again, test).collect()}
    assert got == {r.series_id: r.predicted for r in M.predict(model, test).collect()} and set(got) == set(range(14, 24))
    score = M.evaluate(again, test).first()
    assert score.n == 10 and score.accuracy >= 0.8 and score.correct == sum(got[i] == labels[i % 2] for i in got)


def test_multivariate_models(spark, tmp_path):
    rows = waves(spark, 16, 24, dims=2)
    train, test = rows.filter("series_id < 10"), rows.filter("series_id >= 10")
    model = M.fit_multivariate(train, widths=[6, 8], lengths=(2,), norms=(True,), binnings=("depth", "width"), folds=2)
    assert M.evaluate(model, test).first().accuracy >= 0.8 and model.settings["binning"] in ("depth", "width")
    early = M.fit_early(train, lambda p: M.fit_multivariate(p, widths=[6], lengths=(2,), norms=(True,), binnings=("width",)), snapshots=3, least=4)
    M.save(early, f"{tmp_path}/m")
    out = M.predict(M.load(spark, f"{tmp_path}/m"), test).collect()
    assert len(out) == 6 and all(r.s in (2, 3) and r.offset <= 24 for r in out) and np.mean([r.predicted == r.label for r in out]) >= 0.8


def test_supervised_words_and_linear(spark):
    data = [(i, float(i % 2), (np.sin(np.arange(60) * (0.4 + 0.5 * (i % 2))) + 0.1 * rng.normal(size=60)).tolist()) for i in range(24)] + [(99, 1.0, [1.0, 2.0])]
    rows = spark.createDataFrame(data, "series_id long, label double, values array<double>")
    words, chosen = Q.supervised_words(rows, 12, 4, 4)
    words = B.packed_words(words, 2)
    assert words.filter("series_id = 99").first().words == [] and chosen.count() <= 4
    bags = B.bigram_bag(words, 12)
    out = C.linear_fit_predict(bags.filter("series_id % 4 < 2"), bags.filter("series_id % 4 >= 2"), ["prev", "word"], 0.5).collect()
    assert np.mean([r.predicted == r.label for r in out]) > 0.9
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in out)


def test_one_class():
    x = rng.normal(size=(60, 2))
    alpha, rho = C.one_class_svm(x, nu=0.1, gamma=0.5)
    assert alpha.sum() == pytest.approx(6.0) and (alpha >= 0).all() and (alpha <= 1).all()
    assert (C.one_class_predict(x, alpha, rho, 0.5, x) == 1).mean() > 0.8
    assert C.one_class_predict(x, alpha, rho, 0.5, np.array([[9.0, 9.0]]))[0] == -1


def test_masters(spark):
    rows = spark.createDataFrame([(s, i, rng.uniform(size=3).tolist(), i % 3 > 0) for s in (2, 3) for i in range(40)], "s int, series_id long, master array<double>, right boolean")
    got = C.fit_masters(rows, gammas=(10, 1)).collect()
    assert {r.s for r in got} == {2, 3} and all(0 <= r.share <= 1 for r in got)


def test_chi_squared_tail():
    assert B.chi_squared_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert B.chi_squared_tail(16.918977604620448, 9) == pytest.approx(0.05, abs=1e-9)
    assert B.chi_squared_tail(0, 3) == 1.0


def test_readers(spark, tmp_path):
    (tmp_path / "a").write_text("@ comment\n1,2,4,,NaN,6\n 2  1.0e0 3\n3\n-1 5 5")
    got = I.labelled_text(spark, str(tmp_path / "a"), z_norm=False).orderBy("series_id").collect()
    assert [(r.series_id, r.label, r["values"]) for r in got] == [(0, 1.0, [2.0, 4.0, 6.0]), (1, 2.0, [1.0, 3.0]), (2, -1.0, [5.0, 5.0])]
    assert I.labelled_text(spark, str(tmp_path / "a")).filter("series_id = 2").first()["values"] == [0.0, 0.0]
    (tmp_path / "m").write_text("1 0 7 1 2\n1 1 7 3 5\n2 0 8 1 1\n1 0 9 4 4\n")
    got = {(r.series_id, r.dim): (r.label, r["values"]) for r in I.multivariate_text(spark, str(tmp_path / "m"), True).collect()}
    assert got[0, 0] == (7.0, [1.0, 3.0]) and got[0, 3] == (7.0, [3.0, 0.0]) and got[2, 1] == (9.0, [4.0]) and len(got) == 12
    (tmp_path / "r").write_text("@relation x\n% c\n\n'1,2,?\\n3,4,5',yes\n'6\\n7',no\n'8\\n9',yes\n")
    got = {(r.series_id, r.dim): (r.label, r["values"]) for r in I.arff_text(spark, str(tmp_path / "r")).collect()}
    assert got == {(0, 0): (1.0, [1.0, 2.0]), (0, 1): (1.0, [3.0, 4.0, 5.0]), (1, 0): (2.0, [6.0]), (1, 1): (2.0, [7.0]), (2, 0): (1.0, [8.0]), (2, 1): (1.0, [9.0])}
    (tmp_path / "s").write_text(" 1.5 9\n2.5 9\n\n3 9\n")
    assert I.single_column_text(spark, str(tmp_path / "s")).first()["values"] == [1.5, 2.5, 3.0]
    (tmp_path / "q").write_text("1 2 x 3\n\n4 5\n")
    assert [r["values"] for r in I.query_text(spark, str(tmp_path / "q")).orderBy("series_id").collect()] == [[1.0, 2.0, 3.0], [4.0, 5.0]]
    edges = spark.createDataFrame([(0, [1.0, 2.0])], "coef int, edges array<double>")
    I.save_model({"edges": edges}, str(tmp_path / "model"))
    assert I.load_model(spark, str(tmp_path / "model"), ["edges"])["edges"].collect() == edges.collect()
    assert I.random_walks(spark, 5, 8).count() == 5


def test_votes_and_folds(spark):
    votes = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 2.0), (2, 0.0, 3.0), (2, 1.0, 1.0)], "series_id long, label double, weight double")
    assert {r.series_id: r.predicted for r in C.weighted_vote(votes).collect()} == {1: 1.0, 2: 0.0}
    rows = spark.createDataFrame([(i, float(i % 2)) for i in range(7)], "series_id long, label double")
    assert {r.series_id: r.fold for r in C.stratified_folds(rows, 3).collect()} == {0: 0, 2: 1, 4: 2, 6: 0, 1: 0, 3: 1, 5: 2}
    none = C.accuracy(spark.createDataFrame([(1.0, None), (1.0, 1.0), (0.0, 1.0)], "label double, predicted double")).first()
    assert (none.n, none.correct, none.error) == (3, 1, 0.667)


def test_bag_nearest_skips_copies(spark):
    train = spark.createDataFrame([(0, 0.0, 1, 2), (1, 1.0, 1, 3), (2, 5.0, 9, 1)], "series_id long, label double, word long, cnt long")
    test = spark.createDataFrame([(7, None, 1, 2), (8, None, 4, 1)], "series_id long, label double, word long, cnt long")
    assert [(r.series_id, r.train_id) for r in C.bag_nearest(test, train).collect()] == [(7, 1)]


def test_window_distances(spark):
    data = [(i, float(i % 2), rng.normal(size=n).cumsum().tolist()) for i, n in enumerate((20, 23, 5, 30, 8))]
    rows = spark.createDataFrame(data, "series_id long, label double, values array<double>")
    got = {(r.series_id, r.train_id): r.distance for r in C.window_distances(rows, rows, 8, same=True, block=2).collect()}
    for qi, _, q in data:
        w = min(8, len(q))
        for ti, _, t in data:
            if ti != qi and len(t) >= w:
                want = sum(min(((norm(q[a : a + w]) - norm(t[b : b + w])) ** 2).sum() for b in range(len(t) - w + 1)) for a in range(0, len(q) - w + 1, w))
                assert got.pop((qi, ti)) == pytest.approx(want, abs=1e-6)
    assert not got


@pytest.mark.parametrize("numbers", [1 << 22, 100])
def test_nearest_windows_by_blocks(spark, monkeypatch, numbers):
    """The least of all pairs, of one broadcast block and of several; equal series tie to the smaller id."""
    monkeypatch.setattr(K, "BLOCK_NUMBERS", numbers)
    data = [(i, float(i % 2), (rng.normal(size=n) + 3).tolist()) for i, n in enumerate((20, 23, 5, 30, 8, 40))]
    rows = spark.createDataFrame([*data, (6, 0.0, data[1][2]), (7, 1.0, data[1][2]), (8, 1.0, []), (9, 0.0, [2.0] * 20)], "series_id long, label double, values array<double>")
    for same, mean in ((True, True), (False, False)):
        want = {r.series_id: r for r in C.window_nearest(C.window_distances(rows, rows, 8, same=same, with_mean=mean)).collect()}
        got = {r.series_id: r for r in C.window_nearest(K.nearest_windows(rows, rows, 8, same=same, with_mean=mean)).collect()}
        assert {k: (r.train_id, r.predicted) for k, r in got.items()} == {k: (r.train_id, r.predicted) for k, r in want.items()} and 8 not in got
        assert all(r.distance == pytest.approx(want[k].distance, abs=1e-8) for k, r in got.items())


@pytest.mark.parametrize(("dense", "numbers"), [(1_024, 1 << 22), (0, 1 << 22), (1_024, 80)])
def test_nearest_bags_by_blocks(spark, monkeypatch, dense, numbers):
    """As by a join on the words, for dense and sparse bags, several settings and blocks."""
    monkeypatch.setattr(K, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(K, "PAIRS_AT_ONCE", 60)
    made = {(f, i): {int(w): int(rng.integers(1, 6)) for w in rng.choice(12 if i < 18 else 4000, 5, replace=False)} for f in (1, 2) for i in range(24)}
    made[1, 5] = made[1, 3]
    rows = spark.createDataFrame([(f, i, float(i % 3), w, c) for (f, i), bag in made.items() for w, c in bag.items()], "f int, series_id long, label double, word long, cnt long").cache()
    monkeypatch.setattr(K, "DENSE_WORDS", dense)
    got = {(r.f, r.series_id): (r.train_id, r.predicted, r.distance) for r in C.bag_nearest(rows.filter("series_id % 2 = 1"), rows, ("f",)).collect()}
    for (f, i), q in made.items():
        if i % 2:
            found = []
            for j in range(24):
                t = made[f, j]
                d = sum(t[w] ** 2 - 2 * q[w] * t[w] for w in q if w in t)
                distance = sum(c * c for c in q.values()) + d
                if d and distance:
                    found.append((distance, j, j % 3))
            assert got.get((f, i)) == ((min(found)[1], min(found)[2], min(found)[0]) if found else None)


def test_ensembles(spark):
    data = [(i, float(i % 2), (np.sin(np.arange(40) * (0.4 + 0.6 * (i % 2))) + 0.1 * rng.normal(size=40)).tolist()) for i in range(24)]
    rows = spark.createDataFrame(data, "series_id long, label double, values array<double>")
    train, test = rows.filter("series_id < 14"), rows.filter("series_id >= 14")
    for fit in (E.bag_ensemble, lambda *a: E.vector_space_ensemble(*a, folds=3)):
        model = fit(train, [10, 16], (4, 6))
        got = {r.series_id: r.predicted for r in E.ensemble_predict(model, test).collect()}
        assert np.mean([got[i] == i % 2 for i in range(14, 24)]) >= 0.8


@pytest.mark.parametrize("fit", [E.bag_ensemble, lambda *a: E.vector_space_ensemble(*a, folds=3)])
def test_bags_of_one_window_length_stand_at_a_time(spark, monkeypatch, fit):
    data = [(i, float(i % 2), (np.sin(np.arange(30) * (0.4 + 0.6 * (i % 2))) + 0.1 * rng.normal(size=30)).tolist()) for i in range(10)]
    rows, kept, gone = spark.createDataFrame(data, "series_id long, label double, values array<double>"), [], []
    write, drop = E.settled, E.discard
    monkeypatch.setattr(E, "settled", lambda df: kept.append(write(df)) or kept[-1])
    monkeypatch.setattr(E, "discard", lambda df: gone.append(df.select("width").distinct().count()) or drop(df))
    model = fit(rows, [10, 16], (4, 6))
    assert gone == [1, 1] and sum("cnt" in df.columns for df in kept) == 3 and "cnt" in model.bags.columns


def test_equidistant_widths():
    assert E.equidistant_widths(9) == [] and E.equidistant_widths(10) == [10] and E.equidistant_widths(12) == [12]
    widths = E.equidistant_widths(100)
    assert widths[0] == 10 and widths[-1] <= 100 and len(widths) <= 12


def test_bag_rows_are_those_of_the_column_functions(spark):
    data = [(i, float(i % 2), [round(float(x), 1) for x in rng.normal(size=n)]) for i, n in enumerate([40, 40, 33, 9, 40])] + [(5, 1.0, [1.0] * 20), (6, 0.0, [None, *map(float, range(1, 30))]), (7, 1.0, None)]
    rows = spark.createDataFrame(data, "series_id long, label double, values array<double>")
    edges = E.setting_edges(rows.filter("series_id < 5"), [9, 12], 8)
    got = E.bags_by_setting(rows, edges, (4, 8))
    for width in (9, 12):
        words = B.packed_words(Q.window_words(rows, edges.filter(F.col("width") == width).drop("width"), width, 8), 2)
        for f in (4, 8):
            want = B.bag(words.withColumn("words", F.transform("words", lambda w: w.bitwiseAND(F.lit((1 << 2 * f) - 1)))))  # noqa: B023
            one = got.filter((F.col("width") == width) & (F.col("f") == f)).select(want.columns)
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, want.collect())) != []
    twice = E.bags_by_setting(rows.unionByName(rows), edges, (4, 8)).agg(F.sum("cnt"), F.count(F.lit(1))).first()
    assert twice[0] == 2 * got.agg(F.sum("cnt")).first()[0] and twice[1] == got.count()


def test_votes_over_folds_are_those_of_each_fold_alone(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS_AT_ONCE", 7)
    made = [(8 + i % 2, i % 3, i // 6, float(i // 6 % 3), int(w), int(rng.integers(1, 4))) for i in range(120) for w in rng.choice(25, 6, replace=False)]
    bags = spark.createDataFrame(made, "width int, f int, series_id long, label double, word long, cnt long").cache()
    fold = spark.createDataFrame([(i, i % 4 if i % 3 else 1) for i in range(20)], "series_id long, fold int")  # all series of label 0 are in one fold
    got, want, keys = {tuple(r)[:3]: r.predicted for r in W.fold_votes(bags, fold, 4).collect()}, {}, ("width", "f")
    for k in range(4):
        left, own = (bags.join(fold.filter(c), "series_id", "left_semi") for c in (f"fold <> {k}", f"fold = {k}"))
        matrix = B.empty_classes(B.tfidf(left, keys), bags, keys)
        want |= {(r.width, r.f, r.series_id): r.predicted for r in B.best_label(B.class_scores(own, matrix, keys), keys=keys).collect()}
    assert got == want and len(got) == bags.select(*keys, "series_id").distinct().count()


def test_bags_are_gathered_once_for_all_blocks(spark, monkeypatch):
    """The other side's bags are written once, not made again for each block of train."""
    monkeypatch.setattr(K, "BLOCK_NUMBERS", 40)
    written, write = [], K.settled
    monkeypatch.setattr(K, "settled", lambda df: written.append(df.columns) or write(df))
    rows = spark.createDataFrame([(i, float(i % 2), w, 1 + (i + w) % 3) for i in range(12) for w in range(i % 4, 5)], "series_id long, label double, word long, cnt long")
    C.bag_nearest(rows, rows).collect()
    assert sum("counts" in c for c in written) == 1 and len(written) > 2
