from __future__ import annotations

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.functions.tables import settled
from seriesloom.llm.common import checkpoint, dictionary_hashes, gathered, shingle_sets, short_batches, sliced, word_hashes
from seriesloom.llm.components import connected_components, contracted
from seriesloom.llm.exact_dedup import drop_copies, exact_dedup
from seriesloom.llm.ngram_join import drop_near_copies, similarity_classes
from seriesloom.llm.prefix_trie import join_units, shingle_ids
from seriesloom.llm.signatures import signatures

from .fixtures import frame, rows


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def groups_of(data):
    by = {}
    for r in data:
        by.setdefault(norm(r[1]), []).append(r[0])
    return by


def classes_of(data, width, num, den):
    sets = []
    for r in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(data)]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("repeat", [False, True])
def test_exact_dedup(spark, repeat):
    data = rows(3)
    if repeat:
        data = data + data[:7] + [(None, "one", *data[0][2:]), (None, "only null id", *data[0][2:])]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(frame(spark, data)).collect()), key=key)
    by = groups_of(data)
    want = []
    for r in data:
        ids = by[norm(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    assert got == sorted(want, key=key)
    kept = drop_copies(frame(spark, data))
    assert kept.columns == frame(spark, []).columns
    out = kept.collect()
    assert sorted(norm(r.text) for r in out) == sorted(by)
    assert all(r.doc_id == min((i for i in by[norm(r.text)] if i is not None), default=None) for r in out)


def test_exact_dedup_keeps_columns(spark):
    names = ["_digest", "digest", "own", "sha", "_id", "_sha"]
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "a  b"), (None, "d")], "doc_id long, text string").selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    out = drop_copies(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=key) == [(None, "d"), (1, "a b"), (1, "c")] and all(r[n] == n for r in out for n in names)


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
@pytest.mark.parametrize("repeat", [False, True])
def test_similarity_classes(spark, width, num, den, repeat):
    data = rows(5, 70)
    if repeat:
        data = data + data[:9] + [(data[20][0], data[30][1], *data[0][2:]), (None, data[40][1], *data[0][2:]), (None, None, *data[0][2:])]
    got = similarity_classes(frame(spark, data), width, num, den).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(classes_of(data, width, num, den), key=key)
    if not repeat:
        size = {}
        for r in got:
            size[r.component_id] = size.get(r.component_id, 0) + 1
        assert all(r.class_size == size[r.component_id] for r in got)


def test_large_block_is_split(spark, monkeypatch):
    import seriesloom.llm.ngram_join as module

    monkeypatch.setattr(module, "CHUNK_BYTES", 900)
    monkeypatch.setattr(module, "CHUNK_ROOT", 300)
    data = rows(6, 90)
    got = similarity_classes(frame(spark, data), 3, 70, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(classes_of(data, 3, 70, 100))


def test_near_copies_go(spark):
    data = rows(8, 70)
    kept = {r.doc_id for r in drop_near_copies(frame(spark, data)).collect()}
    assert kept == {i for i, n, c in classes_of(data, 5, 80, 100) if c == i}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup(none).collect() == [] and drop_copies(none).collect() == []
    assert similarity_classes(none).collect() == [] and drop_near_copies(none).collect() == []


def test_components_of_a_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (None, 5), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 200, 201: 200}


def shingles(text, width):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def roots(n, pairs):
    up = list(range(n))
    for i, j in pairs:
        a, b = up[i], up[j]
        up = [min(a, b) if u in (a, b) else u for u in up]
    return up


texts_of_few_words = st.lists(st.tuples(st.integers(0, 2), st.lists(st.sampled_from("abc"), max_size=14).map(" ".join), st.integers(1, 3), st.booleans()), max_size=16)


@pytest.mark.parametrize("at_once", [None, 5])
@settings(max_examples=150, deadline=None)
@given(texts_of_few_words, st.lists(st.booleans(), min_size=3, max_size=3), st.sampled_from([(85, 100), (80, 100), (50, 100), (100, 100)]), st.integers(1, 4))
def test_trie_finds_every_link(at_once, found, cross, threshold, width):
    import seriesloom.llm.prefix_trie as module

    num, den = threshold
    found = sorted(found, key=lambda x: x[0])
    used = sorted({u for u, *_ in found})
    unit = np.array([used.index(u) for u, *_ in found], np.int64)
    cross = np.array(cross[: len(used)], bool)
    sets, weights, side = [shingles(t, width) for _, t, _, _ in found], [w for _, _, w, _ in found], [int(b) for *_, b in found]
    before = module.TOKENS_AT_ONCE, module.CELLS_AT_ONCE
    if at_once:
        module.TOKENS_AT_ONCE = module.CELLS_AT_ONCE = at_once
    try:
        links, label = join_units(unit, [t.encode() for _, t, _, _ in found], np.array(weights, np.int64), np.array(side, np.int64), cross, width, num, den)
    finally:
        module.TOKENS_AT_ONCE, module.CELLS_AT_ONCE = before

    def linked(i, j):
        meet = i != j and unit[i] == unit[j] and (not cross[unit[i]] or side[i] != side[j])
        return meet and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])

    n = len(sets)
    assert links.tolist() == [sum(weights[j] for j in range(n) if linked(i, j)) for i in range(n)]
    assert label.tolist() == roots(n, [(i, j) for i in range(n) for j in range(i) if linked(i, j)])


def test_shingles_of_one_hash_stay_apart(monkeypatch):
    import seriesloom.llm.prefix_trie as module

    texts = [b"a b c a b", b"c b a", b"", b"a b"]
    want = [shingles(t.decode(), 2) for t in texts]
    monkeypatch.setattr(module, "shingle_hashes", lambda words, left, at, width: np.zeros(len(at), np.uint64))
    sizes, doc, number = shingle_ids(texts, 2)
    assert sizes.tolist() == [len(s) for s in want]
    got = [set(number[doc == i]) for i in range(4)]
    assert all((len(got[i] & got[j]) == len(want[i] & want[j])) for i in range(4) for j in range(4))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 160), st.sampled_from([(85, 100), (80, 100), (50, 100), (100, 100), (95, 100)]))
def test_linked_sets_share_a_signature(seed, size, threshold):
    num, den = threshold
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, size, dtype=np.uint64)
    sets = [np.unique(base)]
    for _ in range(8):  # as far from the first as a link allows
        lost = int(r.integers(0, size * (den - num) // den + 1))
        more = int(r.integers(0, size * (den - num) // num + 1))
        sets.append(np.unique(np.concatenate([r.permutation(base)[lost:], r.integers(0, 2**63, more, dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    known = np.unique(np.concatenate(sets))
    frequent = known[r.random(len(known)) < r.choice([0, 0.2, 0.7, 1])]  # whichever grams are left out first, no link is lost
    of, sign = signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), num, den, frequent)
    held = [set(sign[of == i].tolist()) for i in range(len(sets))]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if den * both >= num * (len(a) + len(sets[j]) - both):
                assert held[i] & held[j]


@pytest.mark.parametrize("threshold", [(85, 100), (80, 100)])
def test_long_sets_with_few_grams_in_common_share_no_signature(threshold):
    r = np.random.default_rng(3)
    common = r.integers(0, 2**63, 40, dtype=np.uint64)  # one gram in a hundred
    sets = [np.unique(np.concatenate([common, r.integers(0, 2**63, 3960, dtype=np.uint64)])) for _ in range(40)]
    of, sign = signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), *threshold, np.zeros(0, np.uint64))
    held = [set(sign[of == i].tolist()) for i in range(len(sets))]
    assert sum(bool(a & b) for i, a in enumerate(held) for b in held[:i]) <= 2


def test_words_that_break_polynomial_hashes_stay_apart(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    got = similarity_classes(spark.createDataFrame([(1, one), (2, other), (3, one.upper())], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {1: (1, 1), 2: (2, 0), 3: (1, 1)}


def links_of(data, width, num, den):
    sets = []
    for r in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return [(r[0], sum(bool(a) and i != j and den * len(a & b) >= num * len(a | b) for j, b in enumerate(sets))) for i, (r, a) in enumerate(zip(data, sets))]


@pytest.mark.parametrize("chunk", [None, 300])
@pytest.mark.parametrize("repeat", [False, True])
def test_every_link_is_counted(spark, monkeypatch, chunk, repeat):
    import seriesloom.llm.ngram_join as module

    if chunk:
        monkeypatch.setattr(module, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(module, "CHUNK_ROOT", chunk)
    data = rows(11, 90)
    base = " ".join(f"w{i}" for i in range(60))
    data += [(10_000 + i, f"{base} tail{i}" if i % 2 else base.replace(f"w{i}", "other"), *data[0][2:]) for i in range(12)]
    if repeat:
        data = data + data[:9] + data[-3:] + [(None, data[40][1], *data[0][2:]), (None, None, *data[0][2:])]
    got = similarity_classes(frame(spark, data), 2, 80, 100).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=key) == sorted(links_of(data, 2, 80, 100), key=key)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(classes_of(data, 2, 80, 100), key=key)


def test_near_copies_go_by_row(spark):
    rest = (None, None, None, *["x"] * 10)
    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"]
    data = [
        (1, base[0]), (1, base[1]),  # unrelated texts of one id
        (None, base[2]), (None, base[3]),  # unrelated texts without id
        (2, base[0] + " tail"), (2, base[4]),  # only one text of id 2 is a near copy
        (None, base[1] + " tail"),  # a near copy without id
        (None, base[5]), (None, base[5] + " tail"),  # a class without ids
        (3, base[6]), (3, base[6] + " tail"), (4, base[6]),  # the smallest id has two texts of the class
        (1, ""), (1, None), (2, " "), (None, ""), (None, None),
    ]
    docs = frame(spark, [(*d, *rest) for d in data])
    out = drop_near_copies(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted((d for d in got if not (d[1] or "").strip()), key=key) == sorted(data[-5:], key=key)
    full = [d for d in got if (d[1] or "").strip()]
    assert sorted((d for d in full if d[1][0] not in "fg"), key=key) == sorted([(1, base[0]), (1, base[1]), (None, base[2]), (None, base[3]), (2, base[4])], key=key)
    assert [d[0] for d in full if d[1][0] == "f"] == [None] and [d[0] for d in full if d[1][0] == "g"] == [3]


def test_gathered_batches_keep_rows_and_order():
    whole = pa.RecordBatch.from_arrays([pa.array([5, None, 7, 1, 1, 0, 9])], names=["x"])
    got = list(gathered([whole.slice(0, 2), whole.slice(2, 0), whole.slice(2, 1), whole.slice(3, 3), whole.slice(6, 1)], 3))
    assert [b.num_rows for b in got] == [3, 3, 1]
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([whole]))
    assert not list(gathered([])) and not list(gathered([whole.slice(0, 0)]))


def test_large_batches_come_back_in_slices(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(53)), pa.array([None if i % 3 else i for i in range(53)])], names=["a", "b"])
    parts = list(sliced(batch, 20))
    assert [b.num_rows for b in parts] == [20, 20, 13] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(sliced(batch.slice(0, 0))) == []

    class Plan:
        """Gives the function that a task would run."""

        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    place = np.arange(50_000)
    out = list(contracted(Plan())(iter([pa.RecordBatch.from_arrays([pa.array(2 * place), pa.array(2 * place + 1)], names=["a", "b"])])))
    assert max(b.num_rows for b in out) <= 20_000 and {*pa.Table.from_batches(out)["b"].to_pylist()} == {*range(0, 100_000, 2)}


def test_short_batches_keep_a_lower_bound(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given_rows, then in (("10000", "1000"), ("0", "1000"), ("-1", "1000"), ("64", "64")):
            spark.conf.set(key, given_rows)
            short_batches(spark.range(1))
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, before)


def test_checkpoints_give_their_shuffle_files_back(spark):
    """Before, they stayed until the driver collected garbage, so a join's disk was the sum of its steps."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (str(x.getName()) for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())) if f.startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(key, None)
    for keep in (checkpoint, settled):
        table = keep(spark.range(1_000).selectExpr("id", "id % 7 AS k").repartition(3, "k"))
        assert len(table.collect()) == 1_000  # a count would shuffle too
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(key, None) == setting


def test_words_have_one_hash_wherever_they_stand():
    words = [b"a", b"a\0", b"\0", b"\0\0", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", b"abcdefghabcdefgh", b"abcdefghabcdefg", b"x" * 40, b"x" * 41, "größe".encode()]
    hashes = {}
    for order in (words, words[::-1], words[3:] + words[:3]):
        raw = np.frombuffer(b" ".join(order), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in order]) - 1
        found = word_hashes(raw, ends - [len(w) for w in order], ends).tolist()
        coded = pa.array(order, pa.large_binary()).dictionary_encode()
        assert dictionary_hashes(coded)[coded.indices.to_numpy()].tolist() == found
        for word, h in zip(order, found):
            assert hashes.setdefault(word, h) == h
    assert len(set(hashes.values())) == len(words)
    sets = list(shingle_sets(pa.array(["b a b a b", None, "a"]), 2, False))
    assert [len(g) for _, g, _ in sets] == [3] and sets[0][2].tolist() == [0, 2, 2, 3] and (np.diff(sets[0][1][:2].astype(object)) > 0).all()
