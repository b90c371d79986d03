"""Toxicity: a sparse logistic classifier on words and word beginnings, regularised by counterfactual identity swaps.

Sentences of the training documents that name an identity are written again with each other term of the same group, and the squared
difference of the two scores is added to the loss; pairs of bare terms are added too, so that no group is preferred where the sample
hardly names it. Scores of neutral group mentions thus stay together, and can't carry the label."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpoint, held_out, mix, pieces, range_hashes, runs, short_batches, smallest, worker_state

#: Interchangeable identity terms, by group.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("mothers", "fathers"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "arab"), ("old", "young"), ("blind", "deaf", "disabled"), ("immigrants", "natives"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

#: Bounds of the training sample: labelled documents of either kind, in hashed order of their ids.
TOXIC_ROWS, CLEAN_ROWS = 2_000, 4_000
#: Features kept, the documents (distinct ones) that must hold one, and the lengths in bytes of the word beginnings.
FEATURES, LEAST_DOCS, BEGINNINGS = 3_000, 4, (3, 4, 5, 6, 7)
#: Penalties of the selection; share of the first that is left for the selected features; weight of the swaps; steps.
L1, L2, RELAXED, SWAP_WEIGHT, STEPS = 2e-3, 1e-5, 0.02, 1.0, 300
#: Rows of the sample whose features are turned to floats at once, in the driver; elsewhere a feature of a row is a byte.
FLOAT_ROWS = 128
THRESHOLD = 0.7

_inside = np.zeros(256, bool)
_inside[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, document of each feature, feature hash): lower-cased words and their beginnings, as often as they occur."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()))
    for raw, starts, at in pieces(lowered):
        if not len(raw):
            continue
        s, e = runs(_inside[raw], starts[starts < len(raw)])
        spans, doc = [(s, e)], [np.searchsorted(starts, s, "right") - 1]
        for n in BEGINNINGS:
            longer = e - s > n
            spans.append((s[longer], s[longer] + n))
            doc.append(doc[0][longer])
        hashes = range_hashes(raw, *spans)
        hashes[0] = mix(hashes[0])  # a whole word differs from an equal beginning
        yield at, at + np.concatenate(doc), np.concatenate(hashes)


def _distinct(texts: pa.Array) -> list[np.ndarray]:
    found: dict[int, list[np.ndarray]] = {}
    for _, doc, value in features(texts):
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
        cut = np.flatnonzero(np.diff(doc)) + 1
        for d, v in zip(doc[np.concatenate([[0], cut])] if len(doc) else [], np.split(value, cut)):
            found.setdefault(int(d), []).append(np.unique(v))
    return [np.unique(np.concatenate(found[i])) if i in found else np.zeros(0, np.uint64) for i in range(len(texts))]


_terms = {t: group for group in IDENTITIES for t in group}
_named = re.compile(r"(?<!\w)(" + "|".join(sorted(_terms, key=len, reverse=True)) + r")(?!\w)")


def swapped_sentences(text: str) -> list[tuple[str, str]]:
    """Sentences that name an identity, each with every other term of the group in its place."""
    out = []
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        for found in _named.finditer(sentence):
            out += [(sentence, sentence[: found.start()] + other + sentence[found.end() :]) for other in _terms[found[1]] if other != found[1]]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int, seed: int = 5) -> DataFrame:
    """doc_id, toxic, key (digest of the features), features (distinct), swap (features of sentence pairs): a bounded sample of the labelled rows not
    held out. A row is an id and a text: an id with several texts gives several rows, repeated ones count once."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = [smallest(known.filter(F.col("toxic") == t), ["toxic"], F.xxhash64(F.lit(seed), F.col("doc_id")), n) for t, n in ((1, toxic_rows), (0, clean_rows))]
    ids = checkpoint(ids[0].union(ids[1]))
    texts = short_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("of")).filter("text IS NOT NULL")
    own = texts.select("doc_id", "of").join(F.broadcast(ids), "doc_id")  # bounded above
    chosen = [smallest(own.filter(F.col("toxic") == t), ["toxic"], F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("of")), n) for t, n in ((1, toxic_rows), (0, clean_rows))]
    chosen = checkpoint(chosen[0].union(chosen[1]))
    rows = texts.join(F.broadcast(chosen), ["doc_id", "of"]).dropDuplicates(["doc_id", "of", "toxic"])  # bounded above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        for batch in batches:
            own, swap = _distinct(batch.column(1)), []
            for text in batch.column(1).to_pylist():
                pairs = swapped_sentences(text)
                both = _distinct(pa.array([x for p in pairs for x in p], pa.string()))
                swap.append([[np.setdiff1d(a, b).view(np.int64), np.setdiff1d(b, a).view(np.int64)] for a, b in zip(both[::2], both[1::2])])
            key = [hashlib.md5(f.tobytes()).hexdigest() for f in own]
            arrays = [pa.array(key), pa.array([f.view(np.int64) for f in own], pa.list_(pa.int64())), pa.array(swap, pa.list_(pa.list_(pa.list_(pa.int64()))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], names=["doc_id", "toxic", "key", "features", "swap"])

    return rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, key string, features array<long>, swap array<array<array<long>>>")


class ToxicityModel:
    """Weights of feature hashes (sorted) and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.hashes, self.weights, self.bias = hashes, weights, bias

    def margin(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if not len(self.hashes):
            return out
        low = np.uint64(0xFFFFF)
        mask = np.zeros(1 << 20, bool)
        mask[(self.hashes & low).astype(np.int64)] = True
        held: list[np.ndarray] = []
        for _, doc, value in features(texts):
            maybe = mask[(value & low).astype(np.int64)]
            doc, value = doc[maybe], value[maybe]
            place = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
            hit = self.hashes[place] == value
            held.append(np.unique(doc[hit] * len(self.hashes) + place[hit]))
        if held:
            code = np.unique(np.concatenate(held))  # a feature counts once in a document
            out += np.bincount(code // len(self.hashes), self.weights[code % len(self.hashes)], len(texts))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(texts), -40, 40)))


def _place(hashes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Indexes of the known among the features."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(hashes, features), len(hashes) - 1)
    return place[hashes[place] == features]


def screened(sample: DataFrame, learn: DataFrame) -> np.ndarray:
    """Sorted hashes of the FEATURES features whose presence tells most about the label, by log-odds times the root of their documents.

    sample: training_rows; learn(key, toxic): those that count. Sums by feature, then a top-k: only the chosen ones reach the driver."""
    rows = sample.dropDuplicates(["key"]).drop("toxic").join(F.broadcast(learn), "key").select(F.col("toxic").cast("double").alias("toxic"), "features")
    n, positive = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    found = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("all"), F.sum("toxic").alias("pos"))
    found = found.filter(F.col("all") >= LEAST_DOCS)
    odds = F.ln((F.col("pos") + 0.5) / F.lit(positive + 1)) - F.ln((F.col("all") - F.col("pos") + 0.5) / F.lit(n - positive + 1))
    top = found.withColumn("rank", F.round(F.abs(odds) * F.sqrt("all"), 9)).orderBy(F.desc("rank"), "feature").limit(FEATURES)
    return np.sort(np.array([r["feature"] for r in top.select("feature").collect()], np.int64).view(np.uint64))


def fit(sample: DataFrame, l1: float = L1, l2: float = L2, swap_weight: float = SWAP_WEIGHT, steps: int = STEPS) -> ToxicityModel:
    """The model of all sampled rows, its bias moved so that THRESHOLD lies where it errs least on rows that a first model hasn't seen.

    Documents of equal features count once. Without both labels the model is the constant share of the label, smoothed."""
    sample = checkpoint(sample)
    unique: dict[str, tuple[int, int]] = {}
    for r in sorted(sample.select("doc_id", "toxic", "key").collect()):  # a bounded sample: ids, labels and digests
        unique.setdefault(r["key"], (r["doc_id"], r["toxic"]))
    known = sorted((doc_id, toxic, key) for key, (doc_id, toxic) in unique.items())
    n, positive = len(known), sum(t for _, t, _ in known)
    if positive in (0, n):
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log((positive + 0.5) / (n - positive + 0.5))))
    number = {key: i for i, (_, _, key) in enumerate(known)}
    learn = sample.sparkSession.createDataFrame([(key, t) for i, (_, t, key) in enumerate(known) if i % 4], "key string, toxic int")
    hashes = screened(sample, learn)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_bytes = lambda f: _place(hashes, np.sort(np.array(f, np.int64).view(np.uint64))).astype(np.int16).tobytes()
        for batch in batches:
            own = [as_bytes(f) for f in batch.column(1).to_pylist()]
            swap = [[[as_bytes(f) for f in p] for p in s] for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(swap, pa.list_(pa.list_(pa.binary())))], names=["key", "features", "swap"])

    rows = sample.select("key", "features", "swap").mapInArrow(shrink, "key string, features binary, swap array<array<binary>>").collect()
    d = len(hashes)
    x, swaps = np.zeros((n, d), bool), []
    seen = set()
    for r in sorted(rows):
        if r["key"] not in seen:
            seen.add(r["key"])
            x[number[r["key"]], np.frombuffer(r["features"], np.int16)] = 1
            swaps += [(np.frombuffer(a, np.int16), np.frombuffer(b, np.int16)) for a, b in r["swap"]]
    terms = [t for g in IDENTITIES for t in g]
    bare = dict(zip(terms, (_place(hashes, f) for f in _distinct(pa.array(terms)))))
    swaps += [(bare[a], bare[b]) for g in IDENTITIES for a in g for b in g if a < b]
    y = np.array([t for _, t, _ in known], float)
    part = np.arange(n) % 4 != 0
    differences = _differences(swaps, d)
    w, b = _relaxed(x, y, differences, l1, l2, swap_weight, steps)
    aside = y[~part]
    if 0 < aside.sum() < len(aside) and 0 < y[part].sum() < part.sum():
        w_part, b_part = _relaxed(x[part], y[part], differences, l1, l2, swap_weight, steps)
        b += float(np.log(THRESHOLD / (1 - THRESHOLD))) - _cut(_sums(x[~part], w_part) + b_part, aside)
    used = np.flatnonzero(w)
    return ToxicityModel(hashes[used], w[used].astype(float), b)


def _differences(swaps: list[tuple[np.ndarray, np.ndarray]], d: int) -> np.ndarray:
    """A row for each distinct swap that any known feature tells apart, times the root of how often it occurs."""
    count: dict[tuple[bytes, bytes], int] = {}
    for a, b in swaps:
        a, b = (np.unique(v).astype(np.int16) for v in (a, b))
        if len(a) or len(b):
            count[a.tobytes(), b.tobytes()] = count.get((a.tobytes(), b.tobytes()), 0) + 1
    rows = np.zeros((len(count), d), np.float32)
    for row, ((a, b), k) in zip(rows, sorted(count.items())):
        row[np.frombuffer(a, np.int16)] -= np.sqrt(k)
        row[np.frombuffer(b, np.int16)] += np.sqrt(k)
    return rows / np.sqrt(max(1, sum(count.values())))


def _cut(margin: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between margins at which the fewest documents are on the wrong side; a clean one counts three times."""
    order = np.argsort(margin, kind="stable")
    margin, y = margin[order], y[order]
    below = np.concatenate([[0], np.cumsum(y == 1)])  # toxic ones under the cut
    above = np.concatenate([[0], np.cumsum((y == 0)[::-1])])[::-1]
    wrong = (below + 3 * above)[1:-1]
    gaps = np.diff(margin)
    best = np.flatnonzero(wrong == wrong.min())
    i = int(best[np.argmax(gaps[best])])
    return float((margin[i] + margin[i + 1]) / 2)


def _parts(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Places and floats of FLOAT_ROWS rows after the other of a matrix of booleans, which as floats would take four times its room."""
    for at in range(0, len(x), FLOAT_ROWS):
        yield slice(at, at + FLOAT_ROWS), x[at : at + FLOAT_ROWS].astype(np.float32)


def _sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w for booleans x."""
    return np.concatenate([rows @ w for _, rows in _parts(x)])


def _relaxed(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, l1: float, l2: float, swap_weight: float, steps: int) -> tuple[np.ndarray, float]:
    """For booleans x: weights of mean log-loss + l1 |w| + l2 w^2 + swap_weight * mean squared score change of the swaps, both labels weighing alike; what is
    selected is then fitted again and shrunk less."""
    n, positive = len(y), y.sum()
    weight = np.where(y == 1, n / (2 * positive), n / (2 * (n - positive)))
    w, b = _descend(x, y, weight, swaps, swap_weight, l1, l2, steps)
    used = np.flatnonzero(w)
    part, b = _descend(np.ascontiguousarray(x[:, used]), y, weight, np.ascontiguousarray(swaps[:, used]), swap_weight, l1 * RELAXED, l2, steps)
    w[used] = part
    return w, b


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, swaps: np.ndarray, scale: float, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    n, d = x.shape
    v, size = np.ones(d, np.float32), 1.0  # power iteration for the step
    single = weight.astype(np.float32)
    for _ in range(20):
        v = sum(rows.T @ (single[at] * (rows @ v)) for at, rows in _parts(x)) / (4 * n) + 2 * scale * (swaps.T @ (swaps @ v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 1 / (1.2 * size + 2 * l2 + 0.25)
    w = w_old = np.zeros(d, np.float32)
    b = b_old = 0.0
    t = 1.0
    for _ in range(steps):
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wz, bz = w + (t - 1) / t_new * (w - w_old), b + (t - 1) / t_new * (b - b_old)
        off, g = np.zeros(n), 2 * l2 * wz + 2 * scale * (swaps.T @ (swaps @ wz))
        for at, rows in _parts(x):
            off[at] = weight[at] * (1 / (1 + np.exp(-np.clip(rows @ wz + bz, -30, 30))) - y[at]) / n
            g += rows.T @ off[at].astype(np.float32)
        w_old, b_old, t = w, b, t_new
        w = wz - step * g
        w = (np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)).astype(np.float32)
        b = bz - step * float(off.sum())
    return w, b


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> ToxicityModel:
    """Fits on a sample bounded by toxic_rows + clean_rows documents; learns nothing from held-out rows, lang, source or doc_id."""
    return fit(training_rows(docs, labels, toxic_rows, clean_rows))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score for each row of docs(doc_id, text): 0 to 1, from the whole text; null and empty texts get the bias's score.

    Equal texts score alike; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1)))], names=["doc_id", "score"])

    return short_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold, else 0) for each row of docs."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores threshold or more, columns unchanged. The text is scored where it is: no join."""
    model = train(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                yield part.filter(pa.array(model.scores(part.column(names.index("text")).cast(pa.string())) < threshold))

    return short_batches(docs).mapInArrow(run, docs.schema)
