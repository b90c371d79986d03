"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample; the scores are then calibrated by one temperature,
fitted on training documents kept aside. Document frequencies are counted over all documents that may be learned from."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import held_out, mix, pieces, smallest, worker_state

#: Hashed features, and the lengths of the n-grams.
FEATURE_BITS, ORDERS = 15, (1, 2, 3)
FEATURES = 1 << FEATURE_BITS
#: Bound of the training sample: documents of each language, in hashed order of their ids.
ROWS_PER_LANGUAGE = 400
#: Lengths of the excerpts that each training document gives besides its whole text, so that short texts are known too.
EXCERPTS = (8, 20, 60, 200)
#: Follow-the-regularised-leader: step, offset, penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.02, 0.05, 3
#: Share of the training documents that only fit the temperature.
CALIBRATION = 0.15

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def ngrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first document, documents, feature of each n-gram, document offsets, any letter by document) over pieces of the lower-cased whole texts.

    Every run of characters that aren't letters is one space; documents are set apart by a space."""
    for raw, starts, at in pieces(pc.utf8_lower(texts.cast(pa.large_string()))):
        n = len(starts)
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), starts)  # code points before each document
        letter = letters()[codes]
        owner = np.repeat(np.arange(n), np.diff(np.append(place, len(codes))))
        change = np.ones(len(codes), bool)
        change[1:] = owner[1:] != owner[:-1]
        keep = letter.copy()
        keep[1:] |= letter[:-1] & ~change[1:]  # the first of each run that is no letter
        keep |= change
        codes, owner, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
        doc, feature = [], []
        for k in ORDERS:
            if len(codes) < k:
                continue
            end = len(codes) - k + 1
            value = np.full(end, k, np.uint64)
            for j in range(k):
                value = value * np.uint64(0x100000001B3) + codes[j : j + end]
            same = owner[:end] == owner[k - 1 :] if k > 1 else np.ones(end, bool)
            if k == 1:
                same &= letter
            doc.append(owner[:end][same])
            feature.append((mix(value[same]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32))
        some = np.zeros(n, bool)
        some[owner[letter]] = True
        owner, feature = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, feature))
        yield at, n, owner, feature, some


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and how many hold each feature: counted within partitions, then summed by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("language")
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            long_at, long_seen = -1, np.zeros(FEATURES, bool)
            for at, k, doc, feature, _ in ngrams(batch.column(0)):
                if k == 1:  # a text in several pieces counts once
                    if at != long_at:
                        total += long_seen
                        long_at, long_seen = at, np.zeros(FEATURES, bool)
                    long_seen[feature] = True
                else:
                    code = np.unique(doc.astype(np.int64) * FEATURES + feature)
                    total += np.bincount(code % FEATURES, minlength=FEATURES)
            total += long_seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES), pa.int32()), pa.array(np.concatenate([[n], total]), pa.int64())], names=["feature", "df"])

    counts = rows.select(F.col("text").cast("string")).mapInArrow(run, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(FEATURES + 1, np.int64)
    for r in counts:
        out[r["feature"] + 1] = r["df"]
    return int(out[0]), out[1:]


def training_rows(rows: DataFrame, per_language: int) -> DataFrame:
    """doc_id, lang, part (0: the whole text, then excerpts), features, counts of a sample: per_language rows of different id or text a language at most."""
    ids = rows.select("doc_id", "lang", F.xxhash64("text").alias("key"))
    ids = smallest(ids, ["lang"], F.xxhash64(F.lit(3), F.col("doc_id"), F.col("key")), per_language).select("doc_id", "lang", "key").distinct()
    rows = rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("key")).join(F.broadcast(ids), ["doc_id", "lang", "key"])  # bounded above
    sample = rows.dropDuplicates(["doc_id", "lang", "key"]).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [text]
                for k, size in enumerate(EXCERPTS):
                    if len(text) > size:
                        at = int(hashlib.md5(f"{doc_id}:{k}".encode()).hexdigest()[:8], 16) % (len(text) - size)
                        parts.append(text[at : at + size])
                found = {}
                for at, _, doc, feature, _ in ngrams(pa.array(parts, pa.string())):
                    for d in np.unique(doc):
                        found.setdefault(at + int(d), []).append(feature[doc == d])
                for part, lists in found.items():
                    names, counts = np.unique(np.concatenate(lists), return_counts=True)
                    arrays = [pa.array([v], t) for v, t in ((doc_id, pa.int64()), (lang, pa.string()), (part, pa.int32()), (names, pa.list_(pa.int32())), (counts, pa.list_(pa.int32())))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "part", "features", "counts"])

    return sample.mapInArrow(run, "doc_id long, lang string, part int, features array<int>, counts array<int>")


class LanguageModel:
    """weights[feature, language] of TF-IDF values, biases, a temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.languages, self.bias, self.temperature = languages, bias, temperature
        self.table = (idf[:, None] * weights).astype(np.float32)

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and whether it has a letter."""
        total, size, some = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for at, n, doc, feature, letter in ngrams(texts):
            some[at : at + n] |= letter
            size[at : at + n] += np.bincount(doc, minlength=n)
            for c in range(len(self.languages)):
                total[at : at + n, c] += np.bincount(doc, self.table[feature, c], n)
        return total / np.maximum(size, 1)[:, None] + self.bias, some

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        logits, some = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        return [self.languages[b] if s else "und" for b, s in zip(best, some)], np.where(some, p.max(1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list, n_docs: int, df: np.ndarray) -> LanguageModel:
    """Follow-the-regularised-leader over the sample in hashed order. Without rows there are no languages."""
    languages = sorted({r["lang"] for r in rows})
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    k = len(languages)
    if not k:
        return LanguageModel([], idf, np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    draw = lambda r, salt: int(hashlib.md5(f"{salt}:{r['doc_id']}:{r['part'] if salt else 0}".encode()).hexdigest()[:8], 16) / 2**32
    examples = [(languages.index(r["lang"]), np.array(r["features"]), np.array(r["counts"], float), draw(r, 0) < CALIBRATION, draw(r, 1)) for r in rows]
    examples = [(y, f, c / c.sum() * idf[f], aside, order) for y, f, c, aside, order in examples]
    learn = sorted((e for e in examples if not e[3]), key=lambda e: e[4]) or examples
    aside = [e for e in examples if e[3]] or learn
    scale = 30.0  # term frequencies are small numbers
    z, g2 = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))  # the last row is the bias
    penalty = np.full((FEATURES + 1, 1), L1)
    penalty[-1] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        zz, p = z[at], penalty[at]
        return np.where(np.abs(zz) <= p, 0.0, -(zz - np.sign(zz) * p) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2))

    for _ in range(PASSES):
        for y, f, x, _, _ in learn:
            at, value = np.append(f, FEATURES), np.append(x * scale, 1.0)[:, None]
            w = weights(at)
            p = softmax((w * value).sum(0))
            p[y] -= 1
            g = value * p
            sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA
            z[at] += g - sigma * w
            g2[at] += g * g
    w = weights(np.arange(FEATURES + 1))
    model = LanguageModel(languages, idf, w[:-1] * scale, w[-1], 1.0)
    logits = np.array([model.bias + (w[f] * scale * x[:, None]).sum(0) for _, f, x, _, _ in aside])
    right = np.array([e[0] for e in aside])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(right)), right], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def train(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learns from text and lang of the rows that aren't held out; the sample has at most per_language documents of a language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))
    rows = rows.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = training_rows(rows, per_language).collect()
    return fit(sample, *document_frequencies(rows))


def language_id(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text, lang).

    lang_pred is a learned language, or `und` with score 0 where the text is null or has no letter (or nothing could be learned); score is
    its calibrated probability. The whole text is used and nothing else. Ties go to the first language by name; equal texts are predicted
    alike; an empty table gives no rows; other columns are ignored."""
    model = train(docs, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("language")
        for batch in batches:
            lang, score = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
