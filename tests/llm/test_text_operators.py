from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesloom.llm import bpe as B
from seriesloom.llm import chat as C
from seriesloom.llm import html_extract as H
from seriesloom.llm import mixing as M
from seriesloom.llm import toxicity as X
from seriesloom.llm.common import held_out
from seriesloom.llm.fingerprints import edited_fingerprints, fingerprints
from seriesloom.llm.language_id import language_id
from seriesloom.llm.word_pieces import Automaton, token_counts

from .fixtures import TOXIC, frame, rows, words

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def merges():
    return B.Merges(open(BYTE, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def test_bpe_equals_the_library(spark, library):
    data = rows(2)
    got = {r.doc_id: r for r in B.bpe(frame(spark, data), BYTE).collect()}
    for r in data:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        assert np.frombuffer(got[r[0]].ids, "<u4").tolist() == ids
        assert got[r[0]].decoded == library.decode(ids, skip_special_tokens=False) == (r[1] or "")
    assert B.bpe(frame(spark, []), BYTE).collect() == []
    back = B.bpe_decode(B.bpe(frame(spark, data), BYTE, decoded=False), BYTE).collect()
    assert sorted((r.doc_id, r.decoded) for r in back) == sorted((r[0], r[1] or "") for r in data)


def test_transducer_memory_and_cuts(merges, library):
    rng = random.Random(4)
    for text in ("a" * 3000, "ÃÂ" * 900, "".join(rng.choice("etaoinshr") for _ in range(6000)), "-=" * 2000):
        run, out, most = B.Transducer(merges), [], 0
        data = text.encode()
        for i in range(0, len(data), 37):
            out += run.push(data[i : i + 37])
            most = max(most, len(run.last))
        assert out + run.finish() == merges.plain(data[:0]) + library.encode(text, add_special_tokens=False).ids
        assert most <= 2 * run.STEP + merges.lookahead
    text = "x  y  'll don't \r\n\t z " * 40 + "w" * 700
    assert "".join(B.blocks(text, 300)) == text
    assert [w for b in B.blocks(text, 300) for w in merges.cut.findall(b)] == merges.cut.findall(text)


def small_merges(rng, letters, count):
    """A random merge list over a few letters; some listed tokens are never made."""
    import json

    char = B.byte_characters()
    tokens, pairs = list(letters), []
    while len(pairs) < count:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) <= 6:
            tokens.append(a + b)
            pairs.append([a, b])
    if rng.random() < 0.3:
        rng.shuffle(pairs)
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*char, *tokens]))}
    return B.Merges(json.dumps({"model": {"vocab": vocab, "merges": pairs}}))


def test_lookahead_suffices_for_all_strings_of_small_merge_lists(monkeypatch):
    import itertools

    rng = random.Random(8)
    monkeypatch.setattr(B.Transducer, "STEP", 1)  # settles after every byte
    for _ in range(40):
        m = small_merges(rng, "ab", rng.randint(1, 7))
        assert m.lookahead <= max(map(len, m.ids))
        for n in range(1, 10):
            for t in itertools.product("ab", repeat=n):
                data = "".join(t).encode()
                run = B.Transducer(m)
                early = run.push(data)
                whole = m.plain(data)
                assert early + run.finish() == whole == B.short_word(m, data)
                for more in ("a", "b", "ab", "ba", "aab", "bba"):  # what was emitted stays
                    assert m.plain(data + more.encode())[: len(early)] == early


def test_transducer_memory_is_constant(merges):
    run, most, n = B.Transducer(merges), 0, 0
    rng = random.Random(4)
    for _ in range(300):
        n += len(run.push("".join(rng.choice("etaoinshr") for _ in range(1000)).encode()))
        most = max(most, len(run.last))
    assert most <= 2 * merges.lookahead + run.STEP and n > 100_000


def test_decoder_is_incremental(merges, library):
    rng = random.Random(5)
    ids = [rng.randrange(50257) for _ in range(400)]
    run = B.Decoder(merges)
    assert "".join(run.push([i]) for i in ids) + run.push([], True) == library.decode(ids, skip_special_tokens=False)


def test_token_counts(spark):
    import json

    spec = json.load(open(WORD))
    vocab = set(spec["model"]["vocab"]) - {t["content"] for t in spec["added_tokens"]}
    char = B.byte_characters()

    def greedy(word):
        s, n = "".join(char[b] for b in word.encode()) + "</w>", 0
        while s:
            end = next(k for k in range(len(s), 0, -1) if s[:k] in vocab)
            s, n = s[end:], n + 1
        return n

    data = rows(9, 30)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(frame(spark, data), WORD).collect()}
    for r in data:
        if len(r[1] or "") < 4000:
            w = regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", (r[1] or "").lower())
            assert got[r[0]] == (len(w), sum(map(greedy, w)))
    assert token_counts(frame(spark, []), WORD).collect() == []


def test_automaton_against_greedy():
    rng = random.Random(6)
    for _ in range(300):
        vocab = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(6)}
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        s, n = word, 0
        while s is not None and s:
            k = next((k for k in range(len(s), 0, -1) if s[:k] in vocab), None)
            s, n = (s[k:], n + 1) if k else (None, None)
        assert Automaton(sorted(vocab)).count(word) == n


def test_mixing(spark):
    data = rows(11, 40)
    docs = frame(spark, data)
    out = M.mix(docs).collect()
    rates = {r.source: r for r in M.source_rates(docs).collect()}
    assert abs(sum(r.weight for r in rates.values()) - 1) < 1e-9
    assert abs(sum(r.rate * r.n_docs for r in rates.values()) - len(data)) < 1e-6
    count = {}
    for r in out:
        count.setdefault(r.doc_id, []).append(r["copy"])
    for r in data:
        u = int(hashlib.md5(f"{M.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, total = 0, np.exp(-rates[r[3]].rate), np.exp(-rates[r[3]].rate)
        while total <= u:
            k += 1
            p *= rates[r[3]].rate / k
            total += p
        assert sorted(count.get(r[0], [])) == list(range(k))
    assert M.mix(frame(spark, [])).collect() == []
    only = M.mix(docs, spark.createDataFrame([("b", 2.0), ("nowhere", 1.0)], "source string, weight double")).collect()
    assert {r.source for r in only} <= {"b"} and only
    assert M.mix(docs, spark.createDataFrame([], "source string, weight double")).collect() == []


def test_mixing_keeps_columns(spark):
    names = ["_n", "_key", "_u", "_cdf", "_rate", "key", "cdf", "given", "number", "draw", "salt"]
    docs = frame(spark, rows(11, 20)).drop("copy", "rate").selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    out = M.mix(docs)
    assert set(docs.columns) <= set(out.columns) and all(r[n] == n for r in out.collect() for n in names)


def test_mixing_mean(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    target = spark.createDataFrame([("hot", 1.0), ("s1", 1.0)], "source string, weight double")
    out = {r.source: r["count"] for r in M.mix(docs, target).groupBy("source").count().collect()}
    assert set(out) == {"hot", "s1"} and all(abs(n - 2000) < 250 for n in out.values())


def test_fingerprints(spark):
    data = rows(12, 40)
    got = {r.doc_id: r for r in edited_fingerprints(frame(spark, data)).collect()}
    order = sorted(data, key=lambda r: -r[0])

    def grams(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    by_text, errors = {}, []
    for i, r in enumerate(order):
        after = order[(i + 1) % len(order)][1] or ""
        text = r[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        g = got[r[0]]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, g.fingerprint) == g.fingerprint
        assert (g.fingerprint == "") == (not grams(text)) and len(g.fingerprint) in (0, 512)
        errors += [g.near_edited - jaccard(grams(text), grams(edited)), g.near_next - jaccard(grams(text), grams(after))]
        assert (g.near_edited == 1.0) or g.fingerprint != g.edited_fingerprint
    assert np.sqrt(np.mean(np.square(errors))) < 0.04
    assert edited_fingerprints(frame(spark, [])).collect() == []
    one = edited_fingerprints(frame(spark, [data[30]])).collect()[0]
    assert one.near_next == 1.0
    again = edited_fingerprints(frame(spark, data + data[:3] + [(None, "a b", *data[0][2:])])).collect()
    assert len(again) == len(data) + 4
    assert len(fingerprints(frame(spark, data)).collect()) == len(data)


def test_fingerprint_runs(spark, monkeypatch):
    import seriesloom.llm.fingerprints as module

    monkeypatch.setattr(module, "RUN_ROWS", 7)
    data = [(i * i * 3 - 50, f"text number {i} " + "w " * (i % 5)) for i in range(60)] + [(None, "no id")]
    got = {r.doc_id: r.next_text for r in module.with_next(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    order = sorted(data, key=lambda r: -(r[0] if r[0] is not None else -(10**9)))
    assert got == {r[0]: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}


def test_toxicity(spark):
    rng = random.Random(7)
    data, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = words(rng, rng.randint(5, 60)).split()
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(TOXIC))
        if i % 5 == 0:
            text.insert(0, rng.choice(["women", "men", "muslims"]) + " are here.")
        data.append((i, " ".join(text)))
        if i % 10:
            labels.append((i, 1, int(toxic)))
    data += [(1000, None), (1001, ""), (1002, "women"), (1003, "men"), (1004, "you idiot scum moron"), (1005, "q " * 20000 + "idiot scum")]
    labels += [(0, 1, None), (None, 1, 1), (5000, 0, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.toxicity(docs, known).collect()}
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    aside = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in aside]) > 0.93
    assert abs(got[1002].score - got[1003].score) < 0.02 and got[1000].score == got[1001].score
    assert got[1004].predicted == 1 and got[1005].predicted == 1
    kept = X.drop_toxic(docs.withColumn("extra", held_out(docs["doc_id"])), known)
    assert kept.columns == ["doc_id", "text", "extra"] and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    none = X.toxicity(docs, known.limit(0)).collect()
    assert len(none) == len(data) and len({r.score for r in none}) == 1
    assert X.toxicity(docs.limit(0), known).collect() == []


def test_swaps():
    pairs = X.swapped_sentences("The women left. Nobody saw black cats! Fine")
    assert pairs == [("the women left", "the men left"), *((" nobody saw black cats", f" nobody saw {x} cats") for x in ("white", "asian", "latino"))]


def test_toxicity_of_repeated_ids_and_rows(spark):
    rng = random.Random(9)
    data = [(i, " ".join([words(rng, 12), *rng.choices(TOXIC, k=2 * (i % 3 == 0))])) for i in range(200)]
    data += [(3, words(rng, 12)), (3, None), (6, data[6][1]), (6, data[6][1]), (None, "idiot scum moron"), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'a' AS `of`", "1 AS toxic", "'k' AS key", "2 AS features")
    known = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)] + [(6, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    sample = X.training_rows(docs, known, 2000, 4000).collect()
    aside = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    want = {(i, int(i % 3 == 0)) for i in range(200) if i not in aside} | ({(7, 1)} if 7 not in aside else set())
    assert {(r.doc_id, r.toxic) for r in sample} == want and len([r for r in sample if r.doc_id == 3]) == 2 * (3 not in aside)
    assert len(X.training_rows(docs, known, 5, 7).collect()) == 12
    got = X.toxicity(docs, known).collect()
    assert len(got) == len(data) and len({r.score for r in got if r.doc_id == 6}) == 1


def test_toxicity_trains_in_little_memory(spark):
    rng, n, d = np.random.default_rng(8), 1_500, X.FEATURES
    telling = rng.permutation(d)[:20]
    data = []
    for i in range(n):
        has = {*rng.choice(d, 60, replace=False).tolist()} - {*telling.tolist()} | ({*rng.choice(telling, 3).tolist()} if i % 3 == 0 else set())
        data.append((i, int(i % 3 == 0), str(i), sorted(has), []))
    sample = spark.createDataFrame(data, "doc_id long, toxic int, key string, features array<long>, swap array<array<array<long>>>").repartition(8)
    tracemalloc.start()
    try:
        model = X.fit(sample, steps=20)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    weights = dict(zip(model.hashes.tolist(), model.weights))
    assert {*telling.tolist()} <= {h for h, w in weights.items() if w > 0}
    assert most < 6 * n * d  # bytes: one matrix of floats with a copy takes 8 n d


def test_toxicity_fits_as_on_floats():
    rng = np.random.default_rng(12)
    x, y = rng.random((700, 40)) < 0.2, (np.arange(700) % 3 == 0).astype(float)
    x[:, 5] |= (y == 1) & (rng.random(700) < 0.7)
    weight, swaps = rng.random(700) + 0.5, rng.normal(size=(3, 40)).astype(np.float32)
    w, b = X._descend(x, y, weight, swaps, 0.1, 1e-3, 1e-5, 400)
    assert np.allclose(X._sums(x, w), x.astype(float) @ w, atol=1e-5)

    def loss(w, b):
        z = x.astype(float) @ w + b
        return np.mean(weight * (np.logaddexp(0, z) - y * z)) + 1e-3 * np.abs(w).sum() + 1e-5 * (w @ w) + 0.1 * np.sum((swaps.astype(float) @ w) ** 2)

    least = loss(w.astype(float), b)
    for _ in range(200):
        assert loss(w + rng.normal(size=40) * 0.02, b + rng.normal() * 0.02) > least - 1e-7


def test_smallest(spark):
    from pyspark.sql import functions as F

    from seriesloom.llm.common import smallest

    data = [(f"k{0 if i % 3 else i % 5}", i % 4000) for i in range(9000)]
    rows_ = spark.createDataFrame(data, "key string, place long").repartition(5)
    got = {}
    for r in smallest(rows_, ["key"], F.xxhash64("place"), 50).collect():
        got.setdefault(r.key, set()).add(r.place)
    order = {r.place: r.h for r in rows_.select("place", F.xxhash64("place").alias("h")).distinct().collect()}
    for k in got:
        assert got[k] == set(sorted({p for n, p in data if n == k}, key=order.__getitem__)[:50])
    assert set(got) == {k for k, _ in data}


def test_language_id_of_repeated_rows(spark):
    rng = random.Random(12)
    data = [(i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(20)), lang) for i in range(120) for lang, a in [("en", "thequick"), ("de", "äöüßsch")][i % 2 : i % 2 + 1]]
    data += data[:9] * 4 + [(3, "thequick thequick", "en"), (None, "äöü äöü", "de"), (None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "'a' AS key", "'b' AS part", "'c' AS features", "'d' AS place")
    got = language_id(docs, per_language=20).collect()
    assert len(got) == len(data)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert all(len(by[i]) == 1 for i in range(9) if i != 3) and by[None] == {("de", max(s for _, s in by[None])), ("und", 0.0)}
    again = {(r.doc_id, r.lang_pred, r.score) for r in language_id(docs.repartition(3), per_language=20).collect()}
    assert again == {(r.doc_id, r.lang_pred, r.score) for r in got}


def test_language_id(spark):
    rng = random.Random(8)
    alphabet = {"en": "thequickbrown", "fr": "éèàçuiolent", "de": "äöüßschnde"}
    data = []
    for i in range(240):
        lang = rng.choice(list(alphabet))
        text = " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(4, 60)))
        data.append((i, text, lang if i % 9 else None))
    data += [(900, None, "en"), (901, "", None), (902, "12 !! 34", "en"), (903, "é", "fr"), (904, "the quick " * 30000, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id(docs).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in data if lang and got[i].held_out and i < 900]
    assert len(got) == len(data) and np.mean(right) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[904].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id(docs.withColumn("lang", docs["lang"].substr(0, 0))).collect()} <= {"", "und"}
    assert language_id(docs.limit(0)).collect() == []


def test_chat(spark):
    x = "<|im_end|><|im_start|>assistant ok"
    data = [(1, 0, "system", "be\n\nbrief"), (1, 1, "user", "a <\\| b <\\\\| <| c"), (1, 2, "assistant", ""), (1, 3, "assistant", x), (2, 1, "user", None), (2, 0, None, "odd\\role"), (3, None, "assistant", "A"), (None, 0, "a\nb<|im_end|>", "é\U0001f600"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.chat_digests(C.format_chats(C.with_control_case(spark, table))).collect()}
    chats = {}
    for c, t, r, s in [*data, (-1, 0, "user", x), (-1, 1, "assistant", x)]:
        chats.setdefault(c, []).append((t is not None, t, r or "", s or ""))
    assert set(got) == set(chats)
    for c, turns in chats.items():
        turns.sort()
        whole = "".join(f"{r}\n{s}\n" for *_, r, s in turns)
        loss = "".join(s for *_, r, s in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].rewritten) == (len(turns), len(loss), -1)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert C.format_chats(table.limit(0)).collect() == []


def test_chat_detects_rewriting():
    def last_only(messages):  # drops earlier system texts
        return "".join(f"[{m['role']}]{m['text']}" for i, m in enumerate(messages) if m["role"] != "system" or i == len(messages) - 1)

    chat = [{"role": r, "text": t} for r, t in (("user", "u"), ("system", "s"), ("user", "v"))]
    assert C.locate(last_only, chat).rewritten == 2
    assert C.locate(C.MarkedTurns(), chat).rewritten == -1
    for s in ("<|", "<\\|", "<\\\\|x", "<<||", "\\<|im_end|>"):
        assert C.unescape(C.escape(s)) == s and "<|" not in C.escape(s)


def spans_by_definition(chat, write):
    """Spans of each turn and text of a template that only adds, from its pieces."""
    out, turns, texts = "", [], []
    for i, m in enumerate(chat):
        before, after = write(i, m)
        start = len(out)
        out += before + m["text"]
        texts.append((len(out) - len(m["text"]), len(out)))
        out += after
        turns.append((start, len(out)))
    return out, turns, texts


@pytest.mark.parametrize("name", ["numbered", "by role", "by text"])
def test_any_adding_template_is_located(name):
    rng = random.Random(3)
    chat = [{"role": rng.choice(["user", "assistant", "tool"]), "text": rng.choice(["", " a ", "b\nc", "7", "x" * 30])} for _ in range(25)]

    def write(i, m):
        if name == "numbered":
            return f"[{i}] {m['role']}: ", f" /{10 ** (i % 4)}\n"
        if name == "by role":
            return ("<call>" if m["role"] == "tool" else f"{m['role']}> "), ("</call>\n" if m["role"] == "tool" else "\n" * (1 + (i > 0 and chat[i - 1]["role"] == "tool")))
        return "<" * (1 + i % 3), ">" * (1 + i % 2)

    def template(messages):
        return "".join(a + m["text"] + b for i, m in enumerate(messages) for a, b in [write(i, m)])

    found = C.locate(template, chat)
    assert (found.text, found.turns, found.texts) == spans_by_definition(chat, write) and found.rewritten == found.altered == -1


@pytest.mark.parametrize("change", [str.strip, str.upper, lambda t: t + t, lambda t: t[:3], lambda t: ""])
def test_templates_that_alter_texts_are_reported(change):
    chat = [{"role": "user", "text": "PLAIN"[:3]}, {"role": "assistant", "text": " an answer "}, {"role": "user", "text": "Z"}]
    found = C.locate(lambda messages: "".join(f"[{m['role']}]{change(m['text'])};" for m in messages), chat)
    assert found.altered >= 0


def test_altered_chats_have_no_mask(spark):
    table = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", " a "), (2, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    table = table.selectExpr("*", "'x' AS formatted", "1 AS altered")
    trimming = lambda: lambda messages: "".join(f"[{m['role']}]{m['text'].strip()}\n" for m in messages)
    got = {r.conv_id: r for r in C.format_chats(table, trimming).collect()}
    assert all(r.altered == 0 and r.loss_spans == [] for r in got.values())  # the probe's spaces are lost too


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav>{ad}<article><h1>Title {i}</h1>{body}<aside>see also</aside><form>f</form></article><section class="comments"><article><p>reader</p></article></section><footer>&copy; x</footer></body></html>'


def test_html(spark):
    data, want = [], {}
    for i in range(30):
        body = "".join(f"<p>Par {k} &amp; more\n  of {i}&nbsp;x<br>end <b>bold</p>" for k in range(1 + i % 4))
        ad = '<div class="ad">buy</div>' if i % 2 else "<!-- ad -->"
        data.append((i, f"https://h{i % 3}.example.com/x/{i}", PAGE.format(i=i, ad=ad, body=body)))
        want[i] = "\n".join([f"Title {i}", *(f"Par {k} & more of {i} x end bold" for k in range(1 + i % 4))])
    data += [(100, None, None), (101, "odd", ""), (102, "https://z.example.com", "<p>a<p>b<div>c"), (103, "https://z.example.com", "plain <"), (100, None, None)]
    want |= {100: "", 101: "", 102: "a\nb\nc", 103: "plain <"}
    table = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text", "'z' AS paths")
    got = H.extract_pages(table).collect()
    assert len(got) == len(data) and {r.page_id: r.text for r in got} == want
    assert H.extract_pages(table.limit(0)).collect() == []


def texts_of(source):
    return [b.text for b in H.blocks_of(source)]


def test_streams_fold_and_align():
    one = "<ul><li><a>x</a></li><li><a>y</a></li></ul><div id=a>t<p>u<blockquote>q</blockquote>v<blockquote>r</blockquote></div>"
    a, place = H.stream(list(H.blocks_of(one)))
    assert H.as_expression(a, 1) == "(ul|L)+ (div.a|#)+ (div.a/blockquote|#)+" and place == [0, 0, 1, 1, 2, 1, 2]
    b, _ = H.stream(list(H.blocks_of("<ul><li><a>x</a></li></ul><div class=ad>n</div><div id=a>t</div>")))
    both = H.aligned(a, b)
    assert H.as_expression(both, 2) == "(ul|L)+ (div.ad|#)? (div.a|#)+ (div.a/blockquote|#)*"
    assert [c[2:4] for c in both] == [[2, 3], [1, 1], [2, 4], [1, 2]]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_alignment_is_longest(a, b):
    pairs = H.matched(list(a), list(b))
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))

    def longest(x, y):
        return 0 if not x or not y else max(1 + longest(x[1:], y[1:]) if x[0] == y[0] else 0, longest(x[1:], y), longest(x, y[1:]))

    assert len(pairs) == longest(a, b)
    columns = [[[c, False, 1, 1, 1, 0] for c in t] for t in (a, b)]
    out = H.aligned(*columns)
    assert len(out) == len(a) + len(b) - len(pairs) and sum(c[3] for c in out) == len(a) + len(b)


def test_raw_elements_and_depth():
    assert texts_of("<p>a<svg/>b<object>c<p>d") == ["abc", "d"]
    assert texts_of("<svg><svg>x</svg>y</svg><p>z") == ["z"]
    assert texts_of("<select-box>kept</select-box><select><option>gone</select >end") == ["kept", "end"]
    assert texts_of("<script>a</scripty></script>b<ScRipt/>c<style>d") == ["bcd"]
    deep = "<div>" * 1000 + "<nav>" * 1000 + "menu" + "</nav>" * 1000 + "text" + "</div>" * 1000 + "<i>" * 5000 + "tail"
    assert texts_of(deep) == ["text", "tail"]
    assert H.extract(deep, None) == "text\ntail"
    wide = "".join(f'<div class="k{chr(97 + i % 26)}{chr(97 + i // 26)}">t{i}</div>' for i in range(300))
    assert H.extract(wide, None).count("\n") == 299


def test_class_words_need_the_wrapper():
    assert H.extract('<article><div class="main-content related-links-enabled">body text</div></article>', None) == "body text"
    assert H.extract('<h1>T</h1><div class="promo-free"><p>a long body text</p><p>and more</p></div>', None).endswith("a long body text\nand more")
    assert H.extract('<article><p>a body of some length</p><div class="comments">c</div></article>', None) == "a body of some length"


def untold(i, k):
    """A page without telling elements or classes."""
    menu = "".join(f"<div><a href=/{j}>menu {j}</a></div>" for j in range(4))
    body = "".join(f"<p>Host {k} page {i} paragraph {j} says something of its own.</p>" for j in range(2 + i % 3))
    extra = f"<div id=x{i}><span><a>also {i}</a></span></div>" if i % 2 else ""
    return f"<html><body><div>{menu}</div><div class=q><h2>Title {i} of {k}</h2>{body}<p>Subscribe to host {k} now.</p>{extra}<p>Copyright of host {k}.</p></div><div class=z>All rights reserved by {k}.</div></body></html>"


def wanted(i, k):
    return "\n".join([f"Title {i} of {k}", *(f"Host {k} page {i} paragraph {j} says something of its own." for j in range(2 + i % 3)), *([f"also {i}"] if i % 2 else [])])


def test_host_wrapper_decides(spark):
    pages = [(100 * k + i, f"http://h{k}.example.org/{i}", untold(i, k)) for k in range(3) for i in range(6)]
    random.Random(4).shuffle(pages)
    out = {}
    for turn, parts in enumerate((1, 5)):
        table = spark.createDataFrame(pages[::-1] if turn else pages, "page_id long, url string, html string").repartition(parts)
        out[turn] = {r.page_id: r.text for r in H.extract_pages(table).collect()}
    assert out[0] == out[1] == {100 * k + i: wanted(i, k) for k in range(3) for i in range(6)}
    alone = H.extract(untold(1, 0), None)
    assert "Subscribe" in alone and "Copyright" in alone  # one page can't tell


def test_common_lines_and_copies_are_no_template(spark):
    pages = []
    for k in range(4):
        for i in range(5):
            line = "<p>A line that many articles have.</p>" if k == 0 or i == 1 else ""
            pages.append((100 * k + i, f"http://h{k}.example.org/{i}", f"<div><p>Own text {k} {i} goes on for a while.</p>{line}</div>"))
    pages += [(900 + i, "http://copy.example.org/", "<div><p>One article.</p><p>Of two blocks.</p></div>") for i in range(4)]
    got = {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "Own text 0 0 goes on for a while.\nA line that many articles have." and got[301].endswith("have.")
    assert got[900] == "One article.\nOf two blocks."


def test_piece_borders(monkeypatch):
    import seriesloom.llm.common as common

    texts = pa.array(["a bb  ccc", None, "", "d " * 50, "e" * 90, "é ü\tß"])
    whole = [v[c[0] : c[1]] for _, v, c in common.shingle_sets(texts.slice(3, 1), 3, True)]
    monkeypatch.setattr(common, "PIECE", 16)
    got = {}
    for at, n, hashes, cut in common.words_by_document(texts, True):
        for i in range(n):
            got[at + i] = len(hashes[cut[i] : cut[i + 1]])
    assert got == {0: 3, 1: 0, 2: 0, 3: 50, 4: 1, 5: 3}
    assert np.array_equal(whole[0], next(v for at, v, _ in common.shingle_sets(texts, 3, True) if at == 3))
