"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, gram string, norm string, digest string, rate string, copy string, label string, _text string, run string, sig string"
TOXIC = ("idiot", "scum", "moron")


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", "   ", "\n\t", "one", "One", "one two three", "<|endoftext|> x", "é ü 日本 \U0001f600", "12 34 !!"]
    base = [words(rng, rng.randint(8, 90)) for _ in range(12)]
    texts += [words(rng, 9000), "z" * 5000]
    while len(texts) < n:
        b = rng.choice(base).split()
        kind = rng.random()
        if kind < 0.3:
            texts.append(" ".join(b))
        elif kind < 0.5:
            texts.append("  ".join(b) + " ")
        else:
            for _ in range(rng.randint(1, 4)):
                b[rng.randrange(len(b))] = words(rng, 1)
            texts.append(" ".join(b).upper() if rng.random() < 0.2 else " ".join(b))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i * 7, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), None if t is None else len(t), *["x"] * 10) for i, t in zip(ids, texts)]


def frame(spark, data: list[tuple]):
    return spark.createDataFrame(data, SCHEMA)
