from __future__ import annotations

import random

import corpus_pipeline
from seriesloom.llm import mixing
from tests.llm.fixtures import TOXIC, words


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    clean = [words(rng, rng.randint(20, 60)) for _ in range(150)]
    docs, labels = [], []
    for i, text in enumerate(clean):
        docs.append((i, text, "en", "a" if i % 3 else "b", len(text)))
        labels.append((i, 1, 0))
    for i in range(60):
        text = words(rng, 20) + " " + " ".join(rng.choices(TOXIC, k=3))
        docs.append((200 + i, text, "en", "a", len(text)))
        labels.append((200 + i, 0, 1))
    docs += [(300 + i, clean[i].replace(" ", "  ") + " ", "en", "c", 1) for i in range(0)] + [(300 + i, clean[i].replace(" ", " \n"), "en", "c", 1) for i in range(20)]
    docs += [(400 + i, clean[i + 30] + " tail", "en", "c", 1) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = now
        if k + 1 < len(corpus_pipeline.STAGES):
            assert now.columns == columns
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert len([i for i in ids("toxicity") if 200 <= i < 260]) <= 3 and len(ids("toxicity") & set(range(150))) >= 148
    assert not ids("exact_dedup") & set(range(300, 320)) and ids("exact_dedup") >= ids("toxicity") - set(range(300, 320))
    assert not ids("ngram_join") & set(range(400, 420)) and ids("ngram_join") >= ids("exact_dedup") - set(range(400, 420))
    mixed = mixing.mix(seen["ngram_join"]).count()
    assert seen["mixing"].count() == seen["bpe"].count() == mixed
    text = {d[0]: d[1] for d in docs}
    import hashlib

    for r in seen["bpe"].collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens * 4 == len(r.ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == mixed
