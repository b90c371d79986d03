from __future__ import annotations

import importlib
import random
import subprocess
import sys
from pathlib import Path

from seriesloom.operators.classify import early_decisions
from seriesloom.streaming.early import decide_stream

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_corpus_operators():
    code = """
import sys
class No:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("seriesloom.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
assert e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "seriesloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "seriesloom.llm" not in path.read_text()
    assert importlib.import_module("seriesloom")


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, s, float(rng.randrange(2)), rng.random() < 0.7) for i in range(15) for s in range(2, 12)]
    schema = "series_id long, s int, label_at double, accepted boolean"
    for s in range(2, 12):
        spark.createDataFrame([r for r in rows if r[1] == s], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    run = decide_stream(stream, 3, 11).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert run.awaitTermination(180)
    want = {(r.series_id, r.s, r.predicted) for r in early_decisions(spark.createDataFrame(rows, schema), 3, 11).collect()}
    assert {(r.series_id, r.s, r.predicted) for r in spark.table("decided").collect()} == want and len(want) == 15
