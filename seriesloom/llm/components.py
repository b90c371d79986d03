"""Connected components by alternating stars, on DataFrames only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.llm.common import checkpoint, discard, sliced, split_lookup
from seriesloom.llm.prefix_trie import merged

#: Edges that a task contracts at once.
EDGES_AT_ONCE = 500_000

#: Rows for each task of a round, and the fewest tasks; beyond, as many tasks as the shuffle has partitions.
TASK_ROWS, FEWEST_TASKS = 50_000, 8


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of these edges to the smallest one that it is connected with; loops only for nodes that have nothing else."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = merged(np.arange(len(nodes)), place[: len(a)], place[len(a) :])
    alone = np.bincount(label, minlength=len(nodes)) == 1
    keep = (label != np.arange(len(nodes))) | alone
    return nodes[keep], nodes[label[keep]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what the given ones connect, fewer of them: stars of bounded parts of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            a, b = stars(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            n += batch.num_rows
            if n >= EDGES_AT_ONCE:
                yield from sliced(out())
                held, n = [], 0
        if n:
            yield from sliced(out())

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a long, b long); the component is its smallest node.

    Edges are contracted within partitions, then two steps alternate until nothing changes: every node links its larger neighbours to its
    smallest one, then its smaller neighbours and itself. Both keep connectivity; a star is done in a round and a path of n nodes in about log n.
    No node's neighbours are gathered: minima are aggregated and joined back, the nodes of very many edges by a broadcast of bounded size. A round has
    tasks by its counted edges, so that few edges don't cost a task for each shuffle partition. Loops
    and repeated edges are harmless, though a node with only a loop is returned too; rows with a null end are ignored; an empty table gives
    an empty result."""
    given = checkpoint(contracted(edges.filter("a IS NOT NULL AND b IS NOT NULL")))
    loops = checkpoint(given.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    edges = checkpoint(given.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    discard(given)
    count, state = edges.count(), None
    while count:
        tasks = max(FEWEST_TASKS, count // TASK_ROWS)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("size")).coalesce(tasks))
        large = split_lookup(both.filter("v > u"), least, "u", "size", 2 * count).coalesce(tasks)
        large = checkpoint(large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks))
        discard(edges, least)
        # contraction leaves each node one smaller neighbour a part, so what follows has as many rows of an a as there were parts at most
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a"))).coalesce(tasks)
        ends = F.explode(F.array_distinct(F.array("a", F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")))))
        edges = checkpoint(small.select(ends.alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks))
        discard(large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        count, state = now[0], now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.union(heads).union(loops.join(found.union(heads), "node", "left_anti"))
