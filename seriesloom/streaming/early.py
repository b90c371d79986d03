"""Early decisions over a stream of snapshots: keyed state, one row out when a series is decided."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def decide_stream(snapshots: DataFrame, threshold: int, last: int) -> DataFrame:
    """series_id, s, predicted as soon as `threshold` accepted labels in a row are equal, or at snapshot `last`.

    snapshots: a stream of series_id long, s int, label_at double, accepted boolean, in order of s within a series. State is a label, a run length
    and whether the series is decided; later snapshots of a decided series give nothing. A series that is silent keeps its few bytes of state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        label, run, done = state.get if state.exists else (0.0, 0, False)
        out = []
        for row in pd.concat(list(batches)).sort_values("s").itertuples():
            if done or not (row.accepted or row.s >= last):
                continue
            run = run + 1 if run and row.label_at == label else 1
            label = float(row.label_at)
            if run >= threshold or row.s >= last:
                done = True
                out.append((key[0], int(row.s), label))
        state.update((label, int(run), done))
        yield pd.DataFrame(out, columns=["series_id", "s", "predicted"])

    schema = "series_id long, s int, predicted double"
    return snapshots.groupBy("series_id").applyInPandasWithState(step, schema, "label double, run int, done boolean", "append", GroupStateTimeout.NoTimeout)
