"""User functions over the ordered frames of a clip, with a state that no other clip sees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from clipflow.streaming.folds import fold


def with_stage(df: DataFrame, start: Callable[[], dict], step: Callable[[dict, dict], list[dict]], schema: str) -> DataFrame:
    """``step(state, frame)`` for each frame in order; every clip begins with a new ``start()``. Columns: session_id, idx, t, score, present."""
    return fold(df, step, lambda s: [], start, schema)


def with_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A stateless stage over batches of frames, such as an encoder of single images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)
