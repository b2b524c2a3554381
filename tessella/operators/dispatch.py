"""Sending parts of a frame to workers and collecting what they make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def one_to_all(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Every task gets all of ``small``, if it is small; else both sides are dealt by key."""
    return df.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, keys, "left")


def data_parallel(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, workers: int | None = None) -> DataFrame:
    """``f`` on batches of rows of each worker; nothing has to be padded to a multiple of the workers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield f(pdf)

    return (df.repartition(workers) if workers else df).mapInPandas(run, schema)


def all_reduce_max(df: DataFrame, value: str) -> DataFrame:
    """The largest value of all workers on every row; one row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(F.max(value).alias(f"max_{value}"))))
