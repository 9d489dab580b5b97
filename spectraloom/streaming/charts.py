"""Streaming twins of the control charts, with the state of each series kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "series string, at long, value double, ewma double, cusum double"


def chart(stream: DataFrame, mu: float, sd: float, weight: float = 0.2, slack: float = 0.5) -> DataFrame:
    """EWMA and one-sided CUSUM of (series, at, value) rows, in the order of `at` within each micro-batch.

    Equals the batch charts when batches arrive in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ewma, cusum = state.get if state.exists else (mu, 0.0)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for at, v in zip(rows["at"], rows["value"], strict=True):
            ewma = weight * v + (1 - weight) * ewma
            cusum = max(0.0, cusum + (v - mu) / sd - slack)
            out.append((key[0], at, v, ewma, cusum))
        state.update((ewma, cusum))
        yield pd.DataFrame(out, columns=["series", "at", "value", "ewma", "cusum"])

    rows = stream.select(F.col("series").cast("string"), F.col("at").cast("long"), F.col("value").cast("double"))
    return rows.groupBy("series").applyInPandasWithState(step, OUT, "ewma double, cusum double", "append", GroupStateTimeout.NoTimeout)
