"""Streaming forms of the operators that are online by nature."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def windowed_totals(events: DataFrame, *, size: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """(window, by, n, value) of an event stream (ts, value), with late data kept for ``late``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


#: Keyed state of this kind needs Spark's store on RocksDB.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TrailingVolatility(StatefulProcessor):
    """For each series, the last ``window`` values and its volatility after each of them."""

    def __init__(self, window: int, periods: int) -> None:
        self.window, self.root = window, math.sqrt(periods)

    def init(self, handle: StatefulProcessorHandle) -> None:
        # The count of values so far and the last ``window`` of them: one read and one write for each series and trigger.
        self.tail = handle.getValueState("tail", "n long, last array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        frame = pd.concat(frames).sort_values(["ts", "id"], kind="stable").reset_index(drop=True)
        n, past = self.tail.get() if self.tail.exists() else (0, [])
        values = np.concatenate([np.array(past, float), frame["value"].to_numpy(float)])
        out = np.full(len(frame), np.nan)
        own = values[-(len(frame) + self.window - 1) :]
        if len(own) >= self.window:
            ends = np.std(np.lib.stride_tricks.sliding_window_view(own, self.window), axis=1, ddof=1) * self.root
            out[len(out) - len(ends) :] = ends
        self.tail.update((n + len(frame), values[-self.window :].tolist()))
        yield pd.DataFrame({"series": key[0], "id": frame["id"], "ts": frame["ts"], "value": frame["value"], "volatility": [None if np.isnan(v) else float(v) for v in out]})

    def close(self) -> None:
        pass


def trailing_volatility(events: DataFrame, *, window: int = 21, periods: int = 252) -> DataFrame:
    """(series, id, ts, value, volatility) of a stream (series, id, ts, value): the annualised deviation of a full trailing window.

    Within a trigger a series' rows are taken in the order of ts and id; over triggers in that of arrival. The
    state of a series is ``window`` values and a count, and survives restarts with the query's checkpoint. The
    session must use the store named by ``STATE_STORE``.
    """
    kinds = dict(events.dtypes)
    schema = f"series {kinds['series']}, id {kinds['id']}, ts {kinds['ts']}, value double, volatility double"
    return events.groupBy("series").transformWithStateInPandas(TrailingVolatility(window, periods), StructType.fromDDL(schema), "Append", "None")
