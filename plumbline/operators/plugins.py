"""A user's own models as table functions: forecasters by fold, detectors and encoders by key.

A plug-in is an object with one method; it is shipped to the tasks, gets the rows of one key at a time and
gives back its results. The functions are polymorphic: their schema follows the type of the ids they are given.
"""

from __future__ import annotations

from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from plumbline.session import ship


class Forecaster(Protocol):
    """``name`` and ``forecast(history, horizon)``: the next ``horizon`` values after the history."""

    name: str

    def forecast(self, history: np.ndarray, horizon: int) -> np.ndarray: ...


class Detector(Protocol):
    """``fit_score(x)``: a score for each row of a matrix, greater for odder ones."""

    def fit_score(self, x: np.ndarray) -> np.ndarray: ...


class Encoder(Protocol):
    """``fit(categories, labels)`` on training rows, then ``transform(categories)``: a number for each."""

    def fit(self, categories: list, labels: np.ndarray) -> Any: ...

    def transform(self, categories: list) -> np.ndarray: ...


def fold_forecasts(series: DataFrame, origins: list[int], horizon: int, models: list[Forecaster]) -> DataFrame:
    """(model, origin, last, i, actual, forecast): each model at each origin, on the values before it alone.

    A fold is one key, so folds run in parallel; rows are (idx, value) with distinct idx from 0. A forecast that
    is shorter than the horizon or not finite is an error of the plug-in and raises.
    """
    ship(series.sparkSession)

    class Folds:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            whole, real = IntegerType(), DoubleType()
            return AnalyzeResult(StructType([StructField("model", StringType()), *(StructField(n, whole) for n in ("origin", "last", "i")), StructField("actual", real), StructField("forecast", real)]))

        def __init__(self) -> None:
            self.origin, self.rows = None, []

        def eval(self, rows) -> None:
            self.origin = rows["origin"]
            self.rows.append((rows["idx"], rows["value"]))

        def terminate(self):
            if self.origin is not None:
                values = np.array([v for _, v in sorted(self.rows)], float)
                history, future = values[: self.origin], values[self.origin :]
                for model in models:
                    ahead = np.asarray(model.forecast(history.copy(), horizon), float)
                    if len(ahead) < horizon or not np.isfinite(ahead).all():
                        raise ValueError(f"{model.name}: {horizon} finite values expected")
                    for i in range(len(future)):
                        yield model.name, self.origin, self.origin - 1, i, float(future[i]), float(ahead[i])

    picks = series.sparkSession.createDataFrame([(o,) for o in origins], "origin int")
    rows = F.broadcast(picks).join(series.select(F.col("idx").cast("int").alias("idx"), "value"), F.col("idx") < F.col("origin") + horizon)
    return F.udtf(Folds)(rows.select("origin", "idx", "value").asTable().partitionBy("origin"))


def detect(rows: DataFrame, detector: Detector, *, key: str = "key") -> DataFrame:
    """(key, id, score) of rows (key, id, x): the detector is fitted to each key's rows in one task."""
    ship(rows.sparkSession)

    class Scores:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            types = {f.name: f.dataType for f in rows.dataType.fields}
            return AnalyzeResult(StructType([StructField("key", types["key"]), StructField("id", types["id"]), StructField("score", DoubleType())]))

        def __init__(self) -> None:
            self.key, self.ids, self.x = None, [], []

        def eval(self, rows) -> None:
            self.key = rows["key"]
            self.ids.append(rows["id"])
            self.x.append(rows["x"])

        def terminate(self):
            if self.ids:
                yield from ((self.key, i, float(s)) for i, s in zip(self.ids, detector.fit_score(np.array(self.x, float)), strict=True))

    return F.udtf(Scores)(rows.select(F.col(key).alias("key"), "id", "x").asTable().partitionBy("key"))


def encode(rows: DataFrame, encoder: Encoder, *, key: str = "key") -> DataFrame:
    """(key, id, split, y, encoded) of rows (key, id, split, category, y): fitted to each key's rows of split ``train``."""
    ship(rows.sparkSession)

    class Codes:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            types = {f.name: f.dataType for f in rows.dataType.fields}
            return AnalyzeResult(StructType([*(StructField(n, types[n]) for n in ("key", "id", "split", "y")), StructField("encoded", DoubleType())]))

        def __init__(self) -> None:
            self.rows = []

        def eval(self, rows) -> None:
            self.rows.append((rows["key"], rows["id"], rows["split"], rows["category"], rows["y"]))

        def terminate(self):
            train = [r for r in self.rows if r[2] == "train"]
            if self.rows:
                encoder.fit([r[3] for r in train], np.array([r[4] for r in train], float))
                for r, code in zip(self.rows, encoder.transform([r[3] for r in self.rows]), strict=True):
                    yield r[0], r[1], r[2], r[4], float(code)

    return F.udtf(Codes)(rows.select(F.col(key).alias("key"), "id", "split", "category", "y").asTable().partitionBy("key"))
