"""Splits of rows in time and by group, as frames of (fold, role) rows or as range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_bounds(spark, n: int, *, n_splits: int = 5, min_train: int = 0, embargo: int = 0) -> DataFrame:
    """(fold, train_end, test_start, test_end): expanding folds; the last n mod (k + 1) rows are never tested."""
    if n_splits < 1 or n // (n_splits + 1) < 1:
        raise ValueError("too few rows or splits")
    size = n // (n_splits + 1)
    rows = [(i, max(0, size * i - embargo), size * i, size * (i + 1)) for i in range(1, n_splits + 1) if size * i >= min_train]
    return spark.createDataFrame([r for r in rows if not embargo or r[1] > 0], "fold int, train_end int, test_start int, test_end int")


def time_split(rows: DataFrame, n: int, *, n_splits: int = 5, min_train: int = 0, embargo: int = 0) -> DataFrame:
    """``rows`` (idx) once for each fold that has them, with fold and role; ``embargo`` purges the end of the training rows."""
    bounds = fold_bounds(rows.sparkSession, n, n_splits=n_splits, min_train=min_train, embargo=embargo)
    train, test = F.col("idx") < F.col("train_end"), (F.col("idx") >= F.col("test_start")) & (F.col("idx") < F.col("test_end"))
    joined = rows.join(F.broadcast(bounds), train | test)
    return joined.withColumn("role", F.when(train, "train").otherwise("test")).drop("train_end", "test_start", "test_end")


def group_split(rows: DataFrame, group: str, *, test_fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """``rows`` with role: whole groups are held out, those of least seeded hash (MD5, the same in every engine)."""
    groups = rows.select(group).distinct().withColumn("_h", F.md5(F.concat_ws("/", F.col(group).cast("string"), F.lit(str(seed)))))
    n = groups.count()
    held = groups.orderBy("_h", group).limit(max(1, round(n * test_fraction))).select(F.col(group).alias("_held"))
    return rows.join(held, F.col(group).eqNullSafe(F.col("_held")), "left").withColumn("role", F.when(F.col("_held").isNull(), "train").otherwise("test")).drop("_held")


def rolling_origins(n: int, *, horizon: int, step: int, min_train: int) -> list[int]:
    return list(range(min_train, n - horizon + 1, step))
