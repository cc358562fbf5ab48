"""Leakage audit: how well each column alone predicts the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import auc


def audit_columns(rows: DataFrame, columns: list[str], y: str, known: set[str]) -> DataFrame:
    """(column, solo_auc, available, verdict, suspicion) of each numeric column, from one pass over all.

    Null and not-a-number values are skipped, not imputed. LEAK: suspicious (AUC of 0.7 or more, or 0.3
    or less) and not available at decision time; check: suspicious but available; else ok.
    """
    long = rows.select(F.col(y).cast("int").alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("score")) for c in columns))).alias("e")).select("y", "e.column", "e.score")
    solo = auc(long, groups=("column",)).withColumnRenamed("auc", "solo_auc")
    available = F.col("column").isin(*known) if known else F.lit(False)
    odd = (F.col("solo_auc") >= 0.7) | (F.col("solo_auc") <= 0.3)
    return solo.select("column", "solo_auc", available.alias("available"), F.when(odd & ~available, "LEAK").when(odd, "check").otherwise("ok").alias("verdict"), F.abs(F.col("solo_auc") - 0.5).alias("suspicion"))
