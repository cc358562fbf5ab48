"""Connected components by parent pointers and pointer jumping, with checkpoints between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import checkpointed


def salted_join(left: DataFrame, right: DataFrame, on: str | list[str], by: str | list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``on``: rows of a frequent key are dealt out by ``by``.

    ``right`` comes ``salts`` times, so it should be the narrow side.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*([by] if isinstance(by, str) else by)), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*([on] if isinstance(on, str) else on), "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the least node of its component.

    Each round gives a node its least smaller neighbour as parent, hands its other smaller neighbours
    to that parent, and jumps to the parent's parent; depth halves, so rounds grow with the logarithm
    of the longest chain. Joins are on nodes; a parent of many nodes is a frequent key, so its rows are
    salted. Loops and repeated edges do no harm; an empty table has no node.
    """
    up = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    up = checkpointed(up.where("u <> v").distinct())
    while True:
        parent = up.groupBy("u").agg(F.min("v").alias("p"))
        above = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jumped = salted_join(parent, above, "p", "u", "left").select("u", F.coalesce("pp", "p").alias("v"), F.col("pp").isNotNull().alias("moved"))
        handed = salted_join(up, parent, "u", "v").where("v <> p").select(F.col("v").alias("u"), F.col("p").alias("v"), F.lit(True).alias("moved"))
        step = checkpointed(jumped.unionByName(handed).groupBy("u", "v").agg(F.max("moved").alias("moved")))
        up = step.select("u", "v")
        if step.where("moved").limit(1).count() == 0:
            roots = up.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            return up.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
