"""Target encoding that leaks, and that does not. Rows are (id, category, y[, split])."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.metrics import auc
from plumbline.session import checkpointed


def _smooth(total: Column, n: Column, prior: Column, m: float) -> Column:
    """n / (n + m) of the category's mean and m / (n + m) of the prior."""
    return F.when(n + m > 0, (total + m * prior) / (n + m)).otherwise(prior)


def category_means(rows: DataFrame, *, smoothing: float, prior: Column | None = None) -> DataFrame:
    """(category, n, encoded) with the mean of all rows as prior unless given."""
    sums = rows.groupBy("category").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    mean = rows.agg(F.avg("y").alias("prior"))
    return sums.crossJoin(F.broadcast(mean)).select("category", "n", _smooth(F.col("s"), F.col("n"), F.col("prior") if prior is None else prior, smoothing).alias("encoded"))


def naive_encoding(rows: DataFrame, *, smoothing: float = 0.0) -> DataFrame:
    """(id, category, split, y, encoded) from the means of train and test rows together: the leak itself."""
    return rows.join(category_means(rows, smoothing=smoothing).select("category", "encoded"), "category").select("id", "category", "split", "y", "encoded")


def train_only_encoding(rows: DataFrame, *, smoothing: float = 0.0) -> DataFrame:
    """(id, split, y, encoded) from the train rows' means; categories not seen there get their prior."""
    train = rows.where("split = 'train'")
    mean = train.agg(F.avg("y").alias("prior"))
    joined = rows.join(category_means(train, smoothing=smoothing).select("category", "encoded"), "category", "left").crossJoin(F.broadcast(mean))
    return joined.select("id", "split", "y", F.coalesce("encoded", "prior").alias("encoded"))


def out_of_fold_encoding(rows: DataFrame, *, folds: int = 5, smoothing: float = 20.0, fold: Column | None = None, seed: int = 0) -> DataFrame:
    """(id, split, y, encoded): train rows from the other folds, test rows from all train rows.

    A category's other folds are its totals less its own fold, so there is one aggregation, not a fit for
    each fold. Folds come from a seeded hash of the id unless given.
    """
    fold = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds)) if fold is None else fold
    train = rows.where("split = 'train'").withColumn("fold", fold)
    mean = train.agg(F.avg("y").alias("prior"))
    own = train.groupBy("category", "fold").agg(F.count("*").alias("fn"), F.sum("y").alias("fs"))
    all_folds = own.groupBy("category").agg(F.sum("fn").alias("n"), F.sum("fs").alias("s"))
    inside = train.join(own, ["category", "fold"]).join(all_folds, "category").crossJoin(F.broadcast(mean))
    inside = inside.select("id", "split", "y", _smooth(F.col("s") - F.col("fs"), F.col("n") - F.col("fn"), F.col("prior"), smoothing).alias("encoded"))
    outside = rows.where("split <> 'train'").join(all_folds, "category", "left").crossJoin(F.broadcast(mean))
    return inside.unionByName(outside.select("id", "split", "y", F.when(F.col("n").isNotNull(), _smooth(F.col("s"), F.col("n"), F.col("prior"), smoothing)).otherwise(F.col("prior")).alias("encoded")))


def cardinality_profile(rows: DataFrame) -> DataFrame:
    """(bucket, categories, rows, share) of categories by their number of rows."""
    each = rows.groupBy("category").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") < 5, "2-4").when(F.col("n") < 20, "5-19").when(F.col("n") < 100, "20-99").otherwise("100+")
    total = each.agg(F.sum("n").alias("total"))
    cells = each.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("categories"), F.sum("n").alias("rows"))
    return cells.crossJoin(F.broadcast(total)).select("bucket", "categories", "rows", (F.col("rows") / F.col("total")).alias("share"))


def leak_by_rarity(encoded: DataFrame, *, least: int = 30) -> DataFrame:
    """(bucket, rows, correlation) of encoding and label (category, y, encoded) by the size of the category; thin or constant buckets go."""
    sizes = encoded.groupBy("category").agg(F.count("*").alias("size"))
    bucket = F.when(F.col("size") == 1, "1").when(F.col("size") < 5, "2-4").when(F.col("size") < 20, "5-19").when(F.col("size") < 100, "20-99").otherwise("100+")
    joined = encoded.join(sizes, "category").groupBy(bucket.alias("bucket"))
    cells = joined.agg(F.count("*").alias("rows"), F.corr("encoded", "y").alias("correlation"), F.stddev_pop("y").alias("spread"))
    return cells.where((F.col("rows") >= least) & (F.col("spread") > 0)).select("bucket", "rows", "correlation")


def fit_and_score(encoded: DataFrame) -> DataFrame:
    """One row (train_auc, test_auc) of a logistic model on the encoded column alone; rows of (id, split, y, encoded).

    Rows are counted by encoding and label first: a few for each category, whatever its rows, serve the fit and both areas.
    """
    counts = checkpointed(encoded.groupBy("split", F.col("y").cast("double").alias("y"), "encoded").agg(F.count("*").cast("double").alias("n")))
    cells = VectorAssembler(inputCols=["encoded"], outputCol="features").transform(counts)
    model = LogisticRegression(labelCol="y", weightCol="n", regParam=0.0, maxIter=200, tol=1e-8).fit(cells.where("split = 'train'"))
    scored = model.transform(cells).select("split", "y", F.get(vector_to_array("probability"), F.lit(1)).alias("score"), F.col("n").cast("long").alias("n"))
    train, test = (auc(scored.where(F.col("split") == side), weight="n").select(F.col("auc").alias(f"{side}_auc")) for side in ("train", "test"))
    return train.crossJoin(test)


def label_encode(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``<column>_code``: the place of each value, from 0 in the order of values; null is -1.

    A column's distinct values are ranked in one task, so they should be categories: far fewer than rows.
    """
    for c in columns:
        codes = rows.select(c).where(F.col(c).isNotNull()).distinct().withColumn(f"{c}_code", F.row_number().over(Window.orderBy(c)) - 1)
        rows = rows.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return rows
