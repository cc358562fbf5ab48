"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps with the columns of
``documents``; the last gives each document its place in the mix. Null or repeated ids go through: each
row has its own decision, columns and place, whatever its id. Rows that agree in all columns are copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.classifier import classify, grades, train
from plumbline.llm.decontaminate import decontaminate
from plumbline.llm.mixing import mix_sources
from plumbline.llm.near import near_duplicates
from plumbline.llm.registry import read
from plumbline.llm.repeats import remove_repeats
from plumbline.llm.warc import open_folder, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key():
    """A row's key: its id, null ids last, and 128 bits of all columns (a null counts as a value)."""
    marks = [c for name in COLUMNS for c in (F.col(name).isNull(), F.col(name))]
    return F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", F.xxhash64(F.lit(1), *marks).alias("h1"), F.xxhash64(F.lit(2), *marks).alias("h2"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: documents of which the classifier accepts the text stay, each row by its own text.

    Null and empty texts are judged like others (they have no words); null and repeated ids go through, but
    a null id is never a rated one; texts of any length are judged whole; an empty table stays empty; without
    ratings every text gets the same verdict. Columns that are not those of ``documents`` are dropped.
    """
    model = train(docs, grades(read(spark, sf_dir, "labels")))
    return classify(docs, model, carry=True).where("kept").select("row.*").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 6: of each class of near copies the row with the least key stays (least id, null ids last).

    Rows that agree in all columns are one row. Rows without a word are classes of their own, so they all
    stay, as do rows with equal ids and different texts; an empty table stays empty.
    """
    keyed = docs.select(*COLUMNS).withColumn("key", _key())
    found = near_duplicates(keyed, id_col="key")
    heads = found.where(F.col("key") == F.col("class_id")).select(F.col("key").alias("kept")).distinct()
    return keyed.join(heads, F.col("key").eqNullSafe(F.col("kept")), "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 8: byte strings of 200 that occur twice are cut out; documents of which nothing is left go.

    Null and empty texts lose nothing and stay (as empty texts); each row keeps its own columns, whatever
    its id; ``n_chars`` is what is left; an empty table stays empty.
    """
    left = remove_repeats(docs.select(*COLUMNS), carry=True).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.select("doc_id", "text", "row.lang", "row.source", F.char_length("text").cast("long").alias("n_chars"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 10: documents that hold benchmark passages go, each row by its own text.

    Null and empty texts have no words and stay; items without an id or a word find nothing; an empty
    table stays empty, and an empty benchmark lets all rows stay.
    """
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), carry=True).where(~F.col("contaminated")).select("row.*").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: each row with its place in the mix of sources; null is a source of its own.

    Null and repeated ids each get a place, and no two rows share one; an empty table stays empty.
    """
    return mix_sources(docs.select(*COLUMNS), carry=True).select("row.*", "position", "slot", "phase").select(*COLUMNS, "position", "slot", "phase")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", contamination),
    ("mixing sources", mixture),
]

#: SQL can't express the classifier's training; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again.

    A stage's folder goes when the next stage is written; the last one holds the result and stays.
    """
    folder = shared_folder(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files, where = open_folder(f"{folder}/{k - 1}")
            files.delete_dir(where)
    return docs
