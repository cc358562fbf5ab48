"""Sources and sinks beyond Spark's own: archives in archives, ARFF, a provenance manifest, JSON results."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.encoding import label_encode
from plumbline.session import ship

#: Stock codes that are fees and adjustments, not products. Fixed values.
NOT_PRODUCTS = ("POST", "DOT", "M", "S", "BANK CHARGES", "AMAZONFEE", "ADJUST", "ADJUST2", "TEST001", "TEST002", "B", "CRUK", "PADS", "GIFT")


class FetchFailed(RuntimeError):
    """A source could not be read; it is raised, never replaced by other data."""


@dataclass(frozen=True)
class Source:
    name: str
    url: str
    note: str = ""
    licence: str = ""


def read_csv(spark: SparkSession, path: str, schema: StructType | str, *, sep: str = ",", header: bool = True) -> DataFrame:
    """A CSV file by an explicit schema; a malformed row fails. A byte order mark is not part of the first name."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, mode="FAILFAST", encoding="UTF-8", enforceSchema=True)


def zip_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, member, line) of the text lines of members that end in ``suffix``, also inside nested archives.

    Archives are read by Spark, so any store that it reads will do; an archive is one task's work.
    """
    ship(spark)

    def unpack(batches):
        def walk(data: bytes, prefix: str):
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                for name in archive.namelist():
                    if name.lower().endswith(".zip"):
                        yield from walk(archive.read(name), f"{prefix}{name}!")
                    elif name.endswith(suffix):
                        yield prefix + name, archive.read(name)

        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for member, data in walk(content, ""):
                    lines = data.decode("utf-8-sig").splitlines()
                    yield pa.RecordBatch.from_pydict({"path": [where] * len(lines), "member": [member] * len(lines), "n": pa.array(range(len(lines)), pa.int64()), "line": pa.array(lines, pa.string())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "path string, member string, n long, line string")


def parse_lines(lines: DataFrame, schema: StructType | str, *, sep: str = ",") -> DataFrame:
    """Columns of CSV lines (n, line), the header line left out."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = lines.where("n > 0 and trim(line) <> ''").select(F.from_csv("line", ddl, {"sep": sep, "mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """The data of an ARFF file: names and types from its header (at most a few lines), rows by ``from_csv``."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '%')")
    columns = []
    for row in lines.where(F.lower("line").startswith("@attribute")).collect():
        _, name, kind = row["line"].split(None, 2)
        columns.append(f"`{name.strip(chr(39) + chr(34))}` {'double' if kind.lower().startswith(('numeric', 'real', 'integer')) else 'string'}")
    body = lines.where(~F.col("line").rlike(r"(?i)^@(relation|attribute|data)(\s|$)"))
    return body.select(F.from_csv("line", ", ".join(columns), {"quote": "'", "nullValue": "?", "ignoreLeadingWhiteSpace": "true"}).alias("r")).select("r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, modified) of files: the provenance of what was read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def status(spark: SparkSession, sources: list[Source], folder: str) -> DataFrame:
    """(name, url, cached): which sources have a file of their name in ``folder``."""
    catalogue = spark.createDataFrame([(s.name, s.url) for s in sources], "name string, url string")
    present = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name")).distinct().withColumn("cached", F.lit(True))
    return catalogue.join(present, "name", "left").select("name", "url", F.coalesce("cached", F.lit(False)).alias("cached"))


def clean_ledger(raw: DataFrame) -> DataFrame:
    """Retail lines: trimmed upper-case codes (a missing code is no fee), positive prices, returns flagged by invoice C..., revenue."""
    code = F.upper(F.trim("StockCode"))
    rows = raw.withColumn("StockCode", code).where(~F.coalesce(F.col("StockCode").isin(*NOT_PRODUCTS), F.lit(False)) & (F.col("Price") > 0))
    return rows.withColumn("is_return", F.col("Invoice").startswith("C")).withColumn("revenue", F.col("Quantity") * F.col("Price"))


def clean_policies(raw: DataFrame) -> DataFrame:
    """Exposure capped at one year and claims at four."""
    return raw.withColumn("Exposure", F.least("Exposure", F.lit(1.0))).withColumn("ClaimNb", F.least("ClaimNb", F.lit(4)))


def read_motor(spark: SparkSession, frequency: str, severity: str) -> tuple[DataFrame, DataFrame]:
    """(policies, claims) of two ARFF files: cleaned policies, and each claim's amount with its policy.

    They stay two frames, as how often and how much are models of their own; claims without an amount are left out.
    """
    return clean_policies(read_arff(spark, frequency)), read_arff(spark, severity).where("ClaimAmount is not null")


def bank_view(raw: DataFrame, *, label: str = "y") -> DataFrame:
    """Calls as rows (id, label, features): names without quotes and spaces, ``label`` 1 for yes, text columns as codes.

    A code is the place of the value among the sorted distinct values of its column, -1 for null. ``id`` is a
    hash of the row; it names equal rows alike.
    """
    rows = raw.toDF(*(c.strip().strip('"').strip() for c in raw.columns))
    key = F.xxhash64(*(c for name in rows.columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))))
    texts = [c for c, kind in rows.dtypes if kind == "string" and c != label]
    marked = rows.withColumn("id", key).withColumn("label", (F.lower(F.trim(label)) == "yes").cast("int")).drop(label)
    coded = label_encode(marked, texts) if texts else marked
    return coded.select("id", "label", *(F.col(f"{c}_code").alias(c) if c in texts else F.col(f"`{c}`") for c in rows.columns if c != label))


def write_results(rows: DataFrame, path: str, *, digits: int = 6) -> None:
    """Rows as JSON lines, doubles rounded."""
    rows.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes)).write.mode("overwrite").json(path)
