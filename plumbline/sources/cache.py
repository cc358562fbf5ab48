"""Fetching sources once: a cache of files with a manifest of where each came from.

Fetching is a write through a data source: tasks copy each url to a file of their attempt and digest it, and
only the commit of the whole write gives the files their names and appends to the manifest. A failed or aborted
write leaves neither a name nor a row, and what the manifest holds already is not read again.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from plumbline.session import ship
from plumbline.sources.readers import FetchFailed, Source

RECORD = "name string, url string, note string, licence string, path string, bytes long, sha256 string, fetched timestamp"
PIECE = 1 << 20
TIMEOUT = 60


def _pieces(url: str) -> Iterator[bytes]:
    """The content of a url: http(s) by request, all else by Arrow's file systems."""
    try:
        if url.startswith(("http://", "https://")):
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "plumbline"}), timeout=TIMEOUT) as response:  # noqa: S310
                while piece := response.read(PIECE):
                    yield piece
        else:
            files, where = pafs.FileSystem.from_uri(url)
            with files.open_input_stream(where) as stream:
                while piece := stream.read(PIECE):
                    yield piece
    except (urllib.error.URLError, TimeoutError, OSError) as fault:
        raise FetchFailed(f"could not read {url}: {fault}") from fault


@dataclass
class Fetched(WriterCommitMessage):
    """What one task copied: (temporary path, record) pairs."""

    copies: list[tuple[str, dict]]


class FetchWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.drafts = folder.rstrip("/"), f"_unfinished/{uuid.uuid4().hex}"  # drafts of this write alone

    def write(self, iterator: Iterator[Row]) -> Fetched:
        files, where = pafs.FileSystem.from_uri(self.folder)
        files.create_dir(f"{where}/{self.drafts}", recursive=True)
        copies: list[tuple[str, dict]] = []
        try:
            for row in iterator:
                part, digest, size = f"{where}/{self.drafts}/{uuid.uuid4().hex}", hashlib.sha256(), 0
                copies.append((part, {}))
                with files.open_output_stream(part, compression=None) as out:
                    for piece in _pieces(row["url"]):
                        digest.update(piece)
                        size += len(piece)
                        out.write(piece)
                if not size:
                    raise FetchFailed(f"{row['url']} is empty")
                name = row["file"] or f"{row['name']}{_suffix(row['url'])}"
                copies[-1] = (part, {"name": row["name"], "url": row["url"], "note": row["note"], "licence": row["licence"], "path": f"{self.folder}/{name}", "bytes": size, "sha256": digest.hexdigest()})
        except BaseException:
            _drop(files, [part for part, _ in copies])
            raise
        return Fetched(copies)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, where = pafs.FileSystem.from_uri(self.folder)
        copies = [c for m in messages if m is not None for c in m.copies]
        if not copies:
            return
        for part, record in copies:
            files.move(part, f"{where}/{record['path'].rsplit('/', 1)[1]}")
        now = dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
        files.create_dir(f"{where}/_manifest", recursive=True)
        lines = "".join(json.dumps(record | {"fetched": now}, sort_keys=True) + "\n" for _, record in copies).encode()
        # One new file, given its name when it is whole: the manifest is only ever appended to.
        draft = f"{where}/{self.drafts}/manifest"
        with files.open_output_stream(draft, compression=None) as out:
            out.write(lines)
        files.move(draft, f"{where}/_manifest/{uuid.uuid4().hex}.json")
        files.delete_dir(f"{where}/{self.drafts}")  # with what attempts left that did not count

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Drafts go as a whole, as tasks that were stopped have sent no message."""
        files, where = pafs.FileSystem.from_uri(self.folder)
        if files.get_file_info(f"{where}/{self.drafts}").type == pafs.FileType.Directory:
            files.delete_dir(f"{where}/{self.drafts}")


def _drop(files: pafs.FileSystem, parts: list[str]) -> None:
    for part in parts:
        if files.get_file_info(part).type == pafs.FileType.File:
            files.delete_file(part)


def _suffix(url: str) -> str:
    last = url.split("?")[0].rsplit("/", 1)[-1]
    return f".{last.rsplit('.', 1)[1]}" if "." in last else ".csv"


class FetchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return "name string, url string, note string, licence string, file string"

    def writer(self, schema: StructType, overwrite: bool) -> FetchWriter:
        return FetchWriter(self.options["folder"])


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a cache: name, url, note, licence, path, bytes, sha256, fetched; empty where nothing was fetched."""
    files, where = pafs.FileSystem.from_uri(folder)
    if files.get_file_info(f"{where}/_manifest").type != pafs.FileType.Directory:
        return spark.createDataFrame([], RECORD)
    # Spark passes over names that begin with an underscore, so the files are named by a pattern.
    return spark.read.schema(RECORD.replace("fetched timestamp", "fetched string")).json(f"{folder.rstrip('/')}/_manifest/*.json").withColumn("fetched", F.col("fetched").cast("timestamp"))


def fetch(spark: SparkSession, sources: list[Source], folder: str, *, names: dict[str, str] | None = None) -> DataFrame:
    """The latest record of each source, after those that the cache does not hold were fetched.

    A source is held if the manifest names it and its file is there with as many bytes. ``names`` gives files of
    other names than the source's own and its url's suffix. A source that can't be read or is empty raises
    ``FetchFailed`` on its task and fails the write as a whole; sources are fetched in parallel.
    """
    ship(spark)
    spark.dataSource.register(FetchSource)
    files, _ = pafs.FileSystem.from_uri(folder)
    held = {r["name"] for r in records(spark, folder).select("name", "path", "bytes").distinct().collect() if _size(files, r["path"]) == r["bytes"]}
    wanted = [(s.name, s.url, s.note, s.licence, (names or {}).get(s.name)) for s in sources if s.name not in held]
    if wanted:
        rows = spark.createDataFrame(wanted, "name string, url string, note string, licence string, file string")
        rows.repartition(len(wanted)).write.format("fetch").option("folder", folder).mode("append").save()
    latest = records(spark, folder).where(F.col("name").isin([s.name for s in sources]))
    return latest.groupBy("name").agg(F.max_by(F.struct(*(c.split()[0] for c in RECORD.split(", ")[1:])), F.struct("fetched", "path")).alias("r")).select("name", "r.*")


def _size(files: pafs.FileSystem, path: str) -> int | None:
    found = files.get_file_info(pafs.FileSystem.from_uri(path)[1])
    return found.size if found.type == pafs.FileType.File else None
