"""Excel workbooks as a Spark data source: one partition for each sheet, streamed from the zipped XML.

``spark.read.format("workbook").option("sheets", "a,b").load(path)`` gives every cell as text; with a schema the
first row of a sheet holds the names, columns are matched by name (case and spaces aside) and converted. A
column ``_sheet`` of the schema gets the sheet's name. Dates are numbers with a date format.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType, TimestampType

from plumbline.session import ship

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the built-in formats that show dates or times. Fixed values.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
RAW = "sheet string, row long, cells array<string>"


class Workbook:
    """The parts of an open workbook."""

    def __init__(self, path: str) -> None:
        files, where = pafs.FileSystem.from_uri(path)
        self.zip = zipfile.ZipFile(files.open_input_file(where))
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = {s.get("name"): targets[s.get(_REL)] for s in book.iter(f"{_MAIN}sheet")}
        properties = book.find(f"{_MAIN}workbookPr")
        late = properties is not None and properties.get("date1904") in ("1", "true")
        self.epoch = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)

    def close(self) -> None:
        self.zip.close()

    def shared(self) -> list[str]:
        """Strings that cells name by number; runs of one string are joined, phonetic hints left out."""
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        out: list[str] = []
        with self.zip.open("xl/sharedStrings.xml") as part:
            for _, node in ET.iterparse(part):
                if node.tag == f"{_MAIN}si":
                    out.append("".join(t.text or "" for way in (f"{_MAIN}t", f"{_MAIN}r/{_MAIN}t") for t in node.findall(way)))
                    node.clear()
        return out

    def dated(self) -> set[int]:
        """Numbers of the cell styles that show dates."""
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        styles = ET.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
        cells = styles.find(f"{_MAIN}cellXfs")
        return {k for k, xf in enumerate(cells if cells is not None else ()) if int(xf.get("numFmtId", 0)) in DATE_FORMATS | own}

    def rows(self, name: str) -> Iterator[tuple[int, list]]:
        """(row number, cells) of a sheet, one row in memory at a time; cells are None, str, bool, float or datetime."""
        shared, dated, target = self.shared(), self.dated(), self.sheets[name]
        at = 0
        with self.zip.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            for _, node in ET.iterparse(part):
                if node.tag == f"{_MAIN}row":
                    at = int(node.get("r", at + 1))
                    cells: list = []
                    for cell in node.iter(f"{_MAIN}c"):
                        place = _column(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (place - len(cells))
                        cells.append(self._value(cell, shared, dated))
                    yield at, cells
                    node.clear()

    def _value(self, cell: ET.Element, shared: list[str], dated: set[int]):
        kind, value = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        if value is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(value)]
        if kind == "b":
            return value.strip() == "1"
        if kind == "d":
            return dt.datetime.fromisoformat(value.strip())
        if kind == "str":
            return value
        number = float(value)
        return self.epoch + dt.timedelta(microseconds=round(number * 86_400_000_000)) if int(cell.get("s", 0)) in dated else number


def _column(reference: str) -> int:
    """The place from 0 of a cell's column, A = 0."""
    out = 0
    for c in reference:
        if not c.isalpha():
            break
        out = out * 26 + ord(c.upper()) - 64
    return out - 1


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return value.isoformat(sep=" ")


def _convert(value, kind):
    """A cell as a value of a Spark type; what can't be converted raises."""
    if value is None or (value == "" and not isinstance(kind, StringType)):
        return None
    if isinstance(kind, StringType):
        return _text(value)
    if isinstance(kind, (DoubleType, FloatType)):
        return float(value)
    if isinstance(kind, (LongType, IntegerType, ShortType)):
        number = float(value)
        if not number.is_integer():
            raise ValueError(f"{value!r} is not whole")
        return int(number)
    if isinstance(kind, DecimalType):
        from decimal import Decimal

        return Decimal(str(value))
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "1.0", "true")
    when = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
    if isinstance(kind, DateType):
        return when.date()
    if isinstance(kind, TimestampType):
        return when.replace(tzinfo=dt.UTC)
    raise TypeError(f"no cells of type {kind.simpleString()}")


def _plain(name) -> str:
    return re.sub(r"\s+", "", str(_text(name) or "")).lower()


class Sheet(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, sheets: list[str] | None) -> None:
        self.schema, self.path, self.wanted = schema, path, sheets
        self.raw = schema.fieldNames() == ["sheet", "row", "cells"]

    def partitions(self) -> list[Sheet]:
        book = Workbook(self.path)
        try:
            missing = set(self.wanted or ()) - set(book.sheets)
            if missing:
                raise ValueError(f"no sheet {sorted(missing)} in {self.path}; there are {list(book.sheets)}")
            return [Sheet(name) for name in (self.wanted or book.sheets)]
        finally:
            book.close()

    def read(self, partition: Sheet) -> Iterator[tuple]:
        book, names = Workbook(self.path), None
        try:
            for number, cells in book.rows(partition.name):
                if self.raw:
                    yield partition.name, number, [_text(c) for c in cells]
                elif names is None:
                    names = {_plain(c): k for k, c in enumerate(cells) if c is not None}
                elif any(c is not None for c in cells):
                    row = []
                    for field in self.schema.fields:
                        at = names.get(_plain(field.name))
                        row.append(partition.name if field.name == "_sheet" else None if at is None or at >= len(cells) else _convert(cells[at], field.dataType))
                    yield tuple(row)
        finally:
            book.close()


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> WorkbookReader:
        wanted = [s.strip() for s in self.options.get("sheets", "").split(",") if s.strip()]
        return WorkbookReader(schema, self.options["path"], wanted or None)


def register(spark: SparkSession) -> None:
    """Make the format ``workbook`` known to the session."""
    ship(spark)
    spark.dataSource.register(WorkbookSource)


def workbook_bytes(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook of small sheets (names, rows): strings shared, dates and datetimes as styled numbers."""
    shared: dict[str, int] = {}

    def cell(value, row: int, column: int) -> str:
        letters, k = "", column + 1
        while k:
            k, rest = divmod(k - 1, 26)
            letters = chr(65 + rest) + letters
        at = f'r="{letters}{row}"'
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c {at} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (dt.date, dt.datetime)):
            day = value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)
            return f'<c {at} s="1"><v>{(day.replace(tzinfo=None) - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)!r}</v></c>'
        if isinstance(value, str):
            return f'<c {at} t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
        return f"<c {at}><v>{value!r}</v></c>"

    head, main = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    links, types = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {f"xl/worksheets/sheet{k}.xml": f"{head}<worksheet {main}><sheetData>" + "".join(f'<row r="{r}">' + "".join(cell(v, r, c) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([tuple(names), *rows], 1)) + "</sheetData></worksheet>" for k, (names, rows) in enumerate(sheets.values(), 1)}
    listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'{head}<workbook {main} xmlns:r="{links}"><sheets>{listed}</sheets></workbook>'
    package = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    extra = [("styles", len(sheets) + 1), ("sharedStrings", len(sheets) + 2)]
    parts["xl/_rels/workbook.xml.rels"] = f"{head}<Relationships {package}>" + "".join(f'<Relationship Id="rId{k}" Type="{links}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "".join(f'<Relationship Id="rId{k}" Type="{links}/{n}" Target="{n}.xml"/>' for n, k in extra) + "</Relationships>"
    parts["_rels/.rels"] = f'{head}<Relationships {package}><Relationship Id="rId1" Type="{links}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    parts["xl/styles.xml"] = f'{head}<styleSheet {main}><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'
    parts["xl/sharedStrings.xml"] = f"{head}<sst {main}>" + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared) + "</sst>"
    over = "".join(f'<Override PartName="/{p}" ContentType="{types}.{"worksheet" if "worksheets" in p else "sheet.main" if "workbook.xml" in p else p[3:-4]}+xml"/>' for p in parts if p.startswith("xl/") and not p.endswith(".rels"))
    parts["[Content_Types].xml"] = f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{over}</Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()
