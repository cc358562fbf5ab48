"""Workbooks, the fetch cache, sinks and streams."""

import datetime as dt
import hashlib
import json
import math
import random
import zipfile
from pathlib import Path

import numpy as np
import pytest
from plumbline.operators import regularise
from plumbline.sources import cache, readers, views, workbook
from plumbline.streaming import windows
from pyspark.sql import functions as F


def test_workbook_cells_come_back(spark, tmp_path):
    day, moment = dt.date(2020, 2, 29), dt.datetime(2011, 12, 9, 12, 50)
    rows = [(1, "a & <b>", 2.5, day, moment, True), (None, None, None, None, None, None), (3, " x ", -1e-3, None, dt.datetime(1999, 12, 31, 23, 59, 59), False), (4, "é", 7.0, day, None, None)]
    data = workbook.workbook_bytes({"One": (["Id", "Stock Code", "Price", "Day", "InvoiceDate", "Flag"], rows), "Two": (["Id"], [(9,)]), "Empty": ([], [])})
    path = tmp_path / "w.xlsx"
    path.write_bytes(data)
    workbook.register(spark)
    schema = "_sheet string, id int, StockCode string, price double, day date, invoicedate timestamp, flag boolean, missing string"
    frame = spark.read.format("workbook").schema(schema).load(str(path))
    assert frame.rdd.getNumPartitions() == 3
    got = sorted((tuple(r) for r in frame.collect()), key=lambda r: r[1])
    utc = lambda t: t and t.replace(tzinfo=dt.UTC)
    first = spark.createDataFrame([(utc(moment),), (utc(dt.datetime(1999, 12, 31, 23, 59, 59)),)], "t timestamp").collect()
    assert got == [("One", 1, "a & <b>", 2.5, day, first[0]["t"], True, None), ("One", 3, " x ", -0.001, None, first[1]["t"], False, None), ("One", 4, "é", 7.0, day, None, None, None), ("Two", 9, *[None] * 6)]
    raw = {(r["sheet"], r["row"]): r["cells"] for r in spark.read.format("workbook").load(str(path)).collect()}
    assert raw["One", 1][1] == "Stock Code" and raw["One", 2][:3] == ["1", "a & <b>", "2.5"] and raw["One", 2][3].startswith("2020-02-29")
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("workbook").option("sheets", "Nope").load(str(path)).collect()
    with pytest.raises(Exception, match="not whole"):
        spark.read.format("workbook").schema("price int").load(str(path)).collect()


def test_workbook_as_other_writers_make_it(tmp_path):
    """Inline strings, rich text, gaps, errors, own date formats and the epoch of 1904."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="1"/><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="/xl/worksheets/x.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/worksheets/x.xml": f'<worksheet {main}><sheetData><row r="2"><c r="B2" t="inlineStr"><is><t>in</t></is></c><c r="AA2" t="s"><v>0</v></c></row><row><c s="1"><v>1.5</v></c><c s="2"><v>1.5</v></c><c t="e"><v>#N/A</v></c><c t="b"><v>1</v></c><c t="str"><v>f</v></c></row></sheetData></worksheet>',
    }
    with zipfile.ZipFile(tmp_path / "o.xlsx", "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    book = workbook.Workbook(str(tmp_path / "o.xlsx"))
    rows = list(book.rows("S"))
    assert rows[0][0] == 2 and rows[0][1][1] == "in" and rows[0][1][26] == "rich" and rows[0][1][0] is None and len(rows[0][1]) == 27
    assert rows[1] == (3, [dt.datetime(1904, 1, 2, 12), 1.5, None, True, "f"])
    book.close()


def test_fetching_happens_once_and_whole(spark, tmp_path):
    origin, folder = tmp_path / "origin", str(tmp_path / "cache")
    origin.mkdir()
    for name in "abc":
        (origin / f"{name}.txt").write_text(name * 10)
    source = lambda name, url=None: readers.Source(name, url or f"file://{origin}/{name}.txt", "n", "cc0")
    assert cache.records(spark, folder).count() == 0
    first = {r["name"]: r for r in cache.fetch(spark, [source("a"), source("b")], folder).collect()}
    assert first["a"]["sha256"] == hashlib.sha256(b"a" * 10).hexdigest() and first["a"]["bytes"] == 10 and first["a"]["licence"] == "cc0"
    assert Path(first["b"]["path"]).read_text() == "b" * 10 and abs(first["a"]["fetched"].replace(tzinfo=dt.UTC).timestamp() - dt.datetime.now(dt.UTC).timestamp()) < 90_000
    # What is held is not read again: its origin may be gone.
    (origin / "a.txt").unlink()
    again = {r["name"]: r for r in cache.fetch(spark, [source("a"), source("c")], folder, names={"c": "see.dat"}).collect()}
    assert again["a"] == first["a"] and again["c"]["path"].endswith("/see.dat") and cache.records(spark, folder).count() == 3
    # A write of which one source fails leaves no row, no file and nothing unfinished.
    (origin / "empty.txt").write_text("")
    for bad in (source("d", f"file://{origin}/missing.txt"), source("empty")):
        (origin / "e.txt").write_text("e")
        with pytest.raises(Exception, match="could not read|is empty"):
            cache.fetch(spark, [source("e"), bad], folder)
        assert cache.records(spark, folder).count() == 3 and not (tmp_path / "cache" / "e.txt").exists()
        assert not [p for p in (tmp_path / "cache" / "_unfinished").rglob("*") if p.is_file()]
    # A file that was cut is fetched anew, and the manifest keeps both records.
    Path(first["b"]["path"]).write_text("b")
    assert next(r for r in cache.fetch(spark, [source("b")], folder).collect())["bytes"] == 10 and Path(first["b"]["path"]).read_text() == "b" * 10
    assert cache.records(spark, folder).where("name = 'b'").count() == 2
    with pytest.raises(readers.FetchFailed):
        list(cache._pieces("file:///no/such/file"))


def test_results_as_json(spark, tmp_path):
    readers.write_results(spark.createDataFrame([("a", 1 / 3, None)], "k string, v double, w double").coalesce(1), str(tmp_path / "r"))
    (line,) = [x for f in (tmp_path / "r").glob("*.json") for x in f.read_text().splitlines()]
    assert json.loads(line) == {"k": "a", "v": 0.333333}


def test_windowed_totals_of_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "ab"[m % 2], float(m)) for m in range(0, 60, 5)] + [("2024-01-01 09:00:00", "a", 1.0)]
    frame = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    totals = windows.windowed_totals(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    run = totals.writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r["window"]["start"].hour, r["event_type"]): (r["n"], r["value"]) for r in spark.table("totals").collect()}
    assert sorted(got.values()) == [(1, 1.0), (6, sum(m for m in range(0, 60, 5) if m % 2 == 0)), (6, sum(m for m in range(0, 60, 5) if m % 2))]


def test_trailing_volatility_survives_restarts(spark, tmp_path):
    rnd, n = random.Random(1), 0
    history: dict[str, list] = {"a": [], "b": []}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", windows.STATE_STORE)
    schema = "series string, id long, ts timestamp, value double"
    try:
        for batch in (7, 1, 12, 30):
            rows = []
            for _ in range(batch):
                s = rnd.choice("ab")
                n += 1
                history[s].append((n, rnd.gauss(0, 1)))
                rows.append((s, n, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n), history[s][-1][1]))
            rnd.shuffle(rows)
            spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
            stream = windows.trailing_volatility(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), window=5, periods=4)
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["series"], r["id"]): r["volatility"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == n
    for s, own in history.items():
        for k, (i, _) in enumerate(own):
            past = [v for _, v in own[max(0, k - 4) : k + 1]]
            assert got[s, i] is None if len(past) < 5 else got[s, i] == pytest.approx(np.std(past, ddof=1) * math.sqrt(4))


def test_calendar_fills_gaps_and_marks_closures(spark):
    rows = spark.createDataFrame([("2024-02-27", 5.0), ("2024-03-01", 2.0), ("2024-03-02", None), (None, 9.0), ("2024-03-04", 1.0)], "day string, value double")
    got = [(str(r["day"]), r["value"], r["closed"], r["open_idx"]) for r in views.calendar(rows).orderBy("day").collect()]
    assert got == [("2024-02-27", 5.0, False, 0), ("2024-02-28", 0.0, True, None), ("2024-02-29", 0.0, True, None), ("2024-03-01", 2.0, False, 1), ("2024-03-02", 0.0, True, None), ("2024-03-03", 0.0, True, None), ("2024-03-04", 1.0, False, 2)]
    assert views.calendar(rows.limit(0)).count() == 0


def test_bank_calls_become_rows_of_numbers(spark):
    raw = spark.createDataFrame([(30, "b", None, " YES"), (40, "a", "x", "no"), (None, None, "x", None), (30, "b", None, " YES")], '`"age"` int, ` job` string, poutcome string, `"y"` string')
    got = readers.bank_view(raw).collect()
    assert sorted(((r["label"], r["age"], r["job"], r["poutcome"]) for r in got), key=str) == sorted([(1, 30, 1, -1), (1, 30, 1, -1), (0, 40, 0, 0), (None, None, -1, 0)], key=str)
    assert len({r["id"] for r in got}) == 3 and set(readers.bank_view(raw).columns) == {"id", "label", "age", "job", "poutcome"}


def test_motor_frames_stay_apart(spark, tmp_path):
    (tmp_path / "f.arff").write_text("@relation f\n@attribute IDpol numeric\n@attribute ClaimNb numeric\n@attribute Exposure numeric\n@attribute Area string\n@data\n1,9,1.5,'A'\n2,0,0.5,'B'\n")
    (tmp_path / "s.arff").write_text("@relation s\n@attribute IDpol numeric\n@attribute ClaimAmount numeric\n@data\n1,10\n1,20\n2,?\n")
    policies, claims = readers.read_motor(spark, str(tmp_path / "f.arff"), str(tmp_path / "s.arff"))
    assert sorted((r["IDpol"], r["ClaimNb"], r["Exposure"], r["Area"]) for r in policies.collect()) == [(1.0, 4.0, 1.0, "A"), (2.0, 0.0, 0.5, "B")]
    assert sorted((r["IDpol"], r["ClaimAmount"]) for r in claims.collect()) == [(1.0, 10.0), (1.0, 20.0)]


def test_engineered_features(spark):
    rows = spark.createDataFrame([(1, 1.0, 300.0, 310.0, 1500.0, 40.0, 100.0, "L"), (2, 0.0, None, 310.0, 1500.0, 40.0, 100.0, None)], "id int, y double, a double, p double, s double, t double, w double, g string")
    one, lost = regularise.engineer(rows, air="a", process="p", speed="s", torque="t", wear="w", grade="g").orderBy("id").collect()
    assert one["power"] == pytest.approx(40 * 1500 * 2 * math.pi / 60) and one["log_power"] == pytest.approx(math.log1p(one["power"])) and one["temp_difference"] == 10 and one["wear_x_torque"] == 4000
    assert (one["is_low_quality"], one["is_high_quality"]) == (1.0, 0.0) and lost["temp_ratio"] is None and len(one) == 16
