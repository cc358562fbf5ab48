"""Queries that hold fitted models, sequential folds and readers against what SQL can state in closed form.

They run the same operators as the other queries, where the input gives them a closed form (a factor with
its own mean, all components of a decomposition, scores with few values) or SQL can follow step by step.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from plumbline.functions.running import exact_quantiles
from plumbline.operators import anomaly as AN
from plumbline.operators import calibration as CA
from plumbline.operators import elo as ELO
from plumbline.operators import encoding as EN
from plumbline.operators import overlap as OV
from plumbline.operators import pricing as PR
from plumbline.operators import reduce as RD
from plumbline.operators import regularise as RG
from plumbline.operators import survival as SV
from plumbline.operators.basket import shorten
from plumbline.plans.queries import _categories, _gaps_by_half, _monthly, query
from plumbline.session import checkpoint_dir
from plumbline.sources import cache as CH
from plumbline.sources import readers as RS
from plumbline.sources import views as V
from plumbline.sources.workbook import register, workbook_bytes
from plumbline.streaming import windows as ST

#: Matches of a season.
SEASON = 500
#: Coordinates that the plain projection of vectors keeps.
KEPT = 8


def _vectors(spark, d):
    return V.vectors(spark, d).select("id", "x")


@query
def elo_seasons(spark, d):
    """Ratings that are pulled towards the start every ``SEASON`` matches."""
    rows = V.matches(spark, d).withColumn("league", F.lit("all")).withColumn("season", F.floor(F.col("idx") / SEASON))
    return ELO.walk_forward(rows, season="season").select("idx", "home_rating", "away_rating", "expected")


@query
def severity_by_segment(spark, d):
    return PR.fit_severity(V.policies(spark, d), ["segment"]).relativities(spark).select("term", F.round("relativity", 4).alias("relativity"))


@query
def tweedie_by_segment(spark, d):
    return PR.fit_tweedie(V.policies(spark, d), ["segment"]).relativities(spark).select("term", F.round("relativity", 4).alias("relativity"))


@query
def calibration_report(spark, d):
    """Calibrators fitted on lines with even ids and judged on the others; scores have few values."""
    rows = V.scored(spark, d)
    fit, test = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    return CA.reports([CA.Uncalibrated(), CA.Platt(), CA.Isotonic()], fit, test)


@query
def projection_quality(spark, d):
    """How well the first coordinates of the vectors keep neighbours and distances."""
    rows = _vectors(spark, d)
    flat = rows.select("id", F.slice("x", 1, KEPT).alias("x"))
    return RD.neighbourhoods_kept(rows, flat).crossJoin(RD.pairwise_distance_corr(rows, flat))


def _rebuilt(spark, found):
    """(i, j, value): the matrix that shares and components stand for, over its trace."""
    values = (found.components.T * found.explained) @ found.components
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(values) for j, v in enumerate(row) if i <= j], "i int, j int, value double")


@query
def pca_rebuilt(spark, d):
    """All principal components together give the correlations."""
    rows = _vectors(spark, d)
    return _rebuilt(spark, RD.pca(rows, len(rows.first()["x"])))


@query
def svd_rebuilt(spark, d):
    """All singular vectors together give the second moments."""
    rows = _vectors(spark, d)
    return _rebuilt(spark, RD.truncated_svd(rows, len(rows.first()["x"])))


@query
def pca_needed(spark, d):
    """Components that reach a share of the variance; what all of them leave is nothing."""
    rows = _vectors(spark, d)
    found = RD.pca(rows, len(rows.first()["x"]))
    need = found.components_needed(1.0)
    return found.reconstruction_error(rows).select(F.lit(need).alias("components"), F.abs("mse").alias("mse"))


@query
def detectors_agree(spark, d):
    rows = _vectors(spark, d)
    return AN.agreement_matrix({"mahalanobis": AN.mahalanobis(rows), "lof": AN.local_outlier_factor(rows, neighbours=20)}, k=25)


@query
def fit_and_score(spark, d):
    """AUC of a logistic model on the encoded category alone, by way of encoding."""
    rows = _categories(spark, d)
    ways = {"naive": EN.naive_encoding(rows), "smoothed": EN.train_only_encoding(rows, smoothing=50.0), "out_of_fold": EN.out_of_fold_encoding(rows, fold=F.col("id") % 5)}
    out = None
    for name, encoded in ways.items():
        one = EN.fit_and_score(encoded).select(F.lit(name).alias("way"), "train_auc", "test_auc")
        out = one if out is None else out.unionByName(one)
    return out


@query
def category_codes(spark, d):
    """Codes of the parts' brands and types in the order of their names."""
    return EN.label_encode(V.table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"]).select("p_partkey", "p_brand_code", "p_type_code")


@query
def regression_verdict(spark, d):
    """The overlapping regression as if rows were independent, and with its effective sample size."""
    rows = OV.forward_return(_monthly(spark, d), 12).where("forward is not null").select("x", F.col("forward").alias("y"))
    return OV.overlapping_verdict(rows, 12).select("method", "n_independent", "t", "p", "significant")


@query
def slopes_by_part(spark, d):
    """The slope of discount on quantity in each part's lines, with its p-value: all groups are one aggregation."""
    rows = V.table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"))
    return OV.slopes_by(rows, "l_partkey").select("l_partkey", "slope", "t", "p", "significant")


@query
def log_rank_p(spark, d):
    return SV.log_rank(_gaps_by_half(spark, d), "b").select("chi2", "p_value")


@query
def short_names(spark, d):
    return V.table(spark, d, "part").select("p_partkey", shorten("p_name", 12).alias("short"))


# --- readers: tables written as files and read back


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark, tempfile.gettempdir() + '/plumbline-checkpoints').rstrip('/')}/files-{uuid.uuid4().hex}"


def _write(path: str, data: bytes) -> None:
    """A small file, written by the driver where all executors read it."""
    files, where = pafs.FileSystem.from_uri(path)
    files.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(where, compression=None) as out:
        out.write(data)


@query
def csv_reader(spark, d):
    """The customers through a file with semicolons and a header."""
    folder, rows = _folder(spark), V.table(spark, d, "customer")
    rows.write.csv(folder, sep=";", header=True)
    return RS.read_csv(spark, folder, rows.schema, sep=";")


@query
def zip_reader(spark, d):
    """The nations through an archive in an archive."""
    rows, inner, outer = V.table(spark, d, "nation"), io.BytesIO(), io.BytesIO()  # 25 rows by the schema
    lines = [",".join(rows.columns), *(",".join(str(v) for v in r) for r in rows.collect())]
    with zipfile.ZipFile(inner, "w") as archive:
        archive.writestr("nation.csv", "﻿" + "\n".join(lines))
    with zipfile.ZipFile(outer, "w") as archive:
        archive.writestr("inner.zip", inner.getvalue())
        archive.writestr("notes.txt", "not this one")
    path = f"{_folder(spark)}/nation.zip"
    _write(path, outer.getvalue())
    return RS.parse_lines(RS.zip_members(spark, path, ".csv"), rows.schema)


@query
def arff_reader(spark, d):
    """The nations through an ARFF file."""
    rows = V.table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    path = f"{_folder(spark)}/nation.arff"
    _write(path, "\n".join(["% nations", "@relation nation", "@attribute 'n_name' string", "@ATTRIBUTE n_nationkey numeric", "@data", *(f"'{r[1]}',{r[0]}" for r in rows), "@odd,?"]).encode())
    return RS.read_arff(spark, path)


@query
def source_status(spark, d):
    """Which sources of a catalogue are in a folder, with the size and digest of their files."""
    folder = _folder(spark)
    for name in ("region", "nation"):
        _write(f"{folder}/{name}.txt", name.encode())
    sources = [RS.Source("region", "r"), RS.Source("nation", "n"), RS.Source("missing", "m")]
    files = RS.manifest(spark, folder).select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("name"), "bytes", "sha256")
    return RS.status(spark, sources, folder).join(files, "name", "left")


@query
def clean_retail(spark, d):
    """Lines cleaned as retail lines: fees out (a missing code is no fee), returns flagged, revenue."""
    lines = V.table(spark, d, "lineitem")
    code = F.when(F.col("l_linenumber") == 7, F.lit(" post ")).when(F.col("l_linenumber") == 6, F.lit(None)).otherwise(F.concat(F.lit(" a"), "l_partkey"))
    raw = lines.select(F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("l_orderkey")).alias("Invoice"), code.cast("string").alias("StockCode"), F.col("l_quantity").alias("Quantity"), (F.col("l_extendedprice") - 5000).alias("Price"))
    return RS.clean_ledger(raw).groupBy("is_return").agg(F.count("*").alias("lines"), F.countDistinct("StockCode").alias("codes"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query
def clean_motor(spark, d):
    """Policies with exposure capped at one year and claims at four, and the claims' frame."""
    raw = V.table(spark, d, "customer").select(F.col("c_custkey").alias("IDpol"), (F.col("c_custkey") % 30 / 20).alias("Exposure"), (F.col("c_custkey") % 7).cast("int").alias("ClaimNb"))
    return RS.clean_policies(raw).groupBy("ClaimNb").agg(F.count("*").alias("policies"), F.sum("Exposure").alias("exposure"))


@query
def workbook_reader(spark, d):
    """The nations and the months through an Excel workbook of two sheets, dates among them."""
    register(spark)
    months = V.monthly(spark, d).select("month", "value", "x").orderBy("month").collect()  # a row a month
    nations = V.table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    path = f"{_folder(spark)}/tables.xlsx"
    _write(path, workbook_bytes({"Nations": (["Key", "Name"], [tuple(r) for r in nations]), "Months & more": (["Month", "Total Price", "Orders"], [tuple(r) for r in months])}))
    one = spark.read.format("workbook").schema("_sheet string, key long, name string").option("sheets", "Nations").load(path)
    two = spark.read.format("workbook").schema("_sheet string, month date, TotalPrice double, orders long").option("sheets", "Months & more").load(path)
    return one.select(F.col("_sheet").alias("sheet"), F.col("name").alias("label"), F.col("key").alias("number"), F.lit(None).cast("double").alias("amount")).unionByName(
        two.select(F.col("_sheet").alias("sheet"), F.col("month").cast("string").alias("label"), F.col("orders").alias("number"), F.col("TotalPrice").alias("amount"))
    )


@query
def fetch_cache(spark, d):
    """A file a month, fetched twice: what the manifest says of each, and how often it was recorded."""
    months = V.monthly(spark, d).select(F.col("month").cast("string").alias("month"), F.col("x").cast("long").alias("n")).collect()  # a row a month
    origin, folder = _folder(spark), _folder(spark)
    for r in months:
        _write(f"{origin}/{r['month']}.txt", f"{r['month']} {r['n']}".encode())
    sources = [CH.Source(r["month"], f"{origin if '://' in origin else 'file://' + origin}/{r['month']}.txt", "orders") for r in months]
    CH.fetch(spark, sources[::2], folder)
    found = CH.fetch(spark, sources, folder)
    times = CH.records(spark, folder).groupBy("name").agg(F.count("*").alias("times"))
    return found.join(times, "name").select("name", "note", "bytes", "sha256", "times", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))


@query
def streaming_volatility(spark, d):
    """Trailing volatility of the events' values by user, as a stream that is stopped and started again halfway."""
    folder, store = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    events = V.table(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    halves = exact_quantiles(events, F.unix_micros("ts"), [0.5])
    cut = events.crossJoin(F.broadcast(halves)).withColumn("late", F.unix_micros("ts") > F.get("cuts", F.lit(0))).drop("cuts")
    before = spark.conf.get(store, None)
    spark.conf.set(store, ST.STATE_STORE)
    try:
        for late in (False, True):
            cut.where(F.col("late") == late).drop("late").write.mode("append").parquet(f"{folder}/in")
            stream = ST.trailing_volatility(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), window=21)
            run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    return spark.read.parquet(f"{folder}/out").select(F.col("series").alias("user_id"), F.col("id").alias("event_id"), "volatility")


@query
def trading_calendar(spark, d):
    """Every day between the first and the last order of those still pending, closed where there is none."""
    orders = V.table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("value"))
    return V.calendar(orders).select(F.col("day").cast("string").alias("day"), "value", "closed", "open_idx")


@query
def motor_frames(spark, d):
    """Policies and single claims through two ARFF files: capped policies with the sum of their claims."""
    often, much = _folder(spark), _folder(spark)
    policies = V.policies(spark, d).select("policy", (F.col("exposure") * 1.5).alias("exposure"), (F.col("claims") + 1).alias("claims"), "segment")
    lines = V.table(spark, d, "lineitem").where("l_returnflag = 'R'").join(V.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    _write(f"{often}/head.arff", b"@relation freq\n@attribute IDpol numeric\n@attribute Exposure numeric\n@attribute ClaimNb numeric\n@attribute Area string\n@data")
    _write(f"{much}/head.arff", b"@relation sev\n@attribute IDpol numeric\n@attribute ClaimAmount numeric\n@data")
    policies.select(F.concat_ws(",", "policy", "exposure", "claims", F.concat(F.lit("'"), "segment", F.lit("'")))).write.mode("append").text(often)
    lines.select(F.concat_ws(",", "o_custkey", "l_extendedprice")).write.mode("append").text(much)
    frequency, severity = RS.read_motor(spark, often, much)
    sums = severity.groupBy("IDpol").agg(F.count("*").alias("claims"), F.sum("ClaimAmount").alias("amount"))
    return frequency.join(sums, "IDpol", "left").select(F.col("IDpol").cast("long").alias("policy"), F.col("Exposure").alias("exposure"), F.col("ClaimNb").alias("claim_nb"), F.col("Area").alias("area"), F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("amount", F.lit(0.0)).alias("amount"))


@query
def bank_features(spark, d):
    """The customers as a bank's calls through a file with semicolons and quoted names: label and coded features."""
    folder = _folder(spark)
    calls = V.table(spark, d, "customer").select(F.col("c_custkey").alias("age"), F.col("c_mktsegment").alias("job"), F.when(F.col("c_nationkey") > 3, F.concat(F.lit("n"), "c_nationkey")).alias("poutcome"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_acctbal") > 5000, " Yes").otherwise("no").alias("y"))
    calls.toDF('"age"', "job", " poutcome", "balance", '"y"').write.csv(folder, sep=";", header=True)
    raw = RS.read_csv(spark, folder, "`age` long, job string, `poutcome ` string, balance double, `\"y\"` string", sep=";")
    return RS.bank_view(raw).drop("id")


@query
def engineered_features(spark, d):
    """Means of the features built of each line's figures, read as a machine's readings, and of their products with the label."""
    lines = V.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") + 270).alias("air"), (F.col("l_quantity") + 270 + F.col("l_tax") * 100).alias("process"),
        (F.col("l_extendedprice") / 50 + 100).alias("speed"), (F.col("l_discount") * 500 + 3).alias("torque"), F.col("l_suppkey").alias("wear"), F.when(F.col("l_linestatus") == "O", "L").when(F.col("l_linenumber") == 1, "H").otherwise("M").alias("grade"),
    )
    rows = RG.engineer(lines, air="air", process="process", speed="speed", torque="torque", wear="wear", grade="grade")
    names = [c for c in rows.columns if c not in ("id", "y")]
    one = rows.agg(*(F.avg(c).alias(c) for c in names), *(F.avg(F.col(c) * F.col("y")).alias(f"{c}_y") for c in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean"), F.col(f"{c}_y").alias("with_y")) for c in names))).alias("e")).select("e.*")
