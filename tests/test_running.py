"""Global orders by ranges against brute force."""

import numpy as np
import pytest
from plumbline.functions.running import exact_quantiles, positions, running_totals, trapezoid
from plumbline.operators import metrics, pricing, recommend, survival
from pyspark.sql import functions as F


def test_totals_by_group(spark):
    rnd = np.random.default_rng(1)
    rows = [(g, float(k), int(rnd.integers(0, 9))) for g in ("a", "b", None) for k in rnd.permutation(200)]
    got = running_totals(spark.createDataFrame(rows, "g string, k double, v int"), "k", {"s": F.col("v")}, groups=("g",))
    want = {(g, k): sum(v2 for g2, k2, v2 in rows if g2 == g and k2 <= k) for g, k, _ in rows}
    assert {(r["g"], r["k"]): r["s"] for r in got.collect()} == want


def test_positions_with_ties(spark):
    rows = [(int(k) % 7, int(k)) for k in np.random.default_rng(2).permutation(300)]
    got = positions(spark.createDataFrame(rows, "t int, id int"), F.col("t"), ["id"]).orderBy("idx").collect()
    assert [(r["t"], r["id"]) for r in got] == sorted(rows) and [r["idx"] for r in got] == list(range(300))


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 5.0, None], list(np.random.default_rng(3).normal(size=501))])
def test_quantiles_are_exact(spark, values):
    shares = [0.0, 0.1, 0.33, 0.5, 0.995, 1.0]
    got = exact_quantiles(spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double"), "v", shares).first()["cuts"]
    assert got == pytest.approx(np.quantile([v for v in values if v is not None], shares).tolist())


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first()["cuts"] is None


def test_area_of_a_curve(spark):
    points = [(float(x), float(y)) for x, y in np.random.default_rng(4).integers(0, 60, (400, 2))]
    x, y = np.array(sorted(points)).T
    assert trapezoid(spark.createDataFrame(points, "a double, b double"), "a", "b").first()["area"] == pytest.approx(np.trapezoid(y, x))
    assert trapezoid(spark.createDataFrame([], "a double, b double"), "a", "b").first()["area"] == 0.0


def test_auc_by_group(spark):
    rnd = np.random.default_rng(5)
    rows = [(g, i, int(rnd.integers(0, 2)), float(rnd.integers(0, 40)) * (1 + 9 * g)) for g in range(3) for i in range(150)]
    got = {r["g"]: r["auc"] for r in metrics.auc(spark.createDataFrame(rows, "g int, id int, y int, score double"), groups=("g",)).collect()}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        wins = [(a[3] > b[3]) + (a[3] == b[3]) / 2 for a in own if a[2] for b in own if not b[2]]
        assert got[g] == pytest.approx(np.mean(wins))


def test_concordance_matches_all_pairs(spark):
    rnd = np.random.default_rng(6)
    rows = [(int(t), float(r), bool(o)) for t, r, o in zip(rnd.integers(0, 90, 400), rnd.integers(0, 30, 400), rnd.random(400) < 0.6, strict=True)]
    pairs = [(b[1] < a[1]) + (b[1] == a[1]) / 2 for a in rows if a[2] for b in rows if b[0] > a[0]]
    got = survival.concordance(spark.createDataFrame(rows, "duration int, risk double, observed boolean")).first()
    assert got["pairs"] == len(pairs) and got["c_index"] == pytest.approx(np.mean(pairs))
    none = survival.concordance(spark.createDataFrame([(3, 1.0, True)], "duration int, risk double, observed boolean")).first()
    assert none["c_index"] == 0.5 and none["pairs"] == 0


def test_lift_table_cuts_ties_by_id(spark):
    rows = [(i, float(i % 3), float(i % 5), 1.0) for i in range(57)]
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r["decile"]: (r["policies"], r["actual"]) for r in pricing.lift_table(spark.createDataFrame(rows, "id int, predicted double, actual double, exposure double")).collect()}
    for b in range(10):
        part = order[57 * b // 10 : 57 * (b + 1) // 10]
        assert got[b + 1] == (len(part), pytest.approx(np.mean([r[2] for r in part])))


def test_heavy_users_pair_by_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    rows = spark.createDataFrame([(0, f"i{k}") for k in range(40)] + [(int(u), f"i{k}") for u in range(1, 9) for k in rnd.choice(40, 6, replace=False)], "user int, item string")
    whole = sorted(map(tuple, recommend.item_similarity(rows, neighbours=50).collect()))
    monkeypatch.setattr(recommend, "ITEM_BLOCK", 7)
    assert sorted(map(tuple, recommend.item_similarity(rows, neighbours=50).collect())) == whole and len(whole) == 40 * 39


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    from plumbline.session import checkpoint_dir

    def session(master, folder=None):
        return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master=master, getConf=dict))

    assert checkpoint_dir(session("local[4]"), "/tmp/x") == "/tmp/x"
    assert checkpoint_dir(session("spark://host:7077", "/shared"), "/tmp/x") == "/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session("spark://host:7077"), "/tmp/x")
