"""Steps that a larger table made slow: whole results, at sizes that cut them into several ranges, blocks and parts."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import metrics
from plumbline.operators.batched import CUTS, OFFSET, PRIME, STEP, Fit, Model, _newton, areas, draw_weights, fit_all, narrowed
from plumbline.streaming.windows import TrailingVolatility


def labelled(spark, n: int):
    x = F.round(F.rand(5) * 3, 2)
    rows = spark.range(0, n, 1, 5).select("id", x.alias("a"), F.round(F.rand(6), 1).alias("b"), F.rand(7).alias("u"))
    return rows.select("id", (F.col("u") < 1 / (1 + F.exp(1 - F.col("a") + F.col("b")))).cast("double").alias("y"), "a", "b")


def test_areas_of_all_fits_over_ranges(spark):
    rows = labelled(spark, 5000).withColumn("a", F.when(F.col("id") == 3, None).otherwise(F.col("a")))
    fits = [Fit(Model("one"), np.array([0.5, -0.25, 0.1])), Fit(Model("flat"), np.zeros(3)), Fit(Model("other"), np.array([-1.0, 0.0, 0.0]))]
    found = {r["model"]: r["auc"] for r in areas(narrowed(rows, ["a", "b"], draws=False), ["a", "b"], fits, rows=300).collect()}
    for f in fits:
        score = F.lit(float(f.beta[2])) + F.col("a") * float(f.beta[0]) + F.col("b") * float(f.beta[1])  # in this order, as sums round
        assert abs(found[f.model.name] - metrics.auc(rows.select("id", "y", score.alias("score"))).first()["auc"]) < 1e-12
    assert found["flat"] == 0.5


def test_weights_are_the_draws(spark):
    keys = np.concatenate([np.random.default_rng(0).integers(0, PRIME, 5000), [0, 1, PRIME - 1]])
    wanted = [np.searchsorted(CUTS, (keys * pow(STEP, r + 1, PRIME) + pow(OFFSET, r + 1, PRIME)) % PRIME, side="right") for r in (0, 7, 100_003)]
    found = draw_weights(keys, [0, 7, None, 100_003])
    assert (found[:, [0, 1, 3]] == np.stack(wanted, axis=1)).all() and (found[:, 2] == 1).all()


def test_replicates_start_at_the_fit_of_all_rows(spark):
    rows = labelled(spark, 4000)
    models = [Model(str(r), 0.01, 1.0, r) for r in range(20)]
    fits = fit_all(rows, ["a", "b"], models)
    cold = _newton(narrowed(rows, ["a", "b"]), 2, [Fit(m, np.zeros(3)) for m in models], 20, 1e-7)
    assert max(f.passes for f in fits) < max(f.passes for f in cold)
    assert all(np.abs(a.beta - b.beta).max() < 1e-9 for a, b in zip(fits, cold, strict=True))
    alone = fit_all(rows, ["a", "b"], [Model("3", 0.01, 1.0, 3)])[0]
    assert np.abs(alone.beta - fits[3].beta).max() < 1e-9


def test_volatility_reads_and_writes_a_series_state_once():
    class Value:
        reads = writes = 0
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            self.reads += 1
            return self.held

        def update(self, new):
            self.writes, self.held = self.writes + 1, new

    class Handle:
        value = Value()

        def getValueState(self, *_):  # noqa: N802
            return self.value

    processor, handle = TrailingVolatility(3, 4), Handle()
    processor.init(handle)
    data = np.array([1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 7.5])
    found = []
    for part in (slice(0, 2), slice(2, 3), slice(3, 7)):
        frame = pd.DataFrame({"id": np.arange(7)[part], "ts": np.arange(7)[part], "value": data[part]})
        found += [v for out in processor.handleInputRows(("s",), iter([frame]), None) for v in out["volatility"]]
    wanted = [np.std(data[k - 2 : k + 1], ddof=1) * 2 for k in range(2, 7)]
    assert np.isnan(np.array(found[:2], float)).all() and np.allclose(found[2:], wanted) and (handle.value.reads, handle.value.writes) == (2, 3)
