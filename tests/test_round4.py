"""Steps that read or hold more than their share of a larger table."""

import time

import numpy as np
import pyarrow as pa
import pytest
from plumbline.operators import basket
from plumbline.operators.batched import OFFSET, PRIME, STEP
from plumbline.plans import model_queries, queries  # noqa: F401
from plumbline.sources import views
from pyspark.sql import functions as F

LINES = "/root/testdata/sf0.001"


@pytest.fixture
def read(spark, monkeypatch):
    """Rows that queries read from a table, each time."""
    made, real = spark.sparkContext.accumulator(0), views.table

    def mark(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def marked(session, d, name):
        rows = real(session, d, name)
        return rows.mapInArrow(mark, rows.schema)

    monkeypatch.setattr(views, "table", marked)
    return made


def test_tree_models_score_in_one_pass(spark, read):
    """A fit reads the lines three times; the cut in time and the scores of all models are found once (67 readings in all before)."""
    found = {(r["split"], r["model"]): r["auc"] for r in queries.QUERIES["tree_models"](spark, LINES).collect()}
    assert len(found) == 6 and all(0.4 < v < 0.6 for v in found.values())
    assert read.value <= 22 * 6_000


def test_dealing_is_that_of_two_sorts_in_half_their_time():
    rng = np.random.default_rng(1)
    owner = np.sort(rng.integers(0, 13_000, 50_000))
    owner = np.unique(owner, return_inverse=True)[1]
    keys, few, many = rng.integers(0, PRIME, 50_000), rng.integers(0, 25, 50_000), rng.integers(0, 20_000, 50_000)
    keys[100:120] = keys[7]  # equal keys stay in the order of their slots

    def plain(codes, r):
        order = np.argsort((keys * pow(STEP, r + 1, PRIME) + pow(OFFSET, r + 1, PRIME)) % PRIME, kind="stable")
        return np.divmod(np.unique(owner * (codes.max() + 1) + codes[order]), codes.max() + 1)

    def least(f):
        times = []
        for _ in range(7):
            began = time.perf_counter()
            f(few, 3)
            times.append(time.perf_counter() - began)
        return min(times)

    for codes in (few, many):
        assert all((a == b).all() for a, b in zip(basket.deal(keys, codes, owner, 3), plain(codes, 3), strict=True))
    assert least(lambda codes, r: basket.deal(keys, codes, owner, r)) < 0.6 * least(plain)


def test_buckets_go_on_over_batches():
    rows = [(0, 5, 1, "b"), (0, 6, 1, "a"), (0, 7, 2, "b"), (2, 8, 3, "c"), (2, 9, 4, "a")]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
    whole = pa.RecordBatch.from_arrays(columns, ["bucket", "key", "basket", "item"])
    found = [(k.tolist(), n, c.tolist(), o.tolist()) for k, n, c, o in basket._buckets([whole.slice(0, 2), whole.slice(0, 0), whole.slice(2, 2), whole.slice(4)])]
    assert found == [([5, 6, 7], ["a", "b"], [1, 0, 1], [0, 0, 1]), ([8, 9], ["a", "c"], [1, 0], [0, 1])]


def test_a_task_counts_a_bounded_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(basket, "PAIR_ROWS", 500, raising=False)
    lines = spark.range(6000).select((F.col("id") % 1500).alias("basket"), F.col("id").cast("string").alias("item"))
    found = basket.pair_counts(basket.build_baskets(lines))
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 1000


def test_calibrators_read_the_lines_a_few_times(spark, read):
    """The scaling, the number of rows, the fit's own two readings and one for all scores."""
    assert len(queries.QUERIES["calibrators"](spark, LINES).collect()) == 3
    assert read.value <= 8 * 6_000, read.value / 6_000
