"""Order statistics against sorting, with few values put together so that bounds have to narrow."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neuritic.operators import metrics, order


def made_up():
    rng = random.Random(1)
    return {
        "distinct": [rng.gauss(0, 1) for _ in range(3000)],
        "one value": [2.5] * 2000,
        "nearly one value": [7.0] * 3000 + [rng.random() for _ in range(40)],
        "wide": [math.copysign(10.0 ** rng.uniform(-300, 300), rng.random() - 0.5) for _ in range(2000)],
        "few": [1.0, 2.0, 2.0, 5.0],
        "one": [3.0],
        None: [float(k) for k in range(50)],
    }


@pytest.mark.parametrize("limit,marks", [(8, 4), (100, 16), (4096, 256)])
def test_quantiles_equal_numpy(spark, limit, marks):
    groups, shares = made_up(), [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    rows = spark.createDataFrame([(g, v) for g, of in groups.items() for v in of] + [("few", None), ("nulls", None)], "k string, x double").repartition(6)
    got = {r.k: r for r in order.quantiles(rows, ["k"], "x", shares, limit, marks).collect()}
    assert set(got) == set(groups)
    for g, of in groups.items():
        assert got[g].n == len(of) and np.allclose(got[g].q, np.quantile(of, shares), rtol=1e-12, atol=0)


def test_passes_are_few_and_what_is_gathered_is_bounded(spark, monkeypatch):
    """A third of the rows in one group of distinct values: a pass leaves one of many, and no array exceeds the limit."""
    made = []
    stored = order.checkpointed
    monkeypatch.setattr(order, "checkpointed", lambda df: made.append(stored(df)) or made[-1])
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("k"), (F.xxhash64("id") / 1e18).alias("x"))
    got = {r.k: (r.median, r.p10) for r in metrics.score_summary(rows, ["k"], "x").collect()}
    local = rows.toPandas().groupby("k").x
    assert all(np.isclose(got[k][0], v) for k, v in local.median().items()) and all(np.isclose(got[k][1], v) for k, v in local.quantile(0.1).items())
    assert len(made) <= 5  # groups, bounds, marks and bounds of one pass, values


def test_nearest_rank_takes_values_of_the_data(spark):
    rng = random.Random(3)
    of = [rng.gauss(0, 1) for _ in range(5001)]
    r = metrics.nearest_rank(spark.createDataFrame([("m", v) for v in of], "method string, f1 double"), ["method"]).first()
    of.sort()
    assert (r.median, r.p10, r.p25, r.p75, r.p90, r.least, r.most, r.n) == (of[2500], of[500], of[1250], of[3750], of[4500], of[0], of[-1], 5001)
