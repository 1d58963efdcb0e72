"""The bootstrap draws in many tasks, and once for each file and resample."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from neuritic.operators import stats


def test_equals_resamples_drawn_one_by_one(spark):
    rows = [("m", f"f{k}.swc", float(k * 37 % 11)) for k in range(60)] + [("m", "none.swc", None)]
    got = {r.statistic: r for r in stats.bootstrap(spark.createDataFrame(rows, "method string, file_name string, f1 double"), ["method"], resamples=30).collect()}
    said = {"mean": [], "median": [], "p10": []}
    for r in range(30):
        v = []
        for _, name, f1 in rows[:-1]:
            u = int(hashlib.md5(f"42:{r}:{name}".encode()).hexdigest()[:8], 16) / 4294967295.0
            v += [f1] * sum(p <= u for p in stats.POISSON)
        for n, x in (("mean", np.mean(v)), ("median", np.median(v)), ("p10", np.percentile(v, 10))):
            said[n].append(x)
    for n, v in said.items():
        assert np.allclose([got[n].low, got[n].high, got[n]["std"]], [*np.percentile(v, [2.5, 97.5]), np.std(v, ddof=1)])


def test_one_small_file_is_drawn_for_in_many_tasks(spark):
    one = spark.range(5000).coalesce(1).select(F.lit("m").alias("method"), F.concat(F.lit("f"), "id").alias("file_name"), (F.col("id") % 1000).cast("double").alias("f1"))
    plan = stats.bootstrap(one, ["method"], resamples=10)._jdf.queryExecution().optimizedPlan().toString()
    draw = plan[plan.index("explode"):] if "explode" in plan else plan[plan.index("Generate"):]
    assert "RepartitionByExpression" in draw  # below the draws
    assert plan.count("md5") == 1
