"""Smoothing of small cells inside tasks, against the same cells spread over the cluster."""

import random

from pyspark.sql import functions as F

from neuritic.operators import rules, small

SCHEMA = "cell_id string, cell_type string, id int, parent int, proxy int, pred int, conf double, note string"


def nodes(spark):
    rng, rows = random.Random(5), []
    for c in range(14):
        kind = rng.choice(["pyramidal", "interneuron", "purkinje", None])
        for k in range(1, rng.randrange(2, 60)):
            parent = rng.choice([-1, None, 999]) if k == 1 or rng.random() < 0.05 else rng.randrange(max(1, k - 4), k + (rng.random() < 0.1))
            rows.append((f"c{c}", kind, k, parent, None if c == 3 else 1, rng.choice([1, 2, 3, 4, 2, 3, 4, None]), rng.choice([0.3, 0.5, 0.65, 0.9, None, float("nan")]), f"{c}:{k}"))
    return spark.createDataFrame(rows, SCHEMA).localCheckpoint()


def test_same_as_spread(spark, monkeypatch):
    n = nodes(spark)
    for settings in (*rules.SMOOTHING.values(), {"rounds": 3, "labels": F.array(*map(F.lit, (2, 3, 4)))}):
        got = []
        for most in (0, 30, 50_000):  # none, some and all inside tasks
            with monkeypatch.context() as m:
                m.setattr(small, "SMALL", most)
                out = rules.smooth(n, **settings)
                got.append((out.dtypes, sorted(map(str, out.collect()))))
        assert got[0] == got[1] == got[2]
        assert sorted(map(str, out.drop("pred").collect())) == sorted(map(str, n.drop("pred").select(*out.drop("pred").columns).collect()))


def test_small_cells_take_no_round_each_across_the_cluster(spark, monkeypatch):
    stored, plain = [], rules.checkpointed
    monkeypatch.setattr(rules, "checkpointed", lambda df, *more: (stored.append(df), plain(df, *more))[1])
    rules.smooth(nodes(spark), 3)
    assert len(stored) == 1
    assert stored[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
