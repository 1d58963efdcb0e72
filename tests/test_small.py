"""Small cells inside tasks against the same cells spread over the cluster."""

import random

import pytest
from pyspark.sql import functions as F

from neuritic.operators import forest, small

SCHEMA = "cell_id string, cell_type string, seq int, id int, type int, x double, y double, z double, radius double, parent int"


def cells():
    """Trees with cycles, several roots, missing parents and repeated ids, and one that lacks a number."""
    rng, rows = random.Random(3), []
    for c in range(12):
        for k in range(rng.randrange(1, 60)):
            parent = rng.choice([-1, None, 999]) if k == 0 or rng.random() < 0.05 else rng.randrange(max(1, k - 5), k + 1)
            if rng.random() < 0.05:
                parent = k + 1 + rng.randrange(3)  # itself or a later one
            rows.append((f"c{c}", "pyramidal", k, k + 1, 3, rng.random(), rng.random(), rng.random() if (c, k) != (4, 0) else None, float(rng.randrange(3)), parent))
            if rng.random() < 0.05:
                rows.append((f"c{c}", "pyramidal", k + 1000, k + 1, 2, 0.5, rng.random(), 0.25, 1.0, parent))
    return rows


def rows_of(df):
    return sorted(str([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("held", [100_000, 20])
def test_same_as_spread(spark, monkeypatch, held):
    nodes = spark.createDataFrame(cells(), SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(small, "SMALL", 0)  # all cells are spread
        topo = forest.topology(nodes).localCheckpoint()
        want = [rows_of(x) for x in (topo, forest.subtree_stats(topo), forest.stack_order(topo), forest.strahler(topo))]
    monkeypatch.setattr(small, "HELD", held)
    monkeypatch.setattr(small, "SMALL", 40)  # some cells are
    got = forest.topology(nodes).localCheckpoint()
    assert dict(got.dtypes) == dict(topo.dtypes)
    assert [rows_of(x) for x in (got, forest.subtree_stats(got), forest.stack_order(got), forest.strahler(got))] == want


def test_a_topology_of_small_cells_takes_one_wide_exchange(spark):
    nodes = spark.createDataFrame([(*r[:7], r[7] or 0.0, *r[8:]) for r in cells()], SCHEMA)
    plan = forest.topology(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert forest.topology(nodes).filter(F.col("reached")).count() > 0


def test_stack_order_of_small_cells_takes_no_rounds_across_the_cluster(spark, monkeypatch):
    rows = [(c, i, i, 3, float(i), 0.0, 0.0, 1.0, i - 1 if i % 3 else max(0, i - 2) if i > 1 else -1) for c in range(3) for i in range(1, 9)]
    nodes = spark.createDataFrame(rows, "cell_id long, id long, seq long, type int, x double, y double, z double, radius double, parent long")
    topo = forest.topology(nodes).cache()
    monkeypatch.setattr(forest, "checkpointed_count", None)
    got = forest.stack_order(topo)
    assert got.count() == 24 and {r[0] for r in got.filter("id = 1").select("place").collect()} == {0}
