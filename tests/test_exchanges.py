"""Steps that must not be taken twice, and rows that must not be exchanged without need."""

import random

import pytest
from pyspark.sql import functions as F

from neuritic.operators import features, forest, prep, rules
from neuritic.plans import labelling
from neuritic.session import checkpointed

SCHEMA = "cell_id long, cell_type string, seq int, id long, type int, x double, y double, z double, radius double, parent long, pred int, conf double"


def cells(spark, n=12, kinds=("pyramidal", "interneuron")):
    rng, rows = random.Random(3), []
    for c in range(n):
        for k in range(1, rng.randrange(20, 60)):
            rows.append((c, kinds[c % len(kinds)], k, k, 1 if k == 1 else rng.choice([2, 3, 4]), float(rng.randrange(90)), float(rng.randrange(90)), float(rng.randrange(90)), 9.0 if k == 1 else rng.randrange(1, 9) / 4, -1 if k == 1 else rng.randrange(max(1, k - 5), k), rng.choice([2, 3, 4]), rng.randrange(50, 100) / 100))
    return spark.createDataFrame(rows, SCHEMA)


def test_branches_of_a_baseline_sum_subtrees_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(features, "subtree_stats", lambda topo: asked.append(1) or forest.subtree_stats(topo))
    assert features.neurom_branches(forest.topology(cells(spark))).count() > 0
    assert len(asked) == 1


def exchanged(df):
    """The columns of each exchange of a plan whose joins are not broadcast."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_parts_are_told_without_an_exchange_of_nodes(spark, no_broadcast):
    t = forest.topology(cells(spark)).localCheckpoint()
    for share in (0.3, 1e-9):  # with 1e-9 a type's first cell alone is for tests
        learn, test = labelling.in_parts(t, share)
        want = {r.cell_id: r.is_test for r in prep.split(t.select("cell_id", "cell_type").distinct().withColumn("file_name", F.col("cell_id").cast("string")), share).collect()}
        assert not exchanged(learn) and not exchanged(test)
        assert {r.cell_id for r in test.collect()} == {c for c, is_test in want.items() if is_test}
        assert {r.cell_id for r in learn.collect()} == {c for c, is_test in want.items() if not is_test}
        assert learn.count() + test.count() == t.count()


def test_cells_without_a_type_are_in_no_part(spark):
    t = forest.topology(cells(spark, kinds=("pyramidal", None, "interneuron")))
    learn, test = labelling.in_parts(t, 0.3)
    assert learn.count() + test.count() == t.filter("cell_type IS NOT NULL").count() < t.count()


def test_branch_rows_go_by_branch_alone(spark, no_broadcast):
    t = forest.topology(cells(spark)).localCheckpoint()
    assert len(exchanged(features.branch_geometry(t))) == 2  # nodes, and first nodes of branches
    assert len(exchanged(forest.branches(t, more=("type", "seq")))) == 2
    got = {(r.cell_id, r.id): r.radius for r in forest.branches(t, more=("radius",)).collect()}
    assert got == {(r.cell_id, r.id): r.radius for r in t.filter("head IS NOT NULL AND primary_root IS NOT NULL").collect()}


def test_flips_keep_narrow_rows(spark, monkeypatch):
    written = []
    monkeypatch.setattr(rules, "checkpointed", lambda df, *more: written.append(df.columns) or checkpointed(df, *more))
    t = forest.topology(cells(spark)).withColumn("note", F.lit("x"))
    assert rules.flip_islands(t).columns == t.columns
    assert not any("note" in c for c in written)
