"""Tables with a row for each node are never sent to the driver for a broadcast."""

from neuritic.operators import forest
from neuritic.plans import baselines
from neuritic.session import checkpointed

SCHEMA = "cell_id string, cell_type string, seq int, id long, type int, x double, y double, z double, radius double, parent long"


def test_what_predictors_say_is_joined_by_exchange(spark):
    rows = [(f"c{c}", "pyramidal", k, k + 1, 3, 0.0, 0.0, 0.0, 1.0, -1 if k == 0 else k) for c in range(3) for k in range(5)]
    topo = checkpointed(forest.topology(spark.createDataFrame(rows, SCHEMA)))
    out = baselines.run(topo, {"one": lambda t: t.selectExpr("cell_id", "id", "3 AS pred")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [cell_id" in line and ", id#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
