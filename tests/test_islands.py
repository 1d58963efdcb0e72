"""Island flips, all at once, against a walk through each cell in file order."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from neuritic.operators import forest, rules

SCHEMA = "cell_id string, cell_type string, seq int, id long, type int, x double, y double, z double, radius double, parent long, pred int, conf double"


def random_cell(rng, name, n, reach=6):
    """A tree whose nodes stand in the file in any order; most labels are their parent's."""
    parent, label = {1: -1}, {1: 1}
    for i in range(2, n + 1):
        parent[i] = rng.randrange(max(1, i - reach), i)
        label[i] = label[parent[i]] if label[parent[i]] != 1 and rng.random() < 0.6 else rng.choice([2, 3, 4])
    order = list(range(1, n + 1))
    rng.shuffle(order)
    return [(name, "pyramidal", k, i, 3, float(i), 0.0, 0.0, 9.0 if i == 1 else 1.0, parent[i], label[i], rng.randrange(50, 100) / 100) for k, i in enumerate(order)]


def walked(rows, most, threshold):
    """Labels after a walk over the nodes in file order, region by region."""
    node = {r[3]: r for r in rows}
    below = {i: [] for i in node}
    for r in sorted(rows, key=lambda r: r[2]):
        if r[9] in node:
            below[r[9]].append(r[3])
    label, seen = {i: r[10] for i, r in node.items()}, set()
    for r in sorted(rows, key=lambda r: r[2]):
        start = r[3]
        if start in seen or start == 1:
            continue
        own, region, outside, queue = label[start], [], [], deque([start])
        while queue:
            i = queue.popleft()
            if i in seen or i == 1:
                continue
            if label[i] != own:
                outside.append(label[i])
                continue
            seen.add(i)
            region.append(i)
            queue.extend(([node[i][9]] if node[i][9] in node else []) + below[i])
        sure = round(sum(node[i][11] for i in region) / len(region), 12) >= threshold
        if outside and len(region) <= most and not sure:
            to = max(dict.fromkeys(outside), key=outside.count)  # the first met among equals
            label |= dict.fromkeys(region, to)
    return label


@pytest.mark.parametrize("most,threshold", [(15, 0.75), (3, 0.9), (40, 1.1)])
def test_flips_equal_the_walk(spark, most, threshold):
    rng = random.Random(most)
    cells = [random_cell(rng, f"c{k}", rng.randrange(1, 70), rng.choice([1, 3, 60])) for k in range(60)]
    n = forest.topology(spark.createDataFrame([r for c in cells for r in c], SCHEMA))
    got = {(r.cell_id, r.id): r.pred for r in rules.flip_islands(n, most, threshold).select("cell_id", "id", "pred").collect()}
    want = {(c[0][0], i): v for c in cells for i, v in walked(c, most, threshold).items()}
    assert got == want
    assert sum(got[r[0], r[3]] != r[10] for c in cells for r in c) > 50


def test_a_large_cell_is_not_one_task(spark):
    """A cell with a third of all nodes is dealt out like others, and no step works through a cell in Python."""
    rng = random.Random(9)
    large = random_cell(rng, "large", 3000, 4)
    cells = [large, *(random_cell(rng, f"c{k}", 60) for k in range(100))]
    n = forest.topology(spark.createDataFrame([r for c in cells for r in c], SCHEMA))
    out = rules.flip_islands(n)
    assert {r.id: r.pred for r in out.filter("cell_id = 'large'").collect()} == walked(large, 15, 0.75)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Window" not in plan


def test_settings_by_cell_type(spark):
    rng = random.Random(4)
    cells = [random_cell(rng, f"c{k}", 50) for k in range(20)]
    cells = [[(r[0], "interneuron" if k % 2 else "pyramidal", *r[2:]) for r in c] for k, c in enumerate(cells)]
    n = forest.topology(spark.createDataFrame([r for c in cells for r in c], SCHEMA))
    kind = F.col("cell_type") == "pyramidal"
    got = {(r.cell_id, r.id): r.pred for r in rules.flip_islands(n, F.when(kind, 15).otherwise(2), F.when(kind, 0.9).otherwise(0.6)).collect()}
    assert got == {(c[0][0], i): v for c in cells for i, v in walked(c, *((15, 0.9) if c[0][1] == "pyramidal" else (2, 0.6))).items()}
