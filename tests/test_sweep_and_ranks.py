"""Sweeps that go on where they were, exact p values of signed ranks, and the order in which a stack gives nodes away."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from neuritic.operators import forest, ml, stats


def test_a_sweep_goes_on_where_it_was(spark, tmp_path):
    rows = spark.createDataFrame([(float(k % 10), float(k % 10 > 4) if k % 17 else 1.0, k // 10 % 3) for k in range(120)], "a double, label double, fold int").cache()
    grid = [{"trees": 2, "depth": 2}, {"depth": 3, "trees": 1}, {"trees": 3, "depth": 1}]
    whole = sorted(map(tuple, ml.sweep(rows, ["a"], grid, k=3).select("trees", "depth", "fold", "n", "accuracy").collect()))
    fitted = []

    def fit(learn, setting, stop=None):
        fitted.append(setting)
        if stop is not None and len(fitted) > stop:
            raise RuntimeError("stopped")
        return ml.RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=setting["trees"], maxDepth=setting["depth"], seed=42).fit(ml.assemble(learn, ["a"]))

    path = str(tmp_path / "results")
    with pytest.raises(RuntimeError):
        ml.sweep(rows, ["a"], grid, k=3, path=path, side_by_side=1, fit=lambda learn, s: fit(learn, s, 4))
    fitted.clear()
    turned = [dict(reversed(s.items())) for s in grid]
    got = ml.sweep(rows, ["a"], turned, k=3, path=path, fit=fit)
    assert len(fitted) == 9 - 4
    assert sorted(map(tuple, got.select("trees", "depth", "fold", "n", "accuracy").collect())) == whole and len({r[4] for r in whole}) > 1
    fitted.clear()
    assert ml.sweep(rows, ["a"], grid, k=3, path=path, fit=fit).count() == 9 and not fitted


def test_exact_signed_ranks(spark):
    rng = random.Random(1)
    pairs, want = [], {}
    for n in range(1, 12):
        d = [rng.choice([-1, 1]) * s for s in rng.sample(range(1, 60), n)]
        ranks = {s: k for k, s in enumerate(sorted(map(abs, d)), 1)}
        low = min(sum(ranks[abs(v)] for v in d if v > 0), sum(ranks[abs(v)] for v in d if v < 0))
        sums = [sum(k for k, on in enumerate(signs, 1) if on) for signs in itertools.product((0, 1), repeat=n)]
        want[f"m{n}"] = min(1.0, 2 * sum(s <= low for s in sums) / 2**n)
        pairs += [(f"m{n}", "x", float(v)) for v in d]
    pairs += [("ties", "x", v) for v in (1.0, 1.0, -3.0, 2.0)] + [("zero", "x", v) for v in (0.0, 1.0, 2.0)] + [("none", "x", 0.0)]
    got = {r.a: r for r in stats.wilcoxon(spark.createDataFrame(pairs, "a string, b string, d double")).collect()}
    assert all(abs(got[a].p_value - p) < 1e-12 for a, p in want.items())
    assert got["none"].p_value == 1.0 and 0 < got["ties"].p_value <= 1 and abs(got["m1"].p_bonferroni - 1) < 1e-12
    fifty = spark.createDataFrame([("a", "x", float(k)) for k in range(1, 51)], "a string, b string, d double")
    assert stats.wilcoxon(fifty).first().p_value == 2.0**-49


def test_stack_order(spark):
    rng = random.Random(2)
    cells, want = [], {}
    for c in range(20):
        n = rng.randrange(1, 60)
        order = list(range(1, n + 1))
        rng.shuffle(order)
        parent = {i: rng.randrange(1, i) if i > 1 and rng.random() < 0.97 else -1 for i in range(1, n + 1)}
        rows = [(f"c{c}", "pyramidal", k, i, 3, 0.0, 0.0, 0.0, 1.0, parent[i]) for k, i in enumerate(order)]
        cells += rows
        for top in (i for i in order if parent[i] == -1):
            stack, place, tips = [top], 0, 0
            while stack:
                i = stack.pop()
                below = [j for j in order if parent[j] == i]
                want[f"c{c}", i] = (place, tips)
                place, tips = place + 1, tips + (not below)
                stack.extend(below)
    topo = forest.topology(spark.createDataFrame(cells, "cell_id string, cell_type string, seq int, id long, type int, x double, y double, z double, radius double, parent long"))
    assert {(r.cell_id, r.id): (r.place, r.tip_place) for r in forest.stack_order(topo).collect()} == want
    assert topo.filter(F.col("reached")).count() == len(want)
