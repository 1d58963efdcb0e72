"""Randomized and boosted trees against plain ones grown row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neuritic.operators import trees


def made_up(n=240, seed=1, classes=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [rng.randrange(9) / 2, rng.gauss(0, 1).__round__(1), float(rng.randrange(3)), rng.random().__round__(2)]
        y = min(classes - 1, int(x[0] > 2) + int(x[1] > 0.5 and classes > 2)) if rng.random() < 0.9 else rng.randrange(classes)
        rows.append((*x, y, rng.choice([0.5, 1.0, 2.0])))
    return rows


NAMES = ["a", "b", "c", "d"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "a double, b double, c double, d double, label int, w double").repartition(5)


def plain_boosted(rows, rounds, depth, rate, least, classes):
    """Predictions of boosted trees found by trying every value of every feature."""
    x, y, w = np.array([r[:4] for r in rows]), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    share = [w[y == k].sum() / w.sum() for k in range(classes)]
    first = [math.log(share[1] / share[0])] if classes == 2 else [math.log(s) for s in share]
    f, structure = np.tile(first, (len(x), 1)), []
    for _ in range(rounds):
        p = trees._softmax(f)
        for t in range(len(first)):
            k = t + (classes == 2)
            g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
            level = [np.arange(len(x))]
            for _ in range(depth):
                after = []
                for part in level:
                    best = (0.0, None)
                    score = lambda s: g[s].sum() ** 2 / h[s].sum()
                    for j in range(4):
                        for v in np.unique(x[part, j])[:-1]:
                            lo, hi = part[x[part, j] <= v], part[x[part, j] > v]
                            if min(len(lo), len(hi)) >= least and (s := round(score(lo) + score(hi) - score(part), 9)) > best[0]:
                                best = (s, (j, v, lo, hi))
                    if best[1]:
                        j, v, lo, hi = best[1]
                        structure.append((j, v, len(lo), len(hi)))
                        after += [lo, hi]
                    else:
                        f[part, t] -= rate * g[part].sum() / h[part].sum() if len(part) < len(x) else 0
                level = after
            for part in level:
                f[part, t] -= rate * g[part].sum() / h[part].sum()
    return trees._softmax(f), structure


@pytest.mark.parametrize("classes", [2, 3])
def test_boosted_trees_equal_brute_force(spark, classes):
    rows = made_up(classes=classes)
    model = trees.train_boosted(frame(spark, rows), NAMES, classes=classes, rounds=3, depth=3, rate=0.3, least=5, weight="w")
    want, structure = plain_boosted(rows, 3, 3, 0.3, 5, classes)
    got = model.probabilities(np.array([r[:4] for r in rows]))
    assert np.allclose(got, want, atol=1e-9)
    assert sorted((t.feature[n], t.cut[n]) for t in model.trees for n in range(len(t.feature)) if t.feature[n] >= 0) == sorted((j, v) for j, v, _, _ in structure)


def test_scores_are_written_now_and_then(spark, monkeypatch):
    rows = made_up(seed=2)
    settings = {"rounds": 5, "depth": 2, "rate": 0.3, "least": 5}
    x = np.array([r[:4] for r in rows])
    want = trees.train_boosted(frame(spark, rows), NAMES, **settings).probabilities(x)
    monkeypatch.setattr(trees, "WRITTEN", 2)
    assert np.allclose(trees.train_boosted(frame(spark, rows), NAMES, **settings).probabilities(x), want, atol=1e-9)


def plain_random(rows, limits, n_trees, depth, least, few, seed, classes):
    """The same randomized trees, leaf by leaf."""
    x, y, w = np.array([r[:4] for r in rows]), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    at = np.stack([np.searchsorted(limits[k], x[:, k]) for k in range(4)], axis=1)
    weights = lambda part: np.array([w[part][y[part] == k].sum() for k in range(classes)])
    pure = lambda s: (s**2).sum() / s.sum() if s.sum() > 0 else 0.0
    out = []
    for t in range(n_trees):
        made = trees.Tree(value=[(weights(np.arange(len(x))) / w.sum()).tolist()])
        level = [(0, np.arange(len(x)))]
        for _ in range(depth):
            after = []
            for node, part in level:
                if node and len(part) < 2 * least:
                    continue
                best = (0.0, None)
                for j in trees.chosen_features(seed, t, np.array([node]), 4, few)[0]:
                    low, high = at[part, j].min(), at[part, j].max()
                    if low == high:
                        continue
                    cut = trees.chosen_cut(seed, t, node, int(j), int(low), int(high))
                    lo, hi = part[at[part, j] <= cut], part[at[part, j] > cut]
                    s = round((pure(weights(lo)) + pure(weights(hi)) - pure(weights(part))) / weights(part).sum(), 9)
                    if min(len(lo), len(hi)) >= least and s > best[0]:
                        best = (s, (int(j), cut, lo, hi))
                if best[1]:
                    j, cut, lo, hi = best[1]
                    new = made.split(node, j, cut, limits[j][cut], (weights(lo) / weights(lo).sum()).tolist(), (weights(hi) / weights(hi).sum()).tolist())
                    after += list(zip(new, (lo, hi)))
            level = after
        out.append(made)
    return out


@pytest.mark.parametrize("classes", [2, 3])
def test_randomized_trees_equal_brute_force(spark, classes):
    rows = made_up(seed=3, classes=classes)
    df = frame(spark, rows)
    model = trees.train_random(df, NAMES, classes=classes, trees=20, depth=4, weight="w", seed=7)
    want = plain_random(rows, trees.cuts(df, NAMES), 20, 4, 2, 2, 7, classes)
    for a, b in zip(model.trees, want, strict=True):
        assert (a.feature, a.bin, a.cut, a.left) == (b.feature, b.bin, b.cut, b.left)
        assert all(np.allclose(p, q) for p, q in zip(a.value, b.value, strict=True))
    assert len({tuple(t.feature) for t in model.trees}) > 10


def test_saved_trees_and_new_rows(spark, tmp_path):
    rows, new = made_up(400, 4), made_up(200, 5)
    df = frame(spark, rows)
    for name, model in (("random", trees.train_random(df, NAMES, trees=15, depth=6)), ("boosted", trees.train_boosted(df, NAMES, rounds=5, depth=3, rate=0.3))):
        model.save(spark, str(tmp_path / name))
        again = trees.Trees.load(spark, str(tmp_path / name))
        got = again.predict(frame(spark, new)).select("label", "prediction", "probability", *NAMES).collect()
        assert np.mean([r.label == r.prediction for r in got]) > 0.8
        assert np.allclose([r.probability for r in got], model.probabilities(np.array([[r[n] for n in NAMES] for r in got])))
        assert again.numFeatures == 4 and again.numClasses == 2


def test_trees_of_odd_tables(spark):
    """No rows, one class, constant features, nulls and values that aren't finite."""
    none = frame(spark, made_up(5)).limit(0)
    assert trees.train_random(none, NAMES, trees=2).probabilities(np.zeros((1, 4))).tolist() == [[0.5, 0.5]]
    assert len(trees.train_boosted(none, NAMES, rounds=2).trees) == 0
    odd = spark.createDataFrame([(None, float("nan"), 1.0, float("inf"), k % 2, 1.0) for k in range(50)] + [(1.0, 1.0, 1.0, 1.0, None, 1.0)], "a double, b double, c double, d double, label int, w double")
    assert all(len(t.feature) == 1 for t in trees.train_random(odd, NAMES, trees=3).trees)
    assert abs(trees.train_boosted(odd, NAMES, rounds=2, least=1).probabilities(np.zeros((1, 4)))[0, 0] - 0.5) < 1e-12
    one = frame(spark, [(*r[:4], 1, 1.0) for r in made_up(40)])
    assert trees.train_boosted(one, NAMES, rounds=2, least=1).probabilities(np.zeros((1, 4)))[0, 1] > 0.99
    assert one.filter(F.col("label") == 1).count() == 40
