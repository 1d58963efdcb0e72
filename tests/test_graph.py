"""The graph network against a plain one, finite differences, and over partitions."""

import random

import numpy as np
import pytest


from neuritic.operators import graph


def made_up(cells=6, n=9, width=3, seed=1, hub=0):
    """Rows (cell_id, id, x, y, learns, run) of trees of branches, and edges in both directions."""
    rng = random.Random(seed)
    rows, edges = [], []
    for c in range(cells):
        size = n + (hub if c == 0 else 0)
        for i in range(size):
            x = [rng.gauss(0, 1) for _ in range(width)]
            y = rng.choice([0, 1, graph.IGNORE]) if hub == 0 else int(x[0] > 0)
            rows.append((c, i, x, y, c % 3 != 0, 0))
            if i:
                p = 0 if hub and c == 0 else rng.randrange(i)
                edges += [(c, i, p), (c, p, i)]
    return rows, edges


def plain(rows, edges, shape, flat):
    """Loss summed over what learns, confusion of the rest, and all logits."""
    p = shape.unpack(flat)
    at = {(r[0], r[1]): k for k, r in enumerate(rows)}
    h = np.array([r[2] for r in rows])
    mean = np.zeros((len(rows), len(rows)))
    for c, a, b in edges:
        mean[at[c, a], at[c, b]] = 1
    mean /= np.maximum(mean.sum(axis=1, keepdims=True), 1)
    for k in range(shape.layers):
        h = np.maximum(h @ p[3 * k] + (mean @ h) @ p[3 * k + 1] + p[3 * k + 2], 0)
    q = graph._probabilities(h @ p[-2] + p[-1])
    loss = -sum(np.log(q[k, r[3]]) for k, r in enumerate(rows) if r[4] and r[3] != graph.IGNORE)
    confusion = np.zeros((shape.classes, shape.classes))
    for k, r in enumerate(rows):
        if not r[4] and r[3] != graph.IGNORE:
            confusion[r[3], q[k].argmax()] += 1
    return loss, confusion, q


def frames(spark, rows, edges, parts=4):
    v = spark.createDataFrame(rows, "cell_id long, id long, x array<double>, y int, learns boolean, run int").repartition(parts, "id")
    e = spark.createDataFrame(edges, "cell_id long, a long, b long").repartition(parts, "a")
    return graph.ready(v, e).cache(), e.cache()


@pytest.mark.parametrize("layers", [1, 2, 3])
def test_gradients_equal_finite_differences(spark, layers):
    rows, edges = made_up()
    shape = graph.Shape(3, 4, layers)
    flat = shape.random(3) * 1.5
    sums, told = graph.gradients(*frames(spark, rows, edges), shape, {0: flat})
    loss, confusion, _ = plain(rows, edges, shape, flat)
    assert abs(told[0][0] - loss) < 1e-9 and told[0][1] == sum(r[4] and r[3] != graph.IGNORE for r in rows)
    assert np.array_equal(told[0][2:].reshape(2, 2), confusion)
    for k in range(len(flat)):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        slope = (plain(rows, edges, shape, flat + step)[0] - plain(rows, edges, shape, flat - step)[0]) / 2e-6
        assert abs(slope - sums[0][k]) < 1e-5 * max(1, abs(slope))


def test_runs_side_by_side_and_partitions(spark):
    """Runs don't touch each other, and partitions don't matter, dropout included."""
    rows, edges = made_up(seed=2)
    shape = graph.Shape(3, 5, 2)
    w = {r: shape.random(r) for r in (0, 1)}
    both = rows + [(*r[:4], not r[4], 1) for r in rows]
    for rate in (0.0, 0.3):
        one, told = graph.gradients(*frames(spark, both, edges, 1), shape, w, rate, 7)
        eight, told8 = graph.gradients(*frames(spark, both, edges, 8), shape, w, rate, 7)
        alone, _ = graph.gradients(*frames(spark, rows, edges, 3), shape, {0: w[0]}, rate, 7)
        for r in w:
            assert np.allclose(one[r], eight[r], atol=1e-10) and np.allclose(told[r], told8[r], atol=1e-10) and np.abs(one[r]).max() > 0
        assert np.allclose(alone[0], one[0], atol=1e-10)


def test_training_lowers_the_loss_and_stops(spark):
    """A cell with a third of all vertices around one hub is one of many rows for Spark; the label follows from a feature."""
    rows, edges = made_up(cells=12, n=12, seed=3, hub=60)
    v, e = frames(spark, rows, edges)
    fits = graph.train(v, e, graph.Shape(3, 8, 2), [0], epochs=25, patience=6, lr=0.05)
    f = fits[0]
    assert f.losses[-1] < 0.6 * f.losses[0] and f.best_f1 > 0.85 and f.best_f1 == max(f.f1) and len(f.f1) - 1 <= f.best_epoch + 6
    confusion = plain(rows, edges, graph.Shape(3, 8, 2), f.weights)[1]
    assert abs(graph.f1_of(confusion).mean() - f.best_f1) < 1e-12
    # the last to be better was kept
    assert all(x <= f.best_f1 + 1e-6 for x in f.f1[f.best_epoch :])


def test_folds_and_prediction(spark):
    rows, edges = made_up(cells=9, n=15, seed=4, hub=1)
    v = spark.createDataFrame([(r[0], r[1], *map(float, r[2]), r[3], r[0] % 3) for r in rows], "cell_id long, id long, p double, q double, r double, y int, fold int")
    e = spark.createDataFrame(edges, "cell_id long, a long, b long")
    fits = graph.cross_validate(v, e, ["p", "q", "r"], k=3, hidden=6, epochs=15, lr=0.05)
    assert sorted(fits) == [0, 1, 2] and all(f.losses[-1] < f.losses[0] for f in fits.values()) and np.mean([f.best_f1 for f in fits.values()]) > 0.7
    net = graph.fit(v, e, ["p", "q", "r"], epochs=15, hidden=6, lr=0.05)
    again = graph.Network.of(net.said())
    got = {(r.cell_id, r.id): r.probability for r in graph.predict(again, v, e).collect()}
    x = (np.array([r[2] for r in rows]) - net.mean) / net.std
    want = plain([(*r[:2], list(z), *r[3:]) for r, z in zip(rows, x)], edges, net.shape, net.weights)[2]
    assert all(np.allclose(got[r[0], r[1]], want[k]) for k, r in enumerate(rows))
    assert np.mean([np.argmax(got[r[0], r[1]]) == r[3] for r in rows]) > 0.8


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, float("nan"))], "a double, b double, c double")
    mean, std = graph.scaler(df, ["a", "b", "c"])
    assert mean.tolist() == [2, 5, 0] and std.tolist() == [1, 1, 1]
    assert [r.x for r in df.select(graph.scaled(["a", "b", "c"], mean, std).alias("x")).collect()] == [[-1, 0, 0], [1, 0, 0]]


def test_small_cells_go_there_and_back_inside_tasks(spark, monkeypatch):
    """Vertices of small cells aren't exchanged or held between layers; both ways give the same gradients, dropout included."""
    rows, edges = made_up(cells=5, n=8)
    rows += [(c, i, [v + 0.5 for v in x], y, c % 2 != 0, 1) for c, i, x, y, _, _ in rows]
    shape = graph.Shape(3, 4, 2)
    weights = {r: shape.random(r) * 1.5 for r in (0, 1)}
    v, e = frames(spark, rows, edges)
    with monkeypatch.context() as m:
        m.setattr(graph.small, "SMALL", 0)
        spread = graph.gradients(v, e, shape, weights, 0.3, 2)
    with monkeypatch.context() as m:
        m.setattr(graph, "HELD", 20)  # cells of 16 rows stay whole, each in a batch of its own or two
        m.setattr(graph, "_layer", None)
        inside = graph.gradients(v, e, shape, weights, 0.3, 2)
    for a, b in zip(spread, inside, strict=True):
        assert all(np.allclose(a[r], b[r], atol=1e-9) for r in weights)


def test_cells_of_both_sizes_add_up(spark, monkeypatch):
    rows, edges = made_up(cells=4, n=6, hub=30)
    shape = graph.Shape(3, 4, 2)
    v, e = frames(spark, rows, edges)
    whole = graph.gradients(v, e, shape, {0: shape.random(1)})
    monkeypatch.setattr(graph, "HELD", 10)  # the cell with the hub is spread
    both = graph.gradients(v, e, shape, {0: shape.random(1)})
    assert all(np.allclose(a[0], b[0], atol=1e-9) for a, b in zip(whole, both, strict=True))
