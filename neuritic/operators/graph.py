"""A mean-aggregating graph network over branches, trained on Spark.

Vertices are rows of a run, a cell and an id; several runs, such as the folds of a cross-validation, are trained side by side, each with
weights of its own. A layer joins every vertex with the mean of its neighbours, which is one aggregation over edges, so a graph of any
size is spread over the cluster; small dense products are done in batches of rows. Cells of up to HELD vertices go there and back inside tasks, on arrays,
once they are dealt, as edges never leave a cell. Back-propagation goes the same way: what a layer's means
owe is the sum over edges of what the neighbours got, each over its own degree. Gradients are summed up within tasks, then across them, and Adam steps are taken on the driver,
on matrices whose size follows from the network alone.

Vertices whose label is IGNORE teach nothing and are not counted. Dropout is a hash of run, epoch, layer, vertex and unit, so reruns agree, and
spares vertices that aren't trained on; so one way through the layers gives both gradients and what is held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import checkpointed
from . import small

IGNORE = -100
#: Vertices, over all runs, up to which a cell may be held by one task, and that a task holds at a time.
HELD = 10_000
KEYS = ["run", "cell_id", "id"]


@dataclass(frozen=True)
class Shape:
    """Widths of a network: features, hidden units, classes; and the number of layers."""

    features: int
    hidden: int = 64
    layers: int = 2
    classes: int = 2

    def widths(self) -> list[int]:
        return [self.features] + [self.hidden] * self.layers

    def parts(self) -> list[tuple[int, ...]]:
        """Shapes of the weights: own, neighbours' and bias of each layer, then of the head."""
        w = self.widths()
        out = [s for a, b in zip(w, w[1:], strict=False) for s in ((a, b), (a, b), (b,))]
        return [*out, (self.hidden, self.classes), (self.classes,)]

    def unpack(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.parts()])
        return [p.reshape(s) for p, s in zip(np.split(np.asarray(flat, dtype=float), ends[:-1]), self.parts(), strict=True)]

    def random(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.uniform(-1, 1, s) / np.sqrt(s[0] if len(s) > 1 else self.hidden)).ravel() for s in self.parts()])


@dataclass
class Network:
    """A trained network with the features it takes, in order, and their means and deviations."""

    shape: Shape
    weights: np.ndarray
    names: list[str]
    mean: np.ndarray
    std: np.ndarray

    def said(self) -> dict:
        s = self.shape
        return {"shape": [s.features, s.hidden, s.layers, s.classes], "weights": self.weights.tolist(), "names": self.names, "mean": self.mean.tolist(), "std": self.std.tolist()}

    @staticmethod
    def of(said: dict) -> Network:
        return Network(Shape(*said["shape"]), np.array(said["weights"]), said["names"], np.array(said["mean"]), np.array(said["std"]))


@dataclass
class Fit:
    """A run: its best weights, the epoch they are from, and of each epoch loss and held-out macro F1, by class too."""

    weights: np.ndarray
    best_epoch: int = -1
    best_f1: float = -1.0
    losses: list[float] = field(default_factory=list)
    f1: list[float] = field(default_factory=list)
    by_class: list[list[float]] = field(default_factory=list)


def scaler(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the population; deviations below 1e-8 count as 1, what isn't finite as 0."""
    values = [F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)) for n in names]
    got = rows.agg(*(F.avg(v) for v in values), *(F.stddev_pop(v) for v in values)).first()
    mean, std = np.array([v or 0.0 for v in got[: len(names)]]), np.array([v or 0.0 for v in got[len(names) :]])
    return mean, np.where(std < 1e-8, 1.0, std)


def scaled(names: list[str], mean: np.ndarray, std: np.ndarray) -> Column:
    """The array of a vertex's scaled features."""
    return F.array(*((F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)) - float(m)) / float(s) for n, m, s in zip(names, mean, std, strict=True)))


def _added(of: Column, width: int, how) -> Column:
    """An array whose elements are aggregates of an array's elements."""
    return F.array(*(how(F.get(of, F.lit(i))) for i in range(width)))


def _over_edges(rows: DataFrame, edges: DataFrame, value: str, width: int, to: str, how) -> DataFrame:
    """For each vertex an aggregate of a column of arrays over the vertices at the other ends of its edges. to: the end that gets it."""
    origin = "b" if to == "a" else "a"
    sent = rows.select("run", "cell_id", F.col("id").alias(origin), F.col(value).alias("_v"))
    got = edges.join(sent, ["cell_id", origin]).groupBy("run", "cell_id", to).agg(_added(F.col("_v"), width, how).alias("_got"))
    return rows.join(got.withColumnRenamed(to, "id"), KEYS, "left")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column; null rows are zeros."""
    out = np.zeros((len(column), width))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    if there.any():
        out[there] = column.filter(pa.array(there)).flatten().to_numpy().reshape(-1, width)
    return out


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))


def _kept(keys: list[str], epoch: int, layer: int, units: int, rate: float) -> np.ndarray:
    """Dropout: what units of vertices are multiplied by."""
    out = np.empty((len(keys), units))
    for k, key in enumerate(keys):
        out[k] = np.random.default_rng([epoch, layer, zlib.crc32(key.encode())]).random(units) >= rate
    return out / (1 - rate)


def _layer(rows: DataFrame, edges: DataFrame, shape: Shape, weights: dict[int, np.ndarray], layer: int, rate: float, epoch: int) -> DataFrame:
    """Vertices after a layer (from 0): h, and `saved` with what came in, the mean of the neighbours and what comes out behind all before."""
    widths = shape.widths()
    taken = _over_edges(rows, edges, "h", widths[layer], "a", F.avg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {r: shape.unpack(w)[3 * layer : 3 * layer + 3] for r, w in weights.items()}
        for b in batches:
            at = {n: k for k, n in enumerate(b.schema.names)}
            h, m = _matrix(b.column(at["h"]), widths[layer]), _matrix(b.column(at["_got"]), widths[layer])
            of, out = b.column(at["run"]).to_numpy(), np.zeros((b.num_rows, widths[layer + 1]))
            for r in np.unique(of):
                own, other, bias = parts[int(r)]
                out[of == r] = np.maximum(h[of == r] @ own + m[of == r] @ other + bias, 0)
            if rate:
                learns = b.column(at["learns"]).to_numpy(zero_copy_only=False)
                keys = [f"{r}:{c}:{i}" for r, c, i in zip(*(b.column(at[n]).to_pylist() for n in KEYS), strict=True)]
                out[learns] *= _kept([k for k, t in zip(keys, learns, strict=True) if t], epoch, layer, out.shape[1], rate)
            saved = np.hstack([_matrix(b.column(at["saved"]), _saved(shape, layer)), m, out])
            yield pa.RecordBatch.from_arrays([*(b.column(at[n]) for n in (*KEYS, "y", "learns", "degree")), _lists(out), _lists(saved)], names=[*KEYS, "y", "learns", "degree", "h", "saved"])

    kind = dict(rows.dtypes)["cell_id"]
    return taken.select(*KEYS, "y", "learns", "degree", "h", "saved", "_got").mapInArrow(run, f"run int, cell_id {kind}, id long, y int, learns boolean, degree long, h array<double>, saved array<double>")


def _saved(shape: Shape, layer: int) -> int:
    """Width of what is saved before a layer."""
    w = shape.widths()
    return w[0] + sum(w[k] + w[k + 1] for k in range(layer))


def _split_saved(shape: Shape, saved: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of saved rows what went into each layer and out of the last, and the neighbours' means."""
    w, at = shape.widths(), shape.features
    ins, means = [saved[:, :at]], []
    for k in range(shape.layers):
        means.append(saved[:, at : at + w[k]])
        ins.append(saved[:, at + w[k] : at + w[k] + w[k + 1]])
        at += w[k] + w[k + 1]
    return ins, means


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _back(rows: DataFrame, edges: DataFrame, shape: Shape, weights: dict[int, np.ndarray], layer: int, rate: float, epoch: int) -> DataFrame:
    """Adds to `owed` the gradients at a layer's sums, before the unit's threshold, behind those of the layers above."""
    width, top = shape.hidden, layer == shape.layers - 1
    taken = rows.withColumn("_got", F.lit(None).cast("array<double>")) if top else _over_edges(rows, edges, "sent", width, "b", F.sum)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {r: shape.unpack(w) for r, w in weights.items()}
        for b in batches:
            at = {n: k for k, n in enumerate(b.schema.names)}
            ins, _ = _split_saved(shape, _matrix(b.column(at["saved"]), _saved(shape, shape.layers)))
            of, y, learns = b.column(at["run"]).to_numpy(), b.column(at["y"]).to_numpy(), b.column(at["learns"]).to_numpy(zero_copy_only=False)
            owed = _matrix(b.column(at["owed"]), shape.classes + width * (shape.layers - 1 - layer))
            g, sent = np.zeros((b.num_rows, width)), np.zeros((b.num_rows, width))
            if top:
                owed = np.zeros((b.num_rows, shape.classes))
            else:
                g += _matrix(b.column(at["_got"]), width)
            for r in np.unique(of):
                p, here = parts[int(r)], of == r
                if top:
                    d = _probabilities(ins[-1][here] @ p[-2] + p[-1])
                    teach = learns[here] & (y[here] != IGNORE)
                    d[np.flatnonzero(teach), y[here][teach]] -= 1
                    d[~teach] = 0
                    owed[here] = d
                    g[here] = d @ p[-2].T
                else:
                    g[here] += owed[here][:, -width:] @ p[3 * layer + 3].T
            if rate:
                keys = [f"{r}:{c}:{i}" for r, c, i in zip(*(b.column(at[n]).to_pylist() for n in KEYS), strict=True)]
                g[learns] *= _kept([k for k, t in zip(keys, learns, strict=True) if t], epoch, layer, width, rate)
            g *= ins[layer + 1] > 0
            degree = np.maximum(b.column(at["degree"]).to_numpy(), 1)[:, None]
            if layer:
                for r in np.unique(of):
                    sent[of == r] = g[of == r] @ parts[int(r)][3 * layer + 1].T
            names = [*KEYS, "y", "learns", "degree", "saved"]
            yield pa.RecordBatch.from_arrays([*(b.column(at[n]) for n in names), _lists(sent / degree), _lists(np.hstack([owed, g]))], names=[*names, "sent", "owed"])

    kind = dict(rows.dtypes)["cell_id"]
    ready = taken if "owed" in taken.columns else taken.withColumn("owed", F.lit(None).cast("array<double>"))
    return ready.select(*KEYS, "y", "learns", "degree", "saved", "owed", "_got").mapInArrow(run, f"run int, cell_id {kind}, id long, y int, learns boolean, degree long, saved array<double>, sent array<double>, owed array<double>")


def _sums(rows: DataFrame, shape: Shape, weights: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Of each run the gradient's sum, and loss, number of vertices that teach, and what is held out by label and prediction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, totals = {r: shape.unpack(w) for r, w in weights.items()}, {}
        for b in batches:
            at = {n: k for k, n in enumerate(b.schema.names)}
            ins, means = _split_saved(shape, _matrix(b.column(at["saved"]), _saved(shape, shape.layers)))
            owed = _matrix(b.column(at["owed"]), shape.classes + shape.hidden * shape.layers)
            of, y, learns = b.column(at["run"]).to_numpy(), b.column(at["y"]).to_numpy(), b.column(at["learns"]).to_numpy(zero_copy_only=False)
            for r in np.unique(of):
                here = of == r
                layers = [owed[here][:, shape.classes + shape.hidden * k :][:, : shape.hidden] for k in reversed(range(shape.layers))]
                flat = _totals(shape, parts[int(r)], [i[here] for i in ins], [m[here] for m in means], owed[here][:, : shape.classes], layers, y[here], learns[here])
                totals[int(r)] = totals.get(int(r), 0) + flat
        for r, flat in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), _lists(flat[None, :])], names=["run", "v"])

    return _collected(rows.select("run", "y", "learns", "saved", "owed").mapInArrow(run, "run int, v array<double>"), shape, weights)


def _totals(shape: Shape, p: list[np.ndarray], ins: list[np.ndarray], means: list[np.ndarray], d: np.ndarray, g: list[np.ndarray], y: np.ndarray, learns: np.ndarray) -> np.ndarray:
    """Of vertices of a run the gradient's sum, loss, number of those that teach, and what is held out by label and prediction. d, g: gradients at
    the head's and at each layer's sums."""
    sums = [s for k in range(shape.layers) for s in (ins[k].T @ g[k], means[k].T @ g[k], g[k].sum(axis=0))]
    sums += [ins[-1].T @ d, d.sum(axis=0)]
    said = _probabilities(ins[-1] @ p[-2] + p[-1])
    known = y != IGNORE
    teach, held = known & learns, known & ~learns
    more = np.zeros(2 + shape.classes**2)
    more[0] = -np.log(np.maximum(said[teach, y[teach]], 1e-300)).sum()
    more[1] = teach.sum()
    np.add.at(more, 2 + y[held] * shape.classes + said[held].argmax(axis=1), 1)
    return np.concatenate([*(s.ravel() for s in sums), more])


def _collected(found: DataFrame, shape: Shape, weights: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Totals of tasks (run, v), added up and cut into gradient and the rest."""
    n = sum(int(np.prod(s)) for s in shape.parts())
    out = {r: np.zeros(n + 2 + shape.classes**2) for r in weights}
    got = found.select("run", F.posexplode("v").alias("i", "v")).groupBy("run", "i").agg(F.sum("v").alias("v")).toPandas()  # as many numbers as the networks have weights
    for r, part in got.groupby("run"):
        out[int(r)][part["i"].to_numpy()] = part["v"].to_numpy()
    return {r: v[:n] for r, v in out.items()}, {r: v[n:] for r, v in out.items()}


@dataclass
class Dealt:
    """Vertices of small cells with their neighbours (near), dealt by cell, and of all others, with the edges of these; both are held."""

    of_tasks: DataFrame
    rest: DataFrame | None
    edges: DataFrame

    def only(self, runs: list[int]) -> Dealt:
        of = F.col("run").isin(runs)
        return Dealt(self.of_tasks.filter(of), None if self.rest is None else self.rest.filter(of), self.edges)

    def dropped(self) -> None:
        self.of_tasks.unpersist()
        if self.rest is not None:
            self.rest.unpersist()


def deal(vertices: DataFrame, edges: DataFrame) -> Dealt:
    """vertices, edges: see ready()."""
    of_tasks, rest = small.parts(vertices, most=HELD)
    if rest is not None:
        others = rest.select("cell_id").distinct()
        rest, edges, own = rest.persist(StorageLevel.MEMORY_AND_DISK), edges.join(others, "cell_id", "left_semi"), edges.join(others, "cell_id", "left_anti")
    else:
        own = edges
    near = own.groupBy("cell_id", F.col("a").alias("id")).agg(F.collect_list("b").alias("near"))  # of small cells, so short
    return Dealt(small.dealt(of_tasks.join(near, ["cell_id", "id"], "left")).persist(StorageLevel.MEMORY_AND_DISK), rest, edges)


def _summed(values: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by where they go; to: in ascending order."""
    out = np.zeros((n, values.shape[1]))
    if len(to):
        first = np.flatnonzero(np.diff(to, prepend=-1))
        out[to[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _of_cells(shape: Shape, p: list[np.ndarray], x: np.ndarray, y: np.ndarray, learns: np.ndarray, degree: np.ndarray, src: np.ndarray, dst: np.ndarray, kept: list[np.ndarray]) -> np.ndarray:
    """_totals() of whole cells of a run. src, dst: places of the ends of edges, ascending in src; kept: dropout of what learns, of each layer if any."""
    n, ins, means = len(x), [x], []
    there, back = np.maximum(np.bincount(src, minlength=n), 1)[:, None], np.argsort(dst, kind="stable")
    for k in range(shape.layers):
        own, other, bias = p[3 * k : 3 * k + 3]
        means.append(_summed(ins[k][dst], src, n) / there)
        ins.append(np.maximum(ins[k] @ own + means[k] @ other + bias, 0))
        if kept:
            ins[-1][learns] *= kept[k]
    d, teach = _probabilities(ins[-1] @ p[-2] + p[-1]), learns & (y != IGNORE)
    d[np.flatnonzero(teach), y[teach]] -= 1
    d[~teach] = 0
    g, owed = d @ p[-2].T, []
    for k in reversed(range(shape.layers)):
        if kept:
            g[learns] *= kept[k]
        g *= ins[k + 1] > 0
        owed.insert(0, g)
        if k:
            sent = g @ p[3 * k + 1].T / np.maximum(degree, 1)[:, None]
            g = g @ p[3 * k].T + _summed(sent[src[back]], dst[back], n)
    return _totals(shape, p, ins, means, d, owed, y, learns)


def _sums_of_cells(rows: DataFrame, shape: Shape, weights: dict[int, np.ndarray], rate: float, epoch: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """_sums() of small cells: one way there and back inside tasks, without an exchange. rows: see Dealt."""

    def run(t: pa.Table) -> pa.Table:
        parts, out = {r: shape.unpack(w) for r, w in weights.items()}, {}
        code, ids, of = small.codes(t), small.numbers(t, "id"), small.numbers(t, "run")
        known = np.unique(ids)
        for r in np.unique(of):
            here = np.flatnonzero(of == r)
            own = t.take(pa.array(here)).combine_chunks()
            key = code[here] * len(known) + np.searchsorted(known, ids[here])
            order = np.argsort(key)
            near = own["near"].combine_chunks()
            src = np.repeat(np.arange(len(here)), pc.fill_null(pc.list_value_length(near), 0).to_numpy())
            wanted = near.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            want = code[here][src] * len(known) + at
            pos = np.minimum(np.searchsorted(key[order], want), len(key) - 1)
            found = (known[at] == wanted) & (key[order][pos] == want)
            learns, kept = own["learns"].to_numpy(), []
            if rate:
                keys = [f"{r}:{c}:{i}" for c, i, s in zip(own["cell_id"].to_pylist(), ids[here], learns, strict=True) if s]
                kept = [_kept(keys, epoch, k, shape.hidden, rate) for k in range(shape.layers)]
            x = _matrix(own["x"].combine_chunks(), shape.features)
            out[int(r)] = _of_cells(shape, parts[int(r)], x, own["y"].to_numpy(), learns, own["degree"].to_numpy(), src[found], order[pos[found]], kept)
        return pa.table({"run": pa.array(list(out), pa.int32()), "v": _lists(np.stack(list(out.values())))})

    return _collected(rows.mapInArrow(small.whole_cells(run, HELD), "run int, v array<double>"), shape, weights)


def gradients(vertices: DataFrame, edges: DataFrame, shape: Shape, weights: dict[int, np.ndarray], rate: float = 0.0, epoch: int = 0) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Of each run the gradient of the summed loss, and loss, count and held-out confusion; see _sums().

    vertices: run, cell_id, id, x (array), y, learns, degree. edges: cell_id, a, b in both directions, each once, between vertices.
    """
    of = deal(vertices, edges)
    out = _gradients(of, shape, weights, rate, epoch)
    of.dropped()
    return out


def _gradients(of: Dealt, shape: Shape, weights: dict[int, np.ndarray], rate: float, epoch: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    out = _sums_of_cells(of.of_tasks, shape, weights, rate, epoch)
    if of.rest is None:
        return out
    more = _spread(of.rest, of.edges, shape, weights, rate, epoch)
    return tuple({r: v + b[r] for r, v in a.items()} for a, b in zip(out, more, strict=True))


def _spread(vertices: DataFrame, edges: DataFrame, shape: Shape, weights: dict[int, np.ndarray], rate: float, epoch: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """gradients() of cells of any size."""
    rows = vertices.select(*KEYS, "y", "learns", "degree", F.col("x").alias("h"), F.col("x").alias("saved"))
    held = []
    for layer in range(shape.layers):
        rows = _layer(rows, edges, shape, weights, layer, rate, epoch).persist(StorageLevel.DISK_ONLY)
        held.append(rows)
    for layer in reversed(range(shape.layers)):
        rows = _back(rows, edges, shape, weights, layer, rate, epoch).persist(StorageLevel.DISK_ONLY)
        held.append(rows)
    out = _sums(rows, shape, weights)
    for x in held:
        x.unpersist()
    return out


def f1_of(confusion: np.ndarray) -> np.ndarray:
    """F1 of each class of a confusion matrix, 0 where it has nothing."""
    both = np.diag(confusion)
    total = confusion.sum(axis=0) + confusion.sum(axis=1)
    return np.where(total > 0, 2 * both / np.maximum(total, 1), 0.0)


def ready(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with their degree. vertices: cell_id, id, x, y, learns, run."""
    degrees = edges.groupBy("cell_id", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    out = vertices.join(degrees, ["cell_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return out.select(F.col("run").cast("int").alias("run"), "cell_id", F.col("id").cast("long").alias("id"), "x", F.col("y").cast("int").alias("y"), "learns", "degree")


def train(vertices: DataFrame, edges: DataFrame, shape: Shape, runs: list[int], epochs: int = 60, patience: int = 12, lr: float = 1e-2, decay: float = 1e-4, dropout: float = 0.0, seed: int = 42) -> dict[int, Fit]:
    """Trains a network for each run on the vertices that learn in it, with Adam on the mean loss over all of them; stops each when
    macro F1 of its other vertices hasn't got better for `patience` epochs, and keeps the best weights. vertices, edges: see ready()."""
    fits = {r: Fit(shape.random(seed + r)) for r in runs}
    now = {r: f.weights.copy() for r, f in fits.items()}
    first, second = ({r: np.zeros_like(w) for r, w in now.items()} for _ in range(2))
    of = deal(vertices, edges)
    for epoch in range(epochs + 1):
        if not now:
            break
        sums, told = _gradients(of.only(sorted(now)), shape, now, dropout, epoch)
        for r in list(now):
            f, n = fits[r], max(told[r][1], 1.0)
            f.losses.append(float(told[r][0] / n))
            scores = f1_of(told[r][2:].reshape(shape.classes, shape.classes))
            f.f1.append(float(scores.mean()))
            f.by_class.append(scores.tolist())
            if f.f1[-1] > f.best_f1 + 1e-6:
                f.best_f1, f.best_epoch, f.weights = f.f1[-1], epoch, now[r].copy()
            if epoch - f.best_epoch >= patience or epoch == epochs:
                del now[r]
                continue
            g = sums[r] / n + decay * now[r]
            first[r], second[r] = 0.9 * first[r] + 0.1 * g, 0.999 * second[r] + 0.001 * g * g
            now[r] = now[r] - lr * (first[r] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second[r] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    of.dropped()
    return fits


def cross_validate(vertices: DataFrame, edges: DataFrame, names: list[str], k: int = 5, hidden: int = 64, layers: int = 2, **settings) -> dict[int, Fit]:
    """A fit for each fold of whole cells left out, all side by side, features scaled by the cells that learn. vertices: cell_id, id, y, fold and features."""
    parts = []
    for r in range(k):
        mean, std = scaler(vertices.filter(F.col("fold") != r), names)
        parts.append(vertices.select("cell_id", "id", "y", scaled(names, mean, std).alias("x"), (F.col("fold") != r).alias("learns"), F.lit(r).alias("run")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return train(ready(rows, edges), edges, Shape(len(names), hidden, layers), list(range(k)), **settings)


def fit(vertices: DataFrame, edges: DataFrame, names: list[str], epochs: int = 40, hidden: int = 64, layers: int = 2, **settings) -> Network:
    """A network of all vertices after so many epochs. vertices: cell_id, id, y and features."""
    mean, std = scaler(vertices, names)
    of = deal(ready(vertices.select("cell_id", "id", "y", scaled(names, mean, std).alias("x"), F.lit(True).alias("learns"), F.lit(0).alias("run")), edges), edges)
    shape = Shape(len(names), hidden, layers)
    now, first, second = shape.random(settings.pop("seed", 42)), 0.0, 0.0
    lr, decay, dropout = (settings.get(n, v) for n, v in (("lr", 1e-2), ("decay", 1e-4), ("dropout", 0.0)))
    for epoch in range(epochs):
        sums, told = _gradients(of, shape, {0: now}, dropout, epoch)
        g = sums[0] / max(told[0][1], 1.0) + decay * now
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        now = now - lr * (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    of.dropped()
    return Network(shape, now, names, mean, std)


def predict(network: Network, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """cell_id, id, probability (an array) of every vertex. vertices: cell_id, id and features."""
    shape = network.shape
    rows = ready(vertices.select("cell_id", "id", F.lit(IGNORE).alias("y"), scaled(network.names, network.mean, network.std).alias("x"), F.lit(False).alias("learns"), F.lit(0).alias("run")), edges)
    rows = rows.select(*KEYS, "y", "learns", "degree", F.col("x").alias("h"), F.col("x").alias("saved"))
    for layer in range(shape.layers):
        rows = checkpointed(_layer(rows, edges, shape, {0: network.weights}, layer, 0.0, 0), rows if layer else None)
    head, bias = shape.unpack(network.weights)[-2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(_probabilities(_matrix(b.column(2), shape.hidden) @ head + bias))], names=["cell_id", "id", "probability"])

    kind = dict(rows.dtypes)["cell_id"]
    return rows.select("cell_id", "id", "h").mapInArrow(run, f"cell_id {kind}, id long, probability array<double>")
