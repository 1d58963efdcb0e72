"""Extremely randomized trees and histogram-boosted trees, grown level by level on Spark.

Features are binned once, at quantiles. A level of all trees is grown by one aggregation: each task finds the open leaf of its rows in every
tree and adds up statistics by leaf, feature and bin; Spark adds these up and finds the best split of each leaf, so what comes to the driver is
a row for each leaf that splits. Boosted trees sum first and second derivatives of the loss and take the bin with the
largest gain. Randomized trees sum class weights; each leaf looks at a few features only, and at one cut of each, both drawn by a hash of
seed, tree, leaf and feature, so reruns agree.

A row's bins and scores are written to the shared folder; models are as large as max_depth allows, whatever the number of rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed, drop_stored

#: Bins of a feature at most, and nodes of a tree at most.
BINS, NODES = 256, 1 << 20
#: Trees that a task puts keys together for at once.
TOGETHER = 16
#: Rounds of boosting after which scores are written.
WRITTEN = 10


@dataclass
class Tree:
    """Nodes by number, the root first: feature (-1: a leaf), bin and cut (up to it rows go left), children, and value (an array)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[list[float]] = field(default_factory=lambda: [[]])

    def split(self, node: int, feature: int, bin_: int, cut: float, left: list[float], right: list[float]) -> list[int]:
        """Makes a leaf into a node with two leaves of these values; their numbers. The right one follows the left."""
        at = len(self.feature)
        self.feature[node], self.bin[node], self.cut[node], self.left[node] = feature, bin_, cut, at
        for v in (left, right):
            for part, x in zip((self.feature, self.bin, self.cut, self.left, self.value), (-1, 0, 0.0, 0, v), strict=True):
                part.append(x)
        return [at, at + 1]

    def leaves(self, x: np.ndarray, by: str = "bin") -> np.ndarray:
        """The leaf of every row. by: whether x has bins or values (cut)."""
        feature, limit, left = np.array(self.feature), np.array(getattr(self, by)), np.array(self.left)
        at = np.zeros(len(x), dtype=np.int64)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            here = at[inner]
            at[inner] = left[here] + (x[inner, feature[here]] > limit[here])
            inner = inner[feature[at[inner]] >= 0]
        return at


@dataclass
class Trees:
    """A model: kind ("random" or "boosted"), trees, features' names in order, number of classes, and of boosted ones the first scores."""

    kind: str
    trees: list[Tree]
    names: list[str]
    numClasses: int  # noqa: N815  (as Spark's models name it)
    first: list[float] = field(default_factory=list)

    @property
    def numFeatures(self) -> int:  # noqa: N802
        return len(self.names)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of rows of feature values, by class."""
        if self.kind == "random":
            return np.mean([np.array(t.value)[t.leaves(x, "cut")] for t in self.trees], axis=0)
        scores = np.tile(np.array(self.first), (len(x), 1))
        for k, t in enumerate(self.trees):
            scores[:, k % len(self.first)] += np.array(t.value)[t.leaves(x, "cut"), 0]
        return _softmax(scores)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds probability (an array) and prediction."""
        shared = rows.sparkSession.sparkContext.broadcast(self)  # as large as trees and depth allow

        @F.pandas_udf("array<double>")
        def told(x: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.probabilities(np.stack(x.to_list()))))

        out = rows.withColumn("probability", told(F.array(*map(_value, self.names))))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes a table of nodes, and what else there is beside it."""
        rows = [(k, n, t.feature[n], t.bin[n], t.cut[n], t.left[n], [float(v) for v in t.value[n]]) for k, t in enumerate(self.trees) for n in range(len(t.feature))]
        spark.createDataFrame(rows, "tree int, node int, feature int, bin int, cut double, left int, value array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        said = {"kind": self.kind, "names": self.names, "classes": self.numClasses, "first": self.first, "trees": len(self.trees)}
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/description")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Trees:
        said = json.loads(spark.read.text(f"{path}/description", wholetext=True).first()[0])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        parts = {k: Tree(*(p[c].tolist() for c in ("feature", "bin", "cut", "left")), [list(v) for v in p["value"]]) for k, p in nodes.groupby("tree")}
        return Trees(said["kind"], [parts[k] for k in range(said["trees"])], said["names"], said["classes"], said["first"])


def _value(name: str) -> Column:
    """A feature; what isn't finite or is null counts as 0."""
    v = F.col(name).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def _softmax(scores: np.ndarray) -> np.ndarray:
    """Probabilities of scores; of one column those of classes 0 and 1."""
    if scores.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(scores[:, 0], -500, 500)))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cuts(rows: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Of each feature the values, ascending, up to which its bins reach; beyond the last there is one more bin."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(_value(n), shares, 100 * bins).alias(f"f{k}") for k, n in enumerate(names)), *(F.max(_value(n)).alias(f"m{k}") for k, n in enumerate(names))).first()
    return [sorted({v for v in found[f"f{k}"] or [] if v < found[f"m{k}"]}) for k in range(len(names))]


def binned(rows: DataFrame, names: list[str], limits: list[list[float]], label: str, weight: str | None) -> DataFrame:
    """x (bins), y, w of every row with a label, in a stored table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, len(names))
            at = np.stack([np.searchsorted(limits[k], x[:, k]) for k in range(len(names))], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(names), pa.int32()), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([lists, b.column(1), b.column(2)], names=["x", "y", "w"])

    of = rows.filter(F.col(label).isNotNull()).select(F.array(*map(_value, names)).alias("v"), F.col(label).cast("int").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    return checkpointed(of.mapInArrow(run, "x array<int>, y int, w double"))


def _hash(*numbers: np.ndarray | int) -> np.ndarray:
    """Numbers of 64 bits that are mixed from others."""
    with np.errstate(over="ignore"):
        out = np.uint64(0x9E3779B97F4A7C15)
        for v in numbers:
            out = (out ^ np.asarray(v).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(29))
            out = out * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(32))
    return out


def chosen_features(seed: int, tree: int, node: np.ndarray, features: int, few: int) -> np.ndarray:
    """Which features a leaf looks at: those with the smallest hashes; rows of numbers, ascending."""
    h = _hash(seed, tree, np.asarray(node)[:, None], np.arange(features)[None, :])
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, :few], axis=1)


def chosen_cut(seed: int, tree: int, node: int, feature: int, low: int, high: int) -> int:
    """The bin up to which a leaf's rows go left, drawn from low to high - 1."""
    return low + int(_hash(seed + 1, tree, node, feature) >> np.uint64(11)) % max(1, high - low)


def _statistics(rows: DataFrame, trees: list[Tree], opened: list[list[int]], features: int, few: int | None, seed: int, wide: int, of) -> DataFrame:
    """tree, node, feature, bin, n and s0, s1 ... of the rows in open leaves. of: statistics of a batch for a tree, rows by number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, features)
            y, w = b.column(1).to_numpy(), b.column(2).to_numpy()
            scores = b.column(3).flatten().to_numpy().reshape(b.num_rows, -1) if b.num_columns > 3 else None
            for lo in range(0, len(trees), TOGETHER):
                keys, at, stats = [], [], []
                for t in range(lo, min(lo + TOGETHER, len(trees))):
                    if not opened[t]:
                        continue
                    leaf = trees[t].leaves(x)
                    is_open = np.zeros(len(trees[t].feature), dtype=bool)
                    is_open[opened[t]] = True
                    here = np.flatnonzero(is_open[leaf])
                    if not len(here):
                        continue
                    if few is None:
                        which = np.tile(np.arange(features), (len(here), 1))
                    else:
                        table = np.zeros((len(trees[t].feature), few), dtype=np.int64)
                        table[opened[t]] = chosen_features(seed, t, np.array(opened[t]), features, few)
                        which = table[leaf[here]]
                    keys.append((((t * NODES + leaf[here])[:, None] * features + which) * BINS + x[here[:, None], which]).ravel())
                    at.append(np.repeat(here, which.shape[1]))
                    stats.append(of(t, y, w, scores)[at[-1]])
                if not keys:
                    continue
                full, back = np.unique(np.concatenate(keys), return_inverse=True)
                s = np.concatenate(stats)
                columns = [pa.array(np.bincount(back, weights=s[:, k], minlength=len(full))) for k in range(wide)]
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.bincount(back, minlength=len(full)).astype(np.int64)), *columns], names=["key", "n", *(f"s{k}" for k in range(wide))])

    parts = rows.mapInArrow(run, "key long, n long, " + ", ".join(f"s{k} double" for k in range(wide)))
    sums = parts.groupBy("key").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(wide)))
    leaf = F.expr(f"key div {features * BINS}")
    return sums.select((F.expr(f"key div {features * BINS * NODES}")).alias("tree"), (leaf % NODES).alias("node"), (F.expr(f"key div {BINS}") % features).alias("feature"), (F.col("key") % BINS).alias("bin"), "n", *(f"s{k}" for k in range(wide)))


def _splits(sums: DataFrame, wide: int, gain, least: int, cut=None) -> list:
    """The best split of each leaf: tree, node, feature, bin, and n and statistics of both sides; the first feature and bin among equals.

    gain: of the left, right and whole statistics. cut: an only bin for each feature of a leaf, from its lowest and highest; by default all are tried.
    """
    by = ["tree", "node", "feature"]
    upto, whole = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)  # 256 bins at most
    names = ["n", *(f"s{k}" for k in range(wide))]
    out = sums.select(*by, "bin", *(F.sum(c).over(upto).alias(f"l_{c}") for c in names), *(F.sum(c).over(whole).alias(f"a_{c}") for c in names), F.min("bin").over(whole).alias("low"), F.max("bin").over(whole).alias("high"), F.lead("bin").over(Window.partitionBy(*by).orderBy("bin")).alias("after"))
    if cut is not None:
        drawn = cut(*(F.col(c) for c in (*by, "low", "high")))
        out = out.withColumn("_cut", drawn).filter((F.col("bin") <= F.col("_cut")) & (F.col("after") > F.col("_cut"))).withColumn("bin", F.col("_cut"))
    out = out.filter((F.col("l_n") >= least) & (F.col("a_n") - F.col("l_n") >= least))
    left, whole_s = [F.col(f"l_s{k}") for k in range(wide)], [F.col(f"a_s{k}") for k in range(wide)]
    out = out.withColumn("gain", F.round(gain(left, [a - b for a, b in zip(whole_s, left, strict=True)], whole_s), 9)).filter("gain > 0")
    best = F.max_by(F.struct("feature", "bin", *(f"l_{c}" for c in names), *(f"a_{c}" for c in names)), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("b")
    return sorted(out.groupBy("tree", "node").agg(best).select("tree", "node", "b.*").collect(), key=lambda r: (r["tree"], r["node"]))  # a row for each leaf


def _grow(trees: list[Tree], limits: list[list[float]], depth: int, statistics, gain, least: int, wide: int, value, cut=None) -> None:
    """Grows all trees from their roots, a level at a time. statistics: of open leaves. value: of a leaf's statistics."""
    opened = [[0] for _ in trees]
    for level in range(depth):
        found = _splits(statistics(trees, opened), wide, gain, least, cut)
        opened = [[] for _ in trees]
        for r in found:
            left = [r[f"l_s{k}"] for k in range(wide)]
            right = [r[f"a_s{k}"] - v for k, v in enumerate(left)]
            new = trees[r["tree"]].split(r["node"], r["feature"], r["bin"], limits[r["feature"]][r["bin"]], value(left), value(right))
            opened[r["tree"]] += [n for n, rows in zip(new, (r["l_n"], r["a_n"] - r["l_n"]), strict=True) if rows >= 2 * least]
        if not found:
            break


def train_random(rows: DataFrame, names: list[str], label: str = "label", classes: int = 2, trees: int = 100, depth: int = 12, least: int = 2, weight: str | None = None, few: int | None = None, seed: int = 42, bins: int = BINS) -> Trees:
    """Extremely randomized trees on all rows. few: features that a leaf looks at, by default the root of their number."""
    limits, few = cuts(rows, names, bins), few or max(1, math.isqrt(len(names)))
    data = binned(rows, names, limits, label, weight)
    totals = {r["y"]: r["w"] for r in data.groupBy("y").agg(F.sum("w").alias("w")).collect()}  # a row for each class

    def value(s: list[float]) -> list[float]:
        return [v / sum(s) for v in s] if sum(s) > 0 else [1 / classes] * classes

    def of(t: int, y: np.ndarray, w: np.ndarray, scores: None) -> np.ndarray:
        out = np.zeros((len(y), classes))
        out[np.arange(len(y)), y] = w
        return out

    def gain(left: list[Column], right: list[Column], whole: list[Column]) -> Column:
        def pure(s: list[Column]) -> Column:
            total = sum(s[1:], s[0])
            return F.when(total > 0, sum((v * v for v in s[1:]), s[0] * s[0]) / total).otherwise(0.0)

        return (pure(left) + pure(right) - pure(whole)) / sum(whole[1:], whole[0])

    @F.pandas_udf("long")
    def cut(tree: pd.Series, node: pd.Series, feature: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        h = _hash(seed + 1, *(s.to_numpy() for s in (tree, node, feature))) >> np.uint64(11)
        return pd.Series(low.to_numpy() + (h % np.maximum(1, (high - low).to_numpy()).astype(np.uint64)).astype(np.int64))

    out = [Tree(value=[value([totals.get(k, 0.0) for k in range(classes)])]) for _ in range(trees)]
    if totals:
        _grow(out, limits, depth, lambda made, opened: _statistics(data, made, opened, len(names), min(few, len(names)), seed, classes, of), gain, least, classes, value, cut)
    drop_stored(data)
    return Trees("random", out, names, classes)


def train_boosted(rows: DataFrame, names: list[str], label: str = "label", classes: int = 2, rounds: int = 40, depth: int = 5, rate: float = 0.1, least: int = 20, ridge: float = 0.0, weight: str | None = None, bins: int = BINS) -> Trees:
    """Boosted trees for the logistic loss: a tree a round, or one for each class if there are more than two."""
    limits = cuts(rows, names, bins)
    data = binned(rows, names, limits, label, weight)
    totals = {r["y"]: r["w"] for r in data.groupBy("y").agg(F.sum("w").alias("w")).collect()}
    all_ = sum(totals.values()) or 1.0
    share = [min(max(totals.get(k, 0.0) / all_, 1e-6), 1 - 1e-6) for k in range(classes)]
    first = [math.log(share[1] / share[0])] if classes == 2 else [math.log(s) for s in share]
    wide, model = len(first), Trees("boosted", [], names, classes, first)
    data = checkpointed(data.withColumn("f", F.array(*map(F.lit, first))), data)
    late: list[Tree] = []  # of rounds since scores were written

    def step(s: list[float]) -> list[float]:
        return [-rate * s[0] / (s[1] + ridge) if s[1] + ridge > 0 else 0.0]

    def gain(left: list[Column], right: list[Column], whole: list[Column]) -> Column:
        score = lambda s: F.when(s[1] + ridge > 0, s[0] * s[0] / (s[1] + ridge)).otherwise(0.0)
        return score(left) + score(right) - score(whole)

    def statistics(made: list[Tree], opened: list[list[int]]) -> DataFrame:
        before = list(late)

        def of(t: int, y: np.ndarray, w: np.ndarray, scores: np.ndarray) -> np.ndarray:
            p = _softmax(scores)[:, t + (classes == 2)]
            return np.stack([w * (p - (y == t + (classes == 2))), w * p * (1 - p)], axis=1)

        return _statistics(_scored(data, before, wide, len(names)), made, opened, len(names), None, 0, 2, of)

    for r in range(rounds if totals else 0):
        made = [Tree(value=[[0.0]]) for _ in range(wide)]
        _grow(made, limits, depth, statistics, gain, least, 2, step)
        model.trees += made
        late += made
        if (r + 1) % WRITTEN == 0:
            data = checkpointed(_scored(data, late, wide, len(names)), data)
            late = []
        if all(len(t.feature) == 1 for t in made):
            break
    drop_stored(data)
    return model


def _scored(data: DataFrame, late: list[Tree], wide: int, features: int) -> DataFrame:
    """Rows with what further trees add to their scores."""
    if not late:
        return data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, features)
            f = b.column(3).flatten().to_numpy().reshape(b.num_rows, wide).copy()
            for k, t in enumerate(late):
                f[:, k % wide] += np.array(t.value)[t.leaves(x), 0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * wide, pa.int32()), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists], names=["x", "y", "w", "f"])

    return data.mapInArrow(run, "x array<int>, y int, w double, f array<double>")
