"""All models of the labelling chain as one artefact, with versions: saved whole or not at all, checked when loaded.

A bundle is a folder of versions. A version holds the models and, written last, a description: its format, the features of
each kind of model in order, the classes in order, and settings. Only versions with a description count.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from ..operators import ml, rules
from ..operators.graph import Network

FORMAT = 1
#: Classes in the order of models' probabilities.
CELL_CLASSES, LABELS = ("interneuron", "pyramidal"), (2, 3, 4)


@dataclass
class Bundle:
    """cell_type: the models of ml.train_cell_type, or None. owners (votes), branches: by cell type. names: features by kind of model
    (cell, subtree, branch). graph: a network that tells basal from apical branches, or None. calibrations: points of branch models' probabilities by cell type (see ml.calibrate). defaults: labels of cell types that have no model of branches. settings: whatever else labelling needs."""

    names: dict[str, list[str]]
    cell_type: list | None = None
    owners: dict = field(default_factory=dict)
    branches: dict = field(default_factory=dict)
    graph: Network | None = None
    calibrations: dict[str, list] = field(default_factory=dict)
    defaults: dict[str, int] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    def check(self, path: str = "") -> Bundle:
        """Itself, if every model has as many features as are named for it and no more classes than there are."""
        where = f"the bundle {path}".rstrip()
        found = [("cell", m, len(CELL_CLASSES)) for m in self.cell_type or []]
        found += [("subtree", m, len(LABELS)) for vote in self.owners.values() for m in vote] + [("branch", m, len(LABELS)) for m in self.branches.values()]
        for kind, model, classes in found:
            if model.numFeatures != len(self.names[kind]):
                raise ValueError(f"{where} names {len(self.names[kind])} features for a {kind} model of {model.numFeatures}")
            if model.numClasses > classes:
                raise ValueError(f"{where} has a {kind} model of {model.numClasses} classes")
        if self.graph and (self.graph.shape.features != len(self.graph.names) or self.graph.shape.classes != 2 or len(self.graph.weights) != sum(int(np.prod(s)) for s in self.graph.shape.parts())):
            raise ValueError(f"{where} has a graph network that doesn't fit its features or classes")
        return self


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a bundle, ascending."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/description/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getParent().getName()[2:]) for f in found)


def save(spark: SparkSession, bundle: Bundle, path: str) -> int:
    """Writes the bundle as the next version; its number."""
    bundle.check()
    version = max(versions(spark, path), default=0) + 1
    base = f"{path}/v={version}"
    ml.save_models(bundle.cell_type or [], f"{base}/cell_type")
    for kind, vote in bundle.owners.items():
        ml.save_models(vote, f"{base}/owners/{kind}")
    for kind, m in bundle.branches.items():
        ml.save_models([m], f"{base}/branches/{kind}")
    said = {
        "format": FORMAT, "names": bundle.names, "cell_type": len(bundle.cell_type or []), "owners": sorted(bundle.owners), "branches": sorted(bundle.branches),
        "cell_classes": CELL_CLASSES, "labels": LABELS, "defaults": bundle.defaults, "settings": bundle.settings, "graph": bundle.graph.said() if bundle.graph else None, "calibrations": bundle.calibrations,
    }
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/description")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Bundle | None:
    """A version of the bundle, by default the last; None if there is none, so that rules are used instead. One whose
    format, classes or features aren't what this library computes is an error."""
    from . import labelling

    there = versions(spark, path)
    if not there or (version is not None and version not in there):
        return None
    base = f"{path}/v={version or there[-1]}"
    said = json.loads(spark.read.text(f"{base}/description", wholetext=True).first()[0])
    if said["format"] != FORMAT:
        raise ValueError(f"the bundle {base} has format {said['format']}, not {FORMAT}")
    if tuple(said["cell_classes"]) != CELL_CLASSES or tuple(said["labels"]) != LABELS:
        raise ValueError(f"the bundle {base} has other classes or another order: {said['cell_classes']}, {said['labels']}")
    if said["names"]["cell"] != list(labelling.CELL_MEASURES) or said["names"]["branch"][-len(rules.OWNER_FEATURES) :] != list(rules.OWNER_FEATURES):
        raise ValueError(f"the bundle {base} was made for other features; train it again")
    out = Bundle(said["names"], defaults=said["defaults"], settings=said["settings"])
    out.calibrations = said["calibrations"]
    out.graph = Network.of(said["graph"]) if said["graph"] else None
    out.cell_type = ml.load_models(spark, f"{base}/cell_type")
    out.owners = {k: ml.load_models(spark, f"{base}/owners/{k}") for k in said["owners"]}
    out.branches = {k: ml.load_models(spark, f"{base}/branches/{k}")[0] for k in said["branches"]}
    return out.check(base)
